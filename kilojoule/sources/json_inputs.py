"""Strict JSON inputs: settings, workouts, fitness requests and fuelling days as text, to typed columns and an error for what doesn't fit.

A row whose text is wrong keeps its place and says why; it never fails the job. Keys that a schema doesn't know are errors, at any
depth, as are values of another type and missing keys that have no default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType


def _struct(required: dict[str, DataType] | None = None, **optional: DataType) -> StructType:
    return StructType([*[StructField(k, t, False) for k, t in (required or {}).items()], *[StructField(k, t) for k, t in optional.items()]])


_NUMBER, _WHOLE, _TEXT = DoubleType(), IntegerType(), StringType()
_SESSION = _struct({"start_min": _WHOLE, "duration_min": _WHOLE, "intensity_factor": _NUMBER}, work_kj=_NUMBER)
SETTINGS = _struct(ftp=_NUMBER, weight_kg=_NUMBER, lthr=_WHOLE, max_hr=_WHOLE, resting_hr=_WHOLE, cp=_NUMBER, w_prime=_NUMBER, trimp=_TEXT, power_zones=ArrayType(_NUMBER), hr_zones=ArrayType(_NUMBER))
WORKOUT = _struct({"name": _TEXT, "steps": ArrayType(_struct({"duration_s": _WHOLE, "target": StructType([StructField("type", _TEXT, False), StructField("pct", _NUMBER), StructField("from", _NUMBER), StructField("to", _NUMBER)])}, kind=_TEXT))})
FUEL_DAY = _struct({"body_mass_kg": _NUMBER, "sessions": ArrayType(_SESSION)}, ftp_w=_NUMBER, wake_min=_WHOLE, ahead=ArrayType(_struct(sessions=ArrayType(_SESSION), priority=_TEXT)))
FITNESS = _struct({"activities": ArrayType(_struct({"day": LongType()}, tss=_NUMBER, curve=ArrayType(ArrayType(_NUMBER)))), "end_day": LongType()}, w_prime_fallback=_NUMBER)
#: Values that a key of text may have.
CHOICES = {"trimp": ("male", "female"), "kind": ("warmup", "active", "recovery", "cooldown"), "type": ("steady", "ramp"), "priority": ("A", "B", "C")}
_NONE = "cast(array() as array<string>)"


def _problems(text: Column, kind: DataType, at: str, name: str = "") -> Column:
    """What is wrong with a JSON value, a text each; empty if nothing is. Null text is fine."""
    none, label = F.expr(_NONE), at or "the text"
    told = lambda what, when: F.when(when, F.array(F.lit(f"{label}: {what}"))).otherwise(none)
    if isinstance(kind, StructType):
        keys = F.from_json(text, MapType(StringType(), StringType()))
        known = [f.name for f in kind.fields]
        odd = F.transform(F.array_sort(F.filter(F.map_keys(keys), lambda k: ~k.isin(known))), lambda k: F.concat(F.lit(f"{label}: unknown key "), k))
        own = [F.when(F.lit(not f.nullable) & F.try_element_at(keys, F.lit(f.name)).isNull(), F.array(F.lit(f"{label}: {f.name} is missing"))).otherwise(_problems(F.try_element_at(keys, F.lit(f.name)), f.dataType, f"{at}.{f.name}" if at else f.name, f.name)) for f in kind.fields]
        return F.when(text.isNull(), none).when(keys.isNull() | ~F.ltrim(text).startswith("{"), F.array(F.lit(f"{label}: no JSON object"))).otherwise(F.concat(odd, *own))
    if isinstance(kind, ArrayType):
        items = F.from_json(text, ArrayType(StringType()))
        own = F.flatten(F.transform(items, lambda x: F.when(x.isNull(), F.array(F.lit(f"{label}: null in a list"))).otherwise(_problems(x, kind.elementType, f"{at}[]", name))))
        return F.when(text.isNull(), none).when(items.isNull() | ~F.ltrim(text).startswith("["), F.array(F.lit(f"{label}: no list"))).otherwise(own)
    if isinstance(kind, StringType):
        return told(f"one of {', '.join(CHOICES[name])} is needed", text.isNotNull() & ~text.isin(*CHOICES[name])) if name in CHOICES else none
    if isinstance(kind, BooleanType):
        return told("no boolean", text.isNotNull() & ~text.isin("true", "false"))
    pattern = r"^-?(0|[1-9][0-9]*)$" if isinstance(kind, (IntegerType, LongType)) else r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
    return told("no whole number" if isinstance(kind, (IntegerType, LongType)) else "no number", text.isNotNull() & (~text.rlike(pattern) | text.try_cast(kind).isNull()))


def strict(rows: DataFrame, column: str, schema: StructType, empty_is_default: bool = False) -> DataFrame:
    """rows with `parsed`, the column's JSON by the schema, null where it doesn't fit, and `error`, what doesn't, joined by "; ".

    Fields of the schema that aren't nullable must be there and not null; numbers may not be written as text. Null text is an error, blank text too unless it stands for
    an object of defaults.
    """
    text = F.when(F.trim(column) == "", "{}").otherwise(F.col(column)) if empty_is_default else F.col(column)
    out = rows.withColumn("_text", text).withColumn("_wrong", F.when(F.col("_text").isNull(), F.array(F.lit("no text"))).otherwise(_problems(F.col("_text"), schema, "")))
    # numbers written as text have passed so far; the parser takes them for corrupt
    whole = StructType([*_nullable(schema).fields, StructField("_corrupt", StringType())])
    out = out.withColumn("_parsed", F.from_json(F.when(F.size("_wrong") == 0, F.col("_text")), whole, {"columnNameOfCorruptRecord": "_corrupt"}))
    error = F.when(F.size("_wrong") > 0, F.array_join("_wrong", "; ")).when(F.col("_parsed._corrupt").isNotNull(), "the text: a value is of another type")
    out = out.withColumn("error", error)
    parsed = F.struct(*[F.col(f"_parsed.{f.name}").alias(f.name) for f in schema.fields])
    return out.withColumn("parsed", F.when(F.col("error").isNull(), parsed)).select(*rows.columns, "parsed", "error")


def _nullable(kind: DataType) -> DataType:
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, _nullable(f.dataType)) for f in kind.fields])
    return ArrayType(_nullable(kind.elementType)) if isinstance(kind, ArrayType) else kind


def settings(rows: DataFrame, column: str) -> DataFrame:
    """rows with the columns of SETTINGS from JSON text, as checked_settings() takes them, and `error`; blank text is all defaults."""
    out = strict(rows, column, SETTINGS, True)
    kind = F.when(F.col("parsed.trimp") == "female", "women").when(F.col("parsed.trimp") == "male", "men")
    return out.select(*rows.columns, *[(kind if f.name == "trimp" else F.col(f"parsed.{f.name}")).alias(f.name) for f in SETTINGS.fields], "error")


def workout_steps(rows: DataFrame, column: str, id_col: str = "activity_id") -> tuple[DataFrame, DataFrame]:
    """(workouts (id, name, error), steps (id, seq, kind, duration_s, from_pct, to_pct)) from JSON text, as to_zwo() and workout_profile() take them.

    A steady target needs pct alone, a ramp from and to; a steady step's to_pct is null. Wrong workouts have no steps.
    """
    out = strict(rows.select(F.col(id_col).alias("activity_id"), column), column, WORKOUT)
    steps = F.col("parsed.steps")
    t = lambda s: s["target"]
    steady = lambda s: (t(s)["type"] == "steady") & t(s)["pct"].isNotNull() & t(s)["from"].isNull() & t(s)["to"].isNull()
    ramp = lambda s: (t(s)["type"] == "ramp") & t(s)["pct"].isNull() & t(s)["from"].isNotNull() & t(s)["to"].isNotNull()
    odd = F.exists(steps, lambda s: ~(steady(s) | ramp(s)) | (s["duration_s"] < 0))
    out = out.withColumn("error", F.coalesce("error", F.when(odd, "steps[]: a steady target has pct, a ramp from and to, and no step a negative duration")))
    rows = out.where("error is null").select("activity_id", F.posexplode(steps).alias("seq", "s"))
    return out.select("activity_id", F.col("parsed.name").alias("name"), "error"), rows.select("activity_id", "seq", F.coalesce("s.kind", F.lit("active")).alias("kind"), "s.duration_s", F.coalesce("s.target.pct", "s.target.from").alias("from_pct"), F.col("s.target.to").alias("to_pct"))


def fuel_days(rows: DataFrame, column: str, id_col: str = "plan_id") -> tuple[DataFrame, DataFrame]:
    """(days, sessions) from JSON text, as day_plan() takes them; days have `error` besides. Sessions stand in order of their start."""
    out = strict(rows.select(F.col(id_col).alias("plan_id"), column), column, FUEL_DAY)
    first = F.array_min(F.transform(F.get("parsed.ahead", F.lit(0))["sessions"], lambda s: s["start_min"]))
    days = out.select("plan_id", F.col("parsed.body_mass_kg").alias("mass"), F.col("parsed.ftp_w").alias("ftp"), F.col("parsed.wake_min").alias("wake_min"), first.alias("tomorrow_start"), "error")
    each = out.where("error is null").select("plan_id", F.posexplode("parsed.sessions").alias("given", "s"))
    by_start = F.row_number().over(Window.partitionBy("plan_id").orderBy("s.start_min", "given")) - 1
    return days, each.select("plan_id", by_start.alias("seq"), "s.start_min", "s.duration_min", F.col("s.intensity_factor").alias("intensity"), F.col("s.work_kj").alias("planned_kj"))

