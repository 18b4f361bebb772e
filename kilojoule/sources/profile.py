"""What the numbers in device recordings mean: a table of messages and fields, views of messages by name, and developer fields."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kilojoule.sources.device_file import field_value

# Messages by number, and of each its fields as number, name, kind, units, scale and offset.
MESSAGES = {0: "file_id", 18: "session", 19: "lap", 20: "record", 21: "event", 23: "device_info", 34: "activity", 78: "hrv", 206: "field_description", 207: "developer_data_id"}
FIELDS = {
    "file_id": [(0, "type", "whole", None, 1, 0), (1, "manufacturer", "whole", None, 1, 0), (2, "product", "whole", None, 1, 0), (3, "serial_number", "whole", None, 1, 0), (4, "time_created", "time", "s", 1, 0), (8, "product_name", "text", None, 1, 0)],
    "session": [
        (253, "timestamp", "time", "s", 1, 0), (2, "start_time", "time", "s", 1, 0), (5, "sport", "whole", None, 1, 0), (7, "total_elapsed_time", "real", "s", 1000, 0), (8, "total_timer_time", "real", "s", 1000, 0), (9, "total_distance", "real", "m", 100, 0),
        (14, "avg_speed", "real", "m/s", 1000, 0), (16, "avg_heart_rate", "whole", "bpm", 1, 0), (20, "avg_power", "whole", "watts", 1, 0), (34, "normalized_power", "whole", "watts", 1, 0), (35, "training_stress_score", "real", "tss", 10, 0),
        (36, "intensity_factor", "real", "if", 1000, 0), (45, "threshold_power", "whole", "watts", 1, 0), (48, "total_work", "whole", "J", 1, 0),
    ],
    "lap": [
        (253, "timestamp", "time", "s", 1, 0), (2, "start_time", "time", "s", 1, 0), (7, "total_elapsed_time", "real", "s", 1000, 0), (8, "total_timer_time", "real", "s", 1000, 0), (9, "total_distance", "real", "m", 100, 0), (15, "avg_heart_rate", "whole", "bpm", 1, 0),
        (16, "max_heart_rate", "whole", "bpm", 1, 0), (19, "avg_power", "whole", "watts", 1, 0), (20, "max_power", "whole", "watts", 1, 0), (33, "normalized_power", "whole", "watts", 1, 0), (41, "total_work", "whole", "J", 1, 0),
    ],
    "record": [
        (253, "timestamp", "time", "s", 1, 0), (0, "position_lat", "whole", "semicircles", 1, 0), (1, "position_long", "whole", "semicircles", 1, 0), (2, "altitude", "real", "m", 5, 500), (3, "heart_rate", "whole", "bpm", 1, 0), (4, "cadence", "whole", "rpm", 1, 0),
        (5, "distance", "real", "m", 100, 0), (6, "speed", "real", "m/s", 1000, 0), (7, "power", "whole", "watts", 1, 0), (13, "temperature", "whole", "C", 1, 0), (73, "enhanced_speed", "real", "m/s", 1000, 0), (78, "enhanced_altitude", "real", "m", 5, 500),
    ],
    "event": [(253, "timestamp", "time", "s", 1, 0), (0, "event", "whole", None, 1, 0), (1, "event_type", "whole", None, 1, 0)],
    "device_info": [(253, "timestamp", "time", "s", 1, 0), (0, "device_index", "whole", None, 1, 0), (2, "manufacturer", "whole", None, 1, 0), (3, "serial_number", "whole", None, 1, 0), (21, "ant_device_number", "whole", None, 1, 0), (27, "product_name", "text", None, 1, 0)],
    "activity": [(253, "timestamp", "time", "s", 1, 0), (0, "total_timer_time", "real", "s", 1000, 0), (1, "num_sessions", "whole", None, 1, 0), (5, "local_timestamp", "time", "s", 1, 0)],
    "hrv": [(0, "time", "reals", "s", 1000, 0)],
    "field_description": [
        (0, "developer_data_index", "whole", None, 1, 0), (1, "field_definition_number", "whole", None, 1, 0), (2, "fit_base_type_id", "whole", None, 1, 0), (3, "field_name", "text", None, 1, 0), (6, "scale", "whole", None, 1, 0), (7, "offset", "whole", None, 1, 0), (8, "units", "text", None, 1, 0),
    ],
    "developer_data_id": [(1, "application_id", "bytes", None, 1, 0), (3, "developer_data_index", "whole", None, 1, 0), (4, "application_version", "whole", None, 1, 0)],
}


def dimension(spark: SparkSession) -> DataFrame:
    """(global_num, message, num, name, kind, units, scale, offset), a row a field; some dozens."""
    number = {m: n for n, m in MESSAGES.items()}
    rows = [(number[m], m, num, name, kind, units, float(scale), float(offset)) for m, fields in FIELDS.items() for num, name, kind, units, scale, offset in fields]
    return spark.createDataFrame(rows, "global_num int, message string, num smallint, name string, kind string, units string, scale double, offset double")


def _scaled(values: Column, scale: Column, offset: Column) -> Column:
    return F.transform(F.filter(values, lambda v: v.isNotNull()), lambda v: v / scale - offset)


def described(decoded: DataFrame, dimension: DataFrame) -> DataFrame:
    """A row for each field of each message, in long form: path, file_seq, seq, global_num, ts, num, message, name, units, values, text, raw.

    values are all valid elements, each divided by the scale, less the offset; what the dimension doesn't name has null names and is
    unscaled. The dimension is a few dozen rows, so it goes to the messages.
    """
    fields = decoded.where("error is null").select("path", "file_seq", "seq", "global_num", "ts", F.explode("fields").alias("f")).select("*", F.col("f.num").alias("num"))
    rows = fields.join(F.broadcast(dimension), ["global_num", "num"], "left")
    numbers = F.coalesce(F.col("f.real"), F.transform("f.whole", lambda v: v.cast("double")), F.transform("f.exact", lambda v: v.cast("double")))
    values = _scaled(numbers, F.coalesce("scale", F.lit(1.0)), F.coalesce("offset", F.lit(0.0)))
    return rows.select("path", "file_seq", "seq", "global_num", "ts", "num", "message", "name", "units", values.alias("values"), F.col("f.text").alias("text"), F.col("f.raw").alias("raw"))


def view(decoded: DataFrame, message: str) -> DataFrame:
    """(path, file_seq, seq, ts and a column for each field of the message that the table names): the projection that the table describes.

    A field's first element counts, scaled; array fields keep all valid elements. Of repeated fields the first counts; absent ones are null.
    """
    number = next(n for n, m in MESSAGES.items() if m == message)
    first = lambda num: F.get(F.filter("fields", lambda f: f["num"] == num), F.lit(0))
    out = []
    for num, name, kind, _, scale, offset in FIELDS[message]:
        f = first(num)
        one = F.coalesce(F.get(f["real"], F.lit(0)), F.get(f["whole"], F.lit(0)).cast("double"))
        column = {
            "whole": F.get(f["whole"], F.lit(0)), "time": F.timestamp_seconds(F.get(f["whole"], F.lit(0)) + 631_065_600), "real": one / scale - offset, "text": f["text"],
            "bytes": F.coalesce(F.unhex(F.array_join(F.transform(f["whole"], lambda v: F.lpad(F.hex(v), 2, "0")), "")), f["raw"]), "reals": _scaled(F.transform(f["whole"], lambda v: v.cast("double")), F.lit(float(scale)), F.lit(float(offset))),
        }[kind]
        out.append(column.alias(name))
    return decoded.where((F.col("global_num") == number) & F.col("error").isNull()).select("path", "file_seq", "seq", "ts", *out)


def developer_values(decoded: DataFrame) -> DataFrame:
    """(path, file_seq, seq, global_num, ts, name, units, values, text) of developer fields, read by their last declaration before them.

    Declarations hold within one file of a chain and for what follows them; a later one of the same application and number takes its
    place. Fields that weren't declared are left out. A window over a file's uses of one field finds the declaration.
    """
    declared = view(decoded, "field_description").select(
        "path", "file_seq", "seq", F.col("developer_data_index").cast("int").alias("index"), F.col("field_definition_number").cast("int").alias("num"),
        F.struct(F.col("field_name").alias("name"), "units", F.col("fit_base_type_id").cast("int").alias("base"), F.coalesce("scale", F.lit(1)).cast("double").alias("scale"), F.coalesce("offset", F.lit(0)).cast("double").alias("offset")).alias("d"),
    )
    used = decoded.where("error is null").select("path", "file_seq", "seq", "global_num", "ts", F.explode("developer").alias("v")).select("path", "file_seq", "seq", F.col("v.index").cast("int").alias("index"), F.col("v.num").cast("int").alias("num"), "global_num", "ts", "v")
    both = declared.unionByName(used, allowMissingColumns=True)
    w = Window.partitionBy("path", "file_seq", "index", "num").orderBy("seq", F.col("v").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    read = both.withColumn("by", F.last("d", True).over(w)).where("v is not null and by is not null").select("path", "file_seq", "seq", "global_num", "ts", "by.*", "v.raw", "v.big")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, texts = [], []
            for raw, big, base in zip(*(b.column(c).to_pylist() for c in ("raw", "big", "base"))):
                f = field_value(0, 13 if base is None else base, raw, ">" if big else "<")
                numbers = f["real"] or f["whole"] or f["exact"]
                values.append(None if numbers is None else [float(x) for x in numbers if x is not None])
                texts.append(f["text"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, pa.list_(pa.float64())), pa.array(texts, pa.string())], names=[*b.schema.names, "numbers", "text"])

    kinds = ", ".join(f"{c} {t}" for c, t in read.dtypes)
    rows = read.mapInArrow(kernel, f"{kinds}, numbers array<double>, text string")
    scale = F.when(F.col("scale") != 0, F.col("scale")).otherwise(1.0)
    return rows.select("path", "file_seq", "seq", "global_num", "ts", "name", "units", _scaled(F.col("numbers"), scale, F.col("offset")).alias("values"), "text")
