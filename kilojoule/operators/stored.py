"""Summaries kept in a table by athlete, worked out anew only for athletes whose settings or activities have changed."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilojoule.operators.analysis import NUMBERS, analyze, checked_settings, settings_on


def version() -> Column:
    """What an activity's settings are known by: the same values have the same version."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return F.xxhash64(*map(text, (*NUMBERS, "trimp")), *[F.coalesce(F.to_json(c), F.lit("-")) for c in ("power_zones", "hr_zones")])


def _stored(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:  # nothing has been stored yet
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def stale(path: str, current: DataFrame) -> DataFrame:
    """(athlete_id) of the athletes whose stored activities aren't those of `current` (activity_id, athlete_id, version)."""
    old = _stored(current.sparkSession, path)
    if old is None:
        return current.select("athlete_id").distinct()
    kept = old.select("activity_id", F.col("athlete_id").alias("_athlete"), F.col("version").alias("_version"))
    both = current.select("activity_id", "athlete_id", "version").join(kept.hint("merge"), "activity_id", "full")
    differs = ~(F.col("version").eqNullSafe(F.col("_version")) & F.col("athlete_id").eqNullSafe(F.col("_athlete")))
    return both.where(differs).select(F.explode(F.array_distinct(F.array("athlete_id", "_athlete"))).alias("athlete_id")).where("athlete_id is not null").distinct()


def refresh(samples: DataFrame, activities: DataFrame, settings: DataFrame, path: str) -> DataFrame:
    """Brings the summaries at `path`, partitioned by athlete_id, up to date with the athletes' settings; returns (athlete_id) of those redone.

    activities are (activity_id, athlete_id, day), settings as settings_on() takes them. Only the partitions of athletes concerned are
    written anew, others keep their files; what is written carries the version of its settings. Activities without an athlete aren't
    stored. An athlete who has no activities left keeps the last summaries. The list of athletes is checkpointed, since the table that it
    is read from is then written to: spark.checkpoint.dir must name a folder that all executors share.
    """
    known = settings_on(activities.where("athlete_id is not null"), checked_settings(settings)).withColumn("version", version())
    spark = samples.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    redone = stale(path, known).checkpoint()
    mine = known.join(redone.hint("merge"), "athlete_id", "left_semi")
    rows = samples.join(mine.select("activity_id").hint("merge"), "activity_id", "left_semi")
    out = analyze(rows, mine).join(mine.select("activity_id", "athlete_id", "version").hint("merge"), "activity_id")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("athlete_id").parquet(path)
    return redone
