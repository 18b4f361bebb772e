"""Irregular activity records to a gap-aware series of one row a second, by window functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHANNELS = ("power", "heart_rate", "cadence", "speed", "altitude", "distance")
#: Channels that end as whole numbers, and their largest value.
WHOLE = {"power": 65535, "heart_rate": 255, "cadence": 255}


@dataclass(frozen=True)
class ResampleConfig:
    pause_gap: int = 30
    max_dropout: int = 8
    max_power: int | None = 2500
    use_timer_events: bool = False


def timer_pauses(timer: DataFrame) -> DataFrame:
    """(activity_id, stop, start) from events (activity_id, seq, ts, kind) in file order; repeats count once, an open end is null."""
    w = Window.partitionBy("activity_id").orderBy("seq")
    turns = timer.withColumn("before", F.lag("kind", 1, "start").over(w)).where("kind <> before")
    return turns.withColumn("start", F.lead("ts").over(w)).where("kind = 'stop'").select("activity_id", F.col("ts").alias("stop"), "start")


def _whole(c: Column, most: int) -> Column:
    """Rounded half up, clamped; NaN is 0, null stays null."""
    return F.when(c.isNull(), None).when(F.isnan(c), 0).otherwise(F.least(F.greatest(F.floor(c + 0.5), F.lit(0)), F.lit(most))).cast("int")


def _clean(records: DataFrame, timer: DataFrame | None, cfg: ResampleConfig) -> tuple[DataFrame, DataFrame | None]:
    """Records with spikes nulled and flags of what is dropped: `paused`, `late`."""
    spike = F.col("power") > F.lit(cfg.max_power) if cfg.max_power is not None else F.lit(False)
    rows = records.withColumn("spike", F.coalesce(spike, F.lit(False))).withColumn("power", F.when(~F.col("spike"), F.col("power")))
    pauses = timer_pauses(timer) if timer is not None and cfg.use_timer_events else None
    if pauses is not None:
        within = rows.alias("r").join(pauses.alias("p"), F.expr("r.activity_id = p.activity_id and r.ts >= p.stop and r.ts < coalesce(p.start, 9223372036854775807)"), "left_semi")
        rows = rows.join(within.select("activity_id", "seq", F.lit(True).alias("paused")), ["activity_id", "seq"], "left").withColumn("paused", F.coalesce("paused", F.lit(False)))
    else:
        rows = rows.withColumn("paused", F.lit(False))
    before = Window.partitionBy("activity_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max(F.when(~F.col("paused"), F.col("ts"))).over(before)
    return rows.withColumn("late", ~F.col("paused") & F.coalesce(F.col("ts") < seen, F.lit(False))), pauses


def _series(rows: DataFrame, pauses: DataFrame | None, cfg: ResampleConfig) -> DataFrame:
    """A row a second: merged records, filled gaps, segment numbers; channels not yet interpolated."""
    merged = rows.where("not paused and not late").groupBy("activity_id", "ts").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in CHANNELS])
    w = Window.partitionBy("activity_id").orderBy("ts")
    merged = merged.withColumn("prev", F.lag("ts").over(w))
    stopped = F.lit(False)
    if pauses is not None:
        hit = merged.alias("m").join(pauses.alias("p"), F.expr("m.activity_id = p.activity_id and p.stop > m.prev and p.stop <= m.ts"), "left_semi").select("activity_id", "ts", F.lit(True).alias("stopped"))
        merged, stopped = merged.join(hit, ["activity_id", "ts"], "left"), F.coalesce("stopped", F.lit(False))
    cut = F.col("prev").isNull() | (F.col("ts") - F.col("prev") - 1 > cfg.pause_gap) | stopped
    merged = merged.withColumn("break", cut).withColumn("segment", F.sum(F.col("break").cast("int")).over(w) - 1)
    seconds = F.when(F.col("break"), F.array("ts")).otherwise(F.sequence(F.col("prev") + 1, F.col("ts")))
    filled = merged.withColumn("t", F.explode(seconds)).withColumn("recorded", F.col("t") == F.col("ts"))
    return filled.select("activity_id", "segment", "t", "recorded", *[F.when(F.col("recorded"), F.col(c)).cast("double").alias(c) for c in CHANNELS])


def _interpolated(series: DataFrame, cfg: ResampleConfig) -> DataFrame:
    """Every channel's gaps bridged within its segment, and raw_<channel> as it was."""
    w = Window.partitionBy("activity_id", "segment").orderBy("t")
    # what lies ahead is what lies behind in falling order: a frame that only grows, where one up to the end is worked out anew in each row
    falling = Window.partitionBy("activity_id", "segment").orderBy(F.desc("t"))
    back, ahead = (x.rowsBetween(Window.unboundedPreceding, 0) for x in (w, falling))
    lost = [F.sum((F.col("recorded") & F.col(c).isNull()).cast("int")).over(back).alias(f"lost_{c}") for c in CHANNELS]
    rows = series.select("*", *lost)
    out = [F.col("activity_id"), F.col("segment"), F.col("t"), F.col("recorded")]
    for c in CHANNELS:
        point = F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col("t"), F.col(f"lost_{c}").alias("lost")))
        a, b = F.last(point, True).over(back), F.last(point, True).over(ahead)
        run = F.coalesce(b["lost"], F.max(f"lost_{c}").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))) - F.coalesce(a["lost"], F.lit(0))
        between = a["v"] + (b["v"] - a["v"]) * (F.col("t") - a["t"]) / F.greatest(b["t"] - a["t"], F.lit(1))
        value = F.when(F.col(c).isNotNull(), F.col(c)).when(run > cfg.max_dropout, None).otherwise(F.coalesce(between, a["v"], b["v"]))
        out += [value.alias(c), F.col(c).alias(f"raw_{c}")]
    return rows.select(*out)


def resample(records: DataFrame, timer: DataFrame | None = None, cfg: ResampleConfig = ResampleConfig()) -> tuple[DataFrame, DataFrame]:
    """(samples, report) of records (activity_id, seq, ts and CHANNELS).

    samples: activity_id, idx, elapsed, CHANNELS, power_dropout, state (recorded or filled), segment, segment_start. Missing power is
    0 and flagged, other channels stay null. report: a row of counters for each activity. All windows share one partitioning by
    activity, so the only shuffle is on activity_id.
    """
    rows, pauses = _clean(records, timer, cfg)
    bridged = _interpolated(_series(rows, pauses, cfg), cfg)
    values = [_whole(F.col(c), WHOLE[c]).alias(c) if c in WHOLE else F.col(c) for c in CHANNELS]
    w = Window.partitionBy("activity_id").orderBy("t")
    full = bridged.select("activity_id", "segment", "t", "recorded", *values, *[f"raw_{c}" for c in ("power", "heart_rate")])
    full = full.withColumn("idx", F.row_number().over(w) - 1).withColumn("prev", F.lag("t").over(w))
    full = full.withColumn("elapsed", F.col("t") - F.min("t").over(Window.partitionBy("activity_id")))
    samples = full.select(
        "activity_id", "idx", "elapsed", F.coalesce("power", F.lit(0)).alias("power"), F.col("power").isNull().alias("power_dropout"), "heart_rate", "cadence", "speed", "altitude", "distance",
        F.when(F.col("recorded"), "recorded").otherwise("filled").alias("state"), "segment", F.coalesce(F.col("t") - F.col("prev") > 1, F.lit(True)).alias("segment_start"),
    )
    counts = rows.groupBy("activity_id").agg(
        F.count("*").alias("records"), F.count_if("late").alias("out_of_order"), F.count_if("paused").alias("timer_paused_records"), F.count_if("spike").alias("power_spikes"),
        F.count_if(~F.col("paused") & ~F.col("late")).alias("kept"),
    )
    gap = F.col("t") - F.col("prev") - 1
    repaired = lambda c: F.count_if(F.col("recorded") & F.col(f"raw_{c}").isNull() & F.col(c).isNotNull())
    made = full.withColumn("run_start", (~F.col("recorded")) & (F.lag("recorded").over(w))).groupBy("activity_id").agg(
        F.count_if("recorded").alias("distinct_ts"), F.count_if("run_start").alias("gaps_filled"), F.count_if(~F.col("recorded")).alias("gap_seconds_filled"),
        F.count_if(gap > 0).alias("pauses"), F.coalesce(F.sum(F.when(gap > 0, gap)), F.lit(0)).alias("paused_seconds"), repaired("power").alias("power_dropouts_repaired"),
        F.when(F.count("power") > 0, F.count_if(F.col("power").isNull())).otherwise(0).alias("power_dropout_seconds"), repaired("heart_rate").alias("hr_dropouts_repaired"),
    )
    report = counts.join(made, "activity_id", "left").select(
        "activity_id", "records", (F.col("kept") - F.coalesce("distinct_ts", F.lit(0))).alias("duplicates"), "out_of_order", "timer_paused_records", "power_spikes",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps_filled", "gap_seconds_filled", "pauses", "paused_seconds", "power_dropouts_repaired", "power_dropout_seconds", "hr_dropouts_repaired")],
    )
    return samples, report
