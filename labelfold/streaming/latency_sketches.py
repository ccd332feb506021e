"""Live latency percentiles from mergeable sketches (STRM-3).

Each micro-batch writes one row per 15-minute pane: counts, the sum, and a KLL sketch of the latencies.
A window is the merge of its panes, over batches and restarts alike, so no state is kept between batches,
late rows only add to their panes, and a batch that is run again replaces its own rows.

The sketch gives a value whose rank among the window's latencies is off by at most ``rank_error`` of
their number (99 % of the time); with no more latencies than ``K`` it holds them all and is exact.
Null and NaN latencies are counted in ``n`` but are in no sketch; a window without any other has NULL percentiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .feedback_stream import _exists, _paths

PANE_MINUTES = 15
K = 4096
PERCENTILES = (0.5, 0.95, 0.99)


def rank_error(k: int = K) -> float:
    """The sketch's published single-sided normalised rank error at 99 % confidence."""
    return 2.296 / k ** 0.9021


def panes(events: DataFrame, ts: str = "ts", latency: str = "value", error: F.Column | None = None, k: int = K) -> DataFrame:
    """(pane, n, n_errors, n_values, total, sketch) of one batch of rows; combined map-side."""
    x = F.col(latency).cast("double")
    x = F.when(~F.isnan(x), x)
    failed = F.coalesce(error, F.lit(False)) if error is not None else F.lit(False)
    rows = events.select(F.window(F.col(ts).cast("timestamp"), f"{PANE_MINUTES} minutes")["start"].alias("pane"), x.alias("x"), failed.alias("failed"))
    return rows.groupBy("pane").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("n_errors"), F.count("x").alias("n_values"),
        F.sum("x").alias("total"), F.kll_sketch_agg_double("x", F.lit(k)).alias("sketch"))


def run_panes(events: DataFrame, name: str, job: str | None = None, k: int = K, **columns) -> DataFrame:
    """Write every micro-batch's panes; returns the table of all of them (several rows per pane).  ``job`` is the fixed folder of a resumable job."""
    spark = events.sparkSession
    data, ck = _paths(spark, name, job)
    schema = panes(events, k=k, **columns).schema.add("_epoch", "long")

    def write(batch: DataFrame, epoch: int) -> None:
        (panes(batch, k=k, **columns).withColumn("_epoch", F.lit(epoch).cast("long")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("_epoch").parquet(data))

    (events.writeStream.foreachBatch(write).option("checkpointLocation", ck)
     .trigger(availableNow=True).start().awaitTermination())
    if not _exists(spark, data):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(data)


def merged(partials: DataFrame, minutes: int = 60, percentiles: Sequence[float] = PERCENTILES, k: int = K) -> DataFrame:
    """Windows of ``minutes`` sliding by a pane: (window_start, n, n_errors, avg_latency_ms, p50, p95, p99)."""
    if minutes % PANE_MINUTES:
        raise ValueError(f"a window is a multiple of {PANE_MINUTES} minutes")
    # panes first: a window then merges one sketch per pane, however many batches there were
    each = _merge(partials, "pane", k)
    back = F.explode(F.sequence(F.lit(0), F.lit(minutes // PANE_MINUTES - 1)))
    start = F.timestamp_add("MINUTE", -F.col("_back") * PANE_MINUTES, F.col("pane"))
    w = _merge(each.select("*", back.alias("_back")).withColumn("window_start", start), "window_start", k)
    found = [F.when(F.col("n_values") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(p))).alias(f"p{p * 100:g}") for p in percentiles]
    return w.select("window_start", "n", "n_errors", (F.col("total") / F.nullif("n_values", F.lit(0))).alias("avg_latency_ms"), *found)


def _merge(partials: DataFrame, by: str, k: int) -> DataFrame:
    return partials.groupBy(by).agg(
        *[F.sum(c).alias(c) for c in ("n", "n_errors", "n_values", "total")], F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
