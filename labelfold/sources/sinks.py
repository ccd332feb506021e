"""Append-only sinks of the feedback loop (SNK-3, SNK-4, SNK-5).

All sinks append parquet files; nothing is updated in place.  Current state
(e.g. the status of a training run) is the latest row per key, read with an
aggregation (``max_by``) rather than a sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

USER_BUCKETS = 64

# The training-run status sequence of the design record.
RUN_STATUSES = ("pending", "running", "completed", "failed")


def user_bucket(user: str = "user_id", buckets: int = USER_BUCKETS) -> F.Column:
    return F.pmod(F.xxhash64(F.col(user)), F.lit(buckets)).cast("int")


def append_training_rows(rows: DataFrame, path: str, buckets: int = USER_BUCKETS) -> None:
    """Insert-only (user_id, embedding|text, label, source) rows, partitioned by a
    user bucket so one user's reads prune to one folder (SNK-3)."""
    (rows.withColumn("user_bucket", user_bucket("user_id", buckets))
     .write.mode("append").partitionBy("user_bucket").parquet(path))


def read_training_rows(spark: SparkSession, path: str, user_id=None,
                       buckets: int = USER_BUCKETS) -> DataFrame:
    """Training rows, optionally of one user (partition-pruned by the user bucket)."""
    df = spark.read.parquet(path)
    if user_id is not None:
        # hash the literal with the column's own type, as the writer did
        uid = F.lit(user_id).cast(df.schema["user_id"].dataType)
        bucket = F.pmod(F.xxhash64(uid), F.lit(buckets))
        df = df.filter((F.col("user_bucket") == bucket) & (F.col("user_id") == user_id))
    return df


def append_history(events: DataFrame, path: str) -> None:
    """Append training-history events (run_id, user_id, status, at, …) (SNK-4)."""
    bad = ~F.col("status").isin(*RUN_STATUSES)
    # the filter keeps every valid row and fails the write on an unknown status
    checked = events.filter(F.when(bad, F.raise_error(F.lit("unknown run status"))).isNull())
    checked.write.mode("append").parquet(path)


def history_state(spark: SparkSession, path: str) -> DataFrame:
    """Current state per run = its latest event (status order breaks time ties)."""
    h = spark.read.parquet(path)
    order = F.array_position(F.array(*[F.lit(s) for s in RUN_STATUSES]), F.col("status"))
    return (h.groupBy("run_id")
            .agg(F.max_by(F.struct(*[c for c in h.columns if c != "run_id"]),
                          F.struct(F.col("at"), order)).alias("s"))
            .select("run_id", "s.*"))


def append_predictions(scored: DataFrame, path: str, ts: str = "scored_at") -> None:
    """Prediction log: predicted label and confidence per item, by day (SNK-5)."""
    (scored.withColumn("day", F.to_date(F.col(ts)))
     .write.mode("append").partitionBy("day").parquet(path))
