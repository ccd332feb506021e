import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelfold.streaming import latency_sketches as LS

T0 = dt.datetime(2024, 1, 1)


def _write(spark, path, rows):
    spark.createDataFrame(rows, "ts timestamp, value double").coalesce(1).write.mode("append").parquet(path)


def _stream(spark, path):
    return spark.readStream.schema("ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(path)


def test_windows_merge_over_batches_restarts_and_late_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    src, job = str(tmp_path / "src"), str(tmp_path / "job")
    rows = [(T0 + dt.timedelta(minutes=float(m)), float(v)) for m, v in zip(rng.uniform(0, 300, 900), rng.lognormal(3, 1, 900))]
    _write(spark, src, rows[:400])
    LS.run_panes(_stream(spark, src), "t", job)
    _write(spark, src, rows[400:])                     # as late as can be: over all windows again
    got = LS.merged(LS.run_panes(_stream(spark, src), "t", job)).collect()
    again = LS.merged(LS.run_panes(_stream(spark, src), "t", job)).collect()   # nothing new: the same
    assert sorted(got) == sorted(again) and len(got) == 23
    for r in got:
        end = r["window_start"] + dt.timedelta(hours=1)
        x = np.sort([v for t, v in rows if r["window_start"] <= t < end])
        assert r["n"] == len(x)
        for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
            assert r[name] == x[max(1, int(np.ceil(p * len(x)))) - 1]


def test_error_of_large_windows_is_within_the_stated_rank_error(spark):
    """200 000 latencies in one window, in 40 batches, with a sketch of 512."""
    k, n = 512, 200_000
    rows = spark.range(n).select(F.lit(T0).alias("ts"), (F.pmod(F.xxhash64("id"), F.lit(n)) / 100.0).cast("double").alias("value"), (F.col("id") % 40).alias("b"))
    parts = None
    for b in range(0, 40, 10):
        part = LS.panes(rows.filter(F.col("b").between(b, b + 9)), k=k)
        parts = part if parts is None else parts.unionByName(part)
    r = LS.merged(parts, minutes=15, k=k).first()
    x = np.sort(np.array([v["value"] for v in rows.select("value").collect()]))
    for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        low, high = np.searchsorted(x, r[name], "left") / n, np.searchsorted(x, r[name], "right") / n
        assert low - 2 * LS.rank_error(k) <= p <= high + 2 * LS.rank_error(k)
    assert LS.rank_error(LS.K) < 0.002


def test_odd_values(spark):
    rows = [(T0, None), (T0, float("nan")), (T0, 5.0), (T0 + dt.timedelta(hours=5), None)]
    df = spark.createDataFrame(rows, "ts timestamp, value double")
    got = {r["window_start"]: r for r in LS.merged(LS.panes(df), minutes=15).collect()}
    assert got[T0]["n"] == 3 and got[T0]["p95"] == 5.0 and got[T0]["avg_latency_ms"] == 5.0
    empty = got[T0 + dt.timedelta(hours=5)]
    assert empty["n"] == 1 and empty["p50"] is None and empty["avg_latency_ms"] is None
    assert LS.merged(LS.panes(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        LS.merged(LS.panes(df), minutes=20)
