import math
import random

import numpy as np
from pyspark.sql import functions as F

from labelfold.operators import quantiles as Q

PROBS = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}


def test_order_key_sorts_like_the_values(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, math.inf, -math.inf, math.nan, 0.1, 0.3]
    for e in range(-1074, 1024):
        p = math.ldexp(1.0, e)
        values += [p, math.nextafter(p, 0), math.nextafter(p, math.inf), -p]
    values += [rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    got = df.select("v", Q.order_key(F.col("v")).alias("k")).collect()
    ordered = sorted((r for r in got if not math.isnan(r.v)), key=lambda r: r.v)
    for a, b in zip(ordered, ordered[1:]):
        assert (a.k < b.k) if a.v < b.v else (a.k == b.k), (a, b)
    assert [r.k for r in got if math.isnan(r.v)] == [2**63 - 1] and ordered[-1].k < 2**63 - 1


def test_equals_numpy_on_odd_distributions(spark):
    rng = np.random.default_rng(2)
    groups = {"narrow": 0.9995 + rng.random(20_000) * 0.0005, "one value": np.full(500, 0.25), "one row": np.array([3.0]),
              "both signs": rng.normal(size=3001), "wide": 10.0 ** rng.uniform(-300, 300, 2000), "two": np.array([1.0, 2.0]),
              "hot": np.concatenate([np.full(9000, 7.0), rng.random(1000)]), "steps": rng.integers(0, 101, 5000) / 100}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("narrow", None), ("nothing", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r.g: r for r in Q.exact_percentiles(df, "v", PROBS, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for name, p in PROBS.items():
            assert math.isclose(got[g][name], float(np.quantile(vs, p)), rel_tol=1e-12, abs_tol=0), (g, name)
    whole = Q.exact_percentiles(df, "v", PROBS).collect()
    assert len(whole) == 1 and whole[0].p50 == np.quantile([v for _, v in rows if v is not None], 0.5)
    assert Q.exact_percentiles(df.limit(0), "v", PROBS, ["g"]).count() == 0


def test_a_million_close_values_meet_in_no_task(spark, tmp_path):
    """Only counts are shuffled: of 10^6 distinct values in [0.9995, 1] no task gets more than 2 % as rows."""
    n = 1_000_000
    path = str(tmp_path / "v")
    spark.range(0, n, 1, 64).select((0.9995 + F.col("id") * (0.0005 / n)).alias("v")).write.parquet(path)
    df = spark.read.parquet(path)
    got = Q.exact_percentiles(df, "v", {"p50": 0.5, "p99": 0.99}).first()
    v = 0.9995 + np.arange(n) * (0.0005 / n)
    assert math.isclose(got.p50, np.quantile(v, 0.5), rel_tol=1e-15) and math.isclose(got.p99, np.quantile(v, 0.99), rel_tol=1e-15)
    # the keys' digits at the levels where the values differ: how many counts one map task hands on
    keys = df.select(Q.order_key(F.col("v")).alias("k"), F.spark_partition_id().alias("task"))
    for shift in (48, 32):
        most = keys.groupBy("task", F.shiftright("k", shift).alias("p")).count().groupBy("task").count().agg(F.max("count")).first()[0]
        assert most <= 0.02 * n
    # at a lower level only the values below one wanted prefix are counted
    last = keys.groupBy(F.shiftright("k", 32).alias("p")).count().agg(F.max("count")).first()[0]
    assert last <= 0.02 * n
