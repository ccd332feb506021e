"""Tasks that count pieces of texts keep a bounded size as the input grows."""

from pyspark.sql import functions as F

from labelfold.operators import features as FE
from labelfold.session import spread


def test_tasks_grow_with_the_text_and_counts_need_no_further_shuffle(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    rows = [(i % 300, f"w{i} and w{i % 7} " * 20) for i in range(600)] + [(None, None)]
    spark.createDataFrame(rows, "k long, t string").coalesce(1).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    size = sum(len(t or "") for _, t in rows)
    n = 3 * cores
    dealt = spread(df, "k", text="t", chars=-(-size // n))
    assert n - 1 <= dealt.rdd.getNumPartitions() <= n
    assert spread(df, "k", text="t").rdd.getNumPartitions() == cores  # small inputs: one task a core
    assert sorted(map(str, dealt.collect())) == sorted(map(str, df.collect()))
    counts = FE.term_counts(dealt, "k", "t")
    assert counts._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {(r.k, r.term): r.tf for r in counts.collect()} == {(r.k, r.term): r.tf for r in FE.term_counts(df, "k", "t").collect()}
    assert spread(df.limit(0), "k", text="t").agg(F.count("k")).first()[0] == 0
