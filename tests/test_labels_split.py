import random

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from labelfold.operators import labels, split
from labelfold.operators.ranking import hash_rank, hash_rank_pair, range_sorted, sorted_rank, time_rank


def test_encode_labels(spark):
    df = spark.createDataFrame([(i, l) for i, l in enumerate("ABAC")], "id long, category string")
    idx = labels.label_index(df)
    enc = {r["id"]: r["label_id"] for r in labels.encode_labels(df, idx).collect()}
    assert enc == {0: 0, 1: 1, 2: 0, 3: 2}


def test_class_weights_unbalanced_and_balanced(spark):
    for ids, expected in (([0, 0, 0, 1, 1, 2], [2 / 3, 1.0, 2.0]), ([0, 0, 1, 1, 2, 2], [1.0, 1.0, 1.0])):
        df = spark.createDataFrame([(str(i),) for i in ids], "category string")
        w = [r["weight"] for r in labels.class_weights(df).orderBy("label_id").collect()]
        assert [round(x, 12) for x in w] == [round(x, 12) for x in expected]


def _trainer_frame(spark):
    cats = ["Electronics"] * 4 + ["Computers"] * 6 + ["Tablets"] * 2
    return spark.createDataFrame([(i, f"item {i}", c) for i, c in enumerate(cats)],
                                 "id long, product_title string, category string")


def test_split_sizes_worked_case(spark):
    s = split.split_stratified(_trainer_frame(spark), "id")
    sizes = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert sizes == {"train": 7, "val": 2, "test": 3}
    # stratified test part: one per class (largest remainder)
    per = {r["category"]: r["count"] for r in s.filter("split = 'test'").groupBy("category").count().collect()}
    assert per == {"Electronics": 1, "Computers": 1, "Tablets": 1}
    assert split.split_sizes(12) == (7, 2, 3)


def test_split_complete_disjoint_deterministic(spark, products):
    a = split.split_stratified(products, "doc_id").select("doc_id", "split")
    b = split.split_stratified(products, "doc_id").select("doc_id", "split")
    assert a.count() == 10 and a.select("doc_id").distinct().count() == 10
    assert a.exceptAll(b).count() == 0
    sizes = {r["split"]: r["count"] for r in a.groupBy("split").count().collect()}
    assert sum(sizes.values()) == 10 and sizes.get("test") == 2  # ceil(10 * 0.2)


def test_split_by_user_sizes(spark):
    rows = [(i, f"u{i % 3}", "ab"[i % 2]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, user_id string, category string")
    s = split.split_random(df, "id", by=["user_id"])
    for r in s.groupBy("user_id").agg(F.count_if(F.col("split") == "test").alias("t"),
                                      F.count_if(F.col("split") == "val").alias("v")).collect():
        assert (r["t"], r["v"]) == (20, 10)  # ceil(100*.2)=20, ceil(80*.125)=10


def test_sorted_rank_equals_row_number_with_hot_group(spark):
    random.seed(7)
    rows = [(i, "hot" if i % 3 else f"g{i % 17}", random.randint(0, 50), random.random())
            for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, day int, v double")
    r = sorted_rank(df, ["g"], [F.col("day"), F.col("id")], running={"cum": F.col("v")})
    w = Window.partitionBy("g").orderBy("day", "id")
    ref = df.withColumn("rn", F.row_number().over(w)).withColumn(
        "c2", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    j = r.join(ref, "id")
    assert j.filter(F.col("_rank") != F.col("rn")).count() == 0
    assert j.filter(F.abs(F.col("cum") - F.col("c2")) > 1e-9).count() == 0
    h = hash_rank(df, "id", ["g"])
    assert h.groupBy("g").agg((F.max("_rank") == F.count("*")).alias("ok")).filter("NOT ok").count() == 0


def test_label_map_round_trip(spark):
    df = spark.createDataFrame([(i, l) for i, l in enumerate("ABAC")], "id long, category string")
    js = labels.label_map_json(labels.label_index(df))
    assert js.first()[0] == '{"0":"A","1":"B","2":"C"}'
    back = labels.parse_label_map(js).first()[0]
    assert back == {0: "A", 1: "B", 2: "C"}


def test_time_rank_hot_day_matches_row_number(spark):
    import datetime as dt
    random.seed(5)
    base = dt.datetime(2024, 1, 1)
    rows = [(i * 7919 % 5_000_000, "hot" if i % 4 else "u%d" % (i % 7),
             base + dt.timedelta(seconds=random.randint(0, 3 * 86400)))
            for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, user string, ts timestamp") \
        .withColumn("d", F.to_date("ts"))
    for col in ("d", "ts"):
        r = time_rank(df, col, "id", ["user"])
        ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("user").orderBy(col, "id")))
        assert r.join(ref.select("id", "rn"), "id").filter(F.col("_rank") != F.col("rn")).count() == 0


def test_ranks_of_many_users_with_hashed_keys(spark):
    """2 000 users, one with half of all rows, keys without order: ranks and sizes are exact, ranges are even, offsets few."""
    n = 40_000
    df = spark.range(0, n, 1, 16).select(
        F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 4001 == 1, F.lit(None)).otherwise(F.concat(F.lit("u"), F.col("id") % 2000)).alias("user"),
        F.md5(F.col("id").cast("string")).alias("key"), (F.col("id") % 7).cast("int").alias("label"), F.timestamp_seconds(F.col("id") % 1000).alias("ts"))
    ref = df.select("key", *[F.struct(F.row_number().over(w.orderBy(*o)).alias("r"), F.count("*").over(w).alias("n")).alias(name) for name, w, o in (
        ("t", Window.partitionBy("user"), ["ts", "key"]), ("h", Window.partitionBy("user"), [F.md5(F.concat(F.lit("42|"), "key")), "key"]),
        ("c", Window.partitionBy("user", "label"), [F.md5(F.concat(F.lit("42|"), "key")), "key"]))])
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many ranges, as on large data
    try:
        t = time_rank(df, "ts", "key", ["user"]).select("key", "_rank", "_n").join(ref, "key")
        assert t.filter((F.col("_rank") == F.col("t.r")) & (F.col("_n") == F.col("t.n"))).count() == n
        pair, counts = hash_rank_pair(df, "key", ["user"], "label")
        pair = pair.select("key", "_r_g", "_n_g", "_r_c", F.col("_c").alias("n_c")).join(ref, "key")
        good = (F.col("_r_g") == F.col("h.r")) & (F.col("_n_g") == F.col("h.n")) & (F.col("_r_c") == F.col("c.r")) & (F.col("n_c") == F.col("c.n"))
        assert pair.filter(good).count() == n
        rows = range_sorted(df, ["user"], [F.col("key")])
        ranges = [r["count"] for r in rows.groupBy("_bucket").count().collect()]
        assert len(ranges) >= 8 and max(ranges) <= 2 * n / len(ranges)  # the hot user is cut
        assert rows.select("user", "_bucket").distinct().count() <= 1002 + len(ranges)  # users are odd numbers below 2000, hot and NULL
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_a_null_label_fails(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, category string")
    for f in (labels.label_index, labels.class_weights):
        with pytest.raises(Exception, match="missing label"):
            f(df).collect()
