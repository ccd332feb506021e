"""Term counts in blocks: the same scores as from rows, without a row for each document and term."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelfold.operators import features as FE
from labelfold.operators import term_blocks as B
from labelfold.plans import q_models
from labelfold.session import spread_groups

from test_sparse_scoring import DOCS, expected

SCHEMA = "user_id string, doc_id long, label string, split string, text string"
MORE = [(u, d, label, split, f"w{d % 7} w{d % 11} tail{d} " + "x " * (d % 300) + f"Ünï{d % 3}")
        for d, (u, label, split) in enumerate([(f"u{i % 5}", "abc"[i % 3], "test" if i % 4 == 0 else "train") for i in range(120)], 100)]
ODD = [("u", 1, "a", "train", "red Red apple"), ("v", 1, "a", "train", "tree"), ("u", 4, "b", "test", "apple"),  # ids that repeat
       ("u", 2, "b", "train", "pear"), ("v", 9, "c", "train", "plum red"), (None, 50, "a", "train", "red tree"), (None, 51, "a", "test", "red plum")]


def tables(spark, rows, by, parts=3):
    """The counts as rows, in blocks, and the documents."""
    df = spark.createDataFrame(rows, SCHEMA)
    sizes = df.groupBy(*by).agg(F.sum(F.char_length("text")).alias("chars"))
    dealt, _ = spread_groups(df, sizes, by, "doc_id", chars=3000)
    more = [*by, "label", "split"]
    return FE.term_counts(df, "doc_id", "text", more), FE.term_counts(dealt, "doc_id", "text", more, label="label", parts=parts), df.drop("text")


def scores_of(docs, terms, by):
    x = q_models.sparse_predict(docs, terms, by)[0]
    return {tuple(r[c] for c in [*by, "doc_id", "label"]): r["score"] for r in x.collect()}, x.columns


@pytest.mark.parametrize("by", [[], ["user_id"]])
@pytest.mark.parametrize("rows", [DOCS, DOCS + MORE, DOCS + ODD + MORE[:40]])
def test_blocks_give_the_scores_of_rows(spark, by, rows):
    long, blocks, docs = tables(spark, rows, ["user_id"])
    want, columns = scores_of(docs, long, by)
    got, packed_columns = scores_of(docs, blocks, by)
    assert packed_columns == columns and want and got == pytest.approx(want)
    if rows is DOCS and not by:
        assert got == pytest.approx(expected(DOCS))


def test_counts_and_idf_of_blocks(spark):
    long, blocks, docs = tables(spark, DOCS + ODD + MORE, ["user_id"])
    want = FE.idf_table(long, docs, "doc_id", ["user_id"])
    x = FE.idf_table(blocks, docs, "doc_id", ["user_id"])
    cols = ["term", "df", "tf_total", "idf"]
    got = x.select("user_id", "m", F.explode(F.arrays_zip(*cols)).alias("t")).select("user_id", "m", "t.*")
    order = lambda df: sorted((r.user_id, r.term, r.df, r.tf_total, r.m, round(r.idf, 12)) for r in df.collect())
    assert order(got) == order(want)
    assert blocks.filter(F.size("doc_id") == 0).isEmpty()


def test_many_labels_and_small_slices(spark, monkeypatch):
    long, blocks, docs = tables(spark, DOCS + MORE, ["user_id"])
    want, _ = scores_of(docs, long, [])
    monkeypatch.setattr(B, "LABELS", 1)
    monkeypatch.setattr(B, "PRODUCTS", 1)
    assert scores_of(docs, blocks, [])[0] == pytest.approx(want)


def test_no_train_rows(spark):
    _, blocks, docs = tables(spark, [r for r in DOCS if r[3] == "test"], [])
    assert q_models.sparse_predict(docs, blocks, [])[0].isEmpty()


def test_numbers_and_codes_of_any_size():
    for most in (0, 200, 60_000, 70_000, 5_000_000):
        a = np.array([0, most, most // 2])
        for there, back in ((B._small, B._numbers), (B._steps, B._codes)):
            assert (back(pa.chunked_array([pa.array([there(a)], pa.binary())]), 3) == a).all()


def test_codes_of_a_document_ascend_with_their_counts():
    doc, code = np.array([0, 0, 0, 1, 1]), np.array([5, 2, 9, 7, 0])
    for tf in (np.array([1, 2, 3, 4, 5]), np.array([1, 2, 3, 4, 1 << 60])):
        codes, counts = B._ascending(doc, code, tf)
        assert list(codes) == [2, 5, 9, 0, 7] and list(counts) == [2, 1, 3, tf[4], 4]


def test_groups_are_dealt_whole_and_large_ones_over_several_tasks(spark):
    rows = [("big", i, "t" * 50) for i in range(400)] + [(f"s{i % 40}", 1000 + i, "t" * 5) for i in range(400)] + [(None, 5000, "t"), ("big", 3, "t")]
    df = spark.createDataFrame(rows, "g string, k long, t string")
    sizes = df.groupBy("g").agg(F.sum(F.char_length("t")).alias("chars"))
    dealt, tasks = spread_groups(df, sizes, ["g"], "k", chars=2000)
    at = dealt.select("g", "k", F.spark_partition_id().alias("p"), F.char_length("t").alias("n")).collect()
    assert sorted((r.k, r.n) for r in at) == sorted((k, len(t)) for _, k, t in rows)
    where = {}
    for r in at:
        where.setdefault((r.g, r.k), set()).add(r.p)
    assert all(len(p) == 1 for p in where.values())
    big = {r.p for r in at if r.g == "big"}
    assert len(big) >= 8 and not big & {r.p for r in at if r.g != "big"} and dealt.rdd.getNumPartitions() <= tasks
    assert max(sum(r.n for r in at if r.p == p) for p in {r.p for r in at}) <= 5000
    for some in (df.filter("g IS NULL"), df.limit(0)):
        dealt, _ = spread_groups(some, some.groupBy("g").agg(F.sum(F.char_length("t")).alias("chars")), ["g"], "k")
        assert dealt.columns == df.columns and dealt.count() == some.count()


def test_term_table_of_a_job_has_no_row_for_each_document_and_term(spark):
    sf = "/root/testdata/sf0.001"
    docs = q_models._user_split(spark, sf)
    terms = q_models._split_terms(spark, sf, docs, True)
    # a block for each task, user and split
    tasks = 4 * spark.sparkContext.defaultParallelism + docs.select("user_id").distinct().count()
    assert terms.count() <= 2 * tasks
    assert terms.select(F.explode("doc_id")).count() == docs.count()
