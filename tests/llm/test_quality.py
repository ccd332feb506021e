import numpy as np
from pyspark.sql import functions as F

from labelfold.llm import quality as q

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_all_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = q.score(*q.train(docs, labels.where("doc_id % 4 <> 1"))).cache()
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    rows = out.join(labels.where("doc_id % 4 = 1"), "doc_id").collect()
    assert np.mean([(r.score >= 0.5) == bool(r.quality) for r in rows]) > 0.95


def test_views_exchange_pseudo_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    table_, model = q.train(docs, labels, max_labelled=40, rounds=1, pseudo=10)
    known = labels.select("doc_id")
    rows = q._confident(table_, model, known, 10)
    assert rows and all(r["sure"] >= q.CONFIDENT for r in rows)
    assert all(sum(1 for r in rows if (r["view"], r["label"]) == k) <= 10 for k in ((0, 0), (0, 1), (1, 0), (1, 1)))


def test_odd_rows(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, score string"
    rows = [(1, None, None, None, None, "mine"), (1, "", "en", "s", -1, "mine"), (None, "x" * 1_000_000, "de", None, 10**12, "x"), (2, "a b", "en", "s", 3, None), (2, "a b", "en", "s", 3, None)]
    docs = spark.createDataFrame(rows, kind)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in q.score(*q.train(docs, none)).collect()] == [0.5] * 5
    marks = spark.createDataFrame([(1, 0), (2, 1), (2, None), (None, 1)], "doc_id long, quality int")
    assert q.score(*q.train(docs, marks)).where(F.col("score").between(0, 1)).count() == 5
    assert q.score(*q.train(docs.limit(0), marks)).count() == 0
