import numpy as np
import pytest
from pyspark.sql import functions as F

from labelfold.llm import toxicity as t
from labelfold.llm.common import fold

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(fold(F.col("doc_id"), 3) != 1)
    return t.train(docs, labels)


def test_nearest_equals_brute_force(spark, model):
    rng = np.random.default_rng(1)
    terms = np.sort(rng.choice(10_000, 300, replace=False).astype(np.uint64))
    bags = []
    for i in range(500):
        h = np.sort(rng.choice(terms, rng.integers(0, 30), replace=False))
        bags.append((h, rng.integers(1, 5, len(h))))
    bags += bags[:40]  # ties
    index = t.BlockMaxIndex(terms, rng.random(300) + 0.5, bags)
    dense = np.zeros((len(bags), 300))
    for i, b in enumerate(bags):
        at, w = index.vector(*b)
        dense[i, at] = w
    for i in range(0, len(bags), 7):
        at, w = index.vector(*bags[i])
        best, cosine = index.nearest(at, w, 15, skip=i)
        full = dense @ dense[i]
        full[i] = 0
        order = np.lexsort((np.arange(len(full)), -np.round(full, 12)))[:15]
        order = order[full[order] > 0]
        assert best.tolist() == order.tolist() and np.allclose(cosine, full[order])


def test_held_out_labels(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = t.query(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert t.query(spark, SF).count() == docs.count()
    clean = [r for r in rows if r.toxic == 0]
    toxic = [r for r in rows if r.toxic == 1]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert sum(r.predicted for r in toxic) >= 0.5 * len(toxic)
    assert all(0 <= r.score <= 1 for r in rows)


def test_sample_is_bounded_and_rates_follow(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} same") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(50)], "doc_id long, toxic int")
    m = t.train(docs, labels, max_examples=5)
    assert len(m.ids) == 10 and set(np.round(m.rate, 6)) == {round(5 / 8, 6), round(5 / 42, 6)}


def test_odd_rows(spark, model):
    rows = [(1, None, "mine"), (1, "", "mine"), (None, "idiot scum " * 50_000, "x"), (2, "\t\n", None), (2, "plain words", None), (2, "plain words", None)]
    out = t.score(spark.createDataFrame(rows, "doc_id long, text string, evidence string"), model).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
    empty = {r.score for r in out if not (r.text or "").strip()}
    assert empty == {model.prior} and next(r for r in out if r.doc_id is None).score > 0.7
    none = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert t.score(none, t.train(none, labels)).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert t.score(one, t.train(one, labels)).first().score == 0.0
    marks = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (1, None)], "doc_id long, toxic int")
    assert t.score(one, t.train(one, marks)).first().score == 1.0


def test_ids_of_any_type(spark):
    for kind in ("smallint", "int", "decimal(12,2)", "string"):
        docs = spark.sql(f"select cast(id as {kind}) as doc_id, if(id % 2 = 0, 'vile scum', 'kind words') as text from range(80)")
        labels = spark.sql(f"select cast(id as {kind}) as doc_id, cast(id % 2 = 0 as int) as toxic from range(80)")
        rows = t.score(docs, t.train(docs, labels)).collect()
        assert len(rows) == 80 and all((r.score > 0.5) == (int(r.doc_id) % 2 == 0) for r in rows)
        assert {type(e.doc_id) for r in rows for e in r.evidence} <= {type(r.doc_id) for r in rows}
