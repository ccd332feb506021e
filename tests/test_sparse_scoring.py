"""TF-IDF prototypes and in-row scoring against plain Python."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from labelfold.operators import classify as C
from labelfold.operators import features as FE
from labelfold.plans import q_models

DOCS = [  # user, doc, label, split, text
    ("u", 1, "a", "train", "red Red apple"), ("u", 2, "b", "train", "blue plum, blue"), ("u", 3, None, "train", "green pear red"),
    ("u", 4, "a", "test", "red  plum"), ("u", 5, "b", "test", "unknown words"), ("u", 6, "b", "train", ""),
    ("v", 7, "a", "train", "red apple"), ("v", 8, "c", "train", "red plum tree"), ("v", 9, "c", "test", "PLUM tree tree apple"),
    ("v", 10, "c", "test", None),
]


def expected(docs):
    """{(doc, label): cosine} of the test documents, documents of one model."""
    bags = {d: Counter((t or "").lower().replace(",", " ").split()) for _, d, _, _, t in docs}
    train = [(d, label) for _, d, label, split, _ in docs if split == "train"]
    df = Counter(t for d, _ in train for t in bags[d])
    idf = {t: math.log((len(train) + 1) / (n + 1)) for t, n in df.items()}

    def unit(bag):
        v = {t: n * idf[t] for t, n in bag.items() if idf.get(t, 0) > 0}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / length for t, x in v.items()}
    sums = defaultdict(Counter)
    for d, label in train:
        for t, x in unit(bags[d]).items():
            sums[label][t] += x
    out = {}
    for _, d, _, split, _ in docs:
        if split == "test":
            v = unit(bags[d])
            for label, s in sums.items():
                if set(v) & set(s):
                    out[d, label] = sum(x * s[t] for t, x in v.items()) / math.sqrt(sum(x * x for x in s.values()))
    return out


@pytest.mark.parametrize("by", [[], ["user_id"]])
def test_sparse_scores_equal_plain_python(spark, by):
    rows = spark.createDataFrame(DOCS, "user_id string, doc_id long, label string, split string, text string")
    terms = FE.term_counts(rows, "doc_id", "text", ["user_id", "label", "split"])
    scores, k = q_models.sparse_predict(rows.drop("text"), terms, by)
    got = {(r["doc_id"], r["label"]): r["score"] for r in scores.collect()}
    want = expected(DOCS) if not by else {**expected([r for r in DOCS if r[0] == "u"]), **expected([r for r in DOCS if r[0] == "v"])}
    assert got == pytest.approx(want) and (4, None) in got
    assert sorted(r["k"] for r in k.collect()) == ([4] if not by else [2, 3])


def test_sparse_without_train_rows(spark):
    rows = spark.createDataFrame(DOCS, "user_id string, doc_id long, label string, split string, text string").filter("split = 'test'")
    terms = FE.term_counts(rows, "doc_id", "text", ["label", "split"])
    assert q_models.sparse_predict(rows.drop("text"), terms, [])[0].isEmpty()


@pytest.mark.parametrize("by", [[], ["user_id"]])
@pytest.mark.parametrize("metric", ["cosine", "linear"])
def test_scores_in_the_row_equal_joined_scores(spark, by, metric):
    x = spark.createDataFrame([("u", 1, [1.0, 0.0]), ("u", 2, [0.0, 0.0]), ("v", 3, [2.0, 1.0]), ("v", 4, [1.0, 1.0])],
                              "user_id string, k long, f array<float>")
    m = spark.createDataFrame([("u", "b", [1.0, 1.0], 0.5), ("u", "a", [1.0, 1.0], 0.5), ("v", "c", [0.0, 0.0], 0.0), ("v", "d", [0.0, 3.0], -1.0)],
                              "user_id string, label string, coef array<double>, intercept double")
    scored = C.score_rows(x, m, "f", by=by, metric=metric)
    joined = C.score_dense(x, m, "k", "f", by=by, metric=metric)
    cols = ["k", "predicted", "score", "confidence", "top_labels"]
    order = lambda df: sorted(tuple(r) for r in df.select(*cols).collect())
    for a, b in zip(order(C.rank_rows(scored)), order(C.rank_scores(joined, "k", by=by))):
        assert a[:2] == b[:2] and a[2:4] == pytest.approx(b[2:4]) and a[4] == b[4]
    p = {(r["k"], r["label"]): r["probability"] for r in C.probability_rows(scored, "k").collect()}
    assert p == pytest.approx({(r["k"], r["label"]): r["probability"] for r in C.probabilities(joined, "k", by=by).collect()})
    # a global model neither joins nor shuffles the scored rows
    if not by:
        plan = C.rank_rows(scored)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Window" not in plan
