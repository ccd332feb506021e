import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelfold.operators import metrics
from labelfold.operators.quantiles import exact_percentiles


def py_prf(y, p):
    labels = sorted(set(y) | set(p))
    out = {}
    for l in labels:
        tp = sum(1 for a, b in zip(y, p) if a == b == l)
        npred = sum(1 for b in p if b == l)
        sup = sum(1 for a in y if a == l)
        pr = tp / npred if npred else 0.0
        rc = tp / sup if sup else 0.0
        f1 = 2 * tp / (sup + npred) if sup + npred else 0.0
        out[l] = (pr, rc, f1, sup)
    return out


def test_evaluate_matches_definitions(spark):
    random.seed(3)
    y = [random.choice("abc") for _ in range(200)]
    p = [random.choice("abcd") if random.random() < 0.4 else t for t in y]
    df = spark.createDataFrame(list(zip(y, p, [random.random() for _ in y])),
                               "y_true string, y_pred string, confidence double")
    pc = py_prf(y, p)
    n = len(y)
    acc = sum(a == b for a, b in zip(y, p)) / n
    macro_f1 = np.mean([v[2] for v in pc.values()])
    w_f1 = sum(v[2] * v[3] for v in pc.values()) / n
    r = metrics.evaluate(df).first()
    assert r["accuracy"] == pytest.approx(acc)
    assert r["macro_f1"] == pytest.approx(macro_f1)
    assert r["f1"] == pytest.approx(w_f1)
    m = metrics.evaluate(df, average="micro").first()
    assert m["precision"] == pytest.approx(acc) and m["f1"] == pytest.approx(acc)
    cm = metrics.confusion_matrix(df)
    assert cm.count() == 16 and cm.agg(F.sum("n")).first()[0] == n


def test_high_confidence_none_above_threshold(spark):
    df = spark.createDataFrame([("a", "a", 0.1), ("b", "a", 0.2), ("a", "a", 0.3), ("b", "b", 0.4)],
                               "y_true string, y_pred string, confidence double")
    r = metrics.evaluate_with_confidence(df, threshold=0.9).first()
    assert r["high_confidence_accuracy"] is None
    assert r["high_confidence_count"] == 0 and r["high_confidence_ratio"] == 0.0
    assert r["median_confidence"] == pytest.approx(0.25)  # mean of the middle two
    r = metrics.evaluate_with_confidence(df, threshold=0.3).first()
    assert r["high_confidence_count"] == 2 and r["high_confidence_accuracy"] == 1.0


def test_exact_percentiles_vs_numpy(spark):
    random.seed(11)
    rows = [("hot" if i % 2 else f"g{i % 5}", float(random.choice([-3.5, 0.0, 1.25]) if i % 7 == 0
                                                   else random.gauss(100, 40))) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in exact_percentiles(df, "v", {"p50": .5, "p95": .95, "p99": .99}, ["g"]).collect()}
    for g in {r[0] for r in rows}:
        vals = np.array([v for k, v in rows if k == g])
        for name, q in (("p50", 50), ("p95", 95), ("p99", 99)):
            assert got[g][name] == pytest.approx(np.percentile(vals, q), rel=1e-12, abs=1e-9)


def test_confusion_matrix_wide_and_strict_encoding(spark):
    from labelfold.operators import labels
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "y_true string, y_pred string")
    wide = {r["y_true"]: r.asDict() for r in metrics.confusion_matrix_wide(df).collect()}
    assert wide["a"]["a"] == 1 and wide["a"]["b"] == 1 and wide["c"]["a"] == 1 and wide["c"]["c"] == 0
    idx = labels.label_index(spark.createDataFrame([("a",), ("b",)], "category string"))
    unknown = spark.createDataFrame([("a",), ("z",)], "category string")
    assert labels.encode_labels(unknown, idx).filter("label_id IS NULL").count() == 1
    with pytest.raises(KeyError):
        labels.encode_labels(unknown, idx, strict=True)


def test_exact_percentiles_edge_cases(spark):
    rows = [("one", 5.0), ("same", 2.5), ("same", 2.5), ("same", 2.5), ("neg", -10.0), ("neg", -0.5),
            ("neg", 0.0), ("neg", 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in exact_percentiles(df, "v", {"p50": .5, "p90": .9}, ["g"]).collect()}
    for g in ("one", "same", "neg"):
        vals = np.array([v for k, v in rows if k == g])
        assert got[g]["p50"] == pytest.approx(np.percentile(vals, 50))
        assert got[g]["p90"] == pytest.approx(np.percentile(vals, 90))
    glob = exact_percentiles(df, "v", {"p50": .5}).first()
    assert glob["p50"] == pytest.approx(np.percentile([v for _, v in rows], 50))
