import numpy as np
import pytest
from pyspark.sql import functions as F

from labelfold.operators import classify as C
from labelfold.operators import features as FE
from labelfold.plans import jobs

SF = "/root/testdata/sf0.001"


def test_lr_matches_l2_objective(spark):
    """Spark's LR solution is a stationary point of Σ w·CE + ||W||²/(2C) (CLS-2)."""
    emb = spark.read.parquet(f"{SF}/embeddings.parquet").withColumn("category", F.col("label").cast("string"))
    model, idx = jobs.fit(emb, "lr", {"C": 1.0, "max_iter": 1000}, features="vector")
    lr = model.stages[-1]
    W, b = lr.coefficientMatrix.toArray(), lr.interceptVector.toArray()
    ids = {r["category"]: r["label_id"] for r in idx.collect()}
    rows = emb.collect()
    X = np.array([r["embedding"] for r in rows], dtype=float)
    y = np.array([ids[r["category"]] for r in rows])
    counts = np.bincount(y)
    w = len(y) / (len(counts) * counts[y])
    Z = X @ W.T + b
    P = np.exp(Z - Z.max(1, keepdims=True))
    P /= P.sum(1, keepdims=True)
    Y = np.eye(len(counts))[y]
    G = ((P - Y) * w[:, None]).T @ X + W / 1.0
    gb = ((P - Y) * w[:, None]).sum(0)
    scale = w.sum()
    assert np.abs(G).max() / scale < 1e-4 and np.abs(gb).max() / scale < 1e-4


def test_text_job_round_trip_and_probabilities(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cfg = {"data": {"column_mapping": {"product_title": "text", "category": "lang"},
                    "keep": ["doc_id"], "key": "doc_id"},
           "model": {"classifier_type": "lr", "classifier_params": {"max_iter": 50}},
           "output": {"model_path": str(tmp_path / "m")}}
    res = jobs.train(spark, cfg, frame=docs)
    ev = {r["split"]: r for r in res["evaluation"].collect()}
    assert set(ev) == {"val", "test"} and ev["test"]["accuracy"] > 0.5
    model, idx, meta = jobs.load(spark, str(tmp_path / "m"))
    assert meta["classifier_type"] == "lr"
    test = res["split"].filter("split = 'test'")
    a = jobs.predict(res["model"], res["labels"], test).select("doc_id", "predicted")
    b = jobs.predict(model, idx, test).select("doc_id", "predicted")
    assert a.exceptAll(b).count() == 0
    p = jobs.predict(model, idx, test)
    bad = p.filter((F.abs(F.aggregate("proba", F.lit(0.0), lambda s, x: s + x) - 1) > 1e-6)
                   | (F.col("confidence") != F.array_max("proba"))
                   | (F.array_position("proba", F.array_max("proba")) - 1 != F.col("prediction")))
    assert bad.count() == 0


def test_mlp_and_svm_fit(spark):
    emb = spark.read.parquet(f"{SF}/embeddings.parquet").withColumn("category", F.col("label").cast("string"))
    for kind in ("mlp", "svm"):
        model, idx = jobs.fit(emb, kind, {"max_iter": 20, "hidden_layer_sizes": (16,)} if kind == "mlp"
                              else {"max_iter": 10}, features="vector")
        out = jobs.predict(model, idx, emb, features="vector")
        assert out.count() == emb.count() and out.filter("predicted IS NULL").count() == 0
    with pytest.raises(ValueError):
        C.make_classifier("tree")


def test_encoder_udf_deterministic(spark):
    def factory():
        def enc(texts):
            return [[float(len(t)), float(sum(map(ord, t)) % 97)] for t in texts]
        return enc
    df = spark.createDataFrame([("abc",), ("abc",), ("zz",)], "t string")
    out = [r["embedding"] for r in FE.encode_with(df, "t", factory, 2).collect()]
    assert out[0] == out[1] and len(out[2]) == 2


def test_rank_scores_softmax_and_ties(spark):
    s = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (1, "c", 0.1), (2, "a", 0.2)],
                              "k long, label string, score double")
    r = {x["k"]: x for x in C.rank_scores(s, "k", k_labels=3).collect()}
    assert r[1]["predicted"] == "a" and r[1]["top_labels"] == ["a", "b", "c"]
    e = np.exp(np.array([0.5, 0.5, 0.1]) / C.TEMPERATURE)
    assert r[1]["confidence"] == pytest.approx(e[0] / e.sum())
    e2 = np.exp(np.array([0.2, 0.0, 0.0]) / C.TEMPERATURE)
    assert r[2]["confidence"] == pytest.approx(e2[0] / e2.sum())


def test_cross_validation_picks_a_reg_param(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(
        F.lower("text").alias("product_title"), F.col("lang").alias("category"))
    cv = jobs.cross_validate(docs, reg_grid=(0.0, 0.1), folds=2, params={"max_iter": 10},
                             num_features=1 << 12)
    assert len(cv.avgMetrics) == 2 and all(0.0 <= m <= 1.0 for m in cv.avgMetrics)
    assert cv.bestModel.stages[-1].getRegParam() in (0.0, 0.1)


def _staged(monkeypatch):
    """Record every MLP fit: its initial weights and its result's."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier as M
    seen, real = [], M.fit

    def fit(self, df, params=None):
        model = real(self, df)
        seen.append((self.getInitialWeights() if self.isDefined("initialWeights") else None, model.weights, self.getMaxIter()))
        return model
    monkeypatch.setattr(M, "fit", fit)
    return seen


def test_mlp_stops_early_and_never_starts_from_zero_again(spark, monkeypatch):
    emb = spark.read.parquet(f"{SF}/embeddings.parquet").withColumn("category", F.col("label").cast("string"))
    seen = _staged(monkeypatch)
    model, idx, scores = jobs.fit_mlp_early_stopping(emb, "vec_id", params={"hidden_layer_sizes": (8,), "max_iter": 400},
                                                     stage_iter=10, patience=2)
    assert scores[-1][0] < 400 and len(seen) == len(scores) < 40
    assert seen[0][0] is None
    for (_, before, _), (start, _, _) in zip(seen, seen[1:]):
        assert start == before                                   # each stage goes on where the last one ended
    best = max(range(len(scores)), key=lambda i: (scores[i][1], -i))
    assert scores[best][1] - scores[-1][1] >= 0 and all(0.0 <= s <= 1.0 for _, s in scores)
    kept = [i for i, (_, w, _) in enumerate(seen) if w == model.stages[-1].weights]
    assert kept and scores[best][1] - scores[kept[0]][1] <= 1e-4  # the best stage's weights are the model
    assert jobs.predict(model, idx, emb, features="vector").filter("predicted IS NULL").count() == 0


def test_training_job_trains_its_mlp_in_stages(spark, monkeypatch, tmp_path):
    rows = [(f"{kind} model {i}", kind) for i in range(20) for kind in ("phone", "laptop")]
    frame = spark.createDataFrame(rows, "product_title string, category string")
    seen = _staged(monkeypatch)
    model = {"classifier_params": {"max_iter": 60, "hidden_layer_sizes": (4,)}, "num_features": 32}
    res = jobs.train(spark, {"output": {"model_path": str(tmp_path / "m")}, "model": model}, frame)
    assert all(n <= 25 for _, _, n in seen) and all(w is not None for w, _, _ in seen[1:])
    again, idx, _ = jobs.load(spark, str(tmp_path / "m"))
    assert again.stages[-1].weights == res["model"].stages[-1].weights
    found = jobs.predict(again, idx, frame).select("product_title", "predicted")
    assert found.exceptAll(jobs.predict(res["model"], idx, frame).select("product_title", "predicted")).count() == 0
    assert found.join(frame, "product_title").filter("predicted = category").count() > 30  # 32 hashed places: some words collide
    seen.clear()
    model["classifier_params"]["early_stopping"] = False
    jobs.train(spark, {"output": {"model_path": str(tmp_path / "n")}, "model": model}, frame)
    assert [n for _, _, n in seen] == [60]


def test_predict_cleans_like_training(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).select(
        F.col("text").alias("product_title"), F.col("lang").alias("category"), "doc_id")
    from labelfold.operators import quality
    model, idx = jobs.fit(quality.preprocess(docs), "lr", {"max_iter": 5})
    noisy = docs.withColumn("product_title", F.concat(F.lit("   "), F.upper("product_title"), F.lit("  ")))
    a = jobs.predict(model, idx, docs).select("doc_id", "predicted")
    b = jobs.predict(model, idx, noisy).select("doc_id", "predicted")
    assert a.exceptAll(b).count() == 0   # cleaning removes the case/space noise before scoring
