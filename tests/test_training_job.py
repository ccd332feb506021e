from pyspark.sql import functions as F

from labelfold.plans import jobs

ROWS = ([("Phone model %d" % i, "Electronics") for i in range(4)]
        + [("Laptop series %d" % i, "Computers") for i in range(6)]
        + [("Tablet edition %d" % i, "Tablets") for i in range(2)])


def test_run_training_from_csv(spark, tmp_path):
    csv = tmp_path / "product_titles.csv"
    csv.write_text("product_title,category\n" + "\n".join(f"{t},{c}" for t, c in ROWS) + "\n", encoding="utf-8")
    cfg = {"data": {"path": str(tmp_path), "ranges": True},
           "split": {"test_size": 0.2, "val_size": 0.1, "random_seed": 42},
           "model": {"classifier_type": "lr", "classifier_params": {"max_iter": 20}},
           "output": {"model_path": str(tmp_path / "models" / "checkpoint")}}
    res = jobs.train(spark, cfg)
    sizes = {r["split"]: r["count"] for r in res["split"].groupBy("split").count().collect()}
    assert sizes == {"train": 7, "val": 2, "test": 3}
    assert (tmp_path / "models" / "checkpoint" / "pipeline").exists()
    ev = {r["split"]: r["n"] for r in res["evaluation"].collect()}
    assert ev == {"val": 2, "test": 3}


def test_prediction_edge_cases(spark):
    train = spark.createDataFrame(ROWS, "product_title string, category string")
    model, idx = jobs.fit(train, "lr", {"max_iter": 10})
    empty = spark.createDataFrame([], "product_title string")
    assert jobs.predict(model, idx, empty).count() == 0
    one = spark.createDataFrame([("Phone model 9",)], "product_title string")
    assert jobs.predict(model, idx, one).first()["predicted"] in {"Electronics", "Computers", "Tablets"}
    uni = spark.createDataFrame([("Ноутбук «Про» 15",), ("手机 型号",), ("Café ☕ tablet",)], "product_title string")
    out = jobs.predict(model, idx, uni)
    assert out.count() == 3 and out.filter(F.col("predicted").isNull()).count() == 0
    assert out.filter((F.col("confidence") < 0) | (F.col("confidence") > 1)).count() == 0


def test_unfitted_and_null_labels_are_errors(spark):
    import pytest
    frame = spark.createDataFrame([("a", None), ("b", "x")], "product_title string, category string")
    with pytest.raises(ValueError, match="fit"):
        jobs.predict(None, None, frame)
    with pytest.raises(ValueError, match="NULL"):
        jobs.fit(frame, "lr")


def test_cleaning_options_hold_for_the_evaluation_and_metadata_comes_back(spark, tmp_path):
    rows = [("IPHONE", "Upper"), ("iphone", "Lower")] * 20
    frame = spark.createDataFrame(rows, "product_title string, category string")
    path = str(tmp_path / "m")
    res = jobs.train(spark, {"preprocessing": {"lowercase": False}, "output": {"model_path": path},
                             "model": {"classifier_type": "lr", "classifier_params": {"max_iter": 20}}}, frame)
    ev = {r["split"]: r for r in res["evaluation"].collect()}
    assert ev["test"]["accuracy"] == 1.0 and ev["test"]["median_confidence"] > 0.5 and "high_confidence_ratio" in res["evaluation"].columns
    _, _, meta = jobs.load(spark, path)
    assert meta["classifier_params"] == {"max_iter": 20} and meta["id_to_label"] == {0: "Lower", 1: "Upper"}
    assert meta["label_to_id"] == {"Lower": 0, "Upper": 1} and meta["is_fitted"] is True and meta["preprocessing"]["lowercase"] is False
    assert {"embedding_model_name", "classifier_type", "embedding_dim"} <= set(meta)


def test_default_classifier_is_an_mlp_of_a_narrow_text(spark, tmp_path):
    frame = spark.createDataFrame(ROWS * 3, "product_title string, category string")
    res = jobs.train(spark, {"output": {"model_path": str(tmp_path / "m")}, "model": {"classifier_params": {"max_iter": 3}, "num_features": 64}}, frame)
    assert res["metadata"]["classifier_type"] == "mlp" and res["metadata"]["embedding_dim"] == 64
