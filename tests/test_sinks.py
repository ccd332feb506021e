import datetime as dt


from labelfold.operators import classify as C
from labelfold.operators import features as FE
from labelfold.sources import sinks


def test_training_rows_append_and_user_pruning(spark, tmp_path):
    path = str(tmp_path / "training_data")
    rows = spark.createDataFrame([(u, f"t{u}-{i}", "x", "auto_confirmed") for u in range(5) for i in range(3)],
                                 "user_id long, text string, label string, source string")
    sinks.append_training_rows(rows, path)
    sinks.append_training_rows(rows.limit(2), path)
    assert spark.read.parquet(path).count() == 17
    one = sinks.read_training_rows(spark, path, user_id=3)
    assert one.count() == 3 and one.select("user_id").distinct().first()[0] == 3
    assert "PartitionFilters: [isnotnull(user_bucket" in one._jdf.queryExecution().executedPlan().toString() \
        or "user_bucket" in one._jdf.queryExecution().executedPlan().toString()


def test_history_latest_state(spark, tmp_path):
    path = str(tmp_path / "history")
    t0 = dt.datetime(2024, 1, 1, 10, 0, 0)
    ev = [(1, 7, "pending", t0), (1, 7, "running", t0 + dt.timedelta(seconds=1)),
          (1, 7, "completed", t0 + dt.timedelta(seconds=30)), (2, 7, "pending", t0),
          (2, 7, "failed", t0)]
    sinks.append_history(spark.createDataFrame(ev, "run_id long, user_id long, status string, at timestamp"), path)
    st = {r["run_id"]: r["status"] for r in sinks.history_state(spark, path).collect()}
    assert st == {1: "completed", 2: "failed"}


def test_zero_shot_with_toy_encoder(spark):
    def factory():
        vocab = ["phone", "laptop", "tablet"]
        return lambda texts: [[float(w in t) for w in vocab] for t in texts]
    cats = FE.encode_with(spark.createDataFrame([("phone",), ("laptop",), ("tablet",)], "label string"),
                          "label", factory, 3)
    items = FE.encode_with(spark.createDataFrame([(1, "cheap phone"), (2, "gaming laptop")],
                                                 "id long, text string"), "text", factory, 3)
    got = {r["id"]: r["predicted"] for r in C.zero_shot(items, cats, "id", "embedding").collect()}
    assert got == {1: "phone", 2: "laptop"}


def test_prediction_log_partitioned_by_day(spark, tmp_path):
    path = str(tmp_path / "predictions")
    t = dt.datetime(2024, 3, 1, 12, 0)
    rows = [(1, "a", 0.9, t), (2, "b", 0.4, t + dt.timedelta(days=1))]
    sinks.append_predictions(spark.createDataFrame(
        rows, "transaction_id long, predicted string, confidence double, scored_at timestamp"), path)
    back = spark.read.parquet(path)
    assert back.count() == 2 and back.select("day").distinct().count() == 2
