import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from labelfold.operators import feedback as fbk
from labelfold.operators import ledger


def test_balance_zero_fill_and_transfers(spark):
    acc = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    tx = spark.createDataFrame([(1, "income", Decimal("100.00")), (1, "expense", Decimal("30.50")),
                                (2, "expense", Decimal("5.00"))],
                               "account_id long, type string, amount decimal(15,2)")
    tr = spark.createDataFrame([(1, 2, Decimal("10.00"), Decimal("0.10"))],
                               "from_account_id long, to_account_id long, amount decimal(15,2), fee decimal(15,2)")
    plain = {r["account_id"]: float(r["balance"]) for r in ledger.account_balance(acc, tx).collect()}
    assert plain == {1: 69.5, 2: -5.0, 3: 0.0}
    withtr = {r["account_id"]: float(r["balance"]) for r in ledger.account_balance(acc, tx, tr).collect()}
    assert withtr == {1: 59.4, 2: 5.0, 3: 0.0}


def test_tree_paths_cycle_guard(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")],
                                  "id string, parent_id string")
    got = {r["id"]: (r["root_id"], r["depth"], r["path"]) for r in ledger.tree_paths(nodes).collect()}
    assert got == {"a": ("a", 0, "a"), "b": ("a", 1, "a/b"), "c": ("a", 2, "a/b/c")}


def test_store_upsert_creates_once(spark):
    known = spark.createDataFrame([(10, 1, "Shop")], "id long, user_id long, name string")
    batch = spark.createDataFrame([(1, "Shop"), (1, "New"), (1, "New"), (2, "Shop")], "user_id long, name string")
    rows = {(r["user_id"], r["name"]): (r["store_key"], r["is_new"]) for r in ledger.store_upsert(known, batch).collect()}
    assert len(rows) == 3 and rows[(1, "Shop")] == ("10", False)
    assert rows[(1, "New")][1] and rows[(2, "Shop")][1] and rows[(1, "New")][0] != rows[(2, "Shop")][0]


def test_auto_confirmed_keeps_null_predictions(spark):
    tx = spark.createDataFrame([(1, "a", None), (2, "a", "a"), (3, "a", "b"), (4, None, "a")],
                               "id long, category string, predicted string")
    assert sorted(r["id"] for r in fbk.auto_confirmed(tx).collect()) == [1, 2]
    acc = fbk.feedback_accuracy(tx.withColumn("user_id", F.lit(1))).first()
    assert acc["n"] == 3 and abs(acc["accuracy"] - 1 / 3) < 1e-12  # NULL prediction counts as wrong


def test_training_set_feedback_wins(spark):
    auto = spark.createDataFrame([(1, 7, "a"), (2, 7, "b")], "transaction_id long, user_id long, label string")
    fb = spark.createDataFrame([(2, 7, "c"), (3, 7, "d")], "transaction_id long, user_id long, label string")
    got = {r["transaction_id"]: (r["label"], r["source"]) for r in fbk.training_set(auto, fb).collect()}
    assert got == {1: ("a", "auto_confirmed"), 2: ("c", "user_feedback"), 3: ("d", "user_feedback")}


def test_retrain_due_reasons(spark):
    t0 = dt.datetime(2024, 1, 10)
    ex = spark.createDataFrame([(1, t0 + dt.timedelta(hours=i)) for i in range(12)]
                               + [(2, t0)] + [(3, t0)], "user_id long, created_at timestamp")
    runs = spark.createDataFrame([(1, t0 - dt.timedelta(hours=1), 1), (2, t0 + dt.timedelta(hours=1), 2)],
                                 "user_id long, trained_at timestamp, run_id long")
    out = {r["user_id"]: (r["n_new"], r["reason"], r["due"]) for r in
           fbk.retrain_due(ex, runs, F.lit(t0 + dt.timedelta(hours=12)).cast("timestamp")).collect()}
    assert out[1] == (12, "feedback_threshold", True)
    assert out[2] == (0, None, False)          # trained 11 h ago, nothing new
    assert out[3] == (1, "periodic", True)     # never trained


def test_acceptance_denominators(spark):
    tx = spark.createDataFrame([(1, "a", "a"), (1, "a", "b"), (1, "b", None), (1, "b", "b")],
                               "user_id long, category string, predicted string")
    d = fbk.acceptance_from_transactions(tx).first()
    assert (d["n_predicted"], d["acceptance_rate"], d["correction_rate"]) == (3, 2 / 3, 1 / 3)
    assert (d["n_all"], d["acceptance_rate_all"], d["correction_rate_all"]) == (4, 0.5, 0.25)


def test_plan_shapes_topk_and_validation(spark):
    from labelfold.operators import quality
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), F.col("id").alias("v"))
    top = ledger.latest_per_group(df, ["g"], [F.col("v").desc()], k=3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert top.count() == 21
    prof = quality.validate_profile(spark.createDataFrame([("a", "x"), ("b", "y")],
                                                          "product_title string, category string"))
    p2 = prof._jdf.queryExecution().executedPlan().toString()
    assert p2.count("HashAggregate") + p2.count("ObjectHashAggregate") + p2.count("SortAggregate") <= 4
