import datetime as dt
from decimal import Decimal


from labelfold.sources import schemas


def test_all_ddl_parse(spark):
    for name, ddl in schemas.DDL.items():
        df = spark.createDataFrame([], ddl)
        assert len(df.columns) == len(ddl.split(", ")), name
    assert set(schemas.DDL) == {
        "users", "accounts", "categories", "stores", "receipts", "transaction_groups", "transactions",
        "tags", "transaction_tags", "transfers", "training_data", "user_classifier_models",
        "model_training_history", "feedback_events"}


def test_typed_scan_and_rules(spark, tmp_path):
    now = dt.datetime(2024, 1, 1)
    rows = [("t1", "a1", None, "income", Decimal("10.00"), "RUB", "coffee", None, None, dt.date(2024, 1, 1),
             "manual", None, None, None, now, now),
            ("t2", "a1", None, "refund", Decimal("5.00"), "RUBX", "tea", None, None, dt.date(2024, 1, 2),
             "fax", None, None, None, now, now)]
    # write with a relaxed schema, read back with the declared one
    relaxed = schemas.DDL["transactions"].replace(" NOT NULL", "")
    spark.createDataFrame(rows, relaxed).write.parquet(str(tmp_path / "tx"))
    tx = schemas.read_ledger_table(spark, str(tmp_path / "tx"), "transactions")
    assert dict(tx.dtypes)["amount"] == "decimal(15,2)"
    v = {r["rule"]: r["violations"] for r in schemas.quality_rules(tx, "transactions").collect()}
    assert v["type_code"] == 1 and v["currency_max_3"] == 1 and v["source_code"] == 1
    assert v["description_not_null"] == 0
    acc = spark.createDataFrame([("a2", "u1")], "id string, user_id string")
    orph = schemas.reference_violations({"transactions": tx, "accounts": acc}, "transactions")
    assert orph["account_id"].count() == 2
