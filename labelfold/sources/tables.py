"""Supplied parquet tables and the roles they play (FIXTURES.md §3).

Each role is a lazy projection of the supplied tables; Catalyst prunes the
columns into the parquet scan and pushes filters down.  Nothing here collects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- text classification roles ------------------------------------------------

def products(spark, sf_dir) -> DataFrame:
    """documents as a labelled product table: (doc_id, product_title, category)."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("text").alias("product_title"),
                    F.col("lang").alias("category"))


def products_short(spark, sf_dir) -> DataFrame:
    """part as short titles with 6 even classes: (p_partkey, product_title, category)."""
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", F.col("p_name").alias("product_title"),
                    F.col("p_type").alias("category"))


def vectors(spark, sf_dir) -> DataFrame:
    """embeddings: (vec_id, embedding ARRAY<FLOAT>, label INT)."""
    return read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def scored(spark, sf_dir) -> DataFrame:
    """A deterministic scored frame: (doc_id, y_true, y_pred, confidence).

    ``xx`` is never a true label, so metrics must run over the label union.
    """
    return _scored(spark, sf_dir)


def _scored(spark, sf_dir, *more) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    y_pred = (F.when(F.col("doc_id") % 11 == 0, F.lit("xx"))
              .when(F.col("doc_id") % 7 == 0, F.lit("en"))
              .otherwise(F.col("lang")))
    conf = ((F.col("doc_id") * 37) % 101).cast("double") / 100.0
    return d.select("doc_id", F.col("lang").alias("y_true"), y_pred.alias("y_pred"),
                    conf.alias("confidence"), *more)


def scored_by_user(spark, sf_dir) -> DataFrame:
    return _scored(spark, sf_dir, F.col("source").alias("user_id"))


# --- ledger roles ---------------------------------------------------------------

def accounts(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"),
                    F.col("c_nationkey").cast("bigint").alias("user_id"),
                    F.col("c_name").alias("name"))


def transactions(spark, sf_dir) -> DataFrame:
    """orders ⋈ customer as ledger transactions."""
    o = read(spark, sf_dir, "orders")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    predicted = (F.when(F.col("o_orderkey") % 5 == 0, F.lit(None).cast("string"))
                 .when(F.col("o_orderkey") % 5 == 1, F.lit("3-MEDIUM"))
                 .otherwise(F.col("o_orderpriority")))
    return (o.join(c, o.o_custkey == c.c_custkey)
            .select(F.col("o_orderkey").alias("id"),
                    F.col("o_custkey").alias("account_id"),
                    F.col("c_nationkey").cast("bigint").alias("user_id"),
                    F.when(F.col("o_orderstatus") == "F", "income")
                     .otherwise("expense").alias("type"),
                    F.col("o_totalprice").cast("decimal(15,2)").alias("amount"),
                    F.col("o_orderpriority").alias("category"),
                    predicted.alias("predicted"),
                    F.to_date("o_orderdate").alias("transaction_date")))


def transfers(spark, sf_dir) -> DataFrame:
    """Orders with status P as transfers to the next customer (mod #customers)."""
    o = read(spark, sf_dir, "orders")
    n_customers = read(spark, sf_dir, "customer").select(F.count("*")).scalar()
    return (o.filter(F.col("o_orderstatus") == "P")
            .select(F.col("o_orderkey").alias("id"),
                    F.col("o_custkey").alias("from_account_id"),
                    ((F.col("o_custkey") + 1) % n_customers).alias("to_account_id"),
                    F.col("o_totalprice").cast("decimal(15,2)").alias("amount"),
                    F.round(F.col("o_totalprice").cast("decimal(15,2)") * F.lit(0.01).cast("decimal(3,2)"), 2)
                    .cast("decimal(15,2)").alias("fee")))


RECEIPT_STATUS = {"F": "completed", "O": "pending", "P": "processing"}


def receipts(spark, sf_dir) -> DataFrame:
    """One receipt per order with its items as an OCR-style JSON payload."""
    li = read(spark, sf_dir, "lineitem")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    items = (li.groupBy("l_orderkey")
             .agg(F.collect_list(F.struct(
                 F.col("l_partkey").alias("part"),
                 F.col("l_quantity").alias("quantity"),
                 F.col("l_extendedprice").alias("amount"))).alias("items")))
    status = (F.when(F.col("o_orderstatus") == "F", RECEIPT_STATUS["F"])
              .when(F.col("o_orderstatus") == "O", RECEIPT_STATUS["O"])
              .when(F.col("o_orderstatus") == "P", RECEIPT_STATUS["P"])
              .otherwise("failed"))
    payload = F.to_json(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), "items"))
    return (o.join(items, o.o_orderkey == items.l_orderkey, "left")
            .select(F.col("o_orderkey").alias("receipt_id"),
                    status.alias("processing_status"),
                    payload.alias("extracted_data")))


def tree(spark, sf_dir) -> DataFrame:
    """region → nation → customer as one (id, parent_id, name) hierarchy."""
    r = read(spark, sf_dir, "region").select(
        F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"),
        F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"))
    n = read(spark, sf_dir, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"),
        F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"),
        F.col("n_name").alias("name"))
    c = read(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"),
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent_id"),
        F.col("c_name").alias("name"))
    return r.unionByName(n).unionByName(c)


def tags(spark, sf_dir) -> DataFrame:
    """transaction_tags bridge: (transaction_id, tag), a pair may repeat; ``ledger.transaction_tags`` dedupes once."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("transaction_id"),
                     F.col("l_returnflag").alias("tag"))


def stores_known(spark, sf_dir) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    return (s.filter(F.col("s_suppkey") % 2 == 0)
            .select(F.col("s_suppkey").alias("id"),
                    F.col("s_nationkey").cast("bigint").alias("user_id"),
                    F.col("s_name").alias("name")))


def stores_batch(spark, sf_dir) -> DataFrame:
    """Store names seen in a batch of receipts: one row per line item."""
    li = read(spark, sf_dir, "lineitem").select("l_suppkey")
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_name")
    return li.join(s, li.l_suppkey == s.s_suppkey).select(
        F.col("s_nationkey").cast("bigint").alias("user_id"), F.col("s_name").alias("name"))


# --- feedback / monitoring roles (events) -----------------------------------------

def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("int")


def feedback(spark, sf_dir) -> DataFrame:
    """Prediction feedback events.

    purchase → confirmation, error → correction, view → rejection, click →
    a prediction without feedback (feedback_type NULL).
    """
    e = read(spark, sf_dir, "events").filter(
        F.col("event_type").isin("purchase", "error", "view", "click"))
    k = _k()
    ftype = (F.when(F.col("event_type") == "purchase", "confirmation")
             .when(F.col("event_type") == "error", "correction")
             .when(F.col("event_type") == "view", "rejection"))
    predicted = (k % 5).cast("int")
    correct = F.when(F.col("event_type") == "error", ((k + 1) % 5).cast("int")).otherwise(predicted)
    return e.select(
        "event_id", "user_id",
        F.col("event_id").alias("transaction_id"),
        F.col("ts").cast("timestamp").alias("created_at"),
        ftype.alias("feedback_type"),
        # decimal(5,4) as declared for feedback_events: sums stay exact in every engine
        (k.cast("double") / 100.0).cast("decimal(5,4)").alias("prediction_confidence"),
        predicted.alias("predicted_category_id"),
        correct.alias("correct_category_id"),
        (k >= 5).alias("is_used_for_training"))


def training_runs(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events").filter(F.col("event_type") == "signup")
    return e.select(F.col("event_id").alias("run_id"), "user_id",
                    F.col("ts").cast("timestamp").alias("trained_at"),
                    F.lit("completed").alias("status"),
                    F.floor("value").cast("bigint").alias("duration_seconds"))


def request_log(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"),
                    F.col("value").alias("latency_ms"),
                    (F.col("event_type") == "error").alias("is_error"))
