"""Ledger analytics over the finance schema (JOIN-5..8, AGG-13/14/28, JSON-2, SORT-6).

Balances are a union of signed movements followed by one aggregation, so
transfers add rows rather than joins.  Dimension joins (accounts, stores,
categories) are plain equi-joins: AQE broadcasts them when their measured
size is small and keeps a shuffle join otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

ITEM_SCHEMA = "array<struct<part:bigint,quantity:double,amount:double>>"
PAYLOAD_SCHEMA = f"struct<date:string,items:{ITEM_SCHEMA}>"


def movements(transactions: DataFrame, transfers: DataFrame | None = None) -> DataFrame:
    """Signed money movements per account: income +, expense −, transfers out/in."""
    m = transactions.select(
        "account_id",
        F.when(F.col("type") == "income", F.col("amount"))
         .when(F.col("type") == "expense", -F.col("amount")).otherwise(F.lit(0))
         .cast("decimal(18,2)").alias("delta"))
    if transfers is not None:
        out = transfers.select(F.col("from_account_id").alias("account_id"),
                               (-(F.col("amount") + F.coalesce("fee", F.lit(0))))
                               .cast("decimal(18,2)").alias("delta"))
        inn = transfers.select(F.col("to_account_id").alias("account_id"),
                               F.col("amount").cast("decimal(18,2)").alias("delta"))
        m = m.unionByName(out).unionByName(inn)
    return m


def account_balance(accounts: DataFrame, transactions: DataFrame,
                    transfers: DataFrame | None = None) -> DataFrame:
    """SUM(income) − SUM(expense) per account, 0 for accounts without rows (AGG-13).

    ``transfers`` adds amount out + fee out and amount in (the option).
    """
    agg = (movements(transactions, transfers).groupBy("account_id")
           .agg(F.sum("delta").alias("balance"), F.count(F.lit(1)).alias("n_movements")))
    return (accounts.select(F.col("id").alias("account_id"))
            .join(agg, "account_id", "left")
            .select("account_id",
                    F.coalesce("balance", F.lit(0).cast("decimal(18,2)")).alias("balance"),
                    F.coalesce("n_movements", F.lit(0)).cast("bigint").alias("n_movements")))


def receipt_items(receipts: DataFrame) -> DataFrame:
    """Parse the OCR payload: one row per item, receipts without items kept (JSON-2)."""
    p = receipts.withColumn("_p", F.from_json("extracted_data", PAYLOAD_SCHEMA))
    return p.select("receipt_id", F.col("_p.date").alias("receipt_date"),
                    F.explode_outer("_p.items").alias("item")).select(
        "receipt_id", "receipt_date", F.col("item.part").alias("part"),
        F.col("item.quantity").alias("quantity"), F.col("item.amount").alias("amount"))


def receipt_groups(items: DataFrame) -> DataFrame:
    """Transaction-group total = sum of item amounts per receipt (AGG-14)."""
    return items.groupBy("receipt_id").agg(
        F.count("part").alias("n_items"),
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total_amount"))


def receipt_status(receipts: DataFrame) -> DataFrame:
    """Receipts per processing status (AGG-28)."""
    return receipts.groupBy("processing_status").agg(F.count(F.lit(1)).alias("n"))


def transaction_tags(transactions: DataFrame, bridge: DataFrame) -> DataFrame:
    """Tags per transaction through the many-to-many bridge (JOIN-6)."""
    tags = (bridge.groupBy("transaction_id")
            .agg(F.array_sort(F.collect_set("tag")).alias("tags")))
    return (transactions.select(F.col("id").alias("transaction_id"), "account_id")
            .join(tags, "transaction_id")
            .select("transaction_id", "account_id", F.size("tags").cast("bigint").alias("n_tags"),
                    F.array_join("tags", ",").alias("tags")))


def tree_paths(nodes: DataFrame) -> DataFrame:
    """Expand an (id, parent_id) hierarchy of any depth: (id, root_id, depth, path) (JOIN-7).

    Pointer doubling: each node knows an ancestor and the path below it; joining
    the pointers with themselves doubles their reach, so a tree of depth d takes
    log2(d) rounds, each one written table.  Nodes on or below a cycle, and below
    a missing parent, have no root: ``tree_faults`` reports them.
    """
    return _tree(nodes)[0]


def tree_faults(nodes: DataFrame) -> DataFrame:
    """(id, fault) of the nodes without a root: ``missing parent`` or ``cycle``."""
    return _tree(nodes)[1]


def _tree(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    n = nodes.select("id", "parent_id")
    roots = n.filter("parent_id is null").select("id", F.col("id").alias("root_id"), F.lit(0).alias("depth"), F.col("id").cast("string").alias("path"))
    known = n.select(F.col("id").alias("parent_id"), F.lit(True).alias("_known"), F.col("parent_id").isNull().alias("_top"))
    j = n.filter("parent_id is not null").join(known, "parent_id", "left")
    # state: open (the pointer's target is no root yet), done, or lost (a missing parent)
    now = materialize(j.select("id", F.col("parent_id").alias("up"), F.lit(1).alias("steps"), F.col("id").cast("string").alias("tail"),
                               F.when(F.col("_known").isNull(), "lost").when(F.col("_top"), "done").otherwise("open").alias("state")), "tree")
    closed = now.filter("state <> 'open'")
    now = now.filter("state = 'open'")
    left = now.count()
    while left:
        reach = now.unionByName(closed).select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"),
                                               F.col("tail").alias("tail2"), F.col("state").alias("state2"))
        step = now.drop("state").join(reach, "up")
        step = materialize(step.select("id", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"),
                                       F.concat_ws("/", "tail2", "tail").alias("tail"), F.col("state2").alias("state")), "tree")
        closed = closed.unionByName(step.filter("state <> 'open'"))
        now = step.filter("state = 'open'")
        before, left = left, now.count()
        if left == before:  # every round ends some node of a tree: what is left runs in circles
            break
    below = closed.filter("state = 'done'").select("id", F.col("up").alias("root_id"), F.col("steps").alias("depth"),
                                                   F.concat_ws("/", F.col("up").cast("string"), "tail").alias("path"))
    faults = closed.filter("state = 'lost'").select("id", F.lit("missing parent").alias("fault")).unionByName(
        now.select("id", F.lit("cycle").alias("fault")))
    return roots.unionByName(below), faults


def store_upsert(known: DataFrame, batch: DataFrame) -> DataFrame:
    """Find-or-create stores by (user_id, name) (JOIN-5).

    Existing ids are reused; a new name is created once even when it repeats
    in the batch (dropDuplicates before the anti join).  New keys are a
    deterministic digest so reruns after a lost executor give the same ids.
    """
    names = batch.select("user_id", "name").dropDuplicates(["user_id", "name"])
    k = known.select(F.col("id").alias("store_id"), "user_id", "name")
    found = names.join(k, ["user_id", "name"], "left")
    new_key = F.concat(F.lit("new-"), F.substring(
        F.md5(F.concat_ws("|", F.col("user_id").cast("string"), F.col("name"))), 1, 16))
    return found.select("user_id", "name",
                        F.coalesce(F.col("store_id").cast("string"), new_key).alias("store_key"),
                        F.col("store_id").isNull().alias("is_new"))


def latest_per_group(df: DataFrame, by: list[str], order: list, k: int = 1) -> DataFrame:
    """Top-k rows per group (SORT-5/6, WIN-6).  ``row_number() <= k`` lets Spark
    plan a WindowGroupLimit, which trims each group map-side before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
