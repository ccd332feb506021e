"""Queries: ledger schema (balances, receipts, tags, trees, stores, data quality)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import ledger, quality
from ..session import checkpoint_path
from ..sources import tables
from ..sources.commits import TableSet
from ..sources.store_table import merge_stores, stores
from . import sqlgen as S
from .registry import r6, register

_BAL_SQL = (
    "SELECT a.id AS account_id, round(CAST(coalesce(sum(m.delta), 0) AS DOUBLE), 6) AS balance, "
    "CAST(count(m.delta) AS BIGINT) AS n_movements FROM accounts a LEFT JOIN ({moves}) m "
    "ON m.account_id = a.id GROUP BY a.id")
_TX_MOVES = ("SELECT account_id, CASE WHEN type = 'income' THEN amount WHEN type = 'expense' "
             "THEN -amount ELSE 0 END AS delta FROM transactions")

register("account_balance", S.with_roles(["accounts", "transactions"],
                                         _BAL_SQL.format(moves=_TX_MOVES)))(
    lambda spark, d: r6(ledger.account_balance(
        tables.accounts(spark, d), tables.transactions(spark, d))))

register("account_balance_transfers", S.with_roles(
    ["accounts", "transactions", "transfers"], _BAL_SQL.format(moves=(
        _TX_MOVES + " UNION ALL SELECT from_account_id, -(amount + coalesce(fee, 0)) FROM transfers "
        "UNION ALL SELECT to_account_id, amount FROM transfers"))))(
    lambda spark, d: r6(ledger.account_balance(
        tables.accounts(spark, d), tables.transactions(spark, d), tables.transfers(spark, d))))

register("receipt_items", (
    "SELECT o_orderkey AS receipt_id, strftime(o_orderdate, '%Y-%m-%d') AS receipt_date, "
    "l_partkey AS part, l_quantity AS quantity, l_extendedprice AS amount "
    "FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey"))(
    lambda spark, d: r6(ledger.receipt_items(tables.receipts(spark, d))))

register("receipt_groups", (
    "SELECT o_orderkey AS receipt_id, CAST(count(l_partkey) AS BIGINT) AS n_items, "
    "round(coalesce(sum(l_extendedprice), 0.0), 6) AS total_amount "
    "FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"))(
    lambda spark, d: r6(ledger.receipt_groups(ledger.receipt_items(tables.receipts(spark, d)))))

register("receipt_status", (
    "SELECT CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' "
    "WHEN 'P' THEN 'processing' ELSE 'failed' END AS processing_status, count(*) AS n "
    "FROM orders GROUP BY ALL"))(
    lambda spark, d: ledger.receipt_status(tables.receipts(spark, d)))

register("tx_tags", S.with_roles(["transactions"], (
    "SELECT id AS transaction_id, account_id, CAST(count(DISTINCT l_returnflag) AS BIGINT) AS n_tags, "
    "string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS tags "
    "FROM transactions JOIN lineitem ON l_orderkey = id GROUP BY id, account_id")))(
    lambda spark, d: ledger.transaction_tags(tables.transactions(spark, d), tables.tags(spark, d)))

register("tree_paths", (
    "WITH RECURSIVE nodes AS ("
    "SELECT 'r' || r_regionkey AS id, NULL AS parent_id FROM region UNION ALL "
    "SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL "
    "SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer), "
    "p(id, root_id, depth, path) AS (SELECT id, id, 0, id FROM nodes WHERE parent_id IS NULL "
    "UNION ALL SELECT n.id, p.root_id, p.depth + 1, p.path || '/' || n.id FROM nodes n "
    "JOIN p ON n.parent_id = p.id) "
    "SELECT id, root_id, depth, path FROM p"))(
    lambda spark, d: ledger.tree_paths(tables.tree(spark, d)))

_LEDGER_DETAIL_SQL = (S.with_roles(["transactions", "accounts"], (
    "SELECT t.id, a.name AS account_name, n.n_name AS user_name, t.type, "
    "round(CAST(t.amount AS DOUBLE), 6) AS amount, t.category, "
    "CASE o.o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' "
    "WHEN 'P' THEN 'processing' ELSE 'failed' END AS receipt_status "
    "FROM transactions t JOIN accounts a ON a.id = t.account_id "
    "LEFT JOIN nation n ON n.n_nationkey = t.user_id "
    "LEFT JOIN orders o ON o.o_orderkey = t.id")))


@register("ledger_detail", _LEDGER_DETAIL_SQL)
def ledger_detail(spark, d):
    """receipt → transaction → account → user (nation) detail rows (JOIN-8)."""
    t = tables.transactions(spark, d)
    a = tables.accounts(spark, d).select(F.col("id").alias("account_id"),
                                         F.col("name").alias("account_name"))
    n = tables.read(spark, d, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("user_id"), F.col("n_name").alias("user_name"))
    r = tables.receipts(spark, d).select(F.col("receipt_id").alias("id"),
                                         F.col("processing_status").alias("receipt_status"))
    out = (t.join(a, "account_id").join(n, "user_id", "left").join(r, "id", "left")
           .select("id", "account_name", "user_name", "type", "amount", "category",
                   "receipt_status"))
    return r6(out)


register("tx_listing", S.with_roles(["transactions"], (
    "SELECT account_id, id, transaction_date, round(CAST(amount AS DOUBLE), 6) AS amount, rn FROM ("
    "SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY transaction_date DESC, id) AS rn "
    "FROM transactions) WHERE rn <= 5")))(
    lambda spark, d: r6(ledger.latest_per_group(
        tables.transactions(spark, d), ["account_id"],
        [F.col("transaction_date").desc(), F.col("id")], k=5)
        .select("account_id", "id", "transaction_date", "amount", "rn")))

register("store_upsert", (
    "WITH names AS (SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS user_id, s_name AS name "
    "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), "
    "known AS (SELECT s_suppkey AS store_id, CAST(s_nationkey AS BIGINT) AS user_id, s_name AS name "
    "FROM supplier WHERE s_suppkey % 2 = 0) "
    "SELECT user_id, name, coalesce(CAST(store_id AS VARCHAR), "
    "'new-' || substr(md5(CAST(user_id AS VARCHAR) || '|' || name), 1, 16)) AS store_key, "
    "store_id IS NULL AS is_new FROM names LEFT JOIN known USING (user_id, name)"))(
    lambda spark, d: ledger.store_upsert(tables.stores_known(spark, d), tables.stores_batch(spark, d)))


@register("store_merge", (
    "WITH known AS (SELECT CAST(s_nationkey AS BIGINT) AS user_id, s_name AS name, CAST(min(s_suppkey) AS VARCHAR) AS store_key "
    "FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY ALL), "
    "seen AS (SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS user_id, s_name AS name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) "
    "SELECT * FROM known UNION ALL SELECT user_id, name, 'new-' || md5(CAST(user_id AS VARCHAR) || '|' || name) "
    "FROM seen ANTI JOIN known USING (user_id, name)"))
def store_merge(spark, d):
    """The stored table after the known stores and a batch of receipts' names were merged into it (JOIN-5)."""
    table = TableSet(spark, checkpoint_path(spark, f"stores-{uuid.uuid4().hex[:12]}"))
    known = tables.stores_known(spark, d)
    merge_stores(table, known.select("user_id", "name", F.col("id").cast("string").alias("store_key")))
    merge_stores(table, tables.stores_batch(spark, d))
    return stores(table)


# --- data quality ------------------------------------------------------------------------

register("dq_unique", (
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem "
    "GROUP BY ALL HAVING count(*) > 1"))(
    lambda spark, d: quality.duplicated_keys(
        tables.read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]))

_DQ_ORPHANS_SQL = (
    "SELECT 'lineitem.l_partkey' AS relation, count(*) AS orphans FROM lineitem "
    "WHERE l_partkey IS NOT NULL AND l_partkey NOT IN (SELECT p_partkey FROM part) UNION ALL "
    "SELECT 'lineitem.l_suppkey', count(*) FROM lineitem WHERE l_suppkey IS NOT NULL "
    "AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL "
    "SELECT 'orders.o_custkey', count(*) FROM orders WHERE o_custkey IS NOT NULL "
    "AND o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL "
    "SELECT 'labels.doc_id', count(*) FROM labels WHERE doc_id IS NOT NULL "
    "AND doc_id NOT IN (SELECT doc_id FROM documents)")


@register("dq_orphans", _DQ_ORPHANS_SQL)
def dq_orphans(spark, d):
    """Count of dangling references per relation (DQ-3)."""
    rd = lambda n: tables.read(spark, d, n)
    checks = [("lineitem.l_partkey", rd("lineitem"), "l_partkey", rd("part"), "p_partkey"),
              ("lineitem.l_suppkey", rd("lineitem"), "l_suppkey", rd("supplier"), "s_suppkey"),
              ("orders.o_custkey", rd("orders"), "o_custkey", rd("customer"), "c_custkey"),
              ("labels.doc_id", rd("labels"), "doc_id", rd("documents"), "doc_id")]
    parts = [quality.orphans(c.select(fk), fk, p, pk).agg(
        F.lit(name).alias("relation"), F.count(F.lit(1)).alias("orphans"))
        for name, c, fk, p, pk in checks]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_TX_RULES_SQL = (
    "SELECT 'transactions' AS table_name, rule, violations FROM (SELECT "
    "count(*) FILTER (WHERE type IS NULL OR type NOT IN ('income', 'expense')) AS type_code, "
    "count(*) FILTER (WHERE amount IS NULL) AS amount_not_null, "
    "count(*) FILTER (WHERE amount <= 0) AS amount_positive, "
    "count(*) FILTER (WHERE length(category) > 100) AS category_length, "
    "count(*) FILTER (WHERE transaction_date IS NULL) AS date_not_null FROM transactions) "
    "UNPIVOT (violations FOR rule IN (type_code, amount_not_null, amount_positive, category_length, "
    "date_not_null)) UNION ALL "
    "SELECT 'feedback_events', rule, violations FROM (SELECT "
    "count(*) FILTER (WHERE feedback_type IS NOT NULL AND feedback_type NOT IN "
    "('confirmation', 'correction', 'rejection')) AS feedback_type_code, "
    "count(*) FILTER (WHERE prediction_confidence < 0 OR prediction_confidence > 1) AS confidence_range, "
    "count(*) FILTER (WHERE feedback_type = 'correction' AND correct_category_id = predicted_category_id) "
    "AS correction_changes_label FROM feedback) "
    "UNPIVOT (violations FOR rule IN (feedback_type_code, confidence_range, correction_changes_label))")


@register("dq_rules", S.with_roles(["transactions", "feedback"], _TX_RULES_SQL))
def dq_rules(spark, d):
    """NOT NULL, length and code-list rules stacked to (table, rule, violations) (DQ-4)."""
    t = tables.transactions(spark, d)
    tx = quality.rule_violations(t, "transactions", {
        "type_code": F.col("type").isNull() | ~F.col("type").isin("income", "expense"),
        "amount_not_null": F.col("amount").isNull(),
        "amount_positive": F.col("amount") <= 0,
        "category_length": F.length("category") > 100,
        "date_not_null": F.col("transaction_date").isNull(),
    })
    fb = tables.feedback(spark, d)
    fe = quality.rule_violations(fb, "feedback_events", {
        "feedback_type_code": F.col("feedback_type").isNotNull()
        & ~F.col("feedback_type").isin("confirmation", "correction", "rejection"),
        "confidence_range": (F.col("prediction_confidence") < 0) | (F.col("prediction_confidence") > 1),
        "correction_changes_label": (F.col("feedback_type") == "correction")
        & (F.col("correct_category_id") == F.col("predicted_category_id")),
    })
    return tx.unionByName(fe)
