"""Queries: scan, mapping, cleaning, validation, labels, splits, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import null_na_tokens
from ..operators import labels, metrics, quality, split
from ..sources import tables
from ..sources.columns import map_columns
from ..session import spread
from . import sqlgen as S
from .registry import r6, register

# --- SRC / PF / STR ------------------------------------------------------------------

register("scan_clean", S.with_roles(["products"], (
    f"SELECT doc_id, {S.na('product_title')} AS product_title, {S.na('category')} AS category "
    f"FROM products")))(
    lambda spark, d: tables.products(spark, d).select(
        "doc_id", null_na_tokens("product_title").alias("product_title"),
        null_na_tokens("category").alias("category")))


@register("autodetect_columns",
          "SELECT p_partkey, p_name AS product_title, p_type AS category FROM part")
def autodetect_columns(spark, d):
    # source names as a vendor file would have them; autodetect picks name / cat
    p = tables.read(spark, d, "part").select(
        "p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("cat"),
        F.col("p_brand").alias("label"), "p_size")
    return map_columns(p, None, keep=("p_partkey",))


@register("custom_mapping",
          "SELECT p_partkey, p_name AS product_title, p_brand AS category FROM part")
def custom_mapping(spark, d):
    p = tables.read(spark, d, "part")
    return map_columns(p, {"product_title": "p_name", "category": "p_brand"}, keep=("p_partkey",))


register("preprocess", S.with_roles(["products"], (
    f"SELECT doc_id, {S.clean('product_title')} AS product_title, {S.strip('category')} AS category "
    f"FROM products WHERE length({S.clean('product_title')}) > 0")))(
    lambda spark, d: quality.preprocess(spread(tables.products(spark, d), "doc_id")))

register("preprocess_punct", S.with_roles(["products"], (
    f"SELECT doc_id, {S.clean('product_title', True, True)} AS product_title, "
    f"{S.strip('category')} AS category FROM products "
    f"WHERE length({S.clean('product_title', True, True)}) > 0")))(
    lambda spark, d: quality.preprocess(spread(tables.products(spark, d), "doc_id"), punctuation=True))

register("preprocess_removed", S.with_roles(["products"], (
    f"SELECT category, count(*) AS n_before, "
    f"count(*) FILTER (WHERE length({S.clean('product_title', True, True)}) > 0) AS n_after, "
    f"count(*) - count(*) FILTER (WHERE length({S.clean('product_title', True, True)}) > 0) AS n_removed "
    f"FROM products GROUP BY category")))(
    lambda spark, d: quality.preprocess_removed(tables.products(spark, d), by=["category"],
                                                punctuation=True))


def _profile_sql(by: list[str], src: str) -> str:
    b = S.cols(by)
    num = lambda c: (f"(count(TRY_CAST({c} AS DOUBLE)) = count({c}) AND count({c}) > 0)")
    return (
        f"WITH p AS ({src}), q AS (SELECT {b}count(*) AS n_rows, "
        f"count(*) FILTER (WHERE product_title IS NULL) AS title_nulls, "
        f"count(*) FILTER (WHERE category IS NULL) AS category_nulls, "
        f"count(*) FILTER (WHERE length({S.strip('product_title')}) = 0) AS blank_titles, "
        f"count(*) FILTER (WHERE length({S.strip('category')}) = 0) AS blank_categories, "
        f"count(DISTINCT category) AS n_categories, "
        f"{num('product_title')} OR {num('category')} AS bad_type "
        f"FROM p {'GROUP BY ' + ', '.join(by) if by else ''}) "
        f"SELECT {b}n_rows, title_nulls, category_nulls, blank_titles, blank_categories, n_categories, "
        f"CASE WHEN n_rows = 0 THEN 'empty' WHEN title_nulls + category_nulls > 0 THEN 'nulls' "
        f"WHEN bad_type THEN 'type' WHEN blank_titles > 0 THEN 'blank_title' "
        f"WHEN blank_categories > 0 THEN 'blank_category' WHEN n_categories < 2 THEN 'too_few_categories' "
        f"ELSE 'ok' END AS status FROM q")


register("validate_profile", _profile_sql(
    [], "SELECT text AS product_title, lang AS category FROM documents"))(
    lambda spark, d: quality.validate_profile(tables.products(spark, d)))


@register("validate_by_user", _profile_sql(
    ["user_id"], "SELECT source AS user_id, text AS product_title, lang AS category FROM documents"))
def validate_by_user(spark, d):
    docs = tables.read(spark, d, "documents").select(
        F.col("source").alias("user_id"), F.col("text").alias("product_title"),
        F.col("lang").alias("category"))
    return quality.validate_profile(docs, by=["user_id"])


# --- labels ------------------------------------------------------------------------------

register("category_distribution", S.with_roles(["products"], (
    "SELECT category, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share "
    "FROM products WHERE category IS NOT NULL GROUP BY category")))(
    lambda spark, d: r6(labels.category_distribution(tables.products(spark, d))))


@register("encode_labels", S.with_roles(["products"], (
    "SELECT doc_id, category, CAST(label_id AS INTEGER) AS label_id FROM products "
    "JOIN (SELECT category, row_number() OVER (ORDER BY category) - 1 AS label_id "
    "FROM (SELECT DISTINCT category FROM products WHERE category IS NOT NULL)) USING (category)")))
def encode_labels(spark, d):
    p = tables.products(spark, d)
    idx = labels.label_index(p)
    return labels.encode_labels(p.select("doc_id", "category"), idx)


register("class_weights", S.with_roles(["products"], (
    "SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS INTEGER) AS label_id, n, "
    "round(CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n), 6) AS weight "
    "FROM (SELECT category, count(*) AS n FROM products WHERE category IS NOT NULL GROUP BY category)")))(
    lambda spark, d: r6(labels.class_weights(tables.products(spark, d))))


_INDEX_SQL = ("(SELECT category, n, CAST(row_number() OVER (ORDER BY category) - 1 AS INTEGER) AS label_id, "
              "CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n) AS weight FROM (SELECT category, count(*) AS n "
              "FROM products WHERE category IS NOT NULL GROUP BY category))")


@register("label_lookup", S.with_roles(["products"], (
    f"SELECT p.doc_id, i.label_id, i.category AS label FROM products p JOIN {_INDEX_SQL} i USING (category)")))
def label_lookup(spark, d):
    """Label ids back to names through the index's lookup table (JOIN-2)."""
    p = tables.products(spark, d)
    idx = labels.label_index(p)
    ids = labels.encode_labels(p.select("doc_id", "category"), idx).select("doc_id", "label_id")
    names = labels.label_names(idx).select("label_id", F.col("category").alias("label"))
    return ids.join(names, "label_id").select("doc_id", "label_id", "label")


register("weighted_rows", S.with_roles(["products"], (
    f"SELECT p.doc_id, p.category, i.label_id, round(i.weight, 6) AS weight FROM products p LEFT JOIN {_INDEX_SQL} i "
    "USING (category)")))(
    lambda spark, d: r6(labels.attach_weights(tables.products(spark, d).select("doc_id", "category"),
                                              labels.class_weights(tables.products(spark, d)))
                        .select("doc_id", "category", "label_id", "weight")))


@register("label_map", S.with_roles(["products"], (
    f"SELECT CAST(label_id AS INTEGER) AS label_id, category AS label FROM {_INDEX_SQL}")))
def label_map(spark, d):
    """id → label map through its JSON form and back (MAP-1, JSON-1)."""
    as_json = labels.label_map_json(labels.label_index(tables.products(spark, d)))
    return labels.parse_label_map(as_json).select(F.explode("id_to_label").alias("label_id", "label"))


# --- splits -------------------------------------------------------------------------------

register("split_plan", (
    "WITH c AS (SELECT source, lang, count(*) AS c FROM documents GROUP BY ALL), "
    "g AS (SELECT source, sum(c) AS n_rows, count(*) AS n_classes, min(c) AS min_class_rows "
    "FROM c GROUP BY source), h AS (SELECT *, CAST(ceil(n_rows * 0.2) AS BIGINT) AS n_test FROM g) "
    "SELECT source, n_rows, n_classes, min_class_rows, n_test, "
    "(min_class_rows >= 2 AND n_test >= n_classes AND n_rows - n_test >= n_classes) AS can_stratify, "
    f"CAST(ceil((n_rows - n_test) * {0.1 / 0.8!r}) AS BIGINT) AS n_val, "
    f"n_rows - n_test - CAST(ceil((n_rows - n_test) * {0.1 / 0.8!r}) AS BIGINT) AS n_train FROM h"))(
    lambda spark, d: split.split_plan(tables.read(spark, d, "documents"), label="lang",
                                      by=["source"]))


def _split_sql(role: str, key: str, stratify: bool, by=()) -> str:
    ctes = [("src", f"SELECT * FROM {role}")] + S.split_ctes(key, "category", by, 0.2, 0.1, 42, stratify)
    return S.with_roles([role], f"SELECT {key}, split FROM assigned", ctes)


register("split_random", _split_sql("products", "doc_id", False))(
    lambda spark, d: split.split_random(tables.products(spark, d), "doc_id").select("doc_id", "split"))

register("split_stratified", _split_sql("products_short", "p_partkey", True))(
    lambda spark, d: split.split_stratified(tables.products_short(spark, d), "p_partkey")
    .select("p_partkey", "split"))


# --- metrics over a scored frame -----------------------------------------------------------

def _metric_sql(body: str, by=(), role="scored", extra=()) -> str:
    ctes = [("src", f"SELECT * FROM {role}")] + S.per_class_ctes(by) + list(extra)
    return S.with_roles([role], body, ctes)


register("evaluate", _metric_sql(S.evaluate_select([], "weighted")))(
    lambda spark, d: r6(metrics.evaluate(tables.scored(spark, d))))

register("evaluate_micro", _metric_sql(S.evaluate_select([], "micro")))(
    lambda spark, d: r6(metrics.evaluate(tables.scored(spark, d), average="micro")))

register("eval_confidence", _metric_sql(
    "SELECT e.*, round(c.hca, 6) AS high_confidence_accuracy, c.high_confidence_count, "
    "round(c.hcr, 6) AS high_confidence_ratio, round(c.mean_confidence, 6) AS mean_confidence, "
    "round(c.median_confidence, 6) AS median_confidence, round(c.min_confidence, 6) AS min_confidence, "
    "round(c.max_confidence, 6) AS max_confidence FROM ev e, cs c",
    extra=[("ev", S.evaluate_select([], "weighted")),
           ("cs", "SELECT CASE WHEN count(*) FILTER (WHERE confidence >= 0.5) > 0 THEN "
                  "(count(*) FILTER (WHERE confidence >= 0.5 AND y_true = y_pred)) / "
                  "(count(*) FILTER (WHERE confidence >= 0.5)) END AS hca, "
                  "CAST(count(*) FILTER (WHERE confidence >= 0.5) AS BIGINT) AS high_confidence_count, "
                  "(count(*) FILTER (WHERE confidence >= 0.5)) / count(*) AS hcr, "
                  "avg(confidence) AS mean_confidence, median(confidence) AS median_confidence, "
                  "min(confidence) AS min_confidence, max(confidence) AS max_confidence FROM src")]))(
    lambda spark, d: r6(metrics.evaluate_with_confidence(tables.scored(spark, d))))

register("classification_report", _metric_sql(
    "SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, "
    "CAST(support AS BIGINT) AS support FROM pc "
    "UNION ALL SELECT 'accuracy', NULL, NULL, round(correct / n, 6), CAST(s_sup AS BIGINT) FROM tot, av "
    "UNION ALL SELECT 'macro avg', round(macro_precision, 6), round(macro_recall, 6), round(macro_f1, 6), "
    "CAST(s_sup AS BIGINT) FROM av "
    "UNION ALL SELECT 'weighted avg', round(w_precision, 6), round(w_recall, 6), round(w_f1, 6), "
    "CAST(s_sup AS BIGINT) FROM av"))(
    lambda spark, d: r6(metrics.classification_report(tables.scored(spark, d))))

register("min_category_precision", _metric_sql(
    "SELECT round(min(precision), 6) AS min_precision, min(precision) >= 0.75 AS meets_target, "
    "count(*) AS n_categories FROM pc WHERE support > 0"))(
    lambda spark, d: r6(metrics.min_category_precision(tables.scored(spark, d))))

register("confusion_matrix", _metric_sql(
    "SELECT a.label AS y_true, b.label AS y_pred, CAST(coalesce(ct.n, 0) AS BIGINT) AS n "
    "FROM pc a JOIN pc b ON TRUE LEFT JOIN ct ON ct.y_true = a.label AND ct.y_pred = b.label"))(
    lambda spark, d: metrics.confusion_matrix(tables.scored(spark, d)))


@register("metrics_by_user", _metric_sql(
    "SELECT * FROM (SELECT user_id, CAST(n AS BIGINT) AS n, round(correct / n, 6) AS accuracy, "
    "round(macro_f1, 6) AS macro_f1, round(w_f1, 6) AS weighted_f1 FROM tot JOIN av USING (user_id)) "
    "UNION ALL SELECT '__all__', count(*), round(avg(correct / n), 6), round(avg(macro_f1), 6), "
    "round(avg(w_f1), 6) FROM tot JOIN av USING (user_id)",
    by=["user_id"], role="scored_by_user"))
def metrics_by_user(spark, d):
    s = tables.scored_by_user(spark, d)
    ev = metrics.evaluate(s, by=["user_id"], average="weighted").select(
        "user_id", "n", "accuracy", "macro_f1", F.col("f1").alias("weighted_f1"))
    allu = ev.agg(F.lit("__all__").alias("user_id"), F.count(F.lit(1)).alias("n"),
                  F.avg("accuracy").alias("accuracy"), F.avg("macro_f1").alias("macro_f1"),
                  F.avg("weighted_f1").alias("weighted_f1"))
    return r6(ev.unionByName(allu))
