"""Queries: training rows, feedback quality, monitoring, retraining state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feedback as fbk
from ..operators import split
from ..operators.metrics import _join_one
from ..sources import tables
from . import sqlgen as S
from .registry import r6, register

TS_FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
TS_SQL = "'%Y-%m-%d %H:%M:%S.%f'"


def _ts(c: str) -> F.Column:
    return F.date_format(F.col(c), TS_FMT)


register("training_auto_confirmed", S.with_roles(["transactions"], (
    "SELECT id AS transaction_id, user_id, category AS label, 'auto_confirmed' AS source "
    "FROM transactions WHERE category IS NOT NULL AND (predicted IS NULL OR predicted = category)")))(
    lambda spark, d: fbk.auto_confirmed(tables.transactions(spark, d)).select(
        F.col("id").alias("transaction_id"), "user_id", F.col("category").alias("label"),
        F.lit("auto_confirmed").alias("source")))

register("training_feedback", S.with_roles(["feedback"], (
    "SELECT transaction_id, user_id, correct_category_id AS label, 'user_feedback' AS source "
    "FROM feedback WHERE feedback_type = 'correction' AND is_used_for_training")))(
    lambda spark, d: fbk.corrections(tables.feedback(spark, d)).select(
        "transaction_id", "user_id", F.col("correct_category_id").alias("label"),
        F.lit("user_feedback").alias("source")))


@register("training_set", S.with_roles(["transactions"], (
    "SELECT id AS transaction_id, user_id, category AS label, CASE WHEN predicted IS NOT NULL "
    "AND predicted <> category THEN 'user_feedback' ELSE 'auto_confirmed' END AS source "
    "FROM transactions WHERE category IS NOT NULL")))
def training_set(spark, d):
    """auto-confirmed transactions ∪ transactions whose prediction the user corrected."""
    t = tables.transactions(spark, d).select(
        F.col("id").alias("transaction_id"), "user_id", "predicted", F.col("category").alias("label"))
    auto = fbk.auto_confirmed(t, label="label")
    corrected = t.filter(F.col("label").isNotNull() & F.col("predicted").isNotNull()
                         & (F.col("predicted") != F.col("label")))
    return fbk.training_set(auto, corrected)


register("eligible_users", S.with_roles(["transactions"], (
    "WITH c AS (SELECT user_id, category, count(*) AS n FROM transactions GROUP BY ALL) "
    "SELECT user_id, category, n FROM c WHERE n >= 50 AND user_id IN "
    "(SELECT user_id FROM c GROUP BY user_id HAVING sum(n) >= 100)")))(
    lambda spark, d: fbk.eligible(tables.transactions(spark, d)))

register("low_confidence_queue", S.with_roles(["feedback"], (
    "SELECT user_id, event_id, round(prediction_confidence, 6) AS prediction_confidence, rn FROM ("
    "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY prediction_confidence, event_id) AS rn "
    "FROM feedback WHERE prediction_confidence < 0.3) WHERE rn <= 5")))(
    lambda spark, d: r6(fbk.low_confidence_queue(tables.feedback(spark, d))
                        .select("user_id", "event_id", "prediction_confidence", "rn")))

_ACCEPT = "(feedback_type IS NULL OR feedback_type = 'confirmation')"

register("acceptance_rate", S.with_roles(["feedback"], (
    f"SELECT user_id, count(*) AS n, round(avg(CASE WHEN {_ACCEPT} THEN 1.0 ELSE 0.0 END), 6) "
    "AS acceptance_rate, round(avg(CASE WHEN feedback_type = 'correction' THEN 1.0 ELSE 0.0 END), 6) "
    "AS correction_rate, round(avg(CASE WHEN feedback_type = 'rejection' THEN 1.0 ELSE 0.0 END), 6) "
    f"AS rejection_rate, round(CAST(avg(CASE WHEN {_ACCEPT} THEN prediction_confidence END) AS DECIMAL(18,8)), 6) "
    "AS avg_confidence_accepted FROM feedback GROUP BY user_id")))(
    lambda spark, d: r6(fbk.acceptance(tables.feedback(spark, d))))

register("feedback_accuracy", S.with_roles(["transactions"], (
    "SELECT user_id, count(*) AS n, round(avg(CASE WHEN predicted = category THEN 1.0 ELSE 0.0 END), 6) "
    "AS accuracy FROM transactions WHERE category IS NOT NULL GROUP BY user_id")))(
    lambda spark, d: r6(fbk.feedback_accuracy(tables.transactions(spark, d))))

register("correction_distribution", S.with_roles(["feedback"], (
    "SELECT predicted_category_id AS from_category, correct_category_id AS to_category, count(*) AS n "
    "FROM feedback WHERE feedback_type = 'correction' GROUP BY ALL")))(
    lambda spark, d: fbk.correction_distribution(tables.feedback(spark, d)))

register("latency_slo", S.with_roles(["request_log"], (
    "SELECT count(*) AS n, round(avg(CASE WHEN is_error THEN 1.0 ELSE 0.0 END), 6) AS error_rate, "
    "round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms, "
    "round(quantile_cont(latency_ms, 0.99), 6) AS p99_ms FROM request_log")))(
    lambda spark, d: r6(fbk.latency_slo(tables.request_log(spark, d))))


@register("time_to_first", (
    "WITH c AS (SELECT user_id, min(ts) AS account_created FROM events WHERE event_type = 'signup' "
    "GROUP BY user_id), f AS (SELECT e.user_id, min(e.ts) AS first_prediction FROM events e "
    "JOIN c ON e.user_id = c.user_id WHERE e.event_type = 'view' AND e.ts >= c.account_created "
    "GROUP BY e.user_id) "
    f"SELECT user_id, strftime(account_created, {TS_SQL}) AS account_created, "
    f"strftime(first_prediction, {TS_SQL}) AS first_prediction, "
    "round(epoch(first_prediction) - epoch(account_created), 6) AS seconds_to_first "
    "FROM c LEFT JOIN f USING (user_id)"))
def time_to_first(spark, d):
    e = tables.read(spark, d, "events").select(
        "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    created = e.filter(F.col("event_type") == "signup").select(
        "user_id", F.col("ts").alias("created_at"))
    views = e.filter(F.col("event_type") == "view").select("user_id", "ts")
    out = fbk.time_to_first(created, views)
    return r6(out.select("user_id", _ts("account_created").alias("account_created"),
                         _ts("first_prediction").alias("first_prediction"), "seconds_to_first"))


register("ab_test", S.with_roles(["feedback"], (
    f"WITH g AS (SELECT CASE WHEN substr(md5(CAST(user_id AS VARCHAR)), 1, 1) < '8' THEN 'A' ELSE 'B' END "
    f"AS arm, user_id, CASE WHEN {_ACCEPT} THEN 1 ELSE 0 END AS acc FROM feedback), "
    "s AS (SELECT arm, count(DISTINCT user_id) AS users, count(*) AS n, sum(acc) AS acc FROM g GROUP BY arm), "
    "w AS (SELECT a.users AS users_a, b.users AS users_b, a.n AS n_a, b.n AS n_b, a.acc / a.n AS uar_a, "
    "b.acc / b.n AS uar_b, (a.acc + b.acc) / (a.n + b.n) AS pool FROM s a, s b WHERE a.arm = 'A' AND b.arm = 'B'), "
    "z AS (SELECT *, CASE WHEN sqrt(pool * (1 - pool) * (1.0 / n_a + 1.0 / n_b)) > 0 THEN (uar_a - uar_b) / "
    "sqrt(pool * (1 - pool) * (1.0 / n_a + 1.0 / n_b)) END AS z FROM w) "
    "SELECT users_a, users_b, n_a, n_b, round(uar_a, 6) AS uar_a, round(uar_b, 6) AS uar_b, "
    "round(z, 6) AS z, abs(z) > 1.959964 AS significant FROM z")))(
    lambda spark, d: r6(fbk.ab_test(tables.feedback(spark, d))))

_SLO_SQL = S.with_roles(["feedback", "transactions", "request_log"], (
    "WITH m AS (SELECT * FROM "
    f"(SELECT avg(CASE WHEN {_ACCEPT} THEN 1.0 ELSE 0.0 END) AS acceptance_rate, "
    "avg(CASE WHEN feedback_type = 'correction' THEN 1.0 ELSE 0.0 END) AS correction_rate, "
    f"avg(CASE WHEN {_ACCEPT} THEN prediction_confidence END) AS avg_confidence_correct FROM feedback), "
    "(SELECT avg(CASE WHEN predicted = category THEN 1.0 ELSE 0.0 END) AS accuracy_from_feedback "
    "FROM transactions WHERE category IS NOT NULL), "
    "(SELECT quantile_cont(latency_ms, 0.5) AS latency_p50_ms, quantile_cont(latency_ms, 0.95) AS latency_p95_ms, "
    "quantile_cont(latency_ms, 0.99) AS latency_p99_ms, avg(CASE WHEN is_error THEN 1.0 ELSE 0.0 END) "
    "AS error_rate FROM request_log)), "
    "t(metric, op, target) AS (VALUES " + ", ".join(
        f"('{m}', '{o}', {t!r})" for m, o, t in fbk.SLO_TARGETS) + "), "
    "l AS (UNPIVOT m ON COLUMNS(*) INTO NAME metric VALUE value) "
    "SELECT metric, round(value, 6) AS value, op, target, "
    "CASE WHEN op = '>=' THEN value >= target ELSE value <= target END AS pass FROM l JOIN t USING (metric)"))


@register("slo_check", _SLO_SQL)
def slo_check(spark, d):
    fb = fbk.acceptance(tables.feedback(spark, d), by=[]).select(
        "acceptance_rate", "correction_rate",
        F.col("avg_confidence_accepted").alias("avg_confidence_correct"))
    acc = fbk.feedback_accuracy(tables.transactions(spark, d), by=[]).select(
        F.col("accuracy").alias("accuracy_from_feedback"))
    lat = fbk.latency_slo(tables.request_log(spark, d)).select(
        F.col("p50_ms").alias("latency_p50_ms"), F.col("p95_ms").alias("latency_p95_ms"),
        F.col("p99_ms").alias("latency_p99_ms"), "error_rate")
    row = _join_one(_join_one(fb, acc), lat)
    return r6(fbk.slo_check(row))


@register("retrain_due", S.with_roles(["feedback", "training_runs"], (
    "WITH ex AS (SELECT user_id, created_at FROM feedback WHERE feedback_type IS NOT NULL "
    "AND is_used_for_training), last AS (SELECT user_id, max(trained_at) AS last_trained_at "
    "FROM training_runs GROUP BY user_id), users AS (SELECT user_id FROM ex UNION SELECT user_id FROM last), "
    "nw AS (SELECT ex.user_id, count(*) AS n_new FROM ex LEFT JOIN last USING (user_id) "
    "WHERE last_trained_at IS NULL OR created_at > last_trained_at GROUP BY ex.user_id), "
    "o AS (SELECT user_id, last_trained_at, CAST(coalesce(n_new, 0) AS BIGINT) AS n_new, "
    "(epoch((SELECT max(ts) FROM events)) - epoch(last_trained_at)) / 3600.0 AS hours_since "
    "FROM users LEFT JOIN last USING (user_id) LEFT JOIN nw USING (user_id)) "
    f"SELECT user_id, strftime(last_trained_at, {TS_SQL}) AS last_trained_at, n_new, "
    "round(hours_since, 6) AS hours_since, CASE WHEN n_new >= 10 THEN 'feedback_threshold' "
    "WHEN last_trained_at IS NULL OR hours_since >= 24.0 THEN 'periodic' END AS reason, "
    "(n_new >= 10 OR last_trained_at IS NULL OR hours_since >= 24.0) AS due FROM o")))
def retrain_due(spark, d):
    fb = tables.feedback(spark, d)
    ex = fb.filter(F.col("feedback_type").isNotNull() & F.col("is_used_for_training")).select(
        "user_id", "created_at")
    as_of = tables.read(spark, d, "events").select(F.max(F.col("ts").cast("timestamp"))).scalar()
    out = fbk.retrain_due(ex, tables.training_runs(spark, d), as_of)
    return r6(out.select("user_id", _ts("last_trained_at").alias("last_trained_at"), "n_new",
                         "hours_since", "reason", "due"))


register("active_model", S.with_roles(["training_runs"], (
    f"SELECT user_id, run_id, strftime(trained_at, {TS_SQL}) AS trained_at, duration_seconds, status "
    "FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY trained_at DESC, run_id DESC) AS rn "
    "FROM training_runs) WHERE rn = 1")))(
    lambda spark, d: fbk.latest_run(tables.training_runs(spark, d)).select(
        "user_id", "run_id", _ts("trained_at").alias("trained_at"), "duration_seconds", "status"))

register("learning_speed", S.with_roles(["scored_by_user"], (
    "WITH r AS (SELECT user_id, row_number() OVER w AS n_seen, "
    "sum(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) OVER w AS n_correct, count(*) OVER "
    "(PARTITION BY user_id) AS n_total FROM scored_by_user "
    "WINDOW w AS (PARTITION BY user_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) "
    "SELECT user_id, max(n_total) AS n_total, min(CASE WHEN n_seen >= 5 AND n_correct >= 0.8 * n_seen "
    "THEN n_seen END) AS examples_to_target FROM r GROUP BY user_id")))(
    lambda spark, d: fbk.learning_speed(tables.scored_by_user(spark, d)))

register("quality_trend", S.with_roles(["feedback"], (
    "WITH dd AS (SELECT CAST(created_at AS DATE) AS day, count(*) AS n, "
    "avg(CASE WHEN feedback_type = 'correction' THEN 1.0 ELSE 0.0 END) AS correction_rate "
    "FROM feedback GROUP BY ALL) SELECT day, n, round(correction_rate, 6) AS correction_rate, "
    "round(lag(correction_rate) OVER (ORDER BY day), 6) AS prev_rate, "
    "round(correction_rate - lag(correction_rate) OVER (ORDER BY day), 6) AS change FROM dd")))(
    lambda spark, d: r6(fbk.quality_trend(tables.feedback(spark, d))))


@register("training_history", S.with_roles(["feedback", "training_runs"], (
    "WITH r AS (SELECT user_id, count(*) AS n_runs, max(trained_at) AS last_trained_at, "
    "sum(duration_seconds) AS total_duration_seconds, avg(duration_seconds) AS avg_duration_seconds "
    "FROM training_runs GROUP BY user_id), e AS (SELECT user_id, count(*) AS n_samples, "
    "count(DISTINCT correct_category_id) AS n_categories FROM feedback WHERE feedback_type IS NOT NULL "
    "AND is_used_for_training GROUP BY user_id) "
    f"SELECT user_id, n_runs, strftime(last_trained_at, {TS_SQL}) AS last_trained_at, "
    "CAST(total_duration_seconds AS BIGINT) AS total_duration_seconds, "
    "round(avg_duration_seconds, 6) AS avg_duration_seconds, n_samples, n_categories "
    "FROM r FULL JOIN e USING (user_id)")))
def training_history(spark, d):
    fb = tables.feedback(spark, d)
    ex = fb.filter(F.col("feedback_type").isNotNull() & F.col("is_used_for_training")).select(
        "user_id", F.col("correct_category_id").alias("label"))
    out = fbk.training_history(tables.training_runs(spark, d), ex)
    return r6(out.select("user_id", "n_runs", _ts("last_trained_at").alias("last_trained_at"),
                         F.col("total_duration_seconds").cast("bigint").alias("total_duration_seconds"),
                         "avg_duration_seconds", "n_samples", "n_categories"))


register("event_props", (
    "SELECT event_type, count(*) AS n, round(avg(CAST(json_extract_string(props, '$.k') AS INTEGER)), 6) "
    "AS avg_k, min(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS min_k, "
    "max(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS max_k FROM events GROUP BY event_type"))(
    lambda spark, d: r6(tables.read(spark, d, "events")
                        .withColumn("k", F.get_json_object("props", "$.k").cast("int"))
                        .groupBy("event_type").agg(F.count(F.lit(1)).alias("n"),
                                                   F.avg("k").alias("avg_k"),
                                                   F.min("k").alias("min_k"),
                                                   F.max("k").alias("max_k"))))

register("split_temporal", S.with_roles(["transactions"], (
    "SELECT id, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.9) THEN 'val' "
    "ELSE 'test' END AS split FROM (SELECT id, row_number() OVER (PARTITION BY user_id "
    "ORDER BY transaction_date, id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM transactions)")))(
    lambda spark, d: split.split_temporal(tables.transactions(spark, d), "id", "transaction_date")
    .select("id", "split"))


@register("acceptance_ledger", S.with_roles(["transactions"], (
    "SELECT user_id, count(*) FILTER (WHERE predicted IS NOT NULL) AS n_predicted, count(*) AS n_all, "
    "round(count(*) FILTER (WHERE predicted = category) / count(*) FILTER (WHERE predicted IS NOT NULL), 6) "
    "AS acceptance_rate, round(count(*) FILTER (WHERE predicted <> category) / "
    "count(*) FILTER (WHERE predicted IS NOT NULL), 6) AS correction_rate, "
    "round(count(*) FILTER (WHERE predicted = category) / count(*), 6) AS acceptance_rate_all "
    "FROM transactions GROUP BY user_id")))
def acceptance_ledger(spark, d):
    """UAR / correction rate over transactions with a prediction, and the literal
    all-transactions UAR (AGG-15)."""
    return r6(fbk.acceptance_from_transactions(tables.transactions(spark, d)).select(
        "user_id", "n_predicted", "n_all", "acceptance_rate", "correction_rate", "acceptance_rate_all"))
