"""Feedback, training-set and monitoring analytics (PF-5..9, SET-4, AGG-15..27, WIN-5..8).

Per-user state is computed with aggregations (``max_by``/``min_by``, counts)
rather than sorts where possible: an aggregation combines map-side, so a user
holding a third of all rows costs one partial-aggregate per task instead of
one sorted partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_percentiles
from .ranking import sorted_rank


# --- training rows ---------------------------------------------------------------------

def auto_confirmed(tx: DataFrame, label: str = "category", predicted: str = "predicted") -> DataFrame:
    """Rows whose category stands and was not changed by the user (PF-5).

    NULL predictions are kept (a bare ``!=`` would drop them).
    """
    keep = F.col(label).isNotNull() & (F.col(predicted).isNull() | (F.col(predicted) == F.col(label)))
    return tx.filter(keep)


def corrections(fb: DataFrame, honour_flag: bool = True) -> DataFrame:
    """Correction feedback usable for training, positive example only (PF-6, PF-7)."""
    c = fb.filter(F.col("feedback_type") == "correction")
    if honour_flag:
        c = c.filter(F.col("is_used_for_training"))
    return c


def training_set(auto: DataFrame, feedback_rows: DataFrame, key: str = "transaction_id",
                 carry: Sequence[str] = (), newest: str | None = None) -> DataFrame:
    """auto-confirmed ∪ user feedback, one row per key, feedback wins (SET-4).

    Inputs carry (key, user_id, label) and the ``carry`` columns.  Precedence is resolved
    with an aggregation (``min_by`` on a priority) — no sort of the whole set.  Of several
    rows of one key and source, the one with the highest ``newest`` column wins if it is
    given; then the lowest label.
    """
    columns = [key, "user_id", "label", *carry, *([newest] if newest else [])]
    a = auto.select(*columns, F.lit("auto_confirmed").alias("source"), F.lit(2).alias("_prio"))
    f = feedback_rows.select(*columns, F.lit("user_feedback").alias("source"), F.lit(1).alias("_prio"))
    u = a.unionByName(f)
    age = [(-F.unix_micros(F.col(newest).cast("timestamp"))).alias("age"), F.col("label").alias("l")] if newest else []
    order = F.struct("_prio", *age) if newest else F.col("_prio")
    best = u.groupBy(key).agg(F.min_by(F.struct("user_id", "label", "source", *carry), order).alias("b"))
    return best.select(key, "b.user_id", "b.label", "b.source", *[f"b.{c}" for c in carry])


def eligible(df: DataFrame, user: str = "user_id", label: str = "category",
             min_user_rows: int = 100, min_label_rows: int = 50) -> DataFrame:
    """(user, label, n) where the user has ≥ min_user_rows and the label ≥ min_label_rows (PF-8)."""
    per_label = df.groupBy(user, label).agg(F.count(F.lit(1)).alias("n"))
    users = (per_label.groupBy(user).agg(F.sum("n").alias("_u"))
             .filter(F.col("_u") >= min_user_rows).select(user))
    return per_label.filter(F.col("n") >= min_label_rows).join(users, user, "left_semi")


def low_confidence_queue(pred: DataFrame, threshold: float = 0.3, k: int = 5,
                         user: str = "user_id", key: str = "event_id",
                         confidence: str = "prediction_confidence") -> DataFrame:
    """Per user the k least confident predictions below ``threshold`` (PF-9, SORT-5)."""
    w = Window.partitionBy(user).orderBy(F.col(confidence), F.col(key))
    return (pred.filter(F.col(confidence) < threshold)
            .withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k))


# --- online quality -----------------------------------------------------------------------

def _is(feedback_type: str) -> F.Column:
    """1.0 when the row has this feedback type, 0.0 otherwise (NULL type included)."""
    return F.coalesce(F.col("feedback_type") == feedback_type, F.lit(False)).cast("double")


def acceptance(fb: DataFrame, by: Sequence[str] = ("user_id",)) -> DataFrame:
    """User acceptance rate, correction rate, rejection rate, confidence of accepted (AGG-15/17).

    Denominator: predictions (rows of the feedback log).  A prediction with no
    feedback or a confirmation counts as accepted.
    """
    accepted = F.col("feedback_type").isNull() | (F.col("feedback_type") == "confirmation")
    return fb.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(accepted.cast("double")).alias("acceptance_rate"),
        F.avg(_is("correction")).alias("correction_rate"),
        F.avg(_is("rejection")).alias("rejection_rate"),
        F.avg(F.when(accepted, F.col("prediction_confidence"))).alias("avg_confidence_accepted"))


def acceptance_from_transactions(tx: DataFrame, by: Sequence[str] = ("user_id",),
                                 label: str = "category", predicted: str = "predicted") -> DataFrame:
    """UAR and correction rate on the ledger itself, both denominators in one pass (AGG-15).

    A prediction is accepted when the final category equals it, changed when it
    differs; without a final category it is neither.  ``acceptance_rate`` / ``correction_rate`` divide by the
    transactions that carry a prediction; the ``*_all`` columns divide by every
    transaction (the literal formula).
    """
    has_pred = F.col(predicted).isNotNull()
    accepted = has_pred & F.coalesce(F.col(predicted) == F.col(label), F.lit(False))
    changed = has_pred & F.coalesce(F.col(predicted) != F.col(label), F.lit(False))
    g = tx.groupBy(*by).agg(F.count_if(has_pred).alias("n_predicted"), F.count(F.lit(1)).alias("n_all"),
                            F.count_if(accepted).alias("_acc"), F.count_if(changed).alias("_chg"))
    return g.select(*by, "n_predicted", "n_all",
                    (F.col("_acc") / F.col("n_predicted")).alias("acceptance_rate"),
                    (F.col("_chg") / F.col("n_predicted")).alias("correction_rate"),
                    (F.col("_acc") / F.col("n_all")).alias("acceptance_rate_all"),
                    (F.col("_chg") / F.col("n_all")).alias("correction_rate_all"))


def feedback_accuracy(tx: DataFrame, by: Sequence[str] = ("user_id",), label: str = "category",
                      predicted: str = "predicted") -> DataFrame:
    """predicted == category over rows with a category; NULL prediction is wrong (AGG-16)."""
    ok = F.coalesce(F.col(predicted) == F.col(label), F.lit(False))
    return (tx.filter(F.col(label).isNotNull()).groupBy(*by)
            .agg(F.count(F.lit(1)).alias("n"), F.avg(ok.cast("double")).alias("accuracy")))


def correction_distribution(fb: DataFrame) -> DataFrame:
    """(from, to, n) of corrections, most corrected first (AGG-18)."""
    return (corrections(fb, honour_flag=False)
            .groupBy(F.col("predicted_category_id").alias("from_category"),
                     F.col("correct_category_id").alias("to_category"))
            .agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "from_category", "to_category"))


def latency_slo(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exact p50/p95/p99 latency and error rate (AGG-23)."""
    by = list(by)
    q = exact_percentiles(log, "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}, by)
    e = log.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                             F.avg(F.col("is_error").cast("double")).alias("error_rate"))
    if by:
        return e.join(q, by)
    from .metrics import _join_one
    return _join_one(e, q)


def time_to_first(created: DataFrame, predictions: DataFrame, user: str = "user_id") -> DataFrame:
    """First prediction after account creation, per user (AGG-24).

    ``created``: (user, created_at) events; ``predictions``: (user, ts).
    """
    c = created.groupBy(user).agg(F.min("created_at").alias("account_created"))
    first = (predictions.join(c, user)
             .filter(F.col("ts") >= F.col("account_created"))
             .groupBy(user).agg(F.min("ts").alias("first_prediction")))
    return (c.join(first, user, "left")
            .withColumn("seconds_to_first", F.col("first_prediction").cast("double")
                        - F.col("account_created").cast("double")))


def ab_groups(user: F.Column) -> F.Column:
    """A when the first hex digit of md5(user id) is below 8, else B."""
    return F.when(F.substring(F.md5(user.cast("string")), 1, 1) < "8", "A").otherwise("B")


def ab_test(fb: DataFrame, user: str = "user_id") -> DataFrame:
    """Acceptance rate per arm and a two-proportion z statistic (AGG-25)."""
    accepted = F.col("feedback_type").isNull() | (F.col("feedback_type") == "confirmation")
    g = (fb.withColumn("arm", ab_groups(F.col(user)))
         .groupBy("arm").agg(F.countDistinct(user).alias("users"), F.count(F.lit(1)).alias("n"),
                             F.sum(accepted.cast("long")).alias("accepted")))
    wide = g.groupBy().pivot("arm", ["A", "B"]).agg(
        F.first("users").alias("users"), F.first("n").alias("n"), F.first("accepted").alias("acc"))
    pa = F.col("A_acc") / F.col("A_n")
    pb = F.col("B_acc") / F.col("B_n")
    pool = (F.col("A_acc") + F.col("B_acc")) / (F.col("A_n") + F.col("B_n"))
    se = F.sqrt(pool * (1 - pool) * (1 / F.col("A_n") + 1 / F.col("B_n")))
    z = F.when(se > 0, (pa - pb) / se)
    return wide.select(F.col("A_users").alias("users_a"), F.col("B_users").alias("users_b"),
                       F.col("A_n").alias("n_a"), F.col("B_n").alias("n_b"),
                       pa.alias("uar_a"), pb.alias("uar_b"), z.alias("z"),
                       (F.abs(z) > 1.959964).alias("significant"))


# Targets stated by the reference (metric, comparison, target).
SLO_TARGETS = (
    ("acceptance_rate", ">=", 0.90),
    ("correction_rate", "<=", 0.10),
    ("accuracy_from_feedback", ">=", 0.90),
    ("avg_confidence_correct", ">=", 0.80),
    ("latency_p50_ms", "<=", 200.0),
    ("latency_p95_ms", "<=", 500.0),
    ("latency_p99_ms", "<=", 1000.0),
    ("error_rate", "<=", 0.01),
)


def slo_check(metrics_row: DataFrame) -> DataFrame:
    """Stack a one-row metric frame and compare with the targets (AGG-26)."""
    names = [m for m, _, _ in SLO_TARGETS]
    stack = ", ".join(f"'{m}', CAST(`{m}` AS DOUBLE)" for m in names)
    long = metrics_row.selectExpr(f"stack({len(names)}, {stack}) AS (metric, value)")
    cmp = F.lit(None).cast("boolean")
    target = F.lit(None).cast("double")
    op = F.lit(None).cast("string")
    for m, o, t in SLO_TARGETS:
        is_m = F.col("metric") == m
        target = F.when(is_m, F.lit(t)).otherwise(target)
        op = F.when(is_m, F.lit(o)).otherwise(op)
        ok = (F.col("value") >= t) if o == ">=" else (F.col("value") <= t)
        cmp = F.when(is_m, ok).otherwise(cmp)
    return long.select("metric", "value", op.alias("op"), target.alias("target"),
                       F.coalesce(cmp, F.lit(False)).alias("pass"))


# --- retraining and model state ---------------------------------------------------------------

def latest_run(runs: DataFrame, user: str = "user_id") -> DataFrame:
    """The active (latest) model run per user via ``max_by`` (WIN-6)."""
    return runs.groupBy(user).agg(
        F.max_by(F.struct("run_id", "trained_at", "duration_seconds", "status"),
                 F.struct("trained_at", "run_id")).alias("r")).select(user, "r.*")


def retrain_due(examples: DataFrame, runs: DataFrame, as_of: F.Column, min_new: int = 10,
                max_age_hours: float = 24.0, user: str = "user_id") -> DataFrame:
    """Users due for retraining: ≥ min_new examples since the last run or the model is stale (WIN-5).

    ``examples``: (user, created_at); ``runs``: (user, trained_at, run_id…).
    """
    last = runs.groupBy(user).agg(F.max("trained_at").alias("last_trained_at"))
    users = examples.select(user).distinct().unionByName(last.select(user)).distinct()
    ex = examples.join(last, user, "left").filter(
        F.col("last_trained_at").isNull() | (F.col("created_at") > F.col("last_trained_at")))
    new = ex.groupBy(user).agg(F.count(F.lit(1)).alias("n_new"))
    age = (as_of.cast("double") - F.col("last_trained_at").cast("double")) / 3600.0
    out = (users.join(last, user, "left").join(new, user, "left")
           .withColumn("n_new", F.coalesce("n_new", F.lit(0)).cast("bigint"))
           .withColumn("hours_since", age))
    reason = (F.when(F.col("n_new") >= min_new, "feedback_threshold")
              .when(F.col("last_trained_at").isNull() | (F.col("hours_since") >= max_age_hours), "periodic"))
    return out.withColumn("reason", reason).withColumn("due", F.col("reason").isNotNull())


def learning_speed(scored: DataFrame, user: str = "user_id", key: str = "doc_id",
                   target: float = 0.8, min_examples: int = 5) -> DataFrame:
    """First n (≥ min_examples) where the running accuracy reaches ``target`` (WIN-7).

    Running counts come from a range-partitioned sort, so a heavy user is not one sorted task.
    """
    ok = F.coalesce(F.col("y_true") == F.col("y_pred"), F.lit(False)).cast("long")
    x = scored.select(user, key, ok.alias("_ok"))
    r = sorted_rank(x, [user], [F.col(key)], rank_col="n_seen", size_col="n_total", running={"n_correct": F.col("_ok")})
    hit = r.filter((F.col("n_seen") >= min_examples)
                   & (F.col("n_correct") >= F.lit(target) * F.col("n_seen")))
    first = hit.groupBy(user).agg(F.min("n_seen").alias("examples_to_target"))
    tot = r.groupBy(user).agg(F.max("n_total").alias("n_total"))
    return tot.join(first, user, "left")


def quality_trend(fb: DataFrame, ts: str = "created_at") -> DataFrame:
    """Daily correction rate and its day-over-day change (WIN-8).

    The window runs over the daily table (one row per day), not the events.
    """
    d = (fb.groupBy(F.to_date(ts).alias("day"))
         .agg(F.count(F.lit(1)).alias("n"),
              F.avg(_is("correction")).alias("correction_rate")))
    w = Window.orderBy("day")
    return (d.withColumn("prev_rate", F.lag("correction_rate").over(w))
            .withColumn("change", F.col("correction_rate") - F.col("prev_rate")))


def training_history(runs: DataFrame, examples: DataFrame, user: str = "user_id",
                     label: str = "label") -> DataFrame:
    """Per-user run facts and the size of the training set (SNK-4, AGG-27)."""
    r = runs.groupBy(user).agg(
        F.count(F.lit(1)).alias("n_runs"), F.max("trained_at").alias("last_trained_at"),
        F.sum("duration_seconds").alias("total_duration_seconds"),
        F.avg("duration_seconds").alias("avg_duration_seconds"))
    e = examples.groupBy(user).agg(F.count(F.lit(1)).alias("n_samples"),
                                   F.countDistinct(label).alias("n_categories"))
    return r.join(e, user, "full")
