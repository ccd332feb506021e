"""Classification metrics over a scored DataFrame (AGG-5..12, AGG-19..21, PF-4).

Input: one frame with ``y_true``, ``y_pred`` (NULL = no prediction, counted
wrong) and optionally ``confidence``.  The only pass over the data is the
contingency aggregate ``(by…, y_true, y_pred) → n`` (map-side partial
aggregation); every metric is then computed on that small table, so the cost
does not grow with the number of rows beyond one aggregation.

Labels are the **union** of true and predicted labels (as the reference's
metric calls do); ``zero_division = 0`` everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_percentiles


def _div(n: Column, d: Column) -> Column:
    return F.when(d == 0, F.lit(0.0)).otherwise(n.cast("double") / d.cast("double"))


def contingency(scored: DataFrame, by: Sequence[str] = (), y_true: str = "y_true",
                y_pred: str = "y_pred") -> DataFrame:
    return (scored.groupBy(*by, F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred"))
            .agg(F.count(F.lit(1)).alias("n")))


def per_class(scored: DataFrame, by: Sequence[str] = (), y_true: str = "y_true",
              y_pred: str = "y_pred", ct: DataFrame | None = None) -> DataFrame:
    """(by…, label, tp, n_pred, support, precision, recall, f1) over the label union."""
    by = list(by)
    ct = ct if ct is not None else contingency(scored, by, y_true, y_pred)
    t = (ct.filter(F.col("y_true").isNotNull()).groupBy(*by, F.col("y_true").alias("label"))
         .agg(F.sum("n").alias("support"),
              F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("tp")))
    p = (ct.filter(F.col("y_pred").isNotNull()).groupBy(*by, F.col("y_pred").alias("label"))
         .agg(F.sum("n").alias("n_pred")))
    pc = t.join(p, by + ["label"], "full")
    pc = pc.select(*by, "label",
                   F.coalesce("tp", F.lit(0)).cast("bigint").alias("tp"),
                   F.coalesce("n_pred", F.lit(0)).cast("bigint").alias("n_pred"),
                   F.coalesce("support", F.lit(0)).cast("bigint").alias("support"))
    return (pc.withColumn("precision", _div(F.col("tp"), F.col("n_pred")))
            .withColumn("recall", _div(F.col("tp"), F.col("support")))
            .withColumn("f1", _div(2 * F.col("tp"), F.col("support") + F.col("n_pred"))))


def _averages(pc: DataFrame, by: list[str]) -> DataFrame:
    sup = F.sum("support")
    return pc.groupBy(*by).agg(
        F.sum("tp").alias("_tp"), sup.alias("_support"), F.sum("n_pred").alias("_n_pred"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        _div(F.sum(F.col("precision") * F.col("support")), sup).alias("weighted_precision"),
        _div(F.sum(F.col("recall") * F.col("support")), sup).alias("weighted_recall"),
        _div(F.sum(F.col("f1") * F.col("support")), sup).alias("weighted_f1"),
        F.count(F.lit(1)).alias("n_labels"))


def evaluate(scored: DataFrame, by: Sequence[str] = (), average: str = "weighted",
             y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """accuracy + precision/recall/f1 (``average``) + macro precision/recall/f1 (AGG-5..7)."""
    if average not in ("micro", "macro", "weighted"):
        raise ValueError(f"average must be micro, macro or weighted, not {average!r}")
    by = list(by)
    ct = contingency(scored, by, y_true, y_pred)
    tot = ct.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("_correct"))
    av = _averages(per_class(scored, by, ct=ct), by)
    if average == "weighted":
        p, r, f = F.col("weighted_precision"), F.col("weighted_recall"), F.col("weighted_f1")
    elif average == "macro":
        p, r, f = F.col("macro_precision"), F.col("macro_recall"), F.col("macro_f1")
    else:
        p = _div(F.col("_tp"), F.col("_n_pred"))
        r = _div(F.col("_tp"), F.col("_support"))
        f = _div(2 * F.col("_tp"), F.col("_support") + F.col("_n_pred"))
    joined = tot.join(av, by, "left") if by else _join_one(tot, av)
    return joined.select(*by, F.col("n").cast("bigint").alias("n"),
                         _div(F.col("_correct"), F.col("n")).alias("accuracy"),
                         p.alias("precision"), r.alias("recall"), f.alias("f1"),
                         "macro_precision", "macro_recall", "macro_f1")


def confidence_stats(scored: DataFrame, by: Sequence[str] = (), threshold: float = 0.5,
                     y_true: str = "y_true", y_pred: str = "y_pred",
                     confidence: str = "confidence") -> DataFrame:
    """High-confidence accuracy/count/ratio and mean/median/min/max confidence (AGG-9/10, PF-4).

    ``confidence >= threshold`` is inclusive.  With no row above the
    threshold, accuracy is NULL, count 0 and ratio 0.
    """
    by = list(by)
    hi = F.col(confidence) >= F.lit(threshold)
    ok = F.coalesce(F.col(y_true) == F.col(y_pred), F.lit(False))
    a = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(hi).alias("high_confidence_count"),
        F.count_if(hi & ok).alias("_hi_ok"),
        F.avg(confidence).alias("mean_confidence"),
        F.min(confidence).alias("min_confidence"),
        F.max(confidence).alias("max_confidence"))
    a = a.select(*by,
                 F.when(F.col("high_confidence_count") > 0,
                        F.col("_hi_ok") / F.col("high_confidence_count")).alias("high_confidence_accuracy"),
                 F.col("high_confidence_count").cast("bigint").alias("high_confidence_count"),
                 _div(F.col("high_confidence_count"), F.col("_rows")).alias("high_confidence_ratio"),
                 "mean_confidence", "min_confidence", "max_confidence")
    med = exact_percentiles(scored, confidence, {"median_confidence": 0.5}, by)
    return a.join(med, by, "left") if by else _join_one(a, med)


def _join_one(a: DataFrame, b: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame ``b`` to ``a``.

    ``b`` is packed into one struct and read as an uncorrelated scalar
    subquery (computed once), so the plan has no join at all.
    """
    packed = b.select(F.struct(*[F.col(f"`{c}`") for c in b.columns]).alias("_b")).scalar()
    return a.select("*", packed.alias("_b")).select(*[F.col(f"`{c}`") for c in a.columns], "_b.*")


def evaluate_with_confidence(scored: DataFrame, by: Sequence[str] = (), threshold: float = 0.5,
                             y_true: str = "y_true", y_pred: str = "y_pred",
                             confidence: str = "confidence") -> DataFrame:
    """AGG-8: weighted metrics + confidence statistics, one row per group."""
    by = list(by)
    ev = evaluate(scored, by, "weighted", y_true, y_pred)
    cs = confidence_stats(scored, by, threshold, y_true, y_pred, confidence)
    return ev.join(cs, by, "left") if by else _join_one(ev, cs)


#: The stated target for the precision of every category (per user, offline).
MIN_PRECISION = 0.75


def min_category_precision(scored: DataFrame, by: Sequence[str] = (), target: float = MIN_PRECISION,
                           y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Smallest precision over the categories that occur, and whether it meets the target (AGG-20)."""
    pc = per_class(scored, by, y_true, y_pred).filter(F.col("support") > 0)
    return pc.groupBy(*by).agg(F.min("precision").alias("min_precision"),
                               (F.min("precision") >= F.lit(target)).alias("meets_target"),
                               F.count(F.lit(1)).alias("n_categories"))


def classification_report(scored: DataFrame, by: Sequence[str] = (), y_true: str = "y_true",
                          y_pred: str = "y_pred") -> DataFrame:
    """Per-class rows + ``accuracy``, ``macro avg``, ``weighted avg`` rows (AGG-11, AGG-20)."""
    by = list(by)
    ct = contingency(scored, by, y_true, y_pred)
    pc = per_class(scored, by, ct=ct)
    rows = pc.select(*by, "label", "precision", "recall", "f1", "support")
    av = _averages(pc, by)
    tot = ct.groupBy(*by).agg(
        F.sum("n").alias("_n"),
        F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("_ok"))
    s = av.join(tot, by) if by else _join_one(av, tot)
    acc = s.select(*by, F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                   F.lit(None).cast("double").alias("recall"), _div(F.col("_ok"), F.col("_n")).alias("f1"),
                   F.col("_support").cast("bigint").alias("support"))
    mac = s.select(*by, F.lit("macro avg").alias("label"), F.col("macro_precision").alias("precision"),
                   F.col("macro_recall").alias("recall"), F.col("macro_f1").alias("f1"),
                   F.col("_support").cast("bigint").alias("support"))
    wei = s.select(*by, F.lit("weighted avg").alias("label"), F.col("weighted_precision").alias("precision"),
                   F.col("weighted_recall").alias("recall"), F.col("weighted_f1").alias("f1"),
                   F.col("_support").cast("bigint").alias("support"))
    return rows.unionByName(acc).unionByName(mac).unionByName(wei)


def confusion_matrix(scored: DataFrame, by: Sequence[str] = (), y_true: str = "y_true",
                     y_pred: str = "y_pred") -> DataFrame:
    """Long zero-filled matrix over the sorted label union: (by…, y_true, y_pred, n) (AGG-12, SET-2).

    The square is built by exploding the per-group label array twice (k² rows
    per group, k = labels), then the contingency counts are joined in.
    """
    by = list(by)
    ct = contingency(scored, by, y_true, y_pred).filter(
        F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())
    labels = (ct.select(*by, F.col("y_true").alias("l"))
              .unionByName(ct.select(*by, F.col("y_pred").alias("l"))).distinct())
    arr = labels.groupBy(*by).agg(F.array_sort(F.collect_list("l")).alias("ls"))
    sq = (arr.select(*by, F.explode("ls").alias("y_true"), "ls")
          .select(*by, "y_true", F.explode("ls").alias("y_pred")))
    return (sq.join(ct, by + ["y_true", "y_pred"], "left")
            .select(*by, "y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def confusion_matrix_wide(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Wide form of the confusion matrix (rows = truth, columns = prediction)."""
    long = confusion_matrix(scored, by)
    return long.groupBy(*by, "y_true").pivot("y_pred").agg(F.first("n")).orderBy(*by, "y_true")


def topk_accuracy(ranked: DataFrame, by: Sequence[str] = (), k: int = 3,
                  y_true: str = "y_true", topk: str = "top_labels") -> DataFrame:
    """Share of rows whose true label is among the first ``k`` of ``topk`` (AGG-19)."""
    hit = F.array_contains(F.slice(F.col(topk), 1, k), F.col(y_true))
    return ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias(f"top{k}_accuracy"),
        F.avg(F.coalesce(F.element_at(F.col(topk), 1) == F.col(y_true), F.lit(False))
              .cast("double")).alias("top1_accuracy"))


def metrics_over_groups(per_group: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """Unweighted mean over groups plus the group count (AGG-21)."""
    return per_group.agg(F.count(F.lit(1)).alias(f"n_{group}s"),
                         *[F.avg(c).alias(f"mean_{c}") for c in cols])
