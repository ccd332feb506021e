"""Train / validation / test splits (AGG-4, WIN-1..4).

Sizes follow the reference exactly:

* ``n_test = ceil(n * test_size)``; the rest is the temporary part;
* ``val_adj = val_size / (1 - test_size)`` (so ``val_size`` is a share of the
  whole) and ``n_val = ceil(n_temp * val_adj)``; the rest is train.
* The first cut is stratified when every class has at least two rows (and,
  as a fix of a reference crash, when test and train can hold every class);
  the second when ``k > 1``, every temporary class has two rows,
  ``int(n_temp*val_adj) >= k`` and ``n_temp - int(n_temp*val_adj) >= k``.
* Stratified quotas use the largest-remainder rule (train quota first, test
  gets the rest) with ties broken by label instead of at random.

Membership is decided by the seeded md5 rank of the row key, computed with
``ranking.hash_rank`` (no single-partition window).  Everything is columnar:
per-group decisions live in small plan tables joined back on ``(by…, label)``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import hash_rank_pair, time_rank


def largest_remainder(counts: DataFrame, by: Sequence[str], label: str, count_col: str,
                      draws_col: str, out_col: str) -> DataFrame:
    """Allocate ``draws`` over classes proportionally to ``count_col``.

    floor(c / n * d) each, then one more to the largest remainders (ties by
    label).  Runs over the small class-count table only.
    """
    by = list(by)
    g = Window.partitionBy(*by) if by else Window.partitionBy()
    total = F.sum(count_col).over(g)
    cont = F.col(count_col).cast("double") / total.cast("double") * F.col(draws_col).cast("double")
    x = (counts.withColumn("_cont", cont)
         .withColumn("_fl", F.floor("_cont"))
         .withColumn("_rem", F.col("_cont") - F.col("_fl"))
         .withColumn("_need", F.col(draws_col) - F.sum("_fl").over(g))
         .withColumn("_rr", F.row_number().over(g.orderBy(F.desc("_rem"), F.col(label)))))
    return (x.withColumn(out_col, (F.col("_fl") + F.when(F.col("_rr") <= F.col("_need"), 1)
                                   .otherwise(0)).cast("bigint"))
            .drop("_cont", "_fl", "_rem", "_need", "_rr"))


def split_plan(df: DataFrame, label: str = "category", by: Sequence[str] = (),
               test_size: float = 0.2, val_size: float = 0.1) -> DataFrame:
    """Per-group feasibility of the first (stratified) cut — AGG-4.

    One aggregate over the data; the rest runs on the class-count table.
    """
    by = list(by)
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("c"))
    val_adj = val_size / (1.0 - test_size)
    g = counts.groupBy(*by).agg(F.sum("c").alias("n_rows"),
                                F.count(F.lit(1)).alias("n_classes"),
                                F.min("c").alias("min_class_rows"))
    n_test = F.ceil(F.col("n_rows") * F.lit(test_size)).cast("bigint")
    g = g.withColumn("n_test", n_test)
    n_temp = F.col("n_rows") - F.col("n_test")
    g = (g.withColumn("can_stratify", (F.col("min_class_rows") >= 2)
                      & (F.col("n_test") >= F.col("n_classes"))
                      & ((F.col("n_rows") - F.col("n_test")) >= F.col("n_classes")))
         .withColumn("n_val", F.ceil(n_temp * F.lit(val_adj)).cast("bigint"))
         .withColumn("n_train", n_temp - F.col("n_val")))
    return g


def _assign(df: DataFrame, key: str, label: str, by: list[str], test_size: float,
            val_size: float, seed: int, stratify: bool) -> DataFrame:
    val_adj = val_size / (1.0 - test_size)
    # ranks: within class (r_c, size c) and within group (r_g, size n)
    x, bucket_counts = hash_rank_pair(df, key, by, label, seed)

    # first cut: test (class counts come from the same bucket-count aggregate)
    counts = bucket_counts.groupBy(*by, label).agg(F.sum("_cnt").alias("c"))
    g = Window.partitionBy(*by) if by else Window.partitionBy()
    p1 = (counts.withColumn("n", F.sum("c").over(g))
          .withColumn("k", F.count(F.lit(1)).over(g))
          .withColumn("min_c", F.min("c").over(g))
          .withColumn("n_test", F.ceil(F.col("n") * F.lit(test_size)).cast("bigint"))
          .withColumn("n_tr1", F.col("n") - F.col("n_test")))
    p1 = p1.withColumn("strat1", F.lit(stratify) & (F.col("min_c") >= 2)
                       & (F.col("n_test") >= F.col("k")) & (F.col("n_tr1") >= F.col("k")))
    p1 = largest_remainder(p1, by, label, "c", "n_tr1", "_trq1")
    p1 = p1.withColumn("tq", F.col("c") - F.col("_trq1")).select(
        *by, label, "n_test", "strat1", "tq")
    x = x.join(p1, by + [label])
    x = x.withColumn("_is_test", F.when(F.col("strat1"), F.col("_r_c") <= F.col("tq"))
                     .otherwise(F.col("_r_g") <= F.col("n_test")))

    # second cut: validation out of the temporary part
    per_bucket = (x.groupBy(*by, label, "_bucket")
                  .agg(F.sum(F.when(~F.col("_is_test"), 1).otherwise(0)).cast("bigint").alias("tc"),
                       F.count(F.lit(1)).alias("c2")))
    temp = per_bucket.groupBy(*by, label).agg(F.sum("tc").alias("tc"), F.sum("c2").alias("c2"))
    # ranks among the temporary rows of a group: a stratified first cut doesn't take the lowest group ranks
    before = per_bucket.groupBy(*by, "_bucket").agg(F.sum("tc").alias("_t"))
    before = before.select(*by, "_bucket", F.coalesce(F.sum("_t").over(
        g.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off_t"))
    within = Window.partitionBy(*by, "_bucket").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_r_t", F.sum((~F.col("_is_test")).cast("bigint")).over(within)).join(before, by + ["_bucket"])
    tpos = temp.filter(F.col("tc") > 0)
    p2 = (tpos.withColumn("n_temp", F.sum("tc").over(g))
          .withColumn("k2", F.count(F.lit(1)).over(g))
          .withColumn("min_tc", F.min("tc").over(g))
          .withColumn("n_val", F.ceil(F.col("n_temp") * F.lit(val_adj)).cast("bigint"))
          .withColumn("_iv", F.floor(F.col("n_temp") * F.lit(val_adj)))
          .withColumn("n_tr2", F.col("n_temp") - F.col("n_val")))
    p2 = p2.withColumn("strat2", F.lit(stratify) & (F.col("k2") > 1) & (F.col("min_tc") >= 2)
                       & (F.col("_iv") >= F.col("k2"))
                       & ((F.col("n_temp") - F.col("_iv")) >= F.col("k2")))
    p2 = largest_remainder(p2, by, label, "tc", "n_tr2", "_trq2")
    p2 = p2.withColumn("vq", F.col("tc") - F.col("_trq2")).select(
        *by, label, "n_val", "strat2", "vq", "tc", "c2")
    x = x.join(p2, by + [label], "left")
    r_temp_class = F.col("_r_c") - (F.col("c2") - F.col("tc"))
    r_temp_group = F.col("_off_t") + F.col("_r_t")
    is_val = (~F.col("_is_test")) & F.when(
        F.col("strat2"), r_temp_class <= F.col("vq")).otherwise(r_temp_group <= F.col("n_val"))
    split = (F.when(F.col("_is_test"), "test").when(is_val, "val").otherwise("train"))
    return x.withColumn("split", split).drop(
        "_h", "_bucket", "_r_c", "_c", "_r_g", "_n_g", "n_test", "strat1", "tq", "_is_test",
        "n_val", "strat2", "vq", "tc", "c2", "_r_t", "_off_t")


def split_random(df: DataFrame, key: str, label: str = "category", by: Sequence[str] = (),
                 test_size: float = 0.2, val_size: float = 0.1, seed: int = 42) -> DataFrame:
    """Random split (WIN-1): adds ``split`` ∈ {train, val, test}."""
    return _assign(df, key, label, list(by), test_size, val_size, seed, stratify=False)


def split_stratified(df: DataFrame, key: str, label: str = "category", by: Sequence[str] = (),
                     test_size: float = 0.2, val_size: float = 0.1, seed: int = 42) -> DataFrame:
    """Stratified split where feasible, random otherwise (WIN-2 + AGG-4)."""
    return _assign(df, key, label, list(by), test_size, val_size, seed, stratify=True)


def split_temporal(df: DataFrame, key: str, ts: str, by: Sequence[str] = ("user_id",),
                   train_share: float = 0.8, val_share: float = 0.1) -> DataFrame:
    """Old → train, then val, newest → test, per group (WIN-3).

    train = rank ≤ floor(n·train_share), val = rank ≤ floor(n·(train+val)).
    """
    cut = train_share + val_share
    x = time_rank(df, ts, key, by, rank_col="_r", size_col="_n")
    split = (F.when(F.col("_r") <= F.floor(F.col("_n") * F.lit(train_share)), "train")
             .when(F.col("_r") <= F.floor(F.col("_n") * F.lit(cut)), "val")
             .otherwise("test"))
    return x.withColumn("split", split).drop("_r", "_n")


def first_n(df: DataFrame, n: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First ``n`` rows per group (WIN-4); Spark plans a WindowGroupLimit."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def split_sizes(n: int, test_size: float = 0.2, val_size: float = 0.1) -> tuple[int, int, int]:
    """(train, val, test) sizes of the random split, computed like the reference."""
    n_test = math.ceil(n * test_size)
    n_temp = n - n_test
    n_val = math.ceil(n_temp * (val_size / (1.0 - test_size)))
    return n_temp - n_val, n_val, n_test
