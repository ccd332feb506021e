"""Exact linear-interpolated percentiles by radix selection over Spark aggregates.

``percentile``/``median`` keep a value→count map of the whole group in one
aggregation buffer.  Here every value has a 64-bit key that sorts like the value
(``order_key``).  A level counts the values by the next 16 bits of their keys, only
among those whose higher bits are still wanted: a partial aggregation of at most
65 536 counts per wanted prefix, so no task holds a group's values, whatever
their distribution.  Running sums over those counts find the bits of all wanted ranks
at once.  A prefix with one distinct value left is settled; four levels settle
every prefix.  The result equals ``percentile(v, p)`` (position ``(n-1)·p``, linear
interpolation between neighbours).  NULLs are left out; NaN sorts above all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

BITS = 16
#: Wanted prefixes that one broadcast may hold.
BROADCAST_PREFIXES = 1_000_000


def order_key(v: F.Column) -> F.Column:
    """A BIGINT that sorts like the DOUBLE: exponent and mantissa of the magnitude, with its sign."""
    a = F.abs(v)
    two_52 = float(1 << 52)
    # floor(log2) may be off by one beside a power of two; the quotient tells, and is exact
    e0 = F.greatest(F.lit(-1022), F.least(F.lit(1023), F.floor(F.log2(a)).cast("int")))
    m0 = a / F.pow(F.lit(2.0), e0.cast("double"))
    e = e0 + F.when(m0 >= 2.0, 1).when(m0 < 1.0, -1).otherwise(0)
    m = F.when(m0 >= 2.0, m0 / 2.0).when(m0 < 1.0, m0 * 2.0).otherwise(m0)
    normal = (e + 1023).cast("long") * F.lit(1 << 52) + ((m - 1.0) * two_52).cast("long")
    tiny = (a * float(1 << 537) * float(1 << 537)).cast("long")  # below the smallest normal number
    size = (F.when(a == 0.0, F.lit(0).cast("long")).when(a < 2.0 ** -1022, tiny)
            .when(a == float("inf"), F.lit(2047 << 52)).otherwise(normal))
    return F.when(F.isnan(v), F.lit((1 << 63) - 1)).when(v < 0.0, -size).otherwise(size)


def _locate(counts: DataFrame, wanted: DataFrame, within: list[str]) -> DataFrame:
    """The bucket of each wanted rank: counts per ``(within…, _p)`` summed up in key order."""
    w = Window.partitionBy(*within).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("_upto", F.sum("_c").over(w))
    hit = wanted.join(upto, within).filter((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_c")))
    return hit.withColumn("_rank", F.col("_rank") - F.col("_upto") + F.col("_c")).drop("_upto", "_c")


def exact_percentiles(df: DataFrame, value: str, probs: dict[str, float],
                      by: Sequence[str] = ()) -> DataFrame:
    """One row per group with one column per entry of ``probs`` (name → p)."""
    by = list(by)
    drop_g = not by
    if drop_g:  # a constant group key keeps every join an equi-join
        df, by = df.withColumn("_g", F.lit(0)), ["_g"]
    x = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    x = materialize(x.withColumn("_k", order_key(F.col("_v"))), "percentile_keys")  # narrow, read once a level

    def counted(rows: DataFrame, within: list[str], shift: int) -> DataFrame:
        return rows.groupBy(*within, F.shiftright("_k", shift).alias("_p")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))

    counts = materialize(counted(x, by, 64 - BITS), "percentile_counts")
    sizes = counts.groupBy(*by).agg(F.sum("_c").alias("_n"))
    # wanted 1-based ranks: lo = floor((n-1)p)+1, hi = ceil((n-1)p)+1
    wanted = []
    for name, p in probs.items():
        pos = (F.col("_n") - 1).cast("double") * F.lit(float(p))
        wanted.append(F.struct(F.lit(name).alias("q"), (F.floor(pos) + 1).cast("long").alias("lo"),
                               (F.ceil(pos) + 1).cast("long").alias("hi"), (pos - F.floor(pos)).alias("frac")))
    targets = sizes.select(*by, F.explode(F.array(*wanted)).alias("t")).select(*by, "t.*")
    ranks = targets.select(*by, F.explode(F.array("lo", "hi")).alias("k")).distinct()
    found = materialize(_locate(counts, ranks.withColumn("_rank", F.col("k")), by), "percentile_found")
    settled = found.filter(F.col("_low") == F.col("_high"))
    for shift in range(64 - 2 * BITS, -1, -BITS):
        open_ = found.filter(F.col("_low") != F.col("_high")).select(*by, "k", "_rank", F.col("_p").alias("_parent"))
        need = open_.select(*by, "_parent").distinct()
        n = need.limit(BROADCAST_PREFIXES + 1).count()
        if n == 0:
            break
        if n <= BROADCAST_PREFIXES:
            need = F.broadcast(need)
        rows = x.withColumn("_parent", F.shiftright("_k", shift + BITS)).join(need, by + ["_parent"], "left_semi")
        counts = counted(rows, by + ["_parent"], shift)
        found = materialize(_locate(counts, open_, by + ["_parent"]).drop("_parent"), "percentile_found")
        settled = settled.unionByName(found.filter(F.col("_low") == F.col("_high")))
    picked = settled.select(*by, "k", F.col("_low").alias("_v"))
    lo = picked.select(*by, F.col("k").alias("lo"), F.col("_v").alias("v_lo"))
    hi = picked.select(*by, F.col("k").alias("hi"), F.col("_v").alias("v_hi"))
    res = (targets.join(lo, by + ["lo"]).join(hi, by + ["hi"])
           .withColumn("val", F.when(F.col("lo") == F.col("hi"), F.col("v_lo"))
                       .otherwise(F.col("v_lo") + F.col("frac") * (F.col("v_hi") - F.col("v_lo")))))
    out = res.groupBy(*by).pivot("q", list(probs)).agg(F.first("val"))
    return out.drop("_g") if drop_g else out
