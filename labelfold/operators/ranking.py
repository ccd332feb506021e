"""Exact ranks within groups without a single-partition window.

A plain ``row_number().over(Window.orderBy(h))`` sends every row to one task,
and ``Window.partitionBy(label)`` sends a hot label (a third of all rows) to
one task.  Instead the rows are sorted by (group, order) over all tasks
(``range_sorted``: a range partitioning, whose bounds Spark samples from the data,
so a hot group, a hot day or hashed keys are cut like any others) and written
with their place in the sort.  One small aggregate counts rows per
``(by…, bucket)``, a bucket being a range: as each range is a stretch of the sort, that table
has at most ``groups + ranges`` rows.  A running sum over it gives the rows of a
group before each range, and a row's rank is that offset plus its place in the range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: ``monotonically_increasing_id`` holds the partition above this many bits of the row's place in it.
_PLACE_BITS = 33


def seeded_hash(key: Column | str, seed: int = 42) -> Column:
    """md5('<seed>|<key>') as lowercase hex — identical in Spark and DuckDB."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}|"), k.cast("string")))


def range_sorted(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` sorted by (by…, order) over ranges, with ``_bucket`` (range, in sort order) and ``_place`` in it.

    Written once, so later reads see the same ranges.
    """
    rows = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    rows = materialize(rows.withColumn("_at", F.monotonically_increasing_id()), "ranked_rows")
    place = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return rows.withColumn("_bucket", F.shiftright("_at", _PLACE_BITS)).withColumn("_place", place).drop("_at")


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    """Equality of the named columns; NULL equals NULL."""
    on = F.lit(True)
    for n in names:
        on = on & left[n].eqNullSafe(right[f"_o_{n}"])
    return on


def _with_offsets(rows: DataFrame, offsets: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows joined with the count table by ``names`` (few rows, or as many as there are groups)."""
    other = offsets.withColumnsRenamed({n: f"_o_{n}" for n in names})
    return rows.join(other, _same(rows, other, names)).drop(*[f"_o_{n}" for n in names])


def sorted_rank(df: DataFrame, by: Sequence[str], order: Sequence[Column], rank_col: str = "_rank",
                size_col: str | None = "_n", running: dict[str, Column] | None = None) -> DataFrame:
    """Add ``rank_col`` = 1-based row number within ``by`` ordered by ``order``.

    ``size_col`` (optional) receives the group size.  ``running`` maps output names to
    numeric columns whose running sum (up to and including the row, in the same
    order) is added.  NULL groups are groups.
    """
    by, running = list(by), running or {}
    x = df
    for name, c in running.items():
        x = x.withColumn(f"_v_{name}", c)
    x = range_sorted(x, by, order)
    counts = x.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_c"), F.min("_place").alias("_first"),
                                           *[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in running])
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    for n in running:
        offsets = offsets.withColumn(f"_r_{n}", F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)))
    if size_col:
        offsets = offsets.withColumn(size_col, F.sum("_c").over(Window.partitionBy(*by)))
    offsets = offsets.drop("_c", *[f"_s_{n}" for n in running])
    out = _with_offsets(x, offsets, [*by, "_bucket"])
    out = out.withColumn(rank_col, F.col("_off") + F.col("_place") - F.col("_first") + 1)
    upto = Window.partitionBy(*by, "_bucket").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    for n in running:
        out = out.withColumn(n, F.col(f"_r_{n}") + F.sum(f"_v_{n}").over(upto))
    return out.drop("_off", "_first", "_bucket", "_place", *[f"_r_{n}" for n in running], *[f"_v_{n}" for n in running])


def hash_rank(df: DataFrame, key: str, by: Sequence[str] = (), seed: int = 42,
              rank_col: str = "_rank", size_col: str | None = "_n",
              hash_col: str = "_h") -> DataFrame:
    """Rank rows within ``by`` by md5(seed|key), ties by key (WIN-1 order)."""
    x = df.withColumn(hash_col, seeded_hash(key, seed))
    return sorted_rank(x, by, [F.col(hash_col), F.col(key)], rank_col=rank_col, size_col=size_col)


def hash_rank_pair(df: DataFrame, key: str, by: Sequence[str], sub: str, seed: int = 42
                   ) -> tuple[DataFrame, DataFrame]:
    """Ranks by md5(seed|key) within ``by`` (``_r_g``, size ``_n_g``) and within
    ``by + [sub]`` (``_r_c``, size ``_c``) from one sort.

    Returns ``(ranked rows, counts)`` where ``counts`` is the single
    ``(by…, sub, _bucket) → _cnt`` aggregate every offset is derived from (one
    pass over the data; at most sub-groups × (groups + ranges) rows).  The place in
    the range gives the first rank; the second is a window within ``(by…, _bucket)``,
    which holds the rows of one range at most.
    """
    by = list(by)
    b = "_bucket"
    x = range_sorted(df.withColumn("_h", seeded_hash(key, seed)), by, [F.col("_h"), F.col(key)])
    counts = x.groupBy(*by, sub, b).agg(F.count(F.lit(1)).alias("_cnt"), F.min("_place").alias("_first"))
    cg = counts.groupBy(*by, b).agg(F.sum("_cnt").alias("_cnt"), F.min("_first").alias("_first"))
    wg = Window.partitionBy(*by) if by else Window.partitionBy()
    og = (cg.withColumn("_off_g", F.coalesce(F.sum("_cnt").over(
        wg.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
          .withColumn("_n_g", F.sum("_cnt").over(wg)).drop("_cnt"))
    wc = Window.partitionBy(*by, sub)
    oc = (counts.drop("_first").withColumn("_off_c", F.coalesce(F.sum("_cnt").over(
        wc.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
          .withColumn("_c", F.sum("_cnt").over(wc)).drop("_cnt"))
    y = _with_offsets(_with_offsets(x, og, by + [b]), oc, by + [sub, b])
    y = y.withColumn("_r_g", F.col("_off_g") + F.col("_place") - F.col("_first") + 1)
    y = y.withColumn("_r_c", F.col("_off_c") + F.row_number().over(Window.partitionBy(*by, b, sub).orderBy("_place")))
    return y.drop("_off_g", "_off_c", "_place", "_first"), counts.drop("_first")


def time_rank(df: DataFrame, ts: str, key: str, by: Sequence[str] = (),
              rank_col: str = "_rank", size_col: str | None = "_n") -> DataFrame:
    """Rank rows within ``by`` by (ts, key)."""
    return sorted_rank(df, by, [F.col(ts), F.col(key)], rank_col=rank_col, size_col=size_col)
