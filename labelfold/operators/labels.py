"""Label tables: distribution, dense label ids, class weights (AGG-1..3, JOIN-1..3).

Label tables are bounded by the number of distinct labels per group, never
by the number of rows.  Joins against them are left to AQE, which broadcasts
them after measuring their real size (and keeps a shuffle join otherwise).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _w(by: Sequence[str]) -> Window:
    return Window.partitionBy(*by) if by else Window.partitionBy()


def _labelled(df: DataFrame, label: str) -> DataFrame:
    """``df``, failing on a row whose label is NULL."""
    missing = F.raise_error(F.lit(f"column {label} holds a missing label"))
    return df.filter(F.when(F.col(label).isNull(), missing).isNull())


def category_distribution(df: DataFrame, label: str = "category",
                          by: Sequence[str] = ()) -> DataFrame:
    """Rows per label, most frequent first, ties by label; NULL labels skipped (AGG-1)."""
    by = list(by)
    return (df.filter(F.col(label).isNotNull()).groupBy(*by, label)
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("share", F.col("n") / F.sum("n").over(_w(by)))
            .orderBy(*by, F.desc("n"), F.col(label)))


def label_index(df: DataFrame, label: str = "category", by: Sequence[str] = (),
                id_col: str = "label_id") -> DataFrame:
    """Dense ids 0..k-1 in code-point order of the distinct labels (AGG-2, SORT-1, SET-1).

    Spark compares strings by UTF-8 bytes, which is code-point order (like
    Python's ``sorted``).  A NULL label is an error; validation reports it beforehand.
    """
    by = list(by)
    d = _labelled(df.select(*by, label), label).distinct()
    return d.withColumn(id_col, (F.row_number().over(_w(by).orderBy(label)) - 1).cast("int"))


def encode_labels(df: DataFrame, index: DataFrame, label: str = "category",
                  by: Sequence[str] = (), id_col: str = "label_id",
                  strict: bool = False) -> DataFrame:
    """Attach label ids (JOIN-1). Unknown labels get NULL, or fail when ``strict``."""
    out = df.join(index, list(by) + [label], "left")
    if strict:
        bad = out.filter(F.col(id_col).isNull() & F.col(label).isNotNull()).limit(1).count()
        if bad:
            raise KeyError("labels not present in the label index")
    return out


def class_weights(df: DataFrame, label: str = "category", by: Sequence[str] = (),
                  id_col: str = "label_id") -> DataFrame:
    """``total / (n_classes * count)`` per present class, with dense ids (AGG-3, MATH-1).  A NULL label is an error."""
    by = list(by)
    counts = _labelled(df.select(*by, label), label).groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    w = _w(by)
    return (counts
            .withColumn(id_col, (F.row_number().over(w.orderBy(label)) - 1).cast("int"))
            .withColumn("weight", F.sum("n").over(w).cast("double")
                        / (F.count(F.lit(1)).over(w) * F.col("n")).cast("double")))


def attach_weights(df: DataFrame, weights: DataFrame, label: str = "category",
                   by: Sequence[str] = ()) -> DataFrame:
    """Per-row weight column for ``weightCol`` (JOIN-3)."""
    return df.join(weights.select(*by, label, "label_id", "weight"), list(by) + [label], "left")


def label_names(index: DataFrame, id_col: str = "label_id", label: str = "category",
                by: Sequence[str] = ()) -> DataFrame:
    """id → label lookup table for predictions (JOIN-2)."""
    return index.select(*by, F.col(id_col), F.col(label))


def label_map_json(index: DataFrame, id_col: str = "label_id", label: str = "category",
                   by: Sequence[str] = ()) -> DataFrame:
    """id → label dictionary per group as a JSON object string (MAP-1, JSON-1).

    JSON object keys are strings; ``parse_label_map`` restores integer keys.
    """
    pairs = F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("k"), F.col(label).alias("v"))))
    m = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["k"].cast("string"), p["v"])))
    return index.groupBy(*by).agg(F.to_json(m).alias("id_to_label"))


def parse_label_map(df: DataFrame, col: str = "id_to_label") -> DataFrame:
    """JSON id → label object back to MAP<INT, STRING> (keys restored to int)."""
    parsed = F.from_json(F.col(col), "map<string,string>")
    return df.withColumn(col, F.transform_keys(parsed, lambda k, v: k.cast("int")))
