"""Mapping source columns to the standard (product_title, category) pair.

SRC-5..7 and PF-1.  Decisions are made from ``df.columns`` on the driver (the
schema only — no job runs); the projection is then pruned into the scan by
Catalyst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STANDARD = ("product_title", "category")

# Autodetect candidates, first hit wins, exact and case-sensitive.
TITLE_VARIANTS = ("product_title", "title", "product_name", "name")
CATEGORY_VARIANTS = ("category", "category_name", "cat", "label")


def detect_mapping(columns: list[str]) -> dict[str, str]:
    """{standard: actual} for the first matching variant of each standard column."""
    mapping: dict[str, str] = {}
    for std, variants in (("product_title", TITLE_VARIANTS), ("category", CATEGORY_VARIANTS)):
        for v in variants:
            if v in columns:
                mapping[std] = v
                break
    return mapping


def resolve_mapping(columns: list[str], column_mapping: dict[str, str] | None) -> dict[str, str]:
    """Standard → actual names; ``None`` autodetects, ``{}`` does not.

    A partial mapping keeps the standard name for the rest.  Raises
    ``ValueError`` listing missing standard columns and the available ones.
    """
    mapping = {s: s for s in STANDARD}
    mapping.update(detect_mapping(columns) if column_mapping is None else column_mapping)
    missing = [std for std, actual in mapping.items() if actual not in columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}; available: {list(columns)}")
    chosen = [mapping[s] for s in STANDARD]
    if len(set(chosen)) != len(chosen):
        raise ValueError(f"two standard columns map to the same source column: {chosen}")
    return mapping


def map_columns(df: DataFrame, column_mapping: dict[str, str] | None = None,
                keep: tuple[str, ...] = ()) -> DataFrame:
    """Project ``df`` to ``keep + (product_title, category)`` (SRC-5/6, PF-1).

    Columns are picked by exact (case-sensitive) name and by position, so
    Spark's case-insensitive resolution and duplicate names cannot bite.
    """
    cols = df.columns
    mapping = resolve_mapping(cols, column_mapping)
    picks = list(keep) + [mapping[s] for s in STANDARD]
    idx = [cols.index(c) for c in picks]
    # rename positionally: select by index through a toDF of unique names
    tmp = df.toDF(*[f"_c{i}" for i in range(len(cols))])
    names = list(keep) + list(STANDARD)
    return tmp.select(*[F.col(f"_c{i}").alias(n) for i, n in zip(idx, names)])
