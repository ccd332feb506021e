"""Cleaning, validation and data-quality rules (PF-1..3, DQ-1..4, PF-10).

Validation is one aggregate that produces every counter at once (one pass,
map-side partial aggregation); the ordered pass/fail decision reads only that
one-row (or one-row-per-group) result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_text, has_content, is_blank, py_strip

REQUIRED = ("product_title", "category")

# The rule order of the reference's validation (first failure wins).
RULE_ORDER = ("empty", "missing_columns", "nulls", "type", "blank_title",
              "blank_category", "too_few_categories")


def preprocess(df: DataFrame, title: str = "product_title", category: str = "category",
               lowercase: bool = True, punctuation: bool = False) -> DataFrame:
    """Clean titles, strip categories, drop rows whose cleaned title is empty (PF-2)."""
    if title not in df.columns:
        raise ValueError(f"column {title!r} is required for preprocessing")
    out = df.filter(has_content(title, punctuation)).withColumn(
        title, clean_text(title, lowercase, punctuation))
    if category in df.columns:
        out = out.withColumn(category, py_strip(F.col(category)))
    return out


def preprocess_removed(df: DataFrame, title: str = "product_title", by: Sequence[str] = (),
                       lowercase: bool = True, punctuation: bool = False) -> DataFrame:
    """Rows before/after cleaning and the number removed, in one aggregate (PF-3)."""
    kept = has_content(title, punctuation)
    return (df.groupBy(*by)
            .agg(F.count(F.lit(1)).alias("n_before"),
                 F.count_if(kept).alias("n_after"))
            .withColumn("n_removed", F.col("n_before") - F.col("n_after")))


def _numeric_like(c: str) -> F.Column:
    # an all-STRING scan reproduces pandas inference: every value parses as a number
    return F.count(F.expr(f"try_cast(`{c}` AS DOUBLE)"))


def validate_profile(df: DataFrame, by: Sequence[str] = (), title: str = "product_title",
                     category: str = "category") -> DataFrame:
    """All DQ-1 counters in one aggregate, plus the first failing rule.

    ``status`` is ``ok`` or the first failing rule of ``RULE_ORDER``.
    """
    by = list(by)
    missing = [c for c in (title, category) if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}; available: {df.columns}")
    types = dict(df.dtypes)
    title_is_string = isinstance(df.schema[title].dataType, T.StringType)
    cat_is_string = isinstance(df.schema[category].dataType, T.StringType)
    t, c = F.col(title), F.col(category)
    prof = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(t.isNull()).alias("title_nulls"),
        F.count_if(c.isNull()).alias("category_nulls"),
        (_numeric_like(title) if types[title] == "string" else F.count(t)).alias("title_numeric"),
        (_numeric_like(category) if types[category] == "string" else F.count(c)).alias("category_numeric"),
        F.count(t).alias("title_values"),
        F.count(c).alias("category_values"),
        F.count_if(is_blank(t)).alias("blank_titles"),
        F.count_if(is_blank(c)).alias("blank_categories"),
        F.countDistinct(c).alias("n_categories"),
    )
    title_bad_type = F.lit(not title_is_string) | (
        (F.col("title_numeric") == F.col("title_values")) & (F.col("title_values") > 0))
    cat_bad_type = F.lit(not cat_is_string) | (
        (F.col("category_numeric") == F.col("category_values")) & (F.col("category_values") > 0))
    status = (F.when(F.col("n_rows") == 0, "empty")
              .when((F.col("title_nulls") + F.col("category_nulls")) > 0, "nulls")
              .when(title_bad_type | cat_bad_type, "type")
              .when(F.col("blank_titles") > 0, "blank_title")
              .when(F.col("blank_categories") > 0, "blank_category")
              .when(F.col("n_categories") < 2, "too_few_categories")
              .otherwise("ok"))
    return prof.withColumn("status", status).drop(
        "title_numeric", "category_numeric", "title_values", "category_values")


def validate(df: DataFrame, title: str = "product_title", category: str = "category") -> bool:
    """Raise ``ValueError`` on the first failing rule, else return True (DQ-1).

    The only action is the one-row profile aggregate.
    """
    missing = [c for c in (title, category) if c not in df.columns]
    if missing:
        if df.isEmpty():
            raise ValueError("dataset is empty")
        raise ValueError(f"missing required columns: {missing}")
    row = validate_profile(df, [], title, category).first()
    if row is None or row["n_rows"] == 0:
        raise ValueError("dataset is empty")
    if row["status"] != "ok":
        detail = {k: row[k] for k in row.asDict() if k != "status"}
        raise ValueError(f"validation failed: {row['status']} {detail}")
    return True


# --- DQ-2..4 ------------------------------------------------------------------------

def duplicated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count (DQ-2)."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1))


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Child rows whose non-NULL reference has no parent (DQ-3)."""
    p = parent.select(F.col(pk).alias("_pk")).distinct()
    return (child.filter(F.col(fk).isNotNull())
            .join(p, F.col(fk) == F.col("_pk"), "left_anti"))


def rule_violations(df: DataFrame, table: str, rules: dict[str, F.Column]) -> DataFrame:
    """Count violations of each named boolean rule in one pass, stacked long (DQ-4).

    Each rule expression is True when the row *violates* the rule.
    """
    names = list(rules)
    counts = df.agg(*[F.count_if(rules[n]).alias(f"r{i}") for i, n in enumerate(names)])
    stack = ", ".join(f"'{n}', r{i}" for i, n in enumerate(names))
    return counts.selectExpr(f"'{table}' AS table_name",
                             f"stack({len(names)}, {stack}) AS (rule, violations)")
