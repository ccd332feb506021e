"""CSV scan of labelled text (SRC-1..4, SRC-8).

``pd.read_csv`` semantics on Spark: header row, RFC-4180 quoting with doubled
quotes and quoted newlines (``multiLine`` + ``escape='"'``), all columns read
as STRING (no inference pass over the data), pandas' NA tokens mapped to
NULL, and ragged rows either rejected (strict) or padded with NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions.text import null_na_tokens
from . import csv_ranges
from .columns import map_columns

CORRUPT = "_corrupt_record"


def _reader(spark: SparkSession, multi_line: bool):
    return (spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
            .option("mode", "PERMISSIVE").option("columnPruning", False))


def read_labelled_csv(spark: SparkSession, path: str, strict: bool = True,
                      na_tokens: bool = True, multi_line: bool = True, ranges: bool = False) -> DataFrame:
    """All-STRING scan of a headed CSV file or folder.

    ``strict`` fails on rows with more fields than the header (pandas raises
    there; Spark would drop the extra fields silently): the text of every row that
    does not fit the header is kept and its fields are counted outside of quotes.
    Rows with fewer fields get NULLs, as in pandas.  ``multi_line=False`` lets Spark
    split large files where no quoted field holds a line break; ``ranges=True`` splits any
    file and finds the records by counting quotes (``csv_ranges``).
    """
    try:
        names = _reader(spark, multi_line).csv(path).columns  # header names only
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise FileNotFoundError(f"data file not found: {path}") from e
        raise
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    if ranges:
        df = csv_ranges.parsed(spark, path, schema, CORRUPT)
    else:
        df = _reader(spark, multi_line).schema(schema).option("columnNameOfCorruptRecord", CORRUPT).csv(path)
    if strict:
        bare = F.regexp_replace(CORRUPT, '"[^"]*+"', "")  # a doubled quote ends one stretch and begins the next
        fields = F.length(bare) - F.length(F.replace(bare, F.lit(","))) + 1
        df = df.filter(F.when(F.col(CORRUPT).isNotNull() & (fields > len(names)), F.raise_error(F.concat(
            F.lit(f"CSV row has more fields than the {len(names)} header columns; it starts with "),
            F.coalesce(F.col(f"`{names[0]}`"), F.lit(""))))).isNull())
    df = df.select(*[F.col(f"`{c}`") for c in names])
    if na_tokens:
        df = df.select(*[null_na_tokens(F.col(f"`{c}`")).alias(c) for c in names])
    return df


def load_dataset(spark: SparkSession, data_path: str, filename: str = "product_titles.csv",
                 column_mapping: dict[str, str] | None = None, ranges: bool = False) -> DataFrame:
    """``load_kaggle_dataset``: scan, map to (product_title, category) (SRC-1..8); ``ranges`` as in the scan."""
    path = f"{data_path.rstrip('/')}/{filename}"
    return map_columns(read_labelled_csv(spark, path, ranges=ranges), column_mapping)
