"""Python-exact text cleaning as native Spark column expressions (STR-1..7).

The reference cleans titles with Python ``str.strip``/``str.lower`` and
``re`` with Unicode ``\\w``/``\\s``.  Java's ``trim`` strips only U+0020 and
Java's plain ``\\w`` is ASCII-only, so the expressions below use Unicode-aware
classes that reproduce Python's behaviour.  Everything stays JVM-side inside
whole-stage codegen: there is no Python UDF on this path.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters for which Python's str.isspace() is true, as an
# explicit class (no Unicode-property lookups per character).
WS_CLASS = (r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
WS_RUN = rf"[{WS_CLASS}]+"
LEADING_WS = rf"\A[{WS_CLASS}]+"
TRAILING_WS = rf"[{WS_CLASS}]+\z"
# Python re: [^\w\s]  (\w = Unicode letters, digits, underscore)
NOT_WORD_OR_SPACE = rf"[^\p{{L}}\p{{N}}_{WS_CLASS}]"
# token separator for the TF-IDF featuriser: anything that is not \w
NOT_WORD_RUN = r"[^\p{L}\p{N}_]+"

# Pandas read_csv default missing-value tokens.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """Python ``str.strip()`` (Unicode whitespace) — STR-1."""
    c = as_col(c)
    return F.regexp_replace(F.regexp_replace(c, LEADING_WS, ""), TRAILING_WS, "")


def remove_punctuation(c: Column | str) -> Column:
    """Python ``re.sub(r"[^\\w\\s]", "", s)`` — STR-3."""
    return F.regexp_replace(as_col(c), NOT_WORD_OR_SPACE, "")


def collapse_whitespace(c: Column | str) -> Column:
    """Python ``re.sub(r"\\s+", " ", s)`` — STR-4 (before the final strip)."""
    return F.regexp_replace(as_col(c), WS_RUN, " ")


def clean_text(c: Column | str, lowercase: bool = True,
               punctuation: bool = False) -> Column:
    """``preprocess_text`` as one expression — STR-6.

    missing → "" (STR-5), strip, optional lower (STR-2), optional punctuation
    removal (STR-3), whitespace collapse (STR-4), strip again.
    """
    x = F.coalesce(as_col(c).cast("string"), F.lit(""))
    # Python strips first, but neither lower-casing nor punctuation removal
    # creates or deletes whitespace: after the collapse every edge run is a
    # single U+0020, which ``trim`` removes.  One regex pass instead of five.
    if lowercase:
        x = F.lower(x)
    if punctuation:
        x = remove_punctuation(x)
    return F.trim(collapse_whitespace(x))


def has_content(c: Column | str, punctuation: bool = False) -> Column:
    """True when ``clean_text`` of the value is non-empty, decided on the raw text.

    Cleaning never adds characters, so the cleaned text is empty exactly when the
    raw text has no non-whitespace character (no word character when punctuation
    is removed).  ``rlike`` stops at the first such character, and the filter no
    longer repeats the whole-text cleaning that Catalyst would otherwise inline
    into it when it pushes the filter below the projection.
    """
    x = F.coalesce(as_col(c).cast("string"), F.lit(""))
    return x.rlike(r"[\p{L}\p{N}_]") if punctuation else x.rlike(rf"[^{WS_CLASS}]")


def is_blank(c: Column | str) -> Column:
    """True when the string is empty after a Python strip (DQ-1e); NULL is not blank."""
    c = as_col(c)
    return F.when(c.isNotNull(), ~has_content(c)).otherwise(F.lit(False))


def null_na_tokens(c: Column | str, tokens=NA_TOKENS) -> Column:
    """pandas ``read_csv`` NA handling: listed tokens become NULL (SRC-3)."""
    c = as_col(c)
    return F.when(c.isin(list(tokens)), F.lit(None).cast("string")).otherwise(c)


def tokens(c: Column | str) -> Column:
    """Word tokens of an already cleaned text (array, empty strings removed)."""
    return F.filter(F.split(as_col(c), NOT_WORD_RUN), lambda t: t != "")
