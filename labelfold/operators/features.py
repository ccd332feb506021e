"""Text and vector features (EMB-1..3, ARR-1).

TF-IDF is kept as long ``(by…, key, term, value)`` triplets: the term
explode and the ``(key, term)`` count are map-side partial aggregations, the
IDF table is bounded by the vocabulary, and its join is left to AQE (broadcast
when measured small, otherwise a sort-merge join with skew splitting for
very common terms).  Jobs that read the counts several times keep them in blocks
(``term_blocks``); the operators take either layout.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import NOT_WORD_RUN, clean_text
from ..session import materialize
from . import term_blocks as B


def term_counts(df: DataFrame, key: str, text: str, by: Sequence[str] = (),
                clean: bool = True, label: str | None = None, parts: int = 1) -> DataFrame:
    """(by…, key, term, tf): token counts per document (whole texts).

    Of the cleaning only the lower-casing can change a token: white space separates tokens
    whether it is collapsed or not, so its regex pass over the text is left out.

    With ``label``, one of ``by``, the same counts come in blocks whose terms are cut into ``parts`` (``term_blocks``);
    the rows of a key must lie in one partition.
    """
    t = F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))) if clean else F.col(text)
    if label is not None:
        words = F.coalesce(F.regexp_replace(t, NOT_WORD_RUN, " "), F.lit(""))
        return B.pack(df.select(*by, key, words.alias("_words")), key, "_words", [c for c in by if c != label], label, parts)
    # explode the raw split and drop empty pieces with a plain predicate (codegen),
    # rather than a per-row higher-order filter
    return (df.select(*by, key, F.explode(F.split(t, NOT_WORD_RUN)).alias("term"))
            .filter(F.col("term") != "")
            .groupBy(*by, key, "term").agg(F.count(F.lit(1)).alias("tf")))


def idf_table(tf: DataFrame, docs: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """(by…, term, df, tf_total, idf) with Spark ML's smoothing ``ln((m + 1) / (df + 1))``.

    ``docs`` holds the fitting documents (one row per key); ``m`` is their count per group.
    """
    by = list(by)
    if B.is_packed(tf):
        m = docs.groupBy(*by).agg(F.count(F.lit(1)).alias("m"))
        x = B.document_counts(tf, by)
        # written, so its measured size decides how the arrays meet it
        x = x.join(materialize(m, "documents"), by) if by else x.withColumn("m", m.scalar())
        return x.withColumn("idf", F.transform("df", lambda n: F.log((F.col("m") + 1).cast("double") / (n + 1))))
    dfreq = tf.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf_total"))
    if by:
        m = docs.groupBy(*by).agg(F.count(F.lit(1)).alias("m"))
        x = dfreq.join(m, by)
    else:
        x = dfreq.withColumn("m", docs.agg(F.count(F.lit(1))).scalar())
    return x.withColumn("idf", F.log((F.col("m") + 1).cast("double") / (F.col("df") + 1)))


def tfidf_norms(tf: DataFrame, idf: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """(by…, key, norm): length of each document's tf·idf vector; terms outside the IDF vocabulary drop out.

    A document's terms lie together, so the sums are nearly finished before the shuffle.
    """
    by = list(by)
    if B.is_packed(tf):
        return B.squared_norms(tf, idf, key, by).groupBy(*by, key).agg(F.sqrt(F.sum("_square")).alias("norm"))
    w = F.col("tf") * F.col("idf")
    return (tf.join(idf.filter(F.col("idf") > 0).select(*by, "term", "idf"), by + ["term"])
            .groupBy(*by, key).agg(F.sqrt(F.sum(w * w)).alias("norm")))


# --- random projection of character n-grams (EMB-1, EMB-2) ----------------------------------

#: Width of the projected vectors and length of the character n-grams.
PROJECTED, GRAM = 64, 3


def char_grams(df: DataFrame, key: str, text: str, n: int = GRAM) -> DataFrame:
    """(key, term, tf): character n-grams of the cleaned text between two spaces, over whole texts.

    Splitting into characters once keeps the work linear in the text's length.
    """
    chars = F.split(F.concat(F.lit(" "), clean_text(text), F.lit(" ")), "")
    grams = F.transform(F.sequence(F.lit(0), F.size("_c") - n), lambda i: F.concat(*[F.get("_c", i + j) for j in range(n)]))
    return (df.select(key, chars.alias("_c")).filter(F.size("_c") >= n)
            .select(key, F.explode(grams).alias("term"))
            .groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf")))


def project_text(df: DataFrame, key: str, text: str, idf: DataFrame, dim: int = PROJECTED, n: int = GRAM) -> DataFrame:
    """(key, embedding): each text's n-gram TF-IDF projected to ``dim`` values, in SQL functions only.

    An n-gram adds its weight, with a sign, to one place; both come from its MD5 digest, so a text has
    the same vector on any cluster.  ``idf`` is the ``idf_table`` of ``char_grams`` of the fitting texts;
    other n-grams weigh as if in none of them.  One row per key of ``df``; a text shorter than one
    n-gram (an empty one, for n > 2) has the zero vector.
    """
    code = F.md5(F.col("term"))
    place = (F.conv(F.substring(code, 1, 4), 16, 10).cast("int") % dim).alias("_place")
    sign = F.when(F.conv(F.substring(code, 5, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    unseen = F.coalesce(idf.agg(F.log(F.max("m") + 1.0)).scalar(), F.lit(1.0))
    w = char_grams(df, key, text, n).join(idf.select("term", "idf"), "term", "left")
    s = w.select(key, place, (F.col("tf") * F.coalesce("idf", unseen) * sign).alias("_w")).groupBy(key, "_place").agg(F.sum("_w").alias("_w"))
    v = s.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_place", "_w"))).alias("_v"))
    full = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("_v", i), F.lit(0.0)))
    return df.select(key).distinct().join(v, key, "left").select(key, full.alias("embedding"))


def to_vector(col: str) -> F.Column:
    """ARRAY<FLOAT|DOUBLE> → ML vector (ARR-1)."""
    return array_to_vector(F.col(col))


def encode_with(df: DataFrame, text: str, encoder_factory: Callable[[], Callable],
                dim: int, out: str = "embedding") -> DataFrame:
    """Batch-embed a text column with a caller-supplied encoder (EMB-1b).

    ``encoder_factory`` is called once per Python worker process; the encoder
    maps a list of strings to an (n, dim) array.  Arrow batches carry the
    texts, so there is no per-row serialisation.
    """
    cache: dict = {}

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _encode(texts: pd.Series) -> pd.Series:
        enc = cache.get("enc")
        if enc is None:
            enc = cache["enc"] = encoder_factory()
        arr = np.asarray(enc(texts.fillna("").tolist()), dtype=np.float32).reshape(len(texts), dim)
        return pd.Series(list(arr))

    return df.withColumn(out, _encode(F.col(text)))
