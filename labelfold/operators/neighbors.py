"""Similar-item search for explanations (JOIN-10), scalable variant.

Exact top-k by cosine needs every query–corpus pair, which this engine does
not emit.  Here candidates come from random-projection LSH on L2-normalised
vectors (Euclidean distance is monotone in cosine there: d² = 2 − 2·cos),
the cosine is then computed exactly on the candidates, and ``row_number() <= k``
per query keeps the best (planned as a WindowGroupLimit).  ``bucket_length``
and ``num_hash_tables`` trade recall for candidate volume.
"""

from __future__ import annotations

from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .classify import cosine
from .vector_index import Index


def _unit(df: DataFrame, key: str, features: str) -> DataFrame:
    x = F.col(features).cast("array<double>")
    n = F.sqrt(F.aggregate(F.transform(x, lambda v: v * v), F.lit(0.0), lambda a, b: a + b))
    unit = F.transform(x, lambda v: F.when(n == 0, F.lit(0.0)).otherwise(v / n))
    return df.select(F.col(key).alias("id"), x.alias("x"), array_to_vector(unit).alias("features"))


def similar_items(queries: DataFrame, corpus: DataFrame, key: str, features: str, k: int = 5,
                  bucket_length: float = 0.6, num_hash_tables: int = 8, max_distance: float = 1.5,
                  seed: int = 42) -> DataFrame:
    """(query_id, item_id, cosine, rank) for up to k LSH candidates per query."""
    q = _unit(queries, key, features)
    c = _unit(corpus, key, features)
    lsh = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", seed=seed,
                                      bucketLength=bucket_length, numHashTables=num_hash_tables).fit(c)
    pairs = lsh.approxSimilarityJoin(q, c, max_distance, distCol="dist")
    p = pairs.select(F.col("datasetA.id").alias("query_id"), F.col("datasetB.id").alias("item_id"),
                     cosine(F.col("datasetA.x"), F.col("datasetB.x")).alias("cosine")) \
        .filter(F.col("query_id") != F.col("item_id"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), F.col("item_id"))
    return p.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest_exact(queries: DataFrame, corpus: DataFrame, key: str, features: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Exact top-k by cosine without scoring every query–corpus pair (JOIN-10): ``vector_index``.

    Result: (query_id, item_id, cosine, rank), ties by id.
    """
    return Index(corpus, key, features, k, seed).search(queries, key, features).drop("certified")
