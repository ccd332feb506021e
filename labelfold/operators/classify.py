"""Model tables and scoring (CLS-1..15, JOIN-9, JOIN-11, SORT-3/4, MATH-3).

A fitted model is a *table* keyed by ``by…`` and label, so global and
per-user models score through the same join: the model is joined on ``by``
(a constant key for the global model), scores are computed column-wise, and
the arg-max / top-k / softmax are taken per scored row over at most ``k``
label scores (bounded by the label count, never by the data size).

* sparse prototype:  (by…, label, term, idf, weight)       — text TF-IDF; arrays by part for counts in blocks (``term_blocks``)
* dense prototype:   (by…, label, coef ARRAY<DOUBLE>, intercept)  — vectors
* linear (LR):       same dense layout, exported from Spark ML
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import (LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, OneVsRest)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import term_blocks as B

# Softmax temperature that turns cosine scores into probabilities.
TEMPERATURE = 0.1


# --- sparse (TF-IDF) prototypes ------------------------------------------------------------

def sparse_prototypes(terms: DataFrame, idf: DataFrame, norms: DataFrame, key: str, label: str = "label",
                      by: Sequence[str] = ()) -> DataFrame:
    """Mean TF-IDF vector per label as (by…, label, term, idf, weight) (CLS-5).

    ``terms(by…, key, label, term, tf)`` are the train documents' counts, ``norms`` the documents'
    lengths (``features.tfidf_norms``).  Weights are sums of unit vectors; ``score_sparse``
    divides by the labels' lengths, so the model is summed once and never joined with itself.
    """
    by = list(by)
    if B.is_packed(terms):
        return B.prototypes(terms, idf, norms, key, label, by)
    x = terms.join(idf.filter(F.col("idf") > 0).select(*by, "term", "idf"), by + ["term"]).join(norms, by + [key])
    return x.groupBy(*by, label, "term").agg(F.first("idf").alias("idf"),
                                             F.sum(F.col("tf") * F.col("idf") / F.col("norm")).alias("weight"))


def score_sparse(terms: DataFrame, model: DataFrame, norms: DataFrame, key: str, label: str = "label",
                 by: Sequence[str] = ()) -> DataFrame:
    """Cosine of each document with each prototype sharing a term: (by…, key, label, score).

    ``terms(by…, key, term, tf)`` are raw counts; both lengths divide the finished sums, so no
    normalised vector is written or shuffled.
    """
    by = list(by)
    if B.is_packed(terms):
        lengths = B.lengths(model, label, by)
        dots = B.dots(terms, model, key, label, by).groupBy(*by, key, label).agg(F.sum("_dot").alias("_dot"))
    else:
        lengths = model.groupBy(*by, label).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_length"))
        dots = (terms.select(*by, key, "term", "tf").join(model, by + ["term"])
                .groupBy(*by, key, label).agg(F.sum(F.col("tf") * F.col("idf") * F.col("weight")).alias("_dot")))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"l.{c}")) for c in by + [label]]  # a NULL label is a label
    x = dots.join(norms, by + [key])
    return (x.alias("s").join(lengths.alias("l"), same)
            .select(*[F.col(f"s.{c}") for c in by + [key, label]], (F.col("s._dot") / (F.col("s.norm") * F.col("l._length"))).alias("score")))


def label_counts(labelled: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Number of labels of each group: (by…, k)."""
    return labelled.select(*by, label).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("k"))


# --- dense prototypes / linear models ------------------------------------------------------

def dense_prototypes(df: DataFrame, features: str, label: str = "label",
                     by: Sequence[str] = ()) -> DataFrame:
    """Mean vector per label: (by…, label, coef, intercept=0) via Summarizer (CLS-5).

    Summarizer aggregates vectors map-side, one row per input vector — no explode.
    """
    by = list(by)
    v = df.select(*by, label, array_to_vector(F.col(features).cast("array<double>")).alias("_v"))
    m = v.groupBy(*by, label).agg(Summarizer.mean(F.col("_v")).alias("_m"))
    return m.select(*by, label, vector_to_array("_m").alias("coef"), F.lit(0.0).alias("intercept"))


def dot(a: F.Column, b: F.Column) -> F.Column:
    """Σ a_i·b_i over two equal-length arrays (ARR-2)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: F.Column) -> F.Column:
    return F.sqrt(dot(a, a))


def cosine(a: F.Column, b: F.Column) -> F.Column:
    """Cosine similarity; 0 when either vector has zero norm (ARR-2)."""
    d = norm(a) * norm(b)
    return F.when(d == 0, F.lit(0.0)).otherwise(dot(a, b) / d)


def score_dense(df: DataFrame, model: DataFrame, key: str, features: str, label: str = "label",
                by: Sequence[str] = (), metric: str = "cosine") -> DataFrame:
    """(by…, key, label, score) for every model label of the row's group.

    ``metric='cosine'`` for prototypes, ``'linear'`` (x·coef + intercept) for LR tables.
    """
    x = df.select(*by, key, F.col(features).cast("array<double>").alias("_x"))
    if by:
        j = x.join(model.select(*by, label, "coef", "intercept"), list(by))
    else:
        # global model: k labels × d dims packed into one scalar subquery (bounded)
        packed = model.agg(F.collect_list(F.struct(F.col(label).alias("_l"), "coef", "intercept"))).scalar()
        j = (x.select("*", F.explode(packed).alias("_m"))
             .select(key, "_x", F.col("_m._l").alias(label), "_m.coef", "_m.intercept"))
    s = cosine(F.col("_x"), F.col("coef")) if metric == "cosine" else dot(F.col("_x"), F.col("coef")) + F.col("intercept")
    return j.select(*by, key, label, s.alias("score"))


def score_rows(df: DataFrame, model: DataFrame, features: str, label: str = "label", by: Sequence[str] = (),
               metric: str = "cosine", score_digits: int = 9) -> DataFrame:
    """``df`` with ``_scores``: the (neg, label, score) of all labels, best first, ties by label (CLS-5, CLS-9, CLS-10).

    Scores stay in the row: a global model is one scalar subquery, a per-group one a packed row
    joined on ``by``; nothing of size rows × labels arises or is shuffled.  ``rank_rows`` and
    ``probability_rows`` read the result.
    """
    by = list(by)
    pack = F.collect_list(F.struct(F.col(label).alias("label"), "coef", "intercept", norm(F.col("coef")).alias("norm")))
    x = df.withColumn("_x", F.col(features).cast("array<double>"))
    x = x.join(model.groupBy(*by).agg(pack.alias("_m")), by) if by else x.withColumn("_m", model.agg(pack).scalar())
    x = x.withColumn("_n", norm(F.col("_x")))

    def one(m):
        d = dot(F.col("_x"), m["coef"])
        if metric == "linear":
            return d + m["intercept"]
        return F.when(F.col("_n") * m["norm"] == 0, F.lit(0.0)).otherwise(d / (F.col("_n") * m["norm"]))

    z = F.transform("_m", lambda m: F.struct(m["label"].alias("label"), one(m).alias("score")))
    ranked = F.array_sort(F.transform(z, lambda s: F.struct(
        (-F.round(s["score"], score_digits)).alias("neg"), s["label"].alias("label"), s["score"].alias("score"))))
    return x.withColumn("_scores", ranked).drop("_x", "_m", "_n")


def _exponents(temperature: float) -> tuple:
    top = F.element_at("_scores", 1)["score"]
    return top, F.aggregate("_scores", F.lit(0.0), lambda acc, s: acc + F.exp((s["score"] - top) / temperature))


def rank_rows(scored: DataFrame, temperature: float = TEMPERATURE, top: int = 3) -> DataFrame:
    """Replace ``_scores`` by predicted, score, confidence and top_labels (SORT-3, SORT-4, MATH-3)."""
    best, total = _exponents(temperature)
    return (scored.withColumns({"predicted": F.element_at("_scores", 1)["label"], "score": best, "confidence": 1.0 / total,
                                "top_labels": F.transform(F.slice("_scores", 1, top), lambda s: s["label"])}).drop("_scores"))


def probability_rows(scored: DataFrame, key: str, label: str = "label", temperature: float = TEMPERATURE) -> DataFrame:
    """(key, label, probability): softmax over each row's labels, unfolded in the row (CLS-9, MATH-3)."""
    best, total = _exponents(temperature)
    p = F.transform("_scores", lambda s: F.struct(s["label"].alias("label"), (F.exp((s["score"] - F.col("_best")) / temperature) / F.col("_total")).alias("p")))
    return (scored.select(key, "_scores", best.alias("_best"), total.alias("_total"))
            .select(key, F.explode(p).alias("_p")).select(key, F.col("_p.label").alias(label), F.col("_p.p").alias("probability")))


def linear_probabilities(df: DataFrame, model: DataFrame, key: str, features: str, label: str,
                         by: Sequence[str]) -> DataFrame:
    """(by…, key, probabilities): softmax over the labels of the row's group, computed in the row (CLS-9).

    ``model`` is a linear model table; the join carries one packed model per group,
    so neither rows × labels nor a second shuffle arises.
    """
    packed = model.groupBy(*by).agg(F.collect_list(F.struct(F.col(label).alias("label"), "coef", "intercept")).alias("_m"))
    x = df.select(*by, key, F.col(features).cast("array<double>").alias("_x")).join(packed, list(by))
    z = F.transform("_m", lambda m: F.struct(m["label"].alias("label"), (dot(F.col("_x"), m["coef"]) + m["intercept"]).alias("z")))
    x = x.select(*by, key, z.alias("_z"))
    top = F.array_max(F.transform("_z", lambda s: s["z"]))
    total = F.aggregate("_z", F.lit(0.0), lambda acc, s: acc + F.exp(s["z"] - top))
    return x.select(*by, key, F.transform("_z", lambda s: F.struct(
        s["label"].alias("label"), (F.exp(s["z"] - top) / total).alias("probability"))).alias("probabilities"))


# --- from label scores to predictions ----------------------------------------------------------

def rank_scores(scores: DataFrame, key: str, label: str = "label", by: Sequence[str] = (),
                k_labels: DataFrame | int | None = None, temperature: float = TEMPERATURE,
                top: int = 3, score_digits: int = 9) -> DataFrame:
    """Per row: predicted label (SORT-3), top labels (SORT-4), confidence (MATH-3).

    Ranks by ``round(score, score_digits)`` descending, ties by label.  Labels
    without a score row (sparse models) count as score 0 in the softmax; pass
    their number through ``k_labels`` (per-group table or constant).
    """
    by = list(by)
    g = scores.groupBy(*by, key).agg(F.array_sort(F.collect_list(F.struct(
        (-F.round("score", score_digits)).alias("neg"), F.col(label).alias("label"),
        F.col("score").alias("score")))).alias("_arr"))
    if isinstance(k_labels, DataFrame):
        if by:
            g = g.join(k_labels, by)
            kcol = F.col("k")
        else:
            g = g.withColumn("k", k_labels.select("k").scalar())
            kcol = F.col("k")
    else:
        kcol = F.size("_arr") if k_labels is None else F.lit(k_labels)
    best = F.element_at("_arr", 1)
    mx = F.greatest(best["score"], F.when(kcol > F.size("_arr"), F.lit(0.0)))
    denom = (F.aggregate("_arr", F.lit(0.0), lambda acc, s: acc + F.exp((s["score"] - mx) / temperature))
             + (kcol - F.size("_arr")) * F.exp((F.lit(0.0) - mx) / temperature))
    return g.select(*by, key, best["label"].alias("predicted"), best["score"].alias("score"),
                    (F.exp((best["score"] - mx) / temperature) / denom).alias("confidence"),
                    F.transform(F.slice("_arr", 1, top), lambda s: s["label"]).alias("top_labels"))


def zero_shot(df: DataFrame, label_vectors: DataFrame, key: str, features: str,
              vector: str = "embedding", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Cold-start fallback: arg-max cosine between an item's vector and the vectors of
    its group's category names, embedded with the same encoder (CLS-6, EMB-2)."""
    model = label_vectors.select(*by, label, F.col(vector).cast("array<double>").alias("coef"),
                                 F.lit(0.0).alias("intercept"))
    return rank_scores(score_dense(df, model, key, features, label, by), key, label, by)


def probabilities(scores: DataFrame, key: str, label: str = "label", by: Sequence[str] = (),
                  temperature: float = TEMPERATURE) -> DataFrame:
    """Softmax over each row's label scores: (by…, key, label, probability) (CLS-9)."""
    by = list(by)
    w = Window.partitionBy(*by, key)
    e = F.exp((F.col("score") - F.max("score").over(w)) / temperature)
    x = scores.withColumn("_e", e)
    return x.select(*by, key, label, (F.col("_e") / F.sum("_e").over(w)).alias("probability"))


def restrict_labels(scores: DataFrame, allowed: DataFrame, label: str = "label",
                    by: Sequence[str] = ("user_id",)) -> DataFrame:
    """Keep only the group's own active labels before the arg-max (JOIN-11)."""
    return scores.join(allowed.select(*by, label), list(by) + [label], "left_semi")


def with_fallback(keys: DataFrame, primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """User model if it scored the row, else the fallback model (JOIN-9).

    Rows that neither model can score keep a NULL prediction.
    """
    p = primary.select(key, F.col("predicted").alias("_p"), F.col("confidence").alias("_pc"))
    f = fallback.select(key, F.col("predicted").alias("_f"), F.col("confidence").alias("_fc"))
    j = keys.select(key).join(p, key, "left").join(f, key, "left")
    return j.select(key, F.coalesce("_p", "_f").alias("predicted"),
                    F.coalesce("_pc", "_fc").alias("confidence"),
                    F.when(F.col("_p").isNotNull(), "user_model").otherwise("fallback").alias("source"))


# --- Spark ML estimators (CLS-1..4, CLS-14, CLS-15) ------------------------------------------------

def make_classifier(classifier_type: str = "mlp", n_features: int | None = None,
                    n_classes: int | None = None, params: dict | None = None,
                    total_weight: float | None = None):
    """Factory: ``lr`` | ``mlp`` | ``svm`` estimator with the reference's defaults."""
    params = dict(params or {})
    if classifier_type == "lr":
        c = float(params.pop("C", 1.0))
        reg = 1.0 / (c * total_weight) if total_weight else 0.0
        return LogisticRegression(featuresCol="features", labelCol="label_id", weightCol="weight",
                                  maxIter=int(params.pop("max_iter", 1000)), regParam=reg,
                                  elasticNetParam=0.0, standardization=False, family="multinomial",
                                  tol=float(params.pop("tol", 1e-6)))
    if classifier_type == "mlp":
        hidden = list(params.pop("hidden_layer_sizes", (128, 64)))
        if n_features is None or n_classes is None:
            raise ValueError("mlp needs n_features and n_classes")
        return MultilayerPerceptronClassifier(featuresCol="features", labelCol="label_id",
                                              layers=[n_features, *hidden, n_classes],
                                              maxIter=int(params.pop("max_iter", 500)),
                                              seed=int(params.pop("random_state", 42)))
    if classifier_type == "svm":
        return OneVsRest(classifier=LinearSVC(maxIter=int(params.pop("max_iter", 100))),
                         featuresCol="features", labelCol="label_id")
    raise ValueError(f"classifier_type must be 'lr', 'mlp' or 'svm', not {classifier_type!r}")


def linear_model_table(lr_model, labels_by_id: DataFrame, label: str = "label") -> DataFrame:
    """Export a fitted multinomial LR to the model table (by-less): (label_id, label, coef, intercept)."""
    spark = labels_by_id.sparkSession
    coef = lr_model.coefficientMatrix.toArray()
    icpt = lr_model.interceptVector.toArray()
    rows = [(i, [float(v) for v in coef[i]], float(icpt[i])) for i in range(coef.shape[0])]
    t = spark.createDataFrame(rows, "label_id int, coef array<double>, intercept double")
    return t.join(labels_by_id.select("label_id", label), "label_id")
