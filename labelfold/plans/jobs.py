"""The training job (CLS-1..4, CLS-8..15, SNK-1/2, SRC-8/9) on Spark ML.

``train(spark, config)`` = load → validate → clean → split → fit → save →
evaluate on val and test.  The featuriser is TF-IDF inside the Spark ML
pipeline (hashing keeps the vocabulary bounded); stored vectors can be used
instead (``features: vector``).  LR reproduces the reference's L2-penalised
objective: ``regParam = 1 / (C · Σw)``, ``standardization = False`` and the
inverse-frequency class weights as ``weightCol``.
"""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import NOT_WORD_RUN, clean_text
from ..operators import classify as C
from ..operators import labels, metrics, quality, split
from ..session import materialize
from ..sources.columns import map_columns
from ..sources.csv_source import load_dataset

HASH_FEATURES = 1 << 18
#: Hashed terms of an MLP's input layer: each costs a row of dense weights.
MLP_FEATURES = 1 << 10
MODEL_PATH = "models/checkpoint"


def prepare_training_frame(df: DataFrame, label: str = "category") -> tuple[DataFrame, DataFrame, float]:
    """Attach label ids and class weights computed on the rows given (the train part).

    Returns (frame with label_id/weight, label index, Σw).  A NULL label is an error.
    """
    if df.filter(F.col(label).isNull()).limit(1).count():
        raise ValueError(f"column {label} has NULL labels")
    w = labels.class_weights(df, label)
    idx = w.select(label, "label_id")
    x = df.join(w.select(label, "label_id", "weight"), label)
    total = x.agg(F.sum("weight")).first()[0]
    return x.withColumn("label_id", F.col("label_id").cast("double")), idx, float(total)


def text_pipeline(classifier, num_features: int = HASH_FEATURES) -> Pipeline:
    """Tokenise cleaned titles → hashed term counts → IDF → classifier."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol="product_title", outputCol="tokens", pattern=NOT_WORD_RUN,
                       toLowercase=False, minTokenLength=1),
        HashingTF(inputCol="tokens", outputCol="tf", numFeatures=num_features),
        IDF(inputCol="tf", outputCol="features"),
        classifier,
    ])


def fit(train: DataFrame, classifier_type: str = "lr", params: dict | None = None,
        features: str = "text", use_class_weights: bool = True, vector_col: str = "embedding",
        label: str = "category", num_features: int | None = None):
    """Fit on the train part (CLS-2/3/4).  Returns (PipelineModel, label index).

    ``num_features`` is the width of the hashed text (by default ``MLP_FEATURES`` for an
    MLP, else ``HASH_FEATURES``).
    """
    x, idx, total = prepare_training_frame(train, label)
    if not use_class_weights:
        x, total = x.withColumn("weight", F.lit(1.0)), float(x.count())
    n_classes = idx.count()
    if features == "vector":
        x = x.withColumn("features", array_to_vector(F.col(vector_col).cast("array<double>")))
        dim = len(x.select(vector_col).first()[0])
    else:
        dim = num_features or (MLP_FEATURES if classifier_type == "mlp" else HASH_FEATURES)
    clf = C.make_classifier(classifier_type, n_features=dim, n_classes=n_classes,
                            params=params, total_weight=total)
    stages = [clf] if features == "vector" else text_pipeline(clf, dim).getStages()
    model = Pipeline(stages=stages).fit(x)
    return model, idx


def predict(model: PipelineModel, idx: DataFrame, df: DataFrame, features: str = "text",
            vector_col: str = "embedding", label: str = "category", clean: bool = True,
            lowercase: bool = True, punctuation: bool = False) -> DataFrame:
    """One transform: predicted label, probabilities and confidence (CLS-8..10).

    Text is cleaned exactly as for training (``clean=False`` reproduces the
    reference, which scores raw titles).
    """
    if model is None:
        raise ValueError("the model isn't fitted: call fit() before predict()")
    if features == "vector":
        df = df.withColumn("features", array_to_vector(F.col(vector_col).cast("array<double>")))
    elif clean:
        df = df.withColumn("product_title", clean_text("product_title", lowercase, punctuation))
    out = model.transform(df)
    if "probability" in out.columns:
        out = out.withColumn("proba", vector_to_array("probability")).withColumn(
            "confidence", F.array_max("proba"))
    else:
        out = out.withColumn("confidence", F.lit(None).cast("double"))
    names = idx.select(F.col("label_id").cast("double").alias("prediction"),
                       F.col(label).alias("predicted"))
    return out.join(names, "prediction", "left")


def save(model: PipelineModel, idx: DataFrame, path: str, meta: dict, label: str = "category") -> None:
    """Model directory: Spark ML pipeline + label table + metadata (SNK-1/2).

    The metadata holds ``meta`` (JSON values), the two label maps and ``is_fitted``.
    """
    if model is None:
        raise ValueError("no trained model to save")
    model.write().overwrite().save(f"{path}/pipeline")
    idx.write.mode("overwrite").parquet(f"{path}/labels")
    rows = [(int(r["label_id"]), r[label]) for r in idx.select("label_id", label).collect()]  # one per label
    full = dict(meta, id_to_label={str(i): x for i, x in rows}, label_to_id={x: i for i, x in rows}, is_fitted=True)
    spark = idx.sparkSession
    spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False)) for k, v in full.items()], "key string, value string") \
        .write.mode("overwrite").json(f"{path}/metadata")


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame, dict]:
    """Inverse of ``save`` (SRC-9): parameters and label maps come back with their types."""
    meta = {r["key"]: json.loads(r["value"]) for r in spark.read.json(f"{path}/metadata").collect()}
    meta["id_to_label"] = {int(k): v for k, v in meta.get("id_to_label", {}).items()}
    return PipelineModel.load(f"{path}/pipeline"), spark.read.parquet(f"{path}/labels"), meta


def content_keys(df: DataFrame, key: str = "_row") -> DataFrame:
    """Give every row a key made of its values and, for equal rows, a number: the same on any cluster."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    each = counted.select(*cols, F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_k"))
    # to_json keeps NULL and the empty text apart
    return each.select(*cols, F.sha2(F.concat_ws("#", F.to_json(F.struct(*cols)), F.col("_k").cast("string")), 256).alias(key))


def cross_validate(train: DataFrame, reg_grid=(0.0, 0.01, 0.1), folds: int = 3, seed: int = 42,
                   params: dict | None = None, num_features: int = HASH_FEATURES):
    """k-fold CV over regParam for text LR (CLS-15)."""
    x, _, _ = prepare_training_frame(train)
    lr = C.make_classifier("lr", total_weight=1.0, params=params)
    pipe = text_pipeline(lr, num_features)
    grid = ParamGridBuilder().addGrid(lr.regParam, list(reg_grid)).build()
    ev = MulticlassClassificationEvaluator(labelCol="label_id", metricName="f1")
    return CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=ev, numFolds=folds,
                          seed=seed).fit(x)


def train(spark: SparkSession, config: dict, frame: DataFrame | None = None) -> dict:
    """``run_training`` + evaluation (CLS-12/13).  Returns model, label table and metric frames."""
    data = config.get("data", {})
    if frame is None:
        if "path" not in data:
            raise ValueError("config data.path is required")
        frame = load_dataset(spark, data["path"], data.get("filename", "product_titles.csv"),
                             data.get("column_mapping"), data.get("ranges", False))
    else:
        frame = map_columns(frame, data.get("column_mapping"), keep=tuple(data.get("keep", ())))
    quality.validate(frame)
    pre = config.get("preprocessing", {})
    options = {"lowercase": pre.get("lowercase", True), "punctuation": pre.get("remove_punctuation", False)}
    clean = quality.preprocess(frame, **options)
    key = data.get("key")
    if key is None:
        key = "_row"  # of the row's content, so the split doesn't depend on partitions or cores
        clean = content_keys(clean, key)
    clean = materialize(clean, "keyed_rows")
    sp = config.get("split", {})
    parts = split.split_stratified(clean, key, label="category", test_size=sp.get("test_size", 0.2),
                                   val_size=sp.get("val_size", 0.1), seed=sp.get("random_seed", 42))
    parts = materialize(parts, "training_split")
    mc = config.get("model", {})
    kind, features = mc.get("classifier_type", "mlp"), mc.get("features", "text")
    part, params = parts.filter("split = 'train'").drop("split"), dict(mc.get("classifier_params") or {})
    if kind == "mlp" and params.pop("early_stopping", True):
        model, idx, _ = fit_mlp_early_stopping(part, key, features, params, num_features=mc.get("num_features"),
                                               validation_fraction=params.pop("validation_fraction", 0.1))
    else:
        model, idx = fit(part, kind, params, features=features, num_features=mc.get("num_features"))
    meta = {"embedding_model_name": mc.get("embedding_model_name", "tf-idf" if features == "text" else features),
            "classifier_type": kind, "classifier_params": mc.get("classifier_params") or {},
            "embedding_dim": model.stages[-1].numFeatures, "preprocessing": options, "features": features}
    save(model, idx, config.get("output", {}).get("model_path") or MODEL_PATH, meta)
    # the parts are clean already
    scored = predict(model, idx, parts.filter("split != 'train'"), features=features, clean=False)
    s = scored.select("split", F.col("category").alias("y_true"), F.col("predicted").alias("y_pred"),
                      "confidence")
    return {"model": model, "labels": idx, "split": parts, "metadata": meta,
            "evaluation": metrics.evaluate_with_confidence(s, by=["split"]),
            "report": metrics.classification_report(s.filter("split = 'test'"))}


def fit_mlp_early_stopping(train: DataFrame, key: str, features: str = "vector", params: dict | None = None,
                           stage_iter: int = 25, patience: int = 4, tol: float = 1e-4,
                           validation_fraction: float = 0.1, seed: int = 42, label: str = "category",
                           num_features: int | None = None, vector_col: str = "embedding"):
    """MLP with early stopping (CLS-3): one training run in stages of ``stage_iter`` iterations.

    Each stage goes on from the weights of the one before (``initialWeights``) and is scored on a seeded,
    stratified hold-out of the train part, whose features are computed once and written.  The run ends at
    ``max_iter`` iterations, when a stage ends early (converged), or after ``patience`` stages without an
    accuracy better by ``tol``; the weights of the best stage are the model, nothing is fitted anew.
    Without any hold-out row (tiny inputs) the newest weights are kept.
    Returns (PipelineModel, label index, [(iterations so far, hold-out accuracy)]).
    """
    params = dict(params or {})
    left = int(params.pop("max_iter", 500))
    x, idx, _ = prepare_training_frame(train, label)
    parts = split.split_stratified(x, key, label=label, test_size=validation_fraction, val_size=0.0, seed=seed)
    parts = materialize(parts, "mlp_holdout")
    fit_part, hold = parts.filter(F.col("split") == "train"), parts.filter(F.col("split") != "train")
    if features == "vector":
        stages, dim = [], len(x.select(vector_col).first()[0])
        featured = lambda df: df.withColumn("features", array_to_vector(F.col(vector_col).cast("array<double>")))
    else:
        dim = num_features or MLP_FEATURES
        prepare = Pipeline(stages=text_pipeline(None, dim).getStages()[:-1]).fit(fit_part)
        stages, featured = prepare.stages, prepare.transform
    fit_part, hold = (materialize(featured(df).select("features", "label_id"), "mlp_features") for df in (fit_part, hold))
    done, best, worse, model, scores = 0, None, 0, None, []
    while left > 0:
        clf = C.make_classifier("mlp", dim, idx.count(), params | {"max_iter": min(stage_iter, left)})
        if model is not None:
            clf = clf.setInitialWeights(model.weights)
        model = clf.fit(fit_part)
        steps = model.summary().totalIterations
        done, left = done + steps, left - clf.getMaxIter()
        accuracy = model.transform(hold).agg(F.avg((F.col("prediction") == F.col("label_id")).cast("double"))).first()[0]
        scores.append((done, accuracy))
        if best is None or accuracy is None or accuracy > best[0] + tol:
            best, worse = (accuracy, model), 0
        else:
            worse += 1
        if steps < clf.getMaxIter() or worse >= patience:
            break
    return PipelineModel(stages=[*stages, best[1]]), idx, scores
