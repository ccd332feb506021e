"""Retraining of due users inside a stream (STRM-5): SET-4, CLS-7, model and history rows, committed together.

Each micro-batch makes two commits to one ``TableSet``:

1. its examples (``training``), the users' counts of examples since their last training (``pending``, 0 for
   the users now due), the due users (``due``), and a ``pending`` and a ``running`` row for each in ``history``;
2. the due users' new models (``models``) and their ``completed`` or ``failed`` rows in ``history``.

A due user is trained anew on all own examples: confirmed and corrected ones together, one per transaction,
a correction before a confirmation and the newest first (SET-4); the model is that user's logistic regression (CLS-7).
A user with fewer than two labels can't be trained and fails.  A batch that is run again, after a lost
executor or a restart, finds what it has already committed and does the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.feedback import training_set
from ..operators.linear import fit_linear_by_group
from ..session import materialize
from ..sources.commits import TableSet

def retrain_batch(tables: TableSet, batch: DataFrame, number: list[int], every: int, features: str, key: str, max_rounds: int = 15,
                  vectors: DataFrame | None = None, vector_key: str | None = None) -> None:
    """One micro-batch ``(key, user_id, label, source, created_at, features)``; ``number`` orders the batches.

    With ``vectors(vector_key, features)``, of one row per key, the examples carry ``vector_key`` instead of
    ``features``; vectors then only meet the chosen examples of the users to train, and no table keeps them.
    """
    carried = features if vectors is None else vector_key
    spark = batch.sparkSession
    kind = batch.schema["user_id"].dataType.simpleString()
    run = "-".join(map(str, number))
    base = tables.manifest()
    if base["key"] is None or base["key"] < [*number, 0]:
        folder = tables.stage("training", batch)
        rows = spark.read.schema(batch.schema).parquet(f"{tables.root}/{folder}")
        before = tables.read("pending", f"user_id {kind}, n long", base)
        counts = before.unionByName(rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))).groupBy("user_id").agg(F.sum("n").alias("n"))
        counts = materialize(counts, "retrain_counts")
        newest = rows.agg(F.max("created_at")).scalar()
        due = counts.filter(F.col("n") >= every).select("user_id", F.concat_ws("-", F.lit(run), F.col("user_id").cast("string")).alias("run_id"),
                                                        newest.alias("at"))
        due = materialize(due, "retrain_due")
        states = due.select("run_id", "user_id", F.explode(F.array(F.lit("pending"), F.lit("running"))).alias("status"), "at",
                            F.lit(None).cast("long").alias("n_samples"), F.lit(None).cast("long").alias("n_categories"),
                            F.lit(None).cast("boolean").alias("converged"))
        left = counts.withColumn("n", F.when(F.col("n") >= every, 0).otherwise(F.col("n")).cast("long"))
        tables.commit([*number, 0], {"training": folder, "history": states}, {"pending": left, "due": due}, base)
    base = tables.manifest()
    if base["key"] >= [*number, 1]:
        return
    due = tables.read("due", None, base)
    rows = tables.read("training", batch.schema, base).join(due.select("user_id"), "user_id", "left_semi")
    examples = training_set(rows.filter(F.col("source") == "auto_confirmed"), rows.filter(F.col("source") == "user_feedback"), key,
                            carry=[carried], newest="created_at")
    examples = materialize(examples, "retrain_examples")
    sizes = examples.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_samples"), F.countDistinct("label").alias("n_categories"))
    able = sizes.filter(F.col("n_categories") >= 2).select("user_id")
    able_rows = examples.join(able, "user_id", "left_semi")
    if vectors is not None:
        able_rows = able_rows.join(vectors.select(vector_key, features), vector_key)
    model = fit_linear_by_group(able_rows, features, "label", ["user_id"], max_rounds=max_rounds)
    model = materialize(model.join(due, "user_id").select("user_id", "label_id", "label", "coef", "intercept", "converged", "run_id",
                                                          F.lit(number[0]).cast("long").alias("run"), F.lit(number[1]).cast("long").alias("batch")), "retrain_models")
    fitted = model.groupBy("user_id").agg(F.bool_and("converged").alias("converged"))
    done = (due.join(sizes, "user_id", "left").join(fitted, "user_id", "left")
            .select("run_id", "user_id", F.when(F.col("converged").isNull(), "failed").otherwise("completed").alias("status"), "at",
                    "n_samples", "n_categories", "converged"))
    tables.commit([*number, 1], {"models": model, "history": done}, None, base)


def retrain_stream(stream: DataFrame, root: str, every: int = 10, features: str = "embedding", key: str = "transaction_id",
                   max_rounds: int = 15, vectors: DataFrame | None = None, vector_key: str | None = None) -> StreamingQuery:
    """Start the loop over a stream of training examples; tables and checkpoint lie under ``root``.

    A restart with the same ``root`` goes on where the last one stopped.
    """
    tables = TableSet(stream.sparkSession, f"{root.rstrip('/')}/tables")
    return (stream.writeStream.foreachBatch(lambda batch, epoch: retrain_batch(tables, batch, [0, epoch], every, features, key, max_rounds, vectors, vector_key))
            .option("checkpointLocation", f"{root.rstrip('/')}/_checkpoint").trigger(availableNow=True).start())


def run_states(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest status of each training run."""
    history = TableSet(spark, f"{root.rstrip('/')}/tables").read("history")
    order = F.array_position(F.array(*[F.lit(s) for s in ("pending", "running", "completed", "failed")]), F.col("status"))
    return history and history.groupBy("run_id", "user_id").agg(
        F.max_by(F.struct("status", "at", "n_samples", "n_categories", "converged"), order).alias("s")).select("run_id", "user_id", "s.*")


def current_models(spark: SparkSession, root: str) -> DataFrame | None:
    """Each user's newest model (WIN-6)."""
    models = TableSet(spark, f"{root.rstrip('/')}/tables").read("models")
    if models is None:
        return None
    newest = models.groupBy("user_id").agg(F.max(F.struct("run", "batch")).alias("b")).select("user_id", "b.run", "b.batch")
    return models.join(newest, ["user_id", "run", "batch"])
