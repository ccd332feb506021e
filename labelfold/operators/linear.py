"""One logistic-regression model per group, fitted with Spark aggregations (CLS-7).

The objective per group is Spark ML's (and, with ``regParam = 1/(C·Σw)``, the
reference's): ``(1/Σw) Σ wᵢ·CE(xᵢ, yᵢ) + (λ/2)·‖W‖²`` with an unpenalised
intercept and inverse-frequency class weights.  Groups are fitted by Newton's
method (``newton``) to a gradient below ``tol``: small ones each in one task, of bounded size,
others by rounds of Spark jobs.  A group with more than
``newton.MAX_PARAMETERS`` parameters, whose Hessian would not fit a task, is
fitted by accelerated gradient descent where every iteration is

* one equi-join of the training rows with the packed per-group model,
* the per-row gradient ``wᵢ (pᵢ − yᵢ) ⊗ [xᵢ, 1]`` computed in the row,
* one ``Summarizer.sum`` per group (a map-side partial aggregation, so a
  group holding a third of all rows is spread over every task),
* an update of the small model table, written to the shared checkpoint
  folder to cut lineage.

In each case the columns ``gradient`` (largest entry) and ``converged`` say how
far a group came.  No group above ``newton.LOCAL_VALUES`` is ever collected into one task, none to the driver.
The result uses the model-table layout ``(by…, label, coef, intercept)`` and
scores with ``classify.score_dense(metric="linear")``.  Rows without a label or
features are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .labels import class_weights
from .newton import LOCAL_VALUES, MAX_PARAMETERS, newton, newton_local


def _sum(arr: F.Column) -> F.Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, b: a + b)


def _logits(w: F.Column, xa: F.Column) -> F.Column:
    """Per class c: Σⱼ w[c·da + j]·xa[j]  (w row-major, da = len(xa))."""
    da = F.size(xa)
    return F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda c: _sum(
        F.zip_with(F.slice(w, c * da + 1, da), xa, lambda a, b: a * b)))


def fit_linear_by_group(df: DataFrame, features: str, label: str, by: Sequence[str],
                        C: float = 1.0, max_iter: int = 200, class_weighted: bool = True,
                        tol: float = 1e-6, max_rounds: int = 15) -> DataFrame:
    """Fit every group: ``(by…, label_id, label, coef, intercept, gradient, converged)``.

    ``max_rounds`` bounds the Newton rounds, ``max_iter`` the gradient steps of very wide groups;
    a group whose gradient is still above ``tol`` then has ``converged = false``.
    """
    by = list(by)
    if not by:
        raise ValueError("use plans.jobs.fit for a single global model")
    df = df.filter(F.col(label).isNotNull() & F.col(features).isNotNull())
    idx = class_weights(df, label, by)
    if not class_weighted:
        idx = idx.withColumn("weight", F.lit(1.0))
    # kept as they came (often floats); doubles and the intercept's one are added where rows are read
    rows = (df.select(*by, F.col(features).alias("x"), label)
            .join(idx.select(*by, label, "label_id", "weight"), by + [label])
            .select(*by, "x", "label_id", "weight"))
    rows = materialize(rows, "linear_rows")
    xa = F.concat(F.col("x").cast("array<double>"), F.array(F.lit(1.0)))
    consts = (rows.groupBy(*by)
              .agg(F.sum("weight").alias("sw"), F.count(F.lit(1)).alias("n"),
                   F.max(_sum(F.transform(xa, lambda v: v * v))).alias("xmax"),
                   F.max(F.size("x") + 1).alias("da"))
              .join(idx.groupBy(*by).agg(F.count(F.lit(1)).alias("k")), by)
              .withColumn("lam", F.lit(1.0) / (F.lit(C) * F.col("sw"))))
    consts = materialize(consts, "linear_groups")
    is_wide, is_long = F.col("k") * F.col("da") > MAX_PARAMETERS, F.col("n") * F.col("da") > LOCAL_VALUES
    wide, long = consts.filter(is_wide), consts.filter(~is_wide & is_long)
    out = newton_local(rows, consts.filter(~is_wide & ~is_long), by, tol, max_rounds)
    packed = rows.select(*by, xa.alias("xa"), "label_id", "weight")
    if not long.isEmpty():
        out = out.unionByName(newton(packed.join(long.select(*by), by, "left_semi"), long, by, tol, max_rounds))
    if not wide.isEmpty():
        out = out.unionByName(_by_gradient(packed.join(wide.select(*by), by, "left_semi"), wide, by, tol, max_iter))
    out = materialize(out, "linear_fits")  # the local fits run once, however often the result is read
    out = out.select(*by, "da", "w", "gradient", "converged", F.posexplode(F.sequence(F.lit(0), F.col("k").cast("int") - 1)).alias("_p", "label_id"))
    out = out.select(*by, F.col("label_id").cast("int").alias("label_id"),
                     F.slice("w", F.col("label_id") * F.col("da") + 1, F.col("da") - 1).alias("coef"),
                     F.element_at("w", ((F.col("label_id") + 1) * F.col("da")).cast("int")).alias("intercept"), "gradient", "converged")
    return out.join(idx.select(*by, "label_id", label), by + ["label_id"])


def _by_gradient(rows: DataFrame, consts: DataFrame, by: list[str], tol: float, max_iter: int, check_every: int = 10) -> DataFrame:
    """Accelerated gradient descent, checked every ``check_every`` steps on the small model table."""
    consts = consts.withColumn("step", F.lit(1.0) / (F.lit(0.5) * F.col("xmax") + F.col("lam")))
    zeros = F.array_repeat(F.lit(0.0), (F.col("k") * F.col("da")).cast("int"))
    model = materialize(consts.select(*by, "k", "da", "sw", "lam", "step",
                                      zeros.alias("w"), zeros.alias("w_prev")), "linear_model")
    for t in range(1, max_iter + 1):
        mom = (t - 1.0) / (t + 2.0)
        look = F.zip_with("w", "w_prev", lambda a, b: a + F.lit(mom) * (a - b))
        m = model.select(*by, "k", look.alias("v"))
        j = rows.join(m, by)
        z = _logits(F.col("v"), F.col("xa"))
        j = j.select(*by, "xa", "label_id", "weight", "k", z.alias("z"))
        mx = F.array_max("z")
        e = F.transform("z", lambda x: F.exp(x - mx))
        j = j.select(*by, "xa", "label_id", "weight", "k", e.alias("e"))
        se = _sum(F.col("e"))
        resid = F.transform("e", lambda x, c: F.col("weight") * (
            x / se - F.when(c == F.col("label_id"), F.lit(1.0)).otherwise(F.lit(0.0))))
        grad_row = F.flatten(F.transform(resid, lambda r: F.transform("xa", lambda xj: r * xj)))
        g = (j.select(*by, array_to_vector(grad_row).alias("g"))
             .groupBy(*by).agg(Summarizer.sum(F.col("g")).alias("g"))
             .select(*by, vector_to_array("g").alias("g")))
        nxt = model.join(g, by)
        v = F.zip_with("w", "w_prev", lambda a, b: a + F.lit(mom) * (a - b))
        # λ applies to coefficients only: the intercept is the last slot of each class block
        mask = F.transform(F.sequence(F.lit(1), F.col("k") * F.col("da")),
                           lambda i: F.when(F.pmod(i, F.col("da")) == 0, F.lit(0.0)).otherwise(F.lit(1.0)))
        full = F.zip_with(F.col("g"), F.zip_with(v, mask, lambda a, m: a * m),
                          lambda gg, vm: gg / F.col("sw") + F.col("lam") * vm)
        w_new = F.zip_with(v, full, lambda a, b: a - F.col("step") * b)
        gmax = F.array_max(F.transform(full, lambda x: F.abs(x)))
        model = materialize(nxt.select(*by, "k", "da", "sw", "lam", "step", w_new.alias("w"),
                                       F.col("w").alias("w_prev"), gmax.alias("_gmax")), "linear_model")
        if t % check_every == 0 and model.agg(F.max("_gmax")).first()[0] < tol:
            break
    return model.select(*by, "k", "da", "w", F.col("_gmax").alias("gradient"), (F.col("_gmax") <= tol).alias("converged"))


def objective(df: DataFrame, model: DataFrame, features: str, label: str, by: Sequence[str],
              C: float = 1.0, class_weighted: bool = True) -> DataFrame:
    """Per-group value of the fitted objective (for checks and model comparison)."""
    by = list(by)
    idx = class_weights(df, label, by)
    if not class_weighted:
        idx = idx.withColumn("weight", F.lit(1.0))
    x = df.select(*by, F.col(features).cast("array<double>").alias("x"), label).join(
        idx.select(*by, label, "label_id", "weight"), by + [label])
    x = x.withColumn("_r", F.monotonically_increasing_id())
    s = x.join(model.select(*by, F.col(label).alias("_lab"), "coef", "intercept"), by)
    s = s.withColumn("z", _sum(F.zip_with("x", "coef", lambda a, b: a * b)) + F.col("intercept"))
    # log-sum-exp about the row's maximum, which doesn't overflow
    s = s.withColumn("_m", F.max("z").over(Window.partitionBy(*by, "_r")))
    per_row = s.groupBy(*by, "_r", "weight", label).agg(
        (F.max("_m") + F.log(F.sum(F.exp(F.col("z") - F.col("_m")))) - F.sum(F.when(F.col("_lab") == F.col(label), F.col("z")))).alias("ce"))
    data = per_row.groupBy(*by).agg((F.sum(F.col("weight") * F.col("ce")) / F.sum("weight")).alias("loss"),
                                    F.sum("weight").alias("sw"))
    reg = model.groupBy(*by).agg(F.sum(_sum(F.transform("coef", lambda c: c * c))).alias("wn"))
    return data.join(reg, by).select(*by, (F.col("loss") + F.lit(0.5) / (F.lit(C) * F.col("sw"))
                                           * F.col("wn")).alias("objective"))
