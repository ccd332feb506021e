import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from labelfold.operators import classify as C
from labelfold.operators import labels
from labelfold.operators.linear import fit_linear_by_group, objective

SF = "/root/testdata/sf0.001"


def test_per_user_lr_reaches_spark_ml_optimum(spark):
    emb = (spark.read.parquet(f"{SF}/embeddings.parquet")
           .withColumn("user_id", F.col("vec_id") % 3)
           .withColumn("category", F.col("label").cast("string")))
    model = fit_linear_by_group(emb, "embedding", "category", ["user_id"], C=1.0)
    ours = {r["user_id"]: r["objective"] for r in
            objective(emb, model, "embedding", "category", ["user_id"]).collect()}
    for u in range(3):
        part = emb.filter(F.col("user_id") == u)
        w = labels.class_weights(part, "category")
        x = part.join(w.select("category", "label_id", "weight"), "category") \
            .withColumn("features", array_to_vector(F.col("embedding").cast("array<double>"))) \
            .withColumn("label_id", F.col("label_id").cast("double"))
        n = x.count()
        lr = LogisticRegression(featuresCol="features", labelCol="label_id", weightCol="weight",
                                regParam=1.0 / n, standardization=False, maxIter=500, tol=1e-10,
                                family="multinomial").fit(x)
        ref = C.linear_model_table(lr, w.select("label_id", "category"), "category") \
            .withColumn("user_id", F.lit(u).cast("long"))
        best = objective(part, ref, "embedding", "category", ["user_id"]).first()["objective"]
        assert abs(ours[u] - best) < 1e-8 * abs(best)
    assert model.filter("NOT converged OR gradient > 1e-6").isEmpty()
    # the per-user table scores through the shared model-table path
    s = C.score_dense(emb, model, "vec_id", "embedding", "category", by=["user_id"], metric="linear")
    assert s.count() == emb.count() * 10


def gradient_of(x, y, k, coef, intercept, C=1.0):
    """Largest entry of the objective's gradient, by numpy."""
    counts = np.bincount(y, minlength=k)
    weight = len(y) / (k * counts)[y]
    z = x @ coef.T + intercept
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    r = p * weight[:, None] / weight.sum()
    return max(np.abs(r.T @ x + coef / (C * weight.sum())).max(), np.abs(r.sum(0)).max())


def skewed(n_users=60, d=5):
    """A user with half of all rows, users of one label or one row, separable and noisy ones."""
    rng = np.random.default_rng(7)
    users = np.concatenate([np.zeros(2000, int), rng.integers(1, n_users, 2000), [n_users + 1] * 3, [n_users + 2]])
    x = rng.normal(size=(len(users), d)) * np.array([1, 10, 0.1, 1, 1])
    y = np.where(users % 3 == 0, (x[:, 0] > 0).astype(int), rng.integers(0, 4, len(users)))
    y[users > n_users] = 2
    return users, x, y


@pytest.mark.parametrize("wide", [False, True])
def test_every_gradient_is_small_or_the_group_is_marked(spark, monkeypatch, wide):
    from labelfold.operators import linear, newton
    users, x, y = skewed()
    df = spark.createDataFrame([(int(u), [float(a) for a in v], f"c{c}") for u, v, c in zip(users, x, y)] + [(1, None, "c0"), (1, [0.0] * 5, None)],
                               "user_id int, v array<double>, label string")
    if wide:  # groups of four labels take the path for wide models
        monkeypatch.setattr(linear, "MAX_PARAMETERS", 12)
    monkeypatch.setattr(newton, "BLOCK_VALUES", 300)
    model = fit_linear_by_group(df, "v", "label", ["user_id"], C=10.0, max_iter=20).collect()
    assert {r.user_id for r in model} == set(users.tolist())
    for u in sorted(set(users.tolist())):
        own = sorted((r for r in model if r.user_id == u), key=lambda r: r.label_id)
        names = [r.label for r in own]
        rows = users == u
        ids = np.array([names.index(f"c{c}") for c in y[rows]])
        g = gradient_of(x[rows], ids, len(own), np.array([r.coef for r in own]), np.array([r.intercept for r in own]), 10.0)
        if own[0].converged:
            assert g <= 1.1e-6
        else:
            assert wide and len(own) > 2 and own[0].gradient > 1e-6
    assert wide or all(r.converged for r in model)


def test_few_rounds_leave_the_mark(spark):
    users, x, y = skewed(4)
    df = spark.createDataFrame([(int(u), [float(a) for a in v], int(c)) for u, v, c in zip(users, x, y)], "user_id int, v array<double>, label int")
    model = fit_linear_by_group(df, "v", "label", ["user_id"], max_rounds=1)
    assert {r.user_id for r in model.filter("NOT converged").select("user_id").distinct().collect()} == {0, 1, 2, 3}
    assert model.filter("converged").select("user_id").distinct().count() == 2  # one label: nothing to learn
    assert fit_linear_by_group(df.limit(0), "v", "label", ["user_id"]).count() == 0


def test_partial_sums_add_up_over_levels(spark, monkeypatch):
    from labelfold.operators import newton
    monkeypatch.setattr(newton, "FAN", 2)
    rows = [("a" if i % 3 else "b", i, [float(i), 1.0]) for i in range(40)]
    partial = spark.createDataFrame(rows, "g string, part int, sums array<double>")
    left = newton.summed(partial, ["g"], 40).collect()
    assert len(left) <= 4
    for g in "ab":
        assert sum(r.sums[0] for r in left if r.g == g) == sum(i for h, i, _ in rows if h == g)
        assert sum(r.sums[1] for r in left if r.g == g) == sum(h == g for h, *_ in rows)


def test_small_groups_exchange_no_hessians(spark, monkeypatch):
    """Small groups are fitted in their task, long ones by rounds of jobs, to the same model."""
    from labelfold.operators import linear
    rng = np.random.default_rng(4)
    rows = [(g, int(i % 3), [float(v) for v in rng.normal(size=4) + (i % 3)]) for g in range(3) for i in range(30 + 10 * g)]
    df = spark.createDataFrame(rows, "user_id long, label int, v array<float>")
    rounds = []
    real = linear.newton
    monkeypatch.setattr(linear, "newton", lambda r, *a: rounds.append(r) or real(r, *a))
    fit = lambda: {(r.user_id, r.label): [*r.coef, r.intercept] for r in fit_linear_by_group(df, "v", "label", ["user_id"]).collect()}
    local = fit()
    assert len(local) == 9 and not rounds
    monkeypatch.setattr(linear, "LOCAL_VALUES", 200)  # of 150, 200 and 250 values
    mixed = fit()
    assert len(rounds) == 1 and rounds[0].select("user_id").distinct().count() == 1
    assert mixed.keys() == local.keys() and all(np.allclose(mixed[k], local[k], atol=1e-7) for k in local)
