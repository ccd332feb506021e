import datetime as dt

import numpy as np
import pytest

from labelfold.sources.commits import Conflict, TableSet
from labelfold.streaming import retraining as R

SCHEMA = "transaction_id long, user_id long, label int, source string, created_at timestamp, embedding array<double>"
T0 = dt.datetime(2024, 5, 1)


def batches():
    rng = np.random.default_rng(3)
    out, tx = [], 0
    for b, sizes in enumerate(({1: 8, 2: 3, 3: 6}, {1: 2, 2: 4}, {1: 4, 2: 1})):
        rows = []
        for u, n in sizes.items():
            for k in range(n):
                label = 0 if u == 3 else k % 2
                rows.append((tx, u, label, "auto_confirmed", T0 + dt.timedelta(hours=b, minutes=k), [float(label) + rng.normal(), rng.normal()]))
                tx += 1
        if b:  # the first transaction of user 1 is corrected, and corrected again
            rows.append((0, 1, 5 + b, "user_feedback", T0 + dt.timedelta(days=b), [9.0, 9.0]))
        out.append(rows)
    return out


def feed(spark, folder):
    for k, rows in enumerate(batches()):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/b{k}")


def start(spark, folder, root):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    R.retrain_stream(stream, root, every=5).awaitTermination()


def content(spark, root):
    tables = TableSet(spark, f"{root}/tables")
    found = {}
    for name in ("training", "pending", "history", "models"):
        rows = tables.read(name).collect()
        found[name] = sorted(str([round(v, 9) if isinstance(v, float) else [round(x, 9) for x in v] if isinstance(v, list) else v for v in r]) for r in rows)
    return found


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    folder, root = str(tmp_path_factory.mktemp("in")), str(tmp_path_factory.mktemp("job"))
    feed(spark, folder)
    start(spark, folder, root)
    return folder, root


def test_due_users_are_trained_on_their_whole_training_set(spark, whole):
    _, root = whole
    runs = {(r.run_id): r for r in R.run_states(spark, root).collect()}
    # user 1: due with 8, then 2 + 1, then 4 + 1 more; user 2: 3 + 4; user 3 has one label
    assert {k: (r.status, r.n_samples, r.n_categories) for k, r in runs.items()} == {
        "0-0-1": ("completed", 8, 2), "0-0-3": ("failed", 6, 1), "0-1-2": ("completed", 7, 2), "0-2-1": ("completed", 14, 3)}
    statuses = [(r.run_id, r.status) for r in TableSet(spark, f"{root}/tables").read("history").collect()]
    assert len(statuses) == 12 and all(sum(s == (k, x) for s in statuses) == 1 for k in runs for x in ("pending", "running"))
    current = R.current_models(spark, root).collect()
    assert {(r.user_id, r.run_id) for r in current} == {(1, "0-2-1"), (2, "0-1-2")}
    assert {r.label for r in current if r.user_id == 1} == {0, 1, 7}  # the newest correction of transaction 0 wins
    pending = {r.user_id: r.n for r in TableSet(spark, f"{root}/tables").read("pending").collect()}
    assert pending == {1: 0, 2: 1, 3: 0}


@pytest.mark.parametrize("dies_at", [0, 3])  # in the first and in the second commit of a batch
def test_a_killed_batch_leaves_the_same_tables(spark, whole, tmp_path, monkeypatch, dies_at):
    folder, root = whole
    mine, commits, publish = str(tmp_path), [0], TableSet._publish

    def dying(self, manifest):
        commits[0] += 1
        if commits[0] == dies_at + 1:
            raise RuntimeError("killed after the folders were written, before the manifest")
        publish(self, manifest)

    monkeypatch.setattr(TableSet, "_publish", dying)
    with pytest.raises(Exception):
        start(spark, folder, mine)
    half = TableSet(spark, f"{mine}/tables").manifest()
    assert half["version"] == dies_at - 1
    start(spark, folder, mine)
    assert content(spark, mine) == content(spark, root)


def test_commits(spark, tmp_path):
    t = TableSet(spark, str(tmp_path))
    df = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    values = lambda name, m=None: sorted(r.v for r in t.read(name, "v int", m).collect())
    assert t.manifest()["version"] == -1 and values("a") == [] and t.read("a") is None
    assert t.commit([0], {"a": df(1), "b": df(10)})
    first = t.manifest()
    assert t.commit([1], {"a": df(2)}, {"b": df(20)})
    assert not t.commit([1], {"a": df(3)}) and not t.commit([0], {"a": df(3)})  # repetitions
    assert values("a") == [1, 2] and values("b") == [20]
    assert values("a", first) == [1] and values("b", first) == [10]
    t.stage("a", df(99))  # a commit that dies here is never read
    assert values("a") == [1, 2]
    with pytest.raises(Conflict):
        t.commit([2], {"a": df(4)}, base=first)
    assert values("a") == [1, 2] and t.manifest(0) == first


def test_examples_that_carry_the_vectors_key(spark, whole, tmp_path):
    """Vectors in a table of their own give the same models, and no table keeps the vectors."""
    folder, root = whole
    rows = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(folder)
    name = "concat_ws('/', transaction_id, source, cast(created_at as string))"
    vectors = rows.selectExpr(f"{name} as vec_id", "embedding").dropDuplicates(["vec_id"])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    R.retrain_stream(stream.selectExpr("* except (embedding)", f"{name} as vec_id"), str(tmp_path), every=5,
                     vectors=vectors, vector_key="vec_id").awaitTermination()
    assert "embedding" not in TableSet(spark, f"{tmp_path}/tables").read("training").columns
    assert content(spark, str(tmp_path))["models"] == content(spark, root)["models"]
    assert content(spark, str(tmp_path))["history"] == content(spark, root)["history"]
