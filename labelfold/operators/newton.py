"""Newton's method for one logistic regression per group, as rounds of Spark jobs (CLS-7).

The objective is ``(1/S) * sum(w_i * CE_i) + (lambda/2) * |W|^2`` with an unpenalised intercept.
The rows are packed once into blocks of one group, dealt over all tasks by (group, content), so a
group that holds a third of all rows is spread.  A round is

* the blocks joined with their group's current coefficients,
* in each task, value, gradient and Hessian of each run of blocks: for two classes c and d the Gram
  matrix of the rows weighted by ``p_c * (1{c=d} - p_d)``,
* their sum per group, in levels of ``FAN`` partial sums each, so no task holds more than that many,
* one small solve per group.

A Hessian is far larger than a small group's rows, so groups of at most ``LOCAL_VALUES`` values are
packed whole and take the same steps in their task (``newton_local``): no sums are written or shuffled.

A step that raises the objective is halved.  A group whose largest gradient entry is below ``tol``
has converged and takes no further part; one that has not after ``max_rounds`` rounds is returned
with ``converged = false``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import materialize

BLOCK_VALUES = 1 << 16
#: Classes times width of a group up to which its Hessian (that number squared, in doubles) is built.
MAX_PARAMETERS = 1536
FAN = 32
#: Rows times width of a group up to which one task takes all its rounds (8 MB in doubles).
LOCAL_VALUES = 1 << 20


def _columns(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def _runs(keys: list[tuple]) -> list[tuple[int, int]]:
    """Start and stop of stretches of equal keys."""
    cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
    return list(zip(cuts, cuts[1:]))


def _keys(batch: pa.RecordBatch, by: list[str]) -> list[tuple]:
    return list(zip(*(batch.column(b).to_pylist() for b in by)))


def blocks(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(by…, xs, ys, ws)``: rows ``(by…, xa, label_id, weight)`` of one group packed together, dealt by (group, content)."""
    by = list(by)
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _runs(_keys(batch, by)):
                width = max(1, len(batch.column("xa")[lo]))
                step = max(1, BLOCK_VALUES // width)
                for at in range(lo, hi, step):
                    part = batch.slice(at, min(step, hi - at))
                    one = lambda c, part=part: pa.ListArray.from_arrays([0, part.num_rows], part.column(c))
                    xs = part.column("xa").flatten()
                    yield pa.RecordBatch.from_arrays([*(part.column(b).slice(0, 1) for b in by), pa.ListArray.from_arrays([0, len(xs)], xs),
                                                      one("label_id"), one("weight")], [*by, "xs", "ys", "ws"])

    dealt = rows.repartitionByRange(n, *by, F.xxhash64("xa", "label_id")).sortWithinPartitions(*by)
    return dealt.mapInArrow(run, f"{_columns(rows, by)}, xs array<double>, ys array<int>, ws array<double>")


def _terms(w: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sums of loss, gradient and Hessian over rows; ``w`` is classes x width.  The Hessian's blocks of classes a <= b follow each other."""
    k, d = w.shape
    z = x @ w.T
    z -= z.max(axis=1, keepdims=True)
    e = np.exp(z)
    total = e.sum(axis=1, keepdims=True)
    p = e / total
    loss = float((weight * (np.log(total[:, 0]) - z[np.arange(len(y)), y])).sum())
    r = p * weight[:, None]
    r[np.arange(len(y)), y] -= weight
    blocks_of = np.empty((k * (k + 1) // 2, d, d))
    for i, (a, b) in enumerate(_pairs(k)):
        v = weight * p[:, a] * ((a == b) - p[:, b])
        blocks_of[i] = x.T @ (x * v[:, None])
    return loss, (r.T @ x).ravel(), blocks_of.ravel()


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(k) for b in range(a, k)]


def partial_sums(joined: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(by…, part, sums)``: loss, gradient and Hessian of each stretch of a group's blocks in a task."""
    by = list(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, None
        for batch in batches:
            keys = _keys(batch, by)
            for lo, hi in _runs(keys):
                if held is not None and keys[lo] != held[0]:
                    yield out(held[1], total)
                    held = None
                k, d = batch.column("k")[lo].as_py(), batch.column("da")[lo].as_py()
                w = np.array(batch.column("w")[lo].values).reshape(k, d)
                if held is None:
                    held, total = (keys[lo], [batch.column(b).slice(lo, 1) for b in by]), [0.0, np.zeros(k * d), np.zeros(k * (k + 1) // 2 * d * d)]
                for i in range(lo, hi):
                    x, y, weight = (np.array(batch.column(c)[i].values) for c in ("xs", "ys", "ws"))
                    total = [a + b for a, b in zip(total, _terms(w, x.reshape(len(y), d), y, weight))]
        if held is not None:
            yield out(held[1], total)

    def out(key: list[pa.Array], total: list) -> pa.RecordBatch:
        flat = np.concatenate([[total[0]], total[1], total[2]])
        part = pa.array([TaskContext.get().partitionId()], pa.int32())
        return pa.RecordBatch.from_arrays([*key, part, pa.ListArray.from_arrays([0, len(flat)], flat)], [*by, "part", "sums"])

    return joined.mapInArrow(run, f"{_columns(joined, by)}, part int, sums array<double>")


def _total(table: pa.Table) -> np.ndarray:
    sums = table.column("sums").combine_chunks()
    return np.asarray(sums.flatten()).reshape(len(sums), -1).sum(axis=0)


def summed(partial: DataFrame, by: Sequence[str], parts: int) -> DataFrame:
    """Partial sums of a group added in levels, until at most ``FAN`` are left."""
    by = list(by)

    def add(key, table):
        flat = _total(table)
        first = table.slice(0, 1).drop_columns(["part", "sums"])
        return (first.append_column("part", pa.array([key[-1].as_py()], pa.int32()))
                .append_column("sums", pa.ListArray.from_arrays([0, len(flat)], flat)))

    while parts > FAN:
        partial = partial.groupBy(*by, F.expr(f"cast(part div {FAN} as int)").alias("level")).applyInArrow(add, partial.schema)
        parts = -(-parts // FAN)
    return partial


MODEL = "k int, da int, sw double, lam double, w array<double>, best array<double>, value double, gradient double, converged boolean"


def _step(row: dict, tol: float) -> dict:
    """The group's next point from the sums at its current one."""
    k, d, sums = row["k"], row["da"], row["sums"]
    m, w = k * d, np.array(row["w"])
    free = np.arange(m) % d != d - 1  # the intercept is the last entry of each class and not penalised
    value = sums[0] / row["sw"] + 0.5 * row["lam"] * float((w[free] ** 2).sum())
    gradient = sums[1:1 + m] / row["sw"] + row["lam"] * w * free
    if row["best"] is not None and value > row["value"] + 1e-12 * max(1.0, abs(row["value"])):
        return row | {"w": (0.5 * (w + np.array(row["best"]))).tolist()}  # back to half the step
    size = float(np.abs(gradient).max())
    row = row | {"best": w.tolist(), "value": value, "gradient": size, "converged": size <= tol}
    if not row["converged"]:
        hessian = np.empty((k, d, k, d))
        for (a, b), block in zip(_pairs(k), sums[1 + m:].reshape(-1, d, d)):
            hessian[a, :, b, :] = hessian[b, :, a, :] = block
        hessian = hessian.reshape(m, m) / row["sw"]
        hessian[np.diag_indices(m)] += row["lam"] * free
        # adding a constant to all intercepts changes nothing; the gradient has no part in that direction
        shared = np.flatnonzero(~free)
        hessian[np.ix_(shared, shared)] += 1.0 / k
        row["w"] = (w - np.linalg.solve(hessian, gradient)).tolist()
    return row


def newton(rows: DataFrame, consts: DataFrame, by: Sequence[str], tol: float, max_rounds: int) -> DataFrame:
    """``(by…, k, da, best, gradient, converged)`` for rows ``(by…, xa, label_id, weight)`` and ``consts(by…, k, da, sw, lam)``."""
    by = list(by)
    zeros = F.array_repeat(F.lit(0.0), F.col("k").cast("int") * F.col("da").cast("int"))
    model = consts.select(*by, F.col("k").cast("int").alias("k"), F.col("da").cast("int").alias("da"), "sw", "lam", zeros.alias("w"),
                          F.lit(None).cast("array<double>").alias("best"), F.lit(None).cast("double").alias("value"),
                          F.lit(None).cast("double").alias("gradient"), F.lit(False).alias("converged"))
    model = materialize(model, "newton_model")
    packed = materialize(blocks(rows, by), "newton_blocks")
    # tasks of the join: its shuffle's or the written table's
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(packed.inputFiles()), 1)
    schema = f"{_columns(model, by)}, {MODEL}"
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in model.schema.fields]

    def step(key, table):
        row = table.slice(0, 1).drop_columns(["sums"]).to_pylist()[0]
        row = _step(row | {"sums": _total(table)}, tol)
        return pa.table({name: pa.array([row[name]], kind) for name, kind in kinds})

    done = None
    for _ in range(max_rounds):
        point = model.select(*by, "k", "da", "w")
        partial = partial_sums(packed.join(point, by), by)
        sums = summed(partial, by, parts).drop("part")
        model = materialize(model.join(sums, by).groupBy(*by).applyInArrow(step, schema), "newton_model")
        ready = model.filter("converged")
        done = ready if done is None else done.unionByName(ready)
        model = model.filter("NOT converged")
        if model.isEmpty():
            break
    out = done.unionByName(model) if done is not None else model
    return out.select(*by, "k", "da", F.coalesce("best", "w").alias("w"), "gradient", "converged")


def newton_local(rows: DataFrame, consts: DataFrame, by: Sequence[str], tol: float, max_rounds: int) -> DataFrame:
    """The same as ``newton`` for groups of at most ``LOCAL_VALUES`` values; ``rows`` are ``(by…, x, label_id, weight)`` without the one of the intercept."""
    by = list(by)

    def fit(key, table):
        first = table.slice(0, 1)
        row = first.select(["k", "da", "sw", "lam"]).to_pylist()[0]
        y, weight = table.column("label_id").to_numpy(), table.column("weight").to_numpy()
        x = np.asarray(table.column("x").combine_chunks().flatten(), np.float64).reshape(len(y), row["da"] - 1)
        x = np.c_[x, np.ones(len(y))]
        row |= {"w": [0.0] * (row["k"] * row["da"]), "best": None, "value": None, "gradient": None, "converged": False}
        for _ in range(max_rounds):
            loss, gradient, hessian = _terms(np.array(row["w"]).reshape(row["k"], row["da"]), x, y, weight)
            row = _step(row | {"sums": np.concatenate([[loss], gradient, hessian])}, tol)
            if row["converged"]:
                break
        w = row["w"] if row["best"] is None else row["best"]
        return pa.table([*(first.column(b) for b in by), pa.array([row["k"]], pa.int32()), pa.array([row["da"]], pa.int32()),
                         pa.array([w], pa.list_(pa.float64())), pa.array([row["gradient"]], pa.float64()), pa.array([row["converged"]])],
                        names=[*by, "k", "da", "w", "gradient", "converged"])

    joined = rows.join(consts.select(*by, F.col("k").cast("int").alias("k"), F.col("da").cast("int").alias("da"), "sw", "lam"), by)
    return joined.groupBy(*by).applyInArrow(fit, f"{_columns(rows, by)}, k int, da int, w array<double>, gradient double, converged boolean")
