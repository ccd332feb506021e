"""Embedding near-duplicates by product quantisation (operator 2).

Vectors of one label link when their cosine (double precision) is at least
``threshold``.  Equal vectors of a label collapse into one class first.  An index
of coarse inverted lists with residual subspace codes is fitted on a bounded
sample of the classes (``SAMPLE``, by a hash) and holds every class:

* unit vectors within the threshold are at most ``r = sqrt(2 - 2 threshold)``
  apart, so a vector probes every list whose cell may hold a point within r: the
  distance to the bisector with its own list's centre is at most r.  These
  probes suffice; there is no fixed number of them;
* in a probed list, asymmetric distances come from per-query tables of subspace
  distances; a code stays a candidate if its distance is at most r plus the
  quantisation error stored with it (triangle inequality), so none is lost;
* candidates are reranked by the exact cosine.

A label's lists lie one after the other and are cut into stretches of ``BLOCK``
codes, by their sizes: small lists share a stretch (a query meets it once, however
many of its lists it probes), a large one spans several.  Queries of a stretch
are cut into blocks as well, so that no list, hot or not, is one task.

Cases: vectors that are null, empty, zero or hold null or non-finite components,
and rows without a label, link with nothing; vectors of different lengths do not
link; repeated rows count as vectors of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, table, written

THRESHOLD = 0.98
SAMPLE = 8192
LISTS = 1024
SUBSPACES = 8
CODES = 64
BLOCK = 4096
QUERY_BLOCK = 2048


def _kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centres of at most k clusters (Lloyd's steps from distinct sampled points)."""
    rng = np.random.default_rng(seed)
    points = np.unique(x, axis=0)
    centres = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        for c in range(len(centres)):
            own = x[near == c]
            if len(own):
                centres[c] = own.mean(0)
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_distances(x[i:i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


class Quantiser:
    """Coarse centres and residual codebooks for vectors of one length."""

    def __init__(self, sample: np.ndarray, lists: int, radius: float):
        self.radius = radius
        self.centres = _kmeans(sample, lists)
        residual = sample - self.centres[_nearest(sample, self.centres)]
        self.parts = [p for p in np.array_split(np.arange(sample.shape[1]), SUBSPACES) if len(p)]
        self.books = [_kmeans(residual[:, p], CODES) for p in self.parts]
        self.apart = np.sqrt(_distances(self.centres, self.centres))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and quantisation error of each vector."""
        cell = _nearest(x, self.centres)
        residual = x - self.centres[cell]
        codes = np.stack([_nearest(residual[:, p], b) for p, b in zip(self.parts, self.books)], 1).astype(np.uint8)
        decoded = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], 1)
        return cell, codes, np.sqrt(((residual - decoded) ** 2).sum(1))

    def probes(self, x: np.ndarray) -> np.ndarray:
        """For each vector, the lists whose cells may hold a vector within the radius."""
        d = _distances(x, self.centres)
        cell = d.argmin(1)
        own = d[np.arange(len(x)), cell]
        with np.errstate(divide="ignore", invalid="ignore"):
            bisector = (d - own[:, None]) / (2 * self.apart[cell])
        near = bisector <= self.radius + 1e-9
        near[np.arange(len(x)), cell] = True
        return near

    def asymmetric(self, x: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Distances of queries to the decoded vectors of one list, by table lookups."""
        residual = x - self.centres[cell]
        out = np.zeros((len(x), len(codes)))
        for i, (p, b) in enumerate(zip(self.parts, self.books)):
            out += _distances(residual[:, p], b)[:, codes[:, i]]
        return np.sqrt(out)


def _units(column: pa.Array) -> list:
    """Unit vectors in double precision; None where a vector can't link."""
    out = []
    for v in column.to_pylist():
        x = None
        if v and None not in v:
            a = np.array(v, np.float64)
            scale = np.abs(a).max()
            if np.isfinite(a).all() and scale > 0:
                a = a / scale
                x = a / np.sqrt((a * a).sum())
        out.append(x)
    return out


def vector_classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(vec_id, node)`` of all rows and ``(node, label, dim, unit, rows)`` of the classes of equal vectors."""
    kind, mark = (vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _units(batch.column("embedding"))
            raw = pa.array([None if u is None else u.tobytes() for u in units], pa.binary())
            dim = pa.array([0 if u is None else len(u) for u in units], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), dim, raw], ["vec_id", "label", "dim", "unit"])

    rows = vectors.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id {kind}, label {mark}, dim int, unit binary")
    good = F.col("unit").isNotNull() & F.col("label").isNotNull()
    rows = written(rows.withColumn("node", F.when(good, F.sha2(F.concat(F.col("label").cast("string").cast("binary"), F.lit(b"|"), F.col("unit")), 256))),
                   "vector-rows")
    classes = rows.where("node is not null").groupBy("node", "label", "dim").agg(
        F.first("unit").alias("unit"), F.min("vec_id").alias("vec_id"), F.count("*").alias("rows"))
    return rows.select("vec_id", "node"), written(classes.withColumn("id", F.xxhash64("node")), "vector-classes")


def _matrix(raw: list, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(r) for r in raw), np.float64).reshape(-1, dim)


def candidate_pairs(classes: DataFrame, dim: int, threshold: float, sample: int = SAMPLE, lists: int = LISTS) -> DataFrame:
    """Pairs ``(a, b)`` of class ids of one dimension that the index can't tell to be too far apart."""
    mine = classes.where(F.col("dim") == dim).select("id", "label", "unit")
    rows = mine.orderBy(F.xxhash64("id"), "id").limit(sample).collect()  # the fit's documented bound
    mark = classes.schema["label"].dataType.simpleString()
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    q = Quantiser(_matrix([r["unit"] for r in rows], dim), min(lists, max(1, int(np.sqrt(len(rows)) / 2))), radius)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _matrix(part.column("unit").to_pylist(), dim)
                cell, codes, error = q.encode(x)
                near = [np.flatnonzero(row) for row in q.probes(x)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("label"), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()),
                     pa.array(error, pa.float64()), pa.array(near, pa.list_(pa.int32())), part.column("unit")],
                    ["id", "label", "cell", "codes", "error", "probes", "unit"])

    placed = written(mine.mapInArrow(place, f"id long, label {mark}, cell int, codes binary, error double, probes array<int>, unit binary"), "vector-placed")
    # where each list begins in its label's row of lists (at most ``lists`` rows a label)
    sizes = placed.groupBy("label", "cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("label").orderBy("cell")) - F.col("n")
    sizes = written(sizes.withColumn("before", before), "vector-lists")
    index = placed.select("id", "label", "cell", "codes", "error").join(sizes, ["label", "cell"])
    index = index.withColumn("stretch", F.floor((F.col("before") + F.pmod(F.xxhash64("id", F.lit(1)), "n")) / BLOCK))
    spans = sizes.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("cell", F.struct(
        F.floor(F.col("before") / BLOCK).alias("first"), F.floor((F.col("before") + F.col("n") - 1) / BLOCK).alias("last"))))).alias("spans"))
    held = F.filter("probes", lambda c: F.map_contains_key("spans", c))
    met = F.array_distinct(F.flatten(F.transform(held, lambda c: F.sequence(
        F.element_at("spans", c)["first"], F.element_at("spans", c)["last"]))))
    asked = written(placed.select("id", "label", "unit", "probes").join(spans, "label").select("id", "label", "unit", F.explode(met).alias("stretch")),
                    "vector-queries")
    key = ["label", "stretch"]
    parts = asked.groupBy(*key).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("parts"))
    asked = asked.join(parts, key).withColumn("part", F.pmod(F.xxhash64("id", F.lit(2)), "parts").cast("int"))
    index = index.join(parts, key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = [*key, "part"]

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(left) and len(right):
            x, ids = _matrix(list(left["unit"]), dim), left["id"].to_numpy()
            own, cell, limit = right["id"].to_numpy(), right["cell"].to_numpy(), q.radius + right["error"].to_numpy() + 1e-9
            codes = np.frombuffer(b"".join(bytes(c) for c in right["codes"]), np.uint8).reshape(len(right), -1)
            near = q.probes(x)
            for c in np.unique(cell):
                codes_here = np.flatnonzero(cell == c)
                asking = np.flatnonzero(near[:, c])
                for at in range(0, len(asking), 256):
                    some = asking[at:at + 256]
                    i, j = np.nonzero(q.asymmetric(x[some], int(c), codes[codes_here]) <= limit[codes_here])
                    i, j = some[i], codes_here[j]
                    less = ids[i] < own[j]  # the other order is found from the other side
                    a.append(ids[i[less]])
                    b.append(own[j[less]])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    left = asked.select(*key, "id", "unit").groupBy(*key)
    right = index.select(*key, "id", "cell", "codes", "error").groupBy(*key)
    return left.cogroup(right).applyInPandas(search, "a long, b long").distinct()


def links(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs ``(a, b)`` of class ids with a cosine of at least ``threshold``, by the index and an exact rerank."""
    dims = [r["dim"] for r in classes.groupBy("dim").count().where("count > 1").orderBy("dim").collect()]  # one row per vector length
    pairs = None
    for dim in dims:
        found = candidate_pairs(classes, dim, threshold)
        pairs = found if pairs is None else pairs.unionByName(found)
    if pairs is None:
        return classes.sparkSession.createDataFrame([], "a long, b long")
    side = lambda c: classes.select(F.col("id").alias(c), F.col("unit").alias(f"u_{c}"))

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dots = [float(np.frombuffer(x, np.float64) @ np.frombuffer(y, np.float64))
                    for x, y in zip(batch.column("u_a").to_pylist(), batch.column("u_b").to_pylist())]
            keep = pa.array([d >= threshold for d in dots], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)
    return written(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "u_a", "u_b").mapInArrow(rerank, "a long, b long"), "vector-links")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row of ``vectors(vec_id, embedding, label)``."""
    rows, classes = vector_classes(vectors)
    linked = links(classes, threshold)
    both = linked.union(linked.select("b", "a"))
    others = both.join(classes.select(F.col("id").alias("b"), "rows"), "b").groupBy("a").agg(F.sum("rows").alias("others"))
    comp = components(classes.select("id"), linked)
    named = classes.select("id", "node", "rows", "vec_id").join(comp, "id").join(others.withColumnRenamed("a", "id"), "id", "left")
    least = named.groupBy("comp").agg(F.min("vec_id").alias("component_id"))
    named = named.join(least, "comp").select("node", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    out = rows.join(named, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"),
                      (F.col("vec_id") == component).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """``op2_vector_dedup``: links and components of all rows of ``embeddings``."""
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


#: Brute force over all pairs of a label.
ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(c.m, e.vec_id)) AS component_id,
       least(e.vec_id, coalesce(c.m, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""
