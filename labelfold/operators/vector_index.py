"""Exact nearest neighbours by cosine over a hyperplane-code index (JOIN-10).

Vectors are scaled to length 1, where cosine order is Euclidean order, and projected on a few
orthonormal directions.  A row's code says on which side of the corpus's median it lies along each of the first
``b`` directions, ``b`` growing with the logarithm of the counted rows; a code's rows are cut into
buckets of at most ``BUCKET`` rows along their widest direction, by exact ranks, so hot codes are split.  A bucket keeps the smallest
and largest projection of its rows: a box.  As the directions are orthonormal, a row of the bucket is no nearer to a
query than the query's projections are to the box.

A search goes in rounds.  Codes that share their first bits are grouped under a common box, and a query first looks at
those; boxes it may not rule out give the list of its buckets, by ascending bound.  The ``first`` nearest buckets are
scored exactly, which gives the query's k-th best distance; a query is *certified* when no other bucket's
bound is below that.  The others go on with every bucket that can still hold a neighbour.  With ``go_on=False`` the search
stops after the first round and the column ``certified`` says which answers are exact for certain.

Where boxes rule little out, they cost more than the scores they save: for each query a row a bucket.  So a search that goes on
first probes ``PROBES`` queries; if these need more than ``WIDE`` of all buckets, all queries meet all rows in
blocks of at most about ``BLOCK_VALUES`` numbers a side, scored by matrix products, with the same exact answers.  Then only blocks are
sent, not buckets to each query; the work is queries times rows, the memory that of a block.

Buckets meet queries in co-groups of one bucket and at most ``QUERIES`` queries, and hand on k rows a query: pairs are not rows.
Of corpus rows with equal vectors only the k smallest ids can be in an answer, and only they are indexed.

Cases: rows without a vector take no part; a vector of length 0 has cosine 0 with everything; ties go to the
smaller id; an empty side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .ranking import sorted_rank

BUCKET = 64
QUERIES = 1024
DIRECTIONS = 16
PROBES = 32
WIDE = 1 / 8
BLOCK_VALUES = 1 << 20
#: Rounding of bounds and distances is far below this.
SLACK = 1e-9


def _units(df: DataFrame, key: str, features: str) -> DataFrame:
    x = F.col(features).cast("array<double>")
    df = df.filter(F.col(features).isNotNull()).select(F.col(key).alias("id"), x.alias("x"))
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, b: a + b * b))
    df = df.withColumn("length", length)
    return df.select("id", F.transform("x", lambda v: F.when(F.col("length") == 0, 0.0).otherwise(v / F.col("length"))).alias("u"),
                     (F.col("length") == 0).alias("zero"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _lists(a: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1], np.ascontiguousarray(a).ravel())


def _projected(df: DataFrame, directions: np.ndarray) -> DataFrame:
    """``df`` with ``s``: projections on the directions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, _lists(_matrix(batch.column("u")) @ directions)], [*batch.schema.names, "s"])

    return df.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) + ", s array<double>")


class Index:
    """Buckets of a corpus; ``k`` is the largest number of neighbours that will be asked for."""

    def __init__(self, corpus: DataFrame, key: str, features: str, k: int, seed: int = 42):
        self.k, self.key_type = k, corpus.schema[key].dataType.simpleString()
        rows = _units(corpus, key, features)
        copies = Window.partitionBy("u").orderBy("id")
        rows = materialize(rows.withColumn("_c", F.row_number().over(copies)).filter(F.col("_c") <= k).drop("_c"), "index_rows")
        self.zeros = rows.filter("zero").select("id")
        self.smallest = rows.select("id").orderBy("id").limit(k)
        rows = rows.filter("NOT zero").drop("zero")
        n, d = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("u")), F.lit(1))).first()
        self.n = n
        bits = min(d, max(0, int(np.ceil(np.log2(max(1, n) / BUCKET)))))
        p = min(d, max(DIRECTIONS, bits))
        self.directions = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, p)))[0]
        rows = materialize(_projected(rows, self.directions), "index_projections")
        cuts = rows.agg(F.array(*[F.percentile_approx(F.get("s", F.lit(j)), 0.5) for j in range(bits)]).alias("m")).scalar()
        # bits of the code from the first direction down; each a sum of powers of two
        side = F.zip_with(F.slice("s", 1, bits), F.col("_m"), lambda s, m: (s > m).cast("long"))
        rows = rows.withColumn("_m", cuts).withColumn("code", F.aggregate(side, F.lit(0).cast("long"), lambda a, b: a * 2 + b)).drop("_m")
        self.shift = bits - bits // 2
        # cut each code along its widest direction into buckets of equal numbers
        spread = rows.groupBy("code").agg(F.array(*[F.max(F.get("s", F.lit(j))) - F.min(F.get("s", F.lit(j))) for j in range(p)]).alias("w"))
        spread = spread.select("code", (F.array_position("w", F.array_max("w")) - 1).cast("int").alias("widest"))
        rows = sorted_rank(rows.join(spread, "code").withColumn("along", F.get("s", F.col("widest"))), ["code"], [F.col("along"), F.col("id")], "r", None)
        rows = rows.select("code", F.expr(f"(r - 1) div {BUCKET}").alias("sub"), "id", "u", "s")
        self.rows = materialize(rows, "index_buckets")
        sides = [f(F.get("s", F.lit(j))) for f in (F.min, F.max) for j in range(p)]
        self.boxes = materialize(self.rows.groupBy("code", "sub").agg(F.array(*sides[:p]).alias("low"), F.array(*sides[p:]).alias("high"))
                                 .withColumn("first_bits", F.shiftright("code", self.shift)), "index_boxes")
        # boxes of the codes' first bits: about the square root of the number of codes
        tops = self.boxes.groupBy("first_bits").agg(F.array(*[F.min(F.get("low", F.lit(j))) for j in range(p)]).alias("low"),
                                                    F.array(*[F.max(F.get("high", F.lit(j))) for j in range(p)]).alias("high"))
        self.tops = tops.select("first_bits", "low", "high").collect()  # at most 2 ** (bits / 2) rows

    def _buckets(self, queries: DataFrame) -> DataFrame:
        """``id, code, sub, bound``: squared distance from each query (with ``reach``, its squared k-th distance) to the boxes within reach."""
        names = np.array([t["first_bits"] for t in self.tops], np.int64)
        low, high = (np.array([t[c] for t in self.tops], np.float64) for c in ("low", "high"))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    s, reach = _matrix(part.column("s")), np.asarray(part.column("reach"))
                    far = sum(np.maximum(0, np.maximum(low[:, j] - s[:, j, None], s[:, j, None] - high[:, j])) ** 2 for j in range(s.shape[1]))
                    row, top = np.nonzero(far <= reach[:, None] + SLACK)
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([part.column("id").take(take), part.column("s").take(take), part.column("reach").take(take),
                                                      pa.array(names[top])], ["id", "s", "reach", "first_bits"])

        pairs = queries.select("id", "s", "reach").mapInArrow(near, f"id {self.key_type}, s array<double>, reach double, first_bits long")
        gap = F.zip_with("s", F.arrays_zip("low", "high"), lambda s, b: F.greatest(F.lit(0.0), b["low"] - s, s - b["high"]))
        bound = F.aggregate(gap, F.lit(0.0), lambda a, g: a + g * g)
        return (pairs.join(self.boxes, "first_bits").withColumn("bound", bound).filter(F.col("bound") <= F.col("reach") + SLACK)
                .select("id", "code", "sub", "bound"))

    def _scored(self, wanted: DataFrame, vectors: DataFrame) -> DataFrame:
        """``query_id, item_id, cosine``: the k best of each wanted (query, bucket)."""
        k = self.k
        asked = wanted.select("id", "code", "sub").join(vectors.select("id", "u"), "id")
        # a bucket that very many queries want meets them in parts
        part = F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.ceil(F.col("n") / QUERIES)))
        crowds = wanted.groupBy("code", "sub").agg(F.count(F.lit(1)).alias("n"))
        asked = asked.join(crowds, ["code", "sub"]).withColumn("part", part.cast("long")).drop("n")
        held = self.rows.join(crowds, ["code", "sub"]).select(
            "code", "sub", "id", "u", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), F.ceil(F.col("n") / QUERIES)).cast("long") - 1)).alias("part"))

        schema, empty = self._result()

        def meet(key, left, right):
            if not left.num_rows or not right.num_rows:
                return empty
            items = right.sort_by("id")
            scores = _matrix(left.column("u").combine_chunks()) @ _matrix(items.column("u").combine_chunks()).T
            best = np.argsort(-np.round(scores, 9), axis=1, kind="stable")[:, :k]  # equal scores by id
            rows = np.repeat(np.arange(len(scores)), best.shape[1])
            return pa.table([left.column("id").take(pa.array(rows)), items.column("id").take(pa.array(best.ravel())),
                             pa.array(scores[rows, best.ravel()])], names=["query_id", "item_id", "cosine"])

        by = ["code", "sub", "part"]
        return asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(meet, schema)

    def _blocks(self, queries: DataFrame) -> DataFrame:
        """``query_id, item_id, cosine``: the k best of every block of corpus rows, for all queries."""
        k, n = self.k, queries.count()
        # at least a few cells a core, and no larger than a task holds
        cores = queries.sparkSession.sparkContext.defaultParallelism
        size = int(min(max(1, BLOCK_VALUES // len(self.directions)), max(1024, np.sqrt(n * self.n / (4 * cores)))))
        cells, blocks = max(1, -(-n // size)), max(1, -(-self.n // size))
        self.pairs_scored = n * self.n
        deal = lambda count: F.pmod(F.xxhash64("id", "u"), F.lit(count)).cast("int")
        every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
        asked = queries.filter("id IS NOT NULL").select("id", "u", deal(cells).alias("cell"), every(blocks).alias("block"))
        held = self.rows.select("id", "u", deal(blocks).alias("block"), every(cells).alias("cell"))
        schema, empty = self._result()

        def meet(key, left, right):
            if not left.num_rows or not right.num_rows:
                return empty
            items = right.sort_by("id")
            x, y = _matrix(left.column("u").combine_chunks()), _matrix(items.column("u").combine_chunks()).T
            rows, columns, values = [], [], []
            step = max(1, (1 << 21) // y.shape[1])
            for at in range(0, len(x), step):
                scores = x[at:at + step] @ y
                least = np.partition(scores, -k, axis=1)[:, -k, None] if y.shape[1] > k else -2.0
                row, column = np.nonzero(scores >= least - 2e-9)  # scores are compared rounded
                value = scores[row, column]
                order = np.lexsort((column, -np.round(value, 9), row))  # equal scores by id
                order = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
                rows.append(row[order] + at)
                columns.append(column[order])
                values.append(value[order])
            return pa.table([left.column("id").take(pa.array(np.concatenate(rows))), items.column("id").take(pa.array(np.concatenate(columns))),
                             pa.array(np.concatenate(values))], names=["query_id", "item_id", "cosine"])

        by = ["cell", "block"]
        return asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(meet, schema)

    def _result(self) -> tuple[str, pa.Table]:
        from pyspark.sql.pandas.types import to_arrow_type
        kind = to_arrow_type(self.rows.schema["id"].dataType)
        empty = pa.table({"query_id": pa.array([], kind), "item_id": pa.array([], kind), "cosine": pa.array([], pa.float64())})
        return f"query_id {self.key_type}, item_id {self.key_type}, cosine double", empty

    def _first(self, q: DataFrame, still: DataFrame, first: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Each query's nearest boxes, the best rows of the ``first`` of them, and the queries with their reach and ``certified``."""
        # the nearest boxes: no distance is known yet, so all first bits are within reach
        near = self._buckets(q.withColumn("reach", F.lit(4.0)))
        order = Window.partitionBy("id").orderBy("bound", "code", "sub")
        ranked = materialize(near.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= first + 1), "index_nearest")
        found = materialize(self._top(self._scored(ranked.filter(F.col("turn") <= first), q).unionByName(still)), "index_first")
        kth = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.min("cosine").alias("_c"))
        # squared distance of the k-th best on unit vectors; 1e-9 as scores are compared rounded
        reach = F.when(F.col("_n") >= self.k, F.least(F.lit(4.0), 2 - 2 * F.col("_c") + 4e-9)).otherwise(4.0)
        kth = kth.select(F.col("query_id").alias("id"), reach.alias("reach"))
        next_bound = ranked.filter(F.col("turn") == first + 1).select("id", "bound")
        known = q.join(kth, "id", "left").withColumn("reach", F.coalesce("reach", F.lit(4.0))).join(next_bound, "id", "left")
        known = known.withColumn("certified", F.col("bound").isNull() | (F.col("bound") > F.col("reach") + SLACK)).drop("bound")
        return ranked, found, materialize(known, "index_known")

    def _wide(self, q: DataFrame, still: DataFrame, first: int) -> bool:
        """Whether a few queries need so many buckets that boxes are not worth asking."""
        few = materialize(q.orderBy(F.xxhash64("id", "u")).limit(PROBES), "index_probes")
        n = few.count()
        _, _, known = self._first(few, still.join(few.select(F.col("id").alias("query_id")), "query_id", "left_semi"), first)
        return self._buckets(known.filter("NOT certified")).count() > WIDE * n * self.boxes.count()

    def _top(self, scored: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), "item_id")
        return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= self.k)

    def search(self, queries: DataFrame, key: str, features: str, first: int = 4, go_on: bool = True, same: bool = True) -> DataFrame:
        """``query_id, item_id, cosine, rank, certified``: the k nearest corpus rows of every query.

        ``same=False`` leaves a query's own id out (the index must then hold k + 1 neighbours' copies; ask for one more).
        """
        q = materialize(_units(queries, key, features), "index_queries")
        everywhere = (q.filter("zero").select(F.col("id").alias("query_id")).join(F.broadcast(self.smallest.withColumnRenamed("id", "item_id")))
                      .withColumn("cosine", F.lit(0.0)).withColumn("certified", F.lit(True)))  # k rows
        q = q.filter("NOT zero").drop("zero")
        still = q.select(F.col("id").alias("query_id")).join(F.broadcast(self.zeros.orderBy("id").limit(self.k).withColumnRenamed("id", "item_id")))
        still = still.withColumn("cosine", F.lit(0.0))  # vectors of length 0: k rows
        if self.n == 0 or q.isEmpty():
            out = still.withColumn("certified", F.lit(True))
        else:
            q = materialize(_projected(q, self.directions), "index_query_projections")
            if go_on and self._wide(q, still, first):
                out = self._blocks(q).unionByName(still).withColumn("certified", F.lit(True))
            else:
                ranked, found, known = self._first(q, still, first)
                out = found.drop("rank")
                if go_on:
                    done = ranked.filter(F.col("turn") <= first).select("id", "code", "sub")
                    more = self._buckets(known.filter("NOT certified")).join(done, ["id", "code", "sub"], "left_anti")
                    more = materialize(more, "index_more")
                    self.pairs_scored = BUCKET * (more.count() + done.count())
                    out = out.unionByName(self._scored(more, q)).withColumn("certified", F.lit(True))
                else:
                    out = out.join(known.select(F.col("id").alias("query_id"), "certified"), "query_id")
        out = out.unionByName(everywhere)
        if not same:
            out = out.filter(F.col("query_id") != F.col("item_id"))
        return self._top(out)
