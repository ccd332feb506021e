"""Helpers of the training-data operators: scratch tables, table reads, word hashes and connected components.

``word_chunks`` hashes the words of an Arrow text column with numpy over the
column's own buffer.  A word is ``[^\\x20\\x09-\\x0D]+`` after A-Z are
lower-cased; its hash is 64 bits of a polynomial over a random byte table.  Two
different words or shingles of one document pair are confused with a
probability of about n^2 / 2^64.
"""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelfold.session import checkpoint_path



def _give_memory_back():
    """Let this process return freed memory to the system.

    Python workers live on from task to task.  By default Arrow's pool keeps what it freed, and glibc
    stops mapping large arrays by themselves after the first of them is freed, so a worker's
    memory only ever grows to the sum of its peaks.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL(None)
        for option, value in ((-3, 1 << 20), (-1, 4 << 20), (-8, 2)):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD, M_ARENA_MAX
            libc.mallopt(option, value)
        libc.malloc_trim.argtypes = [ctypes.c_size_t]
        return libc
    except (AttributeError, OSError):
        return None  # another C library: nothing to set


_LIBC = _give_memory_back()

CHUNK_BYTES = 1 << 18
_MASK = (1 << 64) - 1
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, _MASK, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_STEP = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3,
                  0x589965CC75374CC3], np.uint64)
_POWERS: list = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


#: Bytes of the Arrow batches in which rows travel to Python workers; whole texts make Spark's own bound of 64 MB felt.
BATCH_BYTES = 8 << 20


def _bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table, over its whole extent."""
    _bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text (null: empty), modulo ``folds``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared checkpoint folder and read it back (cuts lineage, survives lost executors)."""
    path = checkpoint_path(df.sparkSession, f"llm/{name}-{uuid.uuid4().hex[:12]}")
    _bound_batches(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def set_aside(df: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """``df`` with columns of these names renamed, and the columns that give its own names and order back."""
    other = {c: f"{c}__of_input" for c in df.columns if c.lower() in names}
    return df.withColumnsRenamed(other), [F.col(f"`{other.get(c, c)}`").alias(c) for c in df.columns]


#: Ids that one broadcast may hold (16 MB of longs); beyond, the rows are found by a shuffled join.
BROADCAST_IDS = 2_000_000


def rows_of(df: DataFrame, ids: DataFrame, key: str | list[str], without: bool = False) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids(key)``, or isn't; null matches null.  ``ids`` is counted before it is broadcast."""
    keys = [key] if isinstance(key, str) else key
    ids = ids.select(*[F.col(k).alias(f"wanted_{k}") for k in keys]).distinct()
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    on = None
    for k in keys:
        same = df[k].eqNullSafe(ids[f"wanted_{k}"])
        on = same if on is None else on & same
    return df.join(ids, on, "left_anti" if without else "left_semi")


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES)
        for k, base in enumerate((_BASE, _BASE_INV)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _POWERS[k] = np.multiply.accumulate(step)
    return _POWERS[0], _POWERS[1]


def _hash_bytes(data: np.ndarray, cuts: np.ndarray, head: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words in ``data``; no word spans a position of ``cuts`` (sorted).

    With ``head``, the hashes are of the words' first ``head`` bytes.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = word[cuts]
    last[cuts - 1] = word[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * power[:n], out=total[1:])
    stops = np.minimum(starts + head, ends) if head else ends
    return mix((total[stops] - total[starts]) * inverse[starts] + np.uint64(head)), starts, ends


def _text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (len + 1) and bytes of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def word_chunks(column: pa.Array, normalise: np.ndarray | None = None, head: int = 0):
    """Yield ``(first_row, word_counts, hashes)`` for runs of rows of a text column.

    ``word_counts[i]`` is the number of words of row ``first_row + i``; hashes
    are in text order.  ``normalise`` maps each byte before hashing (to split at
    punctuation, map it to a space); ``head`` hashes only the first bytes of each
    word.  A text longer than a chunk is hashed in
    pieces cut at white space.
    """
    offsets, data = _text_buffers(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1
        stop = min(max(stop, row + 1), rows)
        lo, hi = int(offsets[row]), int(offsets[stop])
        if hi - lo <= 2 * CHUNK_BYTES:
            part = data[lo:hi] if normalise is None else normalise[data[lo:hi]]
            cuts = offsets[row:stop + 1] - lo
            hashes, starts, _ = _hash_bytes(part, cuts[1:-1], head)
            counts = np.diff(np.searchsorted(starts, cuts))
        else:  # one long text
            pieces = []
            while lo < hi:
                end = min(lo + CHUNK_BYTES, hi)
                while end < hi and not _SPACE[data[end]]:  # to the end of the word
                    end += 1
                part = data[lo:end] if normalise is None else normalise[data[lo:end]]
                pieces.append(_hash_bytes(part, np.zeros(0, np.int64), head)[0])
                lo = end
            hashes = np.concatenate(pieces)
            counts = np.array([len(hashes)])
        yield row, counts, hashes
        row = stop
    if _LIBC is not None:  # what this batch's arrays leave between smaller objects
        _LIBC.malloc_trim(0)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size``-word shingles of one text, in order; a shorter text is one shingle, an empty one none."""
    n = len(words)
    if n == 0:
        return words
    size = min(size, n)
    steps = _STEP if size <= len(_STEP) else mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        out += words[k:n - size + 1 + k] * steps[k]
    return mix(out)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, comp)``: the smallest id reachable from each node over undirected edges ``(a, b)``.

    Star contraction (large star, then small star) until nothing changes.  Each
    step is a min with map-side combine and an equi-join whose hot side AQE can
    split, so a hub never sits in one group of one task; each round's edges are
    written to the shared folder.
    """
    now = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(),
                  "edges")
    before = None
    while True:
        # large star: every larger neighbour of v goes to v's smallest neighbour or v itself
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b")
        # small star: v's smaller neighbours and v itself go to its smallest neighbour
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")),
                                                              F.struct(F.col("m").alias("a"), F.col("b")))).alias("e"))
        now = written(small.select("e.a", "e.b").where("a < b").distinct(), "edges")
        # settled when no edge changes any more
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())
        if state == before:
            break
        before = state
    return (nodes.select("id").join(now.select(F.col("b").alias("id"), F.col("a").alias("m")), "id", "left")
            .select("id", F.coalesce("m", "id").alias("comp")))
