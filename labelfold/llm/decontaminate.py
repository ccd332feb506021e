"""Benchmark decontamination by SimHash of item-sized windows (operator 6).

Words are runs of bytes other than white space and ASCII punctuation, lower-cased;
shingles are ``SHINGLE`` words, weighted by how often they occur.  An item
of n words is compared with the n-word windows of every text: a 64-bit SimHash
over a window's weighted shingles, looked up in a multi-index.  The bits are cut
into ``RADIUS + 1`` blocks, so two fingerprints within ``RADIUS`` bits agree in
one block at least: no pair within the radius is missed.  Candidates within the
radius are verified by the exact weighted similarity sum(min) / sum(max) of
their shingles, at ``SIMILARITY`` or more.

A window without any shingle of the benchmark has similarity 0 with every item
and is not fingerprinted; a text shorter than an item is one window.  Items of
fewer words than a shingle are one shingle and match equal word runs.

The benchmark is cut into parts of bounded size (``MAX_ITEMS`` items and
``MAX_BYTES`` bytes of text, counted first); each part travels to the tasks and
costs one pass over the documents.  A single item above ``MAX_BYTES`` is an error.

Cases: null, empty and punctuation-only texts and items match nothing; repeated
items and documents are treated one by one; an empty benchmark matches nothing;
other columns pass through unless they bear an output's name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import mix, shingle_hashes, table, word_chunks

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 18
MAX_ITEMS = 4096
MAX_BYTES = 16 << 20

_NORMAL = np.arange(256, dtype=np.uint8)
_NORMAL[[b for b in range(128) if not chr(b).isalnum()]] = 32
_BITS = np.arange(64, dtype=np.uint64)


def _signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle's hash."""
    return (((mix(shingles)[:, None] >> _BITS) & np.uint64(1)).astype(np.int8) << 1) - 1


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << _BITS).sum(1, dtype=np.uint64)


def window_fingerprints(shingles: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """SimHash of the windows of ``length`` shingles at the given starts (sorted)."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # runs of near starts share one cumulative sum of bounded size
        lo = starts[at]
        stop = int(np.searchsorted(starts, lo + 4096))
        part = _signs(shingles[lo:starts[stop - 1] + length])
        total = np.zeros((len(part) + 1, 64), np.int32)
        np.cumsum(part, axis=0, out=total[1:])
        here = starts[at:stop] - lo
        out[at:stop] = _fingerprints(total[here + length] - total[here])
        at = stop
    return out


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """sum(min) / sum(max) over two shingle multisets."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    low = int(np.minimum(n[i], m[j]).sum())
    return low / max(1, len(a) + len(b) - low)


class Index:
    """Items by length, with their shingles and the block tables of their fingerprints."""

    def __init__(self, ids: list, words: list[np.ndarray]):
        self.ids, self.sizes = ids, np.array([len(w) for w in words], np.int64)
        self.shingles = [shingle_hashes(w, SHINGLE) for w in words]
        self.radius_blocks = np.array_split(np.arange(64), RADIUS + 1)
        self.groups = {}
        for n in sorted(set(self.sizes.tolist()) - {0}):
            items = np.flatnonzero(self.sizes == n)
            prints = np.concatenate([window_fingerprints(self.shingles[i], np.zeros(1, np.int64), len(self.shingles[i])) for i in items])
            tables = []
            for bits in self.radius_blocks:
                held = np.zeros((1 << len(bits), len(items)), bool)
                held[self.block(prints, bits), np.arange(len(items))] = True
                tables.append(held)
            self.groups[n] = (items, prints, tables)
        owners: dict[int, dict[int, set]] = {}
        for i, s in enumerate(self.shingles):
            for h in s.tolist():
                owners.setdefault(min(int(self.sizes[i]), SHINGLE), {}).setdefault(h, set()).add(int(self.sizes[i]))
        #: by shingle length: sorted hashes, and the item lengths that hold each
        self.known = {k: (np.array(sorted(v), np.uint64), [v[h] for h in sorted(v)]) for k, v in owners.items()}

    @staticmethod
    def block(prints: np.ndarray, bits: np.ndarray) -> np.ndarray:
        return ((prints >> np.uint64(bits[0])) & np.uint64((1 << len(bits)) - 1)).astype(np.int64)

    def candidates(self, n: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window numbers, item numbers and distances of all pairs within the radius among items of n words."""
        items, own, tables = self.groups[n]
        near = np.zeros((len(prints), len(items)), bool)
        for bits, held in zip(self.radius_blocks, tables):
            near |= held[self.block(prints, bits)]
        window, item = np.nonzero(near)
        distance = np.bitwise_count(prints[window] ^ own[item]).astype(np.int64)
        ok = distance <= RADIUS
        return window[ok], items[item[ok]], distance[ok]

    def matches(self, words: np.ndarray, hits: dict[int, np.ndarray]) -> list[dict]:
        """Best window of every item found in a text; ``hits``: by shingle length, starts of known shingles."""
        best: dict[int, tuple] = {}
        for k, at in hits.items():
            known, lengths = self.known[k]
            shingles = shingle_hashes(words, k)
            at = at[at < len(shingles)]
            if not len(at):
                continue
            owner = np.searchsorted(known, shingles[at])
            by_length: dict[int, list] = {}
            for p, o in zip(at.tolist(), owner.tolist()):
                for n in lengths[o]:
                    by_length.setdefault(n, []).append(p)
            for n, places in by_length.items():
                length = min(n - k + 1, len(shingles))
                p = np.array(places)
                covered = np.zeros(len(shingles) + 1, np.int64)
                np.add.at(covered, np.maximum(0, p - length + 1), 1)
                np.add.at(covered, np.minimum(p, len(shingles) - length) + 1, -1)
                starts = np.flatnonzero(np.cumsum(covered[:-1])[:len(shingles) - length + 1] > 0)
                if not len(starts):
                    continue
                window, item, distance = self.candidates(n, window_fingerprints(shingles, starts, length))
                for w, i, d in zip(window.tolist(), item.tolist(), distance.tolist()):
                    at0 = int(starts[w])
                    s = weighted_similarity(shingles[at0:at0 + length], self.shingles[i])
                    if s >= SIMILARITY and (i not in best or (-s, at0) < best[i][:2]):
                        best[i] = (-s, at0, d, length + k - 1)
        return [{"item_id": self.ids[i], "similarity": -s, "start_word": at, "n_words": n, "distance": d}
                for i, (s, at, d, n) in sorted(best.items())]


def _known_starts(index: Index, counts: np.ndarray, words: np.ndarray):
    """Per shingle length, the positions in a run of texts where a shingle of the benchmark starts."""
    ends = np.cumsum(counts)
    for k, (known, _) in index.known.items():
        shingles = shingle_hashes(words, k) if len(words) >= k else words[:0]
        at = known[np.minimum(np.searchsorted(known, shingles), len(known) - 1)] == shingles
        p = np.flatnonzero(at)
        doc = np.searchsorted(ends, p, "right")
        yield k, p[p + k <= ends[doc]]  # within one text


def _parts(benchmark: DataFrame) -> tuple[DataFrame, int]:
    size = F.octet_length(F.col("text"))
    n, total, most = benchmark.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    if most > MAX_BYTES:
        raise ValueError(f"a benchmark item holds {most} bytes; at most {MAX_BYTES} are allowed")
    parts = max(-(-n * 5 // (MAX_ITEMS * 4)), -(-total * 5 // (MAX_BYTES * 4)), 1)
    return benchmark.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).alias("part")), parts


FOUND = "array<struct<item_id:{0},similarity:double,start_word:long,n_words:long,distance:long>>"


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with ``found``: the items whose text is in it, each with its most similar window."""
    kind = benchmark.schema["item_id"].dataType.simpleString()
    arrow_kind = to_arrow_type(benchmark.schema["item_id"].dataType)
    arrow = pa.list_(pa.struct([("item_id", arrow_kind), ("similarity", pa.float64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("distance", pa.int64())]))
    kept = [f for f in docs.schema.fields if f.name.lower() != "found"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"found {FOUND.format(kind)}"])
    def judge(batch: pa.RecordBatch, index: Index, more: bool) -> pa.RecordBatch:
        found: list = [[] for _ in range(batch.num_rows)]
        for row, counts, hashes in word_chunks(pc.utf8_lower(batch.column("text")), _NORMAL) if index.ids else ():
            starts = np.cumsum(counts) - counts
            hits: dict[int, dict] = {}
            for k, p in _known_starts(index, counts, hashes):
                doc = np.searchsorted(starts, p, "right") - 1
                for d in np.unique(doc):
                    hits.setdefault(int(d), {})[k] = p[doc == d] - starts[d]
            for d, by in hits.items():
                found[row + d] = index.matches(hashes[starts[d]:starts[d] + counts[d]], by)
        if more:
            found = [a + b for a, b in zip(batch.column("found").to_pylist(), found)]
        return pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(found, arrow)],
                                          [*(f.name for f in kept), "found"])

    items, parts = _parts(benchmark)
    out = docs.select(*[F.col(f"`{f.name}`") for f in kept])
    for part in range(parts):
        rows = sorted(items.where(F.col("part") == part).collect(), key=str)  # bounded by _parts
        ids, words = [], []
        column = pa.array([r["text"] for r in rows], pa.string())
        for first, counts, hashes in word_chunks(pc.utf8_lower(column), _NORMAL):
            ends = np.cumsum(counts)
            for i, n in enumerate(counts):
                if n:
                    ids.append(rows[first + i]["item_id"])
                    words.append(hashes[ends[i] - n:ends[i]])
        index = Index(ids, words)

        def run(batches, index=index, more=part > 0):
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    yield judge(batch.slice(at, 512), index, more)

        out = out.mapInArrow(run, schema)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """``op6_decontaminate``: every document with the benchmark items found in it."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"),
                 table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", (F.size("found") > 0).alias("contaminated"), F.size("found").cast("long").alias("n_items"),
                        F.col("found.item_id").alias("item_ids"), F.array_max("found.similarity").alias("similarity"))
