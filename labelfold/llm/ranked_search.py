"""Ranked lexical search by presence masks (operator 13).

Terms are runs of bytes other than ASCII non-alphanumerics, A-Z lower-cased, compared by
64-bit hashes.  One pass over the texts writes, for every document, its number of terms and
the (term, occurrences) of the items' vocabulary; Spark sums the corpus's figures from it.

A task takes the documents in blocks.  Each term of a block has a bitmap of the documents that hold it.
For an item, the bitmaps of its terms stand above each other, and each document's column of bits is its
presence mask; documents of equal mask form a group.  A mask scores at most the sum, over its
terms, of the best single-term score in the block.  Masks are evaluated by descending maximum
score, their documents exactly, until the maximum falls below the ``top``-th best score found so far in
the task; what is left can't enter the answer.  Equal maxima are still evaluated, so ties are
right.  Spark ranks what the tasks found.

The items are cut into parts of bounded size (``MAX_ITEMS`` items and ``MAX_BYTES`` bytes of text, counted
first); each part travels to the tasks and costs one pass.  A single item above ``MAX_BYTES`` is an error.

Cases: null, empty and punctuation-only texts and items have no terms and neither match nor
count; repeated items are answered one by one (their ranks stay apart by ``item_no``); repeated
documents are ranked each; a null doc_id comes after the others of its score; an empty table
gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, word_chunks, written

TOP = 10
MAX_ITEMS = 2048
MAX_BYTES = 16 << 20
BLOCK = 8192
#: Postings of a block; a block of fewer documents keeps it below.
BLOCK_POSTINGS = 1 << 21

_TERM_BYTES = np.arange(256, dtype=np.uint8)
_TERM_BYTES[[b for b in range(128) if not chr(b).isalnum()]] = 32


def item_terms(texts: list) -> list[np.ndarray]:
    """Sorted distinct term hashes of each text."""
    out = []
    for _, counts, hashes in word_chunks(pa.array(texts, pa.string()), _TERM_BYTES):
        ends = np.cumsum(counts)
        out += [np.unique(hashes[e - n:e]) for n, e in zip(counts.tolist(), ends.tolist())]
    return out


def postings(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """``doc_id, n, terms, tfs``: all terms of a document counted, and those of the vocabulary by number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, counts, hashes in word_chunks(batch.column("text"), _TERM_BYTES):
                doc = np.repeat(np.arange(len(counts)), counts)
                if len(vocabulary):
                    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                    held = vocabulary[at] == hashes
                    keys, tf = np.unique(doc[held] * len(vocabulary) + at[held], return_counts=True)
                else:
                    keys = tf = np.zeros(0, np.int64)
                width = max(1, len(vocabulary))
                offsets = np.searchsorted(keys, np.arange(len(counts) + 1) * width).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, len(counts)), pa.array(counts.astype(np.int64)),
                     pa.ListArray.from_arrays(offsets, (keys % width).astype(np.int32)), pa.ListArray.from_arrays(offsets, tf.astype(np.int32))],
                    ["doc_id", "n", "terms", "tfs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tfs array<int>")


class Block:
    """Documents of a block with the single-term scores and bitmaps of their terms."""

    def __init__(self, n: np.ndarray, counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        self.size = len(n)
        # in Python's integers where 64 bits could overflow
        m = np.array([10 + 90 * int(x) * n_docs // n_terms for x in n], np.int64) if 90 * n_docs * int(n.max(initial=0)) >= 1 << 62 else 10 + 90 * n * n_docs // max(1, n_terms)
        doc = np.repeat(np.arange(self.size), counts)
        self.width = len(weights)
        self.keys = doc * self.width + terms  # sorted: documents in order, terms in order
        tf = tfs.astype(np.int64)
        self.scores = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        order = np.argsort(terms, kind="stable")
        held, first = np.unique(terms[order], return_index=True)
        best = np.maximum.reduceat(self.scores[order], first) if len(first) else self.scores
        stops = np.append(first, len(order))
        #: per term: its row among the bitmaps (0: an empty one), and its best single score
        self.row = np.zeros(self.width, np.int64)
        self.row[held] = np.arange(1, len(held) + 1)
        self.best = np.zeros(self.width, np.int64)
        self.best[held] = best
        self.bitmaps = np.zeros((len(held) + 1, -(-self.size // 8)), np.uint8)
        for k in range(len(held)):
            bits = np.zeros(self.size, bool)
            bits[doc[order[stops[k]:stops[k + 1]]]] = True
            self.bitmaps[k + 1] = np.packbits(bits)

    def top(self, terms: np.ndarray, order: np.ndarray, least: int, top: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores of the ``top`` best of an item, none below ``least``; ``order`` ranks ids.  Third: masks evaluated."""
        terms = terms[self.row[terms] > 0]
        empty = np.zeros(0, np.int64)
        if not len(terms):
            return empty, empty, 0
        bits = np.unpackbits(self.bitmaps[self.row[terms]], axis=1, count=self.size)  # terms x documents
        bound = (self.best[terms].astype(np.float64) @ bits).astype(np.int64)  # below 2^53, so exact
        docs = np.flatnonzero(bound >= max(1, least))
        if not len(docs):
            return empty, empty, 0
        # documents of one mask: their columns of bits are equal
        masks = np.packbits(bits[:, docs], axis=0).T
        masks = np.ascontiguousarray(np.pad(masks, ((0, 0), (0, -masks.shape[1] % 8)))).view(np.uint64)
        by_mask = np.lexsort((*masks.T, -bound[docs]))  # by descending maximum, then mask
        docs, masks = docs[by_mask], masks[by_mask]
        fresh = np.ones(len(docs), bool)
        fresh[1:] = (masks[1:] != masks[:-1]).any(axis=1)
        starts = np.append(np.flatnonzero(fresh), len(docs))
        maxima = bound[docs[starts[:-1]]]
        found_docs, found_scores, at, step = empty, empty, 0, 16
        while at < len(maxima) and maxima[at] >= least:
            stop = min(at + step, int(np.searchsorted(-maxima, -least, "right")))
            some = docs[starts[at]:starts[stop]]
            keys = some[:, None] * self.width + terms
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            scores = np.where(self.keys[place] == keys, self.scores[place], 0).sum(axis=1)
            found_docs, found_scores = np.append(found_docs, some), np.append(found_scores, scores)
            keep = np.lexsort((order[found_docs], -found_scores))[:top]
            found_docs, found_scores = found_docs[keep], found_scores[keep]
            if len(found_scores) == top:
                least = max(least, int(found_scores[-1]))
            at, step = stop, step * 2
        good = found_scores >= max(1, least) if len(found_scores) else np.zeros(0, bool)
        return found_docs[good], found_scores[good], at


def best_of_blocks(held: DataFrame, items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """``item_no, doc_id, score``: what the tasks' blocks found; every item's best documents are among them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(0, np.int64) for _ in items]  # each item's best scores in this task so far
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, BLOCK)
                counts = part.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                rows = max(1, int(np.searchsorted(np.cumsum(counts), BLOCK_POSTINGS, "right")))
                part, counts = part.slice(0, rows), counts[:rows]
                at += part.num_rows
                numbers = [part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("terms", "tfs")]
                block = Block(part.column("n").to_numpy(zero_copy_only=False), counts, *numbers, weights, n_docs, n_terms)
                ids = part.column("doc_id")
                order = np.empty(len(ids), np.int64)
                order[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
                found = []
                for i, terms in enumerate(items):
                    least = int(seen[i][-1]) if len(seen[i]) == top else 1
                    docs, scores, _ = block.top(terms, order, least, top)
                    if len(docs):
                        seen[i] = -np.sort(-np.append(seen[i], scores))[:top]
                        found.append((np.full(len(docs), i, np.int64), docs, scores))
                if found:
                    item, docs, scores = (np.concatenate(c) for c in zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array(item), ids.take(pa.array(docs)), pa.array(scores)], ["item_no", "doc_id", "score"])

    kind = held.schema["doc_id"].dataType.simpleString()
    return held.mapInArrow(run, f"item_no long, doc_id {kind}, score long")


def _parts(items: DataFrame) -> tuple[DataFrame, int]:
    size = F.octet_length(F.col("text"))
    n, total, most = items.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    if most > MAX_BYTES:
        raise ValueError(f"an item holds {most} bytes; at most {MAX_BYTES} are allowed")
    parts = max(-(-n * 5 // (MAX_ITEMS * 4)), -(-total * 5 // (MAX_BYTES * 4)), 1)
    return items.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text", F.rand(7)), F.lit(parts)).alias("part")), parts


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``item_no, item_id, rank, doc_id, score``: the ``top`` best documents of every item, with scores above 0."""
    spark = docs.sparkSession
    items = items.select("item_id", "text")
    kind = items.schema["item_id"].dataType.simpleString()
    asked, parts = _parts(items)
    if parts > 1:
        asked = written(asked, "search-items")  # each part is read by itself
    out, base = None, 0
    for part in range(parts):
        rows = asked.where(F.col("part") == part).collect()  # bounded by _parts
        terms = item_terms([r["text"] for r in rows])
        vocabulary = np.unique(np.concatenate(terms)) if terms else np.zeros(0, np.uint64)
        held = written(postings(docs, vocabulary), "search-postings")
        n_docs, n_terms = held.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = dict(held.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # the vocabulary at most
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
        numbers = [np.searchsorted(vocabulary, t) for t in terms]
        found = best_of_blocks(held, numbers, weights, n_docs, n_terms, top)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item_no long, item_id {kind}")
        order = Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        ranked = ranked.join(F.broadcast(names), "item_no").select((F.col("item_no") + base).alias("item_no"), "item_id", "rank", "doc_id", "score")
        out, base = ranked if out is None else out.unionByName(ranked), base + len(rows)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """``op13_ranked_search``: the ten best documents of every benchmark item."""
    found = search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH words AS (SELECT row_number() OVER () AS d, doc_id, {_TERMS} AS ts FROM documents),
filled AS (SELECT d, doc_id, ts, len(ts)::BIGINT AS n FROM words WHERE len(ts) > 0),
whole AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM filled),
tf AS (SELECT d, t, count(*)::BIGINT AS tf FROM (SELECT d, unnest(ts) AS t FROM filled) GROUP BY d, t),
df AS (SELECT t, count(*)::BIGINT AS df FROM tf GROUP BY t),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
weighed AS (SELECT item_id, t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM asked JOIN df USING (t), whole),
single AS (SELECT w.item_id, f.doc_id, f.d,
           sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (10 + (90 * f.n * nd) // l))))::BIGINT AS score
           FROM weighed w JOIN tf USING (t) JOIN filled f USING (d), whole GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, d)::INTEGER AS rank, doc_id, score
           FROM single WHERE score > 0)
SELECT * FROM ranked WHERE rank <= {TOP}
"""
