"""Toxicity from the nearest labelled examples by exact TF-IDF cosine (operator 8).

* Examples: at most ``MAX_EXAMPLES`` labelled texts of each class, the first by
  a hash of the id (the documented bound of the labelled sample).
* Vocabulary: the words and stems (a word's first ``STEM`` bytes) whose document
  frequency differs between the two classes of the examples beyond chance
  (chi-square at 1e-4), and one term for all other words.  Weights are
  ``(1 + ln tf) * (ln((1 + N) / (1 + df)) + 1)`` with N and df counted over all documents.
* Index: inverted lists over the examples, cut into blocks of ``BLOCK``
  examples; each list holds the largest weight of each block.  A query sums the
  block maxima to an upper bound per block and evaluates blocks from the highest
  bound down until the bound falls below the k-th best cosine, so the k nearest
  are exact (ties: the example that comes first).
* Vote: neighbours weigh ``1 / (distance + 0.1)`` and the inverse sampling rate
  of their class; the vote is mapped to a probability by a logistic curve fitted
  on the examples' own leave-one-out votes.

Cases: null and empty texts have no neighbour and get the share of toxic examples
among such texts (among all, if there is none); without labelled rows every score
is 0; repeated rows are scored one by one; conflicting labels of
one id count as toxic; ids and other columns are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import fold, table, word_chunks

MAX_EXAMPLES = 1500
BLOCK = 64
NEIGHBOURS = 15
STEM = 6
CHI_SQUARE = 15.14  # one degree of freedom, 1e-4
THRESHOLD = 0.7
EVIDENCE = 3


#: The term that stands for all words outside the vocabulary.
OTHER = np.uint64(1)


def texts_terms(column: pa.Array):
    """Yield ``(row, words, stems)`` hashes of every text of a column."""
    for (row, counts, words), (_, _, stems) in zip(word_chunks(column), word_chunks(column, head=STEM)):
        at = 0
        for i, n in enumerate(counts):
            yield row + i, words[at:at + n], stems[at:at + n]
            at += n


def bag(words: np.ndarray, stems: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct known terms (sorted) of a text and their frequencies; other words count as ``OTHER``."""
    if not len(words) or not len(terms):
        return words[:0], np.zeros(0, np.int64)
    known = lambda h: terms[np.minimum(np.searchsorted(terms, h), len(terms) - 1)] == h
    k = known(words)
    hashes, tf = np.unique(np.r_[words[k], stems[known(stems)]], return_counts=True)
    rest = len(words) - int(k.sum())
    return (np.r_[OTHER, hashes], np.r_[rest, tf]) if rest else (hashes, tf)


def _spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the concatenated ranges and the number of the range of each."""
    n = ends - starts
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + starts[which], which


class BlockMaxIndex:
    """Inverted lists with block maxima over unit vectors of examples."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray, examples: list[tuple[np.ndarray, np.ndarray]]):
        """``examples``: sorted distinct term hashes and their frequencies, of each example."""
        self.terms, self.idf, self.n = terms, idf, len(examples)
        rows, cols, weights = [], [], []
        for i, (hashes, tf) in enumerate(examples):
            t, w = self.vector(hashes, tf)
            rows.append(np.full(len(t), i))
            cols.append(t)
            weights.append(w)
        row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        col = np.concatenate(cols) if cols else np.zeros(0, np.int64)
        weight = np.concatenate(weights) if weights else np.zeros(0)
        order = np.lexsort((row, col))
        self.example, self.weight, col = row[order], weight[order], col[order]
        self.blocks = -(-self.n // BLOCK)
        cell = col * max(1, self.blocks) + self.example // BLOCK
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
        self.cell_start, self.cell_end = first, np.r_[first[1:], len(cell)] if len(cell) else first
        self.cell_block = self.example[first] // BLOCK if len(cell) else first
        self.cell_max = np.maximum.reduceat(self.weight, first) if len(cell) else np.zeros(0)
        cell_term = col[first] if len(cell) else first
        self.term_start = np.searchsorted(cell_term, np.arange(len(terms)))
        self.term_end = np.searchsorted(cell_term, np.arange(len(terms)), "right")

    def vector(self, hashes: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and weights of the unit TF-IDF vector; empty if no term is known."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        known = self.terms[at] == hashes
        at, w = at[known], (1 + np.log(tf[known])) * self.idf[at[known]]
        norm = np.sqrt((w * w).sum())
        return (at, w / norm) if norm > 0 else (at[:0], w[:0])

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest positive cosine, first examples first on ties, without example ``skip``."""
        cells, which = _spans(self.term_start[t], self.term_end[t])
        if not len(cells):
            return np.zeros(0, np.int64), np.zeros(0)
        bound = np.bincount(self.cell_block[cells], w[which] * self.cell_max[cells], self.blocks)
        order = np.argsort(-bound, kind="stable")
        best, cosine, done, step = np.zeros(0, np.int64), np.zeros(0), 0, 2
        while done < len(order):
            take = order[done:done + step]
            least = cosine[k - 1] if len(cosine) >= k else 0.0
            take = take[(bound[take] > 0) & (bound[take] >= least - 1e-9)]
            if not len(take):
                break
            chosen = np.zeros(self.blocks, bool)
            chosen[take] = True
            mine = chosen[self.cell_block[cells]]
            posts, from_cell = _spans(self.cell_start[cells[mine]], self.cell_end[cells[mine]])
            score = np.bincount(self.example[posts], w[which[mine]][from_cell] * self.weight[posts], self.n)
            if skip >= 0:
                score[skip] = 0
            got = np.flatnonzero(score > 0)
            best, cosine = np.r_[best, got], np.r_[cosine, score[got]]
            top = np.lexsort((best, -np.round(cosine, 12)))[:k]
            best, cosine = best[top], cosine[top]
            done, step = done + step, step * 2
        return best, np.minimum(cosine, 1.0)


class Model:
    """Index, labels and calibration; ``score`` maps a text's words to a probability and its evidence."""

    def __init__(self, index: BlockMaxIndex, terms: np.ndarray, ids: list, toxic: np.ndarray, rate: np.ndarray, examples: list):
        self.index, self.terms, self.ids, self.toxic, self.rate = index, terms, ids, toxic, rate
        votes = np.full(len(ids), np.nan)
        for i, (hashes, tf) in enumerate(examples):
            best, cosine = index.nearest(*index.vector(hashes, tf), NEIGHBOURS, skip=i)
            if len(best):
                votes[i] = self._vote(best, cosine)
        weight = 1 / rate if len(ids) else rate
        none = np.isnan(votes)
        total = weight[none].sum()
        self.prior = float((weight * toxic)[none].sum() / total) if total > 0 else (float(np.average(toxic, weights=weight)) if len(ids) else 0.0)
        self.curve = fit_logistic(votes[~none], toxic[~none], weight[~none])

    def _vote(self, best: np.ndarray, cosine: np.ndarray) -> float:
        w = 1 / (1 - cosine + 0.1) / self.rate[best]
        return float((w * self.toxic[best]).sum() / w.sum())

    def score(self, words: np.ndarray, stems: np.ndarray) -> tuple[float, list]:
        best, cosine = self.index.nearest(*self.index.vector(*bag(words, stems, self.terms)), NEIGHBOURS)
        if not len(best):
            return self.prior, []
        a, b = self.curve
        return float(1 / (1 + np.exp(-(a * self._vote(best, cosine) + b)))), [
            {"doc_id": self.ids[i], "cosine": float(c), "toxic": int(self.toxic[i])} for i, c in zip(best[:EVIDENCE], cosine)]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a weighted, slightly ridged logistic curve (Newton steps)."""
    beta = np.zeros(2)
    if not len(x):
        return 0.0, 0.0
    weight = weight / weight.mean()
    design = np.c_[x, np.ones(len(x))]
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (weight * (y - p)) - 0.1 * beta
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, words, stems in texts_terms(batch.column("text")):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(row, 1), batch.column("toxic").slice(row, 1),
                 pa.array([words.tobytes()], pa.binary()), pa.array([stems.tobytes()], pa.binary())],
                ["doc_id", "toxic", "words", "stems"])


def training_sample(docs: DataFrame, labels: DataFrame, max_examples: int) -> tuple[list, dict[int, int]]:
    """Bags of at most ``max_examples`` labelled documents of each class, and the class totals."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = docs.select("doc_id").where("doc_id is not null").distinct().join(marks, "doc_id")
    totals = {int(r["toxic"]): r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    order = [F.xxhash64(F.col("doc_id"), F.lit(8)), F.col("doc_id")]
    chosen = [r for y in (0, 1) for r in known.where(F.col("toxic") == y).orderBy(*order).limit(max_examples).collect()]
    if not chosen:
        return [], totals
    picked = docs.sparkSession.createDataFrame([(r["doc_id"], r["toxic"]) for r in chosen],
                                               f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic int")
    # the sample's size is bounded by max_examples
    bags = (docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
            .mapInArrow(_bags, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic int, words binary, stems binary"))
    first = {}
    for r in sorted(bags.collect(), key=lambda r: (r["doc_id"], bytes(r["words"]))):
        first.setdefault(r["doc_id"], r)  # one text per id
    rows = [(r["doc_id"], int(r["toxic"]), np.frombuffer(r["words"], np.uint64), np.frombuffer(r["stems"], np.uint64))
            for r in first.values()]
    return rows, totals


def informative_terms(rows: list) -> np.ndarray:
    """Sorted hashes of the words and stems whose presence differs between the classes (chi-square)."""
    n1 = sum(r[1] for r in rows)
    n0 = len(rows) - n1
    if not n0 or not n1:
        return np.zeros(0, np.uint64)
    held = [np.unique(np.r_[r[2], r[3]]) for r in rows]
    y = np.concatenate([np.full(len(h), r[1]) for h, r in zip(held, rows)])
    terms, at = np.unique(np.concatenate(held), return_inverse=True)
    a = np.bincount(at, y, len(terms))
    b = np.bincount(at, None, len(terms)) - a
    c, d = n1 - a, n0 - b
    total = a + b
    chi = (a * d - b * c) ** 2 * (n0 + n1) / np.maximum(1e-12, total * (c + d) * n1 * n0)
    return terms[(chi >= CHI_SQUARE) & (total >= 3)]


def document_counts(docs: DataFrame, terms: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of all documents, and how many of them hold each term."""
    def count(batches):
        df = np.zeros(len(terms) + 1, np.int64)
        for batch in batches:
            df[-1] += batch.num_rows
            for _, words, stems in texts_terms(batch.column("text")):
                hashes, _ = bag(words, stems, terms)
                df[np.searchsorted(terms, hashes[hashes != OTHER])] += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "n"])
    rows = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # bounded by the vocabulary
    out = np.zeros(len(terms) + 1, np.int64)
    for r in rows:
        out[r["term"]] = r["n"]
    return int(out[-1]), out[:-1]


def train(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> Model:
    """Fit on the labelled rows of ``labels(doc_id, toxic)``; counts cover all of ``docs``."""
    rows, totals = training_sample(docs, labels, max_examples)
    terms = informative_terms(rows)
    n, df = document_counts(docs, terms) if len(terms) else (0, np.zeros(0))
    examples = [bag(r[2], r[3], terms) for r in rows]
    toxic = np.array([r[1] for r in rows], np.float64)
    taken = {y: max(1, int((toxic == y).sum())) for y in (0, 1)}
    rate = np.array([min(1.0, taken[r[1]] / max(1, totals.get(r[1], 1))) for r in rows])
    index = BlockMaxIndex(np.r_[OTHER, terms], np.r_[1.0, np.log((1 + n) / (1 + df)) + 1], examples)
    return Model(index, terms, [r[0] for r in rows], toxic, rate, examples)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` and ``evidence`` (the nearest examples: id, cosine, label)."""
    kept = [f for f in docs.schema.fields if f.name.lower() not in ("score", "evidence")]
    kind = docs.schema["doc_id"].dataType.simpleString()
    arrow_id = to_arrow_type(docs.schema["doc_id"].dataType)
    evidence = pa.list_(pa.struct([("doc_id", arrow_id), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [model.score(words, stems) for _, words, stems in texts_terms(part.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name) for f in kept), pa.array([s for s, _ in out], pa.float64()), pa.array([e for _, e in out], evidence)],
                    [*(f.name for f in kept), "score", "evidence"])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "score double",
                        f"evidence array<struct<doc_id:{kind},cosine:double,toxic:int>>"])
    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """``op8_toxicity``: every document, learnt from the labels outside fold 1 of 3."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 3) != 1)
    return score(docs, train(docs, labels)).select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
