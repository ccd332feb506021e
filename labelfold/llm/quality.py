"""Quality classifier by co-training (operator 3).

Two views of a document: its text (byte histogram, hashed words, a few counts)
and its page metadata (language, source, declared length).  A logistic
regression per view starts from a bounded labelled sample.  In each round both
score all unlabelled documents; each view hands its most confident pseudo-labels
of either class to the other view, which is fitted anew.  Both views are then
calibrated on labelled rows kept out of fitting, and a logistic combination of
the two scores every document.

Bounds (documented parameters): ``MAX_LABELLED`` labelled rows of each class, by
a hash of the id, a quarter of them for calibration; ``PSEUDO`` pseudo-labels of
each class, view and round, only with a confidence of ``CONFIDENT``.

Cases: null and empty texts are a text view of zeros; null metadata is a value
of its own; without labels of both classes every score is the share of good
labels (0.5 without any); conflicting labels of an id count as bad; repeated rows
are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _text_buffers, table, word_chunks, written

MAX_LABELLED = 1500
PSEUDO = 200
CONFIDENT = 0.95
ROUNDS = 2
WORDS = 128
TEXT_DIM = 256 + WORDS + 4
META_BINS = 64
META_DIM = 2 * META_BINS + 24


def text_view(column: pa.Array) -> np.ndarray:
    """Features of every text of a column."""
    out = np.zeros((len(column), TEXT_DIM), np.float32)
    offsets, data = _text_buffers(column)
    for i in range(len(column)):
        part = data[offsets[i]:offsets[i + 1]]
        if len(part):
            out[i, :256] = np.sqrt(np.bincount(part, minlength=256) / len(part))
    for row, counts, words in word_chunks(column):
        at = 0
        for i, n in enumerate(counts):
            if n:
                own = words[at:at + n]
                bag = np.log1p(np.bincount((own % np.uint64(WORDS)).astype(np.int64), minlength=WORDS))
                size = offsets[row + i + 1] - offsets[row + i]
                out[row + i, 256:256 + WORDS] = bag / np.sqrt((bag * bag).sum())
                out[row + i, 256 + WORDS:] = (len(np.unique(own)) / n, np.log1p(size / n) / 3, np.log1p(n) / 10, 1)
            at += n
    return out


def meta_view(lang: list, source: list, n_chars: list) -> np.ndarray:
    """Features of the page metadata: hashed language and source, and the length's order of magnitude."""
    from zlib import crc32
    out = np.zeros((len(lang), META_DIM), np.float32)
    for i, (a, b, n) in enumerate(zip(lang, source, n_chars)):
        out[i, crc32(f"lang={a}".encode()) % META_BINS] = 1
        out[i, META_BINS + crc32(f"source={b}".encode()) % META_BINS] = 1
        bin_ = 0 if n is None or n != n or n < 0 else 1 + min(22, int(2 * np.log2(n + 1) / 3))
        out[i, 2 * META_BINS + bin_] = 1
    return out


def features(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_view, meta_view)``: float16 vectors of ``docs(doc_id, text, lang, source, n_chars)``, written once."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                t = text_view(part.column("text")).astype(np.float16)
                m = meta_view(*(part.column(c).to_pylist() for c in ("lang", "source", "n_chars"))).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x.tobytes() for x in t], pa.binary()),
                                                  pa.array([x.tobytes() for x in m], pa.binary())], ["doc_id", "text_view", "meta_view"])
    return written(docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("double")).mapInArrow(
        run, f"doc_id {kind}, text_view binary, meta_view binary"), "quality-features")


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted ridge logistic regression with an unpenalised intercept (damped Newton steps)."""
    design = np.c_[x.astype(np.float64), np.ones(len(x))]
    weight = weight / weight.mean()
    penalty = np.full(design.shape[1], ridge)
    penalty[-1] = 1e-6
    beta = np.zeros(design.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (weight * (y - p)) - penalty * beta
        hess = (design * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ design + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        beta += step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    return beta


def logit(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return np.clip(x.astype(np.float64) @ beta[:-1] + beta[-1], -30, 30)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _matrix(column, dim: int) -> np.ndarray:
    raw = column.to_pylist() if isinstance(column, pa.Array) else column
    return np.frombuffer(b"".join(bytes(r) for r in raw), np.float16).reshape(-1, dim).astype(np.float32)


class Model:
    """Both views, their calibration and the combination."""

    def __init__(self, text, meta, text_curve, meta_curve, both):
        self.text, self.meta, self.text_curve, self.meta_curve, self.both = text, meta, text_curve, meta_curve, both

    def views(self, t: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated logits of the two views."""
        a, b = self.text_curve, self.meta_curve
        return a[0] * logit(t, self.text) + a[1], b[0] * logit(m, self.meta) + b[1]

    def probability(self, t: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        zt, zm = self.views(t, m)
        return sigmoid(zt), sigmoid(zm), sigmoid(logit(np.c_[zt, zm], self.both))


def _confident(table_: DataFrame, model: Model, labelled: DataFrame, pseudo: int) -> list:
    """The most confident unlabelled documents of each class by each view: ``(view, label, text_view, meta_view)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {(v, y): ([], [], []) for v in (0, 1) for y in (0, 1)}
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column("text_view").to_pylist(), batch.column("meta_view").to_pylist()
            views = model.views(_matrix(raw[0], TEXT_DIM), _matrix(raw[1], META_DIM))
            for (v, y), kept in best.items():
                sure = sigmoid(views[v] if y else -views[v])
                for i in np.argsort(-sure, kind="stable")[:pseudo]:
                    if sure[i] < CONFIDENT:
                        break
                    kept[0].append(float(sure[i]))
                    kept[1].append(raw[0][i])
                    kept[2].append(raw[1][i])
                if len(kept[0]) > pseudo:  # of a class, the most confident ones of the task
                    order = np.argsort(-np.array(kept[0]), kind="stable")[:pseudo]
                    best[(v, y)] = tuple([part[i] for i in order] for part in kept)
        for (v, y), (sure, t, m) in best.items():
            n = len(sure)
            yield pa.RecordBatch.from_arrays([pa.array([v] * n, pa.int32()), pa.array([y] * n, pa.int32()), pa.array(sure, pa.float64()),
                                              pa.array(t, pa.binary()), pa.array(m, pa.binary())], ["view", "label", "sure", "text_view", "meta_view"])
    rest = table_.join(labelled, "doc_id", "left_anti")
    found = written(rest.select("text_view", "meta_view").mapInArrow(
        run, "view int, label int, sure double, text_view binary, meta_view binary"), "quality-confident")
    return [r for v in (0, 1) for y in (0, 1)
            for r in found.where((F.col("view") == v) & (F.col("label") == y)).orderBy(F.desc("sure"), "text_view", "meta_view").limit(pseudo).collect()]


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS,
          pseudo: int = PSEUDO) -> tuple[DataFrame, Model | float]:
    """The feature table of ``docs`` and the model (a constant score if a class has no label)."""
    table_ = features(docs)
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    known = docs.select("doc_id").where("doc_id is not null").distinct().join(marks, "doc_id")
    totals = {int(r["y"]): r["count"] for r in known.groupBy("y").count().collect()}  # two rows
    if not totals.get(0) or not totals.get(1):
        return table_, totals.get(1, 0) / sum(totals.values()) if totals else 0.5
    order = [F.xxhash64(F.col("doc_id"), F.lit(3)), F.col("doc_id")]
    chosen = [r for y in (0, 1) for r in known.where(F.col("y") == y).orderBy(*order).limit(max_labelled).collect()]
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    picked = spark.createDataFrame([(r["doc_id"], r["y"], i) for i, r in enumerate(chosen)], f"doc_id {kind}, y int, turn int")
    rows = table_.join(F.broadcast(picked), "doc_id").collect()  # bounded by max_labelled
    rows = list({r["doc_id"]: r for r in sorted(rows, key=lambda r: (r["turn"], bytes(r["text_view"]), bytes(r["meta_view"])))}.values())
    t, m = _matrix([r["text_view"] for r in rows], TEXT_DIM), _matrix([r["meta_view"] for r in rows], META_DIM)
    y = np.array([r["y"] for r in rows], np.float64)
    weight = np.array([totals[int(v)] / (y == v).sum() for v in y])
    held = np.array([r["turn"] % 4 == 3 for r in rows])
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:  # too few labels to keep some out
        held[:] = True
        seen = held
    else:
        seen = ~held
    spread = lambda p: [(r["label"], r["text_view"], r["meta_view"], r["view"]) for r in p]
    pseudo_rows: list = []
    model = None
    for turn in range(rounds + 1):
        beta = []
        for view, x, dim, name in ((0, t, TEXT_DIM, 1), (1, m, META_DIM, 2)):
            other = [r for r in spread(pseudo_rows) if r[3] != view]  # labelled by the other view
            px = _matrix([r[name] for r in other], dim) if other else x[:0]
            py = np.array([r[0] for r in other], np.float64)
            # a class's pseudo-labels together weigh half as much as its labels
            pw = np.array([0.5 * weight[seen][y[seen] == v].sum() / max(1, (py == v).sum()) for v in py])
            beta.append(fit(np.r_[x[seen], px], np.r_[y[seen], py], np.r_[weight[seen], pw]))
        curve = [fit(logit(x, b)[held][:, None], y[held], weight[held], ridge=1e-3) for x, b in ((t, beta[0]), (m, beta[1]))]
        model = Model(beta[0], beta[1], curve[0], curve[1], None)
        zt, zm = model.views(t[held], m[held])
        model.both = fit(np.c_[zt, zm], y[held], weight[held], ridge=1e-2)
        if turn < rounds:
            pseudo_rows = _confident(table_, model, known.select("doc_id"), pseudo)
    return table_, model


def score(table_: DataFrame, model: Model | float) -> DataFrame:
    """``(doc_id, p_text, p_meta, score)`` of every row of a feature table."""
    if not isinstance(model, Model):
        return table_.select("doc_id", *(F.lit(float(model)).alias(c) for c in ("p_text", "p_meta", "score")))
    kind = table_.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = model.probability(_matrix(batch.column("text_view"), TEXT_DIM), _matrix(batch.column("meta_view"), META_DIM)) \
                if batch.num_rows else (np.zeros(0),) * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.float64()) for x in out)], ["doc_id", "p_text", "p_meta", "score"])
    return table_.select("doc_id", "text_view", "meta_view").mapInArrow(run, f"doc_id {kind}, p_text double, p_meta double, score double")


def query(spark, sf_dir: str) -> DataFrame:
    """``op3_quality``: every document's probability of good quality; ``keep`` at one half."""
    out = score(*train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return out.select("doc_id", "p_text", "p_meta", "score", (F.col("score") >= 0.5).alias("keep"))
