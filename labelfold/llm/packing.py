"""Mixture-controlled packing by deficit round-robin over source queues (operator 11).

Every source is a queue of its documents' token ids (each document ends with ``END``).
A round gives each source a credit of its target share of one window and serves it,
in the order of the queues, as many quanta of ``QUANTUM`` tokens as its credit holds;
what is left is its deficit, carried into the next round, the next window and the next
partition.  A queue that has run out takes no part any more, so all windows are full to
the end; what remains after the last full window is cut into sequences of powers of two,
which need no padding.

No task walks through the rounds: after r rounds a source with credit c has been served
``min(tokens, QUANTUM * floor(r * c / QUANTUM))``, so the place of any quantum is a sum over
the sources.  Spark gives each document its place in its queue: a task notes the tokens of
the source before it in the same task, and the tasks' totals by source are summed in order.
Texts are tokenised once, into a written table; the token ids are not shuffled unless there
are more than ``BROADCAST_ROWS`` (task, source) pairs.

The ``MAX_QUEUES - 1`` largest sources have queues of their own; further ones share the last
queue with the sum of their shares.  Within a queue documents follow the scan, so another
cutting of the input files gives another, equally valid packing.

Cases: a null or empty text is ``END`` alone; a null source is a source; null and repeated
doc_ids are packed row by row; an empty table gives an empty result; of other columns only
``doc_id``, ``text`` and ``source`` are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written
from .tokens import ByteIds, public_path, text_runs

WINDOW = 2048
QUANTUM = 256
END = 1
MAX_QUEUES = 1024
#: (task, source) totals that one broadcast may hold (about 40 MB).
BROADCAST_ROWS = 1_000_000


def tokenised(docs: DataFrame, path: str, plain: bool = False) -> DataFrame:
    """``doc_id, source, ids, n, part, before``: token ids with ``END``, and the source's tokens before it in its task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = ByteIds(path, plain), TaskContext.get().partitionId(), {}
        for batch in batches:
            for piece in text_runs(batch):
                ids = encode([t or "" for t in piece.column("text").to_pylist()])
                sizes = np.array([len(x) + 1 for x in ids], np.int64)
                flat = np.full(sizes.sum(), END, np.int32)
                at = np.cumsum(sizes) - sizes
                for k, x in zip(at.tolist(), ids):
                    flat[k:k + len(x)] = x
                before = []
                for source, n in zip(piece.column("source").to_pylist(), sizes.tolist()):
                    before.append(seen.get(source, 0))
                    seen[source] = before[-1] + n
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("source"), pa.ListArray.from_arrays(offsets, flat), pa.array(sizes),
                     pa.array(np.full(len(sizes), part, np.int64)), pa.array(np.array(before, np.int64))],
                    ["doc_id", "source", "ids", "n", "part", "before"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    df = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text")
    return df.mapInArrow(run, f"doc_id {kind}, source string, ids array<int>, n long, part long, before long")


class Rounds:
    """The closed form of the rounds: where each quantum of each queue stands among all tokens."""

    def __init__(self, totals: list[int], shares: list[float], window: int = WINDOW, quantum: int = QUANTUM):
        self.totals, self.quantum, self.window = np.array(totals, np.int64), quantum, window
        self.total = int(sum(totals))
        # credits are integers in units of 1 / scale token; products stay below 2^62
        self.scale = 1 << max(0, min(20, 61 - (self.total + quantum).bit_length()))
        self.cost = quantum * self.scale
        weight = np.array(shares, np.float64)
        weight = weight / weight.sum() if len(weight) and weight.sum() > 0 else np.ones(len(weight)) / max(1, len(weight))
        self.credit = np.maximum(1, np.round(weight * window * self.scale)).astype(np.int64)
        quanta = -(-self.totals // quantum)
        self.last = -(-(quanta * self.cost) // self.credit)  # the round that serves a queue's last quantum
        rest = self.total % window
        self.full = self.total - rest
        #: lengths of the sequences after the last full window
        self.ends = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        self.end_starts = self.full + np.concatenate([[0], np.cumsum(self.ends)]).astype(np.int64)

    def served(self, queue: int, rounds: np.ndarray) -> np.ndarray:
        """Tokens of a queue that the first ``rounds`` rounds have taken."""
        r = np.minimum(rounds, self.last[queue])
        return np.minimum(self.totals[queue], r * self.credit[queue] // self.cost * self.quantum)

    def places(self, queue: np.ndarray, quantum: np.ndarray) -> np.ndarray:
        """Position among all tokens of the first token of each (queue, quantum number)."""
        rounds = -(-((quantum + 1) * self.cost) // self.credit[queue])
        out = quantum * self.quantum
        for other in range(len(self.totals)):
            n = self.served(other, rounds - (other > queue))  # queues after it wait for the round's turn
            out = out + np.where(queue == other, 0, n)
        return out

    def pieces(self, queue: np.ndarray, place: np.ndarray, size: np.ndarray):
        """Documents at ``place`` of their queues cut into pieces: document number, start, length, sequence and offset."""
        first, last = place // self.quantum, (place + size - 1) // self.quantum
        count = last - first + 1
        doc = np.repeat(np.arange(len(place)), count)
        number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[doc]
        begin = np.maximum(place[doc], number * self.quantum)
        end = np.minimum(place[doc] + size[doc], (number + 1) * self.quantum)
        at = self.places(queue[doc], number) + begin - number * self.quantum
        length = end - begin
        # quanta of one document that follow each other are one piece
        fresh = np.ones(len(doc), bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + length[:-1])
        runs = np.flatnonzero(fresh)
        doc, start, at = doc[runs], (begin - place[doc])[runs], at[runs]
        length = np.add.reduceat(length, runs) if len(runs) else length
        # cut where sequences end
        low, high = self.sequence(at), self.sequence(at + length - 1)
        count = high - low + 1
        row = np.repeat(np.arange(len(doc)), count)
        sequence = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[row]
        head, tail = self.start_of(sequence), self.start_of(sequence + 1)
        begin, end = np.maximum(at[row], head), np.minimum(at[row] + length[row], tail)
        return doc[row], start[row] + begin - at[row], end - begin, sequence, begin - head

    def sequence(self, at: np.ndarray) -> np.ndarray:
        late = self.full // self.window + np.searchsorted(self.end_starts, at, "right") - 1
        return np.where(at < self.full, at // self.window, late)

    def start_of(self, sequence: np.ndarray) -> np.ndarray:
        late = np.clip(sequence - self.full // self.window, 0, len(self.end_starts) - 1)
        return np.where(sequence * self.window <= self.full, sequence * self.window, self.end_starts[late])


def queues(parts: DataFrame, shares: dict | None) -> tuple[list[int], list[float], dict]:
    """Tokens and target shares of the queues, and the queue of each source that has one of its own."""
    by_source = parts.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    own = by_source.orderBy(F.desc("tokens"), F.asc_nulls_first("source")).limit(MAX_QUEUES - 1).collect()
    total = by_source.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    names = {r["source"]: i for i, r in enumerate(own)}
    totals = [r["tokens"] for r in own]
    rest = total - sum(totals)
    weights = [float(t) if shares is None else float(shares.get(n, 0)) for n, t in zip(names, totals)]
    if rest:
        totals.append(rest)
        weights.append(float(rest) if shares is None else float(sum(w for n, w in shares.items() if n not in names)))
    return totals, weights, names


def pack(docs: DataFrame, path: str, shares: dict | None = None, window: int = WINDOW, quantum: int = QUANTUM,
         plain: bool = False, with_ids: bool = True) -> DataFrame:
    """Pieces of ``docs(doc_id, source, text)``: where each run of token ids stands in which sequence.

    ``shares`` gives target weights by source (default: the sources' shares of all tokens).
    Columns: doc_id, source, start, length, doc_tokens, sequence_id, offset, ids_crc32 and,
    unless switched off, ids.  ``quantum`` must divide ``window``.
    """
    if window % quantum:
        raise ValueError(f"a quantum of {quantum} tokens does not divide a window of {window}")
    held = written(tokenised(docs, path, plain), "packing-ids")
    parts = written(held.groupBy("part", "source").agg(F.sum("n").alias("tokens")), "packing-parts")
    totals, weights, names = queues(parts, shares)
    schedule = Rounds(totals, weights, window, quantum)
    rest = len(names)  # the shared queue, if there is one
    spark = docs.sparkSession
    numbers = spark.createDataFrame([(n, i) for n, i in names.items()], "name string, queue int")  # MAX_QUEUES rows at most
    parts = (parts.join(F.broadcast(numbers), F.col("source").eqNullSafe(F.col("name")), "left")
             .select("part", F.col("source").alias("of"), "tokens", F.coalesce("queue", F.lit(rest)).alias("queue")))
    # the shared queue takes a task's sources one after the other
    order = Window.partitionBy("queue").orderBy("part", F.asc_nulls_first("of"))
    starts = parts.select("part", "of", "queue", (F.sum("tokens").over(order) - F.col("tokens")).alias("offset_of_part"))
    starts = written(starts.withColumnRenamed("part", "of_part"), "packing-starts")
    if starts.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    placed = held.join(starts, (F.col("part") == F.col("of_part")) & F.col("source").eqNullSafe(F.col("of")))
    placed = placed.select("doc_id", "source", "ids", "n", "queue", (F.col("before") + F.col("offset_of_part")).alias("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                queue, place, n = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("queue", "place", "n"))
                doc, start, length, sequence, offset = schedule.pieces(queue, place, n)
                flat = part.column("ids").flatten().to_numpy(zero_copy_only=False).astype("<i4", copy=False)
                cuts = np.concatenate([[0], np.cumsum(length)])  # pieces follow their documents, gapless
                crc = np.array([zlib.crc32(flat[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())], np.int64)
                rows = pa.array(doc)
                columns = [part.column("doc_id").take(rows), part.column("source").take(rows), pa.array(start), pa.array(length),
                           part.column("n").take(rows), pa.array(sequence), pa.array(offset), pa.array(crc)]
                names = ["doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(cuts.astype(np.int32), np.ascontiguousarray(flat)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, source string, start long, length long, doc_tokens long, sequence_id long, offset long, "
              "ids_crc32 long" + (", ids array<int>" if with_ids else ""))
    return placed.mapInArrow(run, schema)


def sequences(pieces: DataFrame, window: int = WINDOW, pad: int = 0) -> DataFrame:
    """``sequence_id, ids, n_tokens``: the assembled sequences, padded to the window unless their length is a power of two."""
    run = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    out = pieces.groupBy("sequence_id").agg(F.flatten(F.transform(run, lambda x: x["ids"])).alias("ids"))  # a window at most
    n = F.size("ids")
    power = F.bit_count(n) == 1
    padded = F.when(power, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad), F.lit(window) - n)))
    return out.select("sequence_id", padded.alias("ids"), n.alias("n_tokens"))


def query(spark, sf_dir: str) -> DataFrame:
    """``op11_packing``: all documents in sequences of 2048 tokens, sources in the corpus's own proportions."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return pack(docs, public_path("byte_bpe_50k.json"), with_ids=False)
