"""Hierarchical Pitman-Yor language model (operator 7).

A token's context is the word before it; a text's first token has the end as its
context, so texts start in a restaurant of their own.  Every context word has its own
restaurant; all share one parent, the restaurant of single words, whose base measure
gives ``UNSEEN`` to the one unknown symbol and the rest evenly to the known words (a
new dish of the root is a new word).  Seating is sampled by Gibbs: every sweep seats
all customers of every pair anew, and those of the root, by drawing the number of tables
(``TableCounts``); predictive quantities are averaged over the sweeps after burn-in.

How the corpus is dealt out (all of it is used):

1. Every scan task cuts its texts into batches of about ``BATCH_BYTES``, counts
   the distinct (word, context) pairs of each and sends, per word part, one
   compact row: word hashes, contexts per word, context hashes, training counts.
   Frequent pairs are thus pre-aggregated.
2. A word part (words by hash, their number set by the corpus' size) merges its
   rows (``_merged``).  A context is a word, so its restaurant belongs to that word's part, its
   owner; a restaurant's pairs lie in the parts of their own words.  Once, the
   parts tell the owners which contexts they use (``_index``).
3. In a sweep, parts send their tables of each restaurant to the owners, owners send the sums
   back (``_summed``), and each part seats its dishes given them (``_swept``); one gamma variable a
   restaurant, drawn from the context's hash, serves all parts.  Only restaurants with pairs of several
   customers in several parts are told each time: a pair of one customer has one table.  The root's totals, the
   discounts and the number of known words are sums over all parts.
4. Each part answers each batch, in the order asked, with the count and tables of each pair, and for each word its count, its
   customers and tables in the root, and the tables of its restaurant; every batch's texts meet their answers and are scored.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased) and one end.  Words and contexts are told apart by
64-bit hashes.  Scores are log10.  Cases: null and empty texts are the end alone; repeated rows are scored
one by one; with no training text every token is unknown to both models; other
columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, mix, table, word_chunks, written

BATCH_BYTES = 12 << 20
PART_BYTES = 24 << 20
BURN_IN, SAMPLES = 8, 8
STRENGTH, ROOT_STRENGTH = 1.0, 10.0
UNSEEN = 0.5
END = np.uint64(0xE17A1465E17A1465)


def batches_of(batches: Iterator[pa.RecordBatch], task: int):
    """Runs of rows of at most ``BATCH_BYTES`` of text (or one longer text), with an id of the task and the run.

    A run ends before the row that does not fit, so runs depend on the rows' order alone, not on how they
    come in Arrow batches; they are the same whenever a task reruns.
    """
    held, size, turn = [], 0, 0
    for batch in batches:
        lengths = np.cumsum([0 if n is None else n for n in pc.binary_length(batch.column("text")).to_pylist()])
        at = 0
        while at < batch.num_rows:
            base = int(lengths[at - 1]) if at else 0
            stop = int(np.searchsorted(lengths, base + BATCH_BYTES - size, "right"))
            if stop <= at and held:
                yield f"{task}-{turn}", pa.Table.from_batches(held)
                held, size, turn = [], 0, turn + 1
                continue
            stop = max(at + 1, stop)
            held.append(batch.slice(at, stop - at))
            size += int(lengths[stop - 1]) - base
            at = stop
    if held:
        yield f"{task}-{turn}", pa.Table.from_batches(held)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts in order, each text closed by the end, and the number of tokens of each."""
    words, counts = [], []
    for _, n, hashes in word_chunks(column):
        ends = np.cumsum(n)
        out = np.insert(hashes, ends, END)
        words.append(out)
        counts.append(n + 1)
    return (np.concatenate(words) if words else np.zeros(0, np.uint64)), (np.concatenate(counts) if counts else np.zeros(0, np.int64))


def context_numbers(numbers: np.ndarray, counts: np.ndarray, start: int) -> np.ndarray:
    """Context of each token: the number of the word before it, ``start`` for the first of a text."""
    out = np.empty_like(numbers)
    out[1:] = numbers[:-1]
    out[(np.cumsum(counts) - counts)[counts > 0]] = start
    return out


def part_of(words: np.ndarray, parts: int) -> np.ndarray:
    return (mix(words) >> np.uint64(11)).astype(np.int64) % parts


def in_part_order(words: np.ndarray, parts: int):
    """Distinct words by part, then hash; their parts; the number of each given word among them."""
    distinct, number = np.unique(words, return_inverse=True)
    part = part_of(distinct, parts)
    order = np.argsort(part, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return distinct[order], part[order], rank[number]


def distinct_pairs(words: np.ndarray, counts: np.ndarray, parts: int):
    """Distinct words in part order, and distinct pairs in the order of their words.

    Returns ``(words, their parts, word number of each pair, word number of each pair's context, pair of each token)``.
    """
    distinct, part, number = in_part_order(words, parts)
    start = int(np.argmax(distinct == END)) if len(distinct) else 0  # every text has an end
    key, token_pair = np.unique(number * len(distinct) + context_numbers(number, counts, start), return_inverse=True)
    n = max(1, len(distinct))
    return distinct, part, key // n, key % n, token_pair


def _requests(docs: DataFrame, parts: int) -> DataFrame:
    """One row per batch and word part: its words, pairs per word, contexts, the pairs' places among these, and training counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        for batch_id, rows in batches_of(batches, TaskContext.get().partitionId()):
            words, counts = tokens(rows.column("text"))
            train = np.repeat(~rows.column("held_out").to_numpy().astype(bool), counts)
            distinct, part, word, context, pair = distinct_pairs(words, counts, parts)
            seen = np.bincount(pair[train], minlength=len(word))
            per_word = np.bincount(word, minlength=len(distinct)).astype(np.uint32)
            present = np.unique(part)
            cut_words = np.r_[np.searchsorted(part, present), len(part)]
            cut_pairs = np.searchsorted(word, cut_words)
            asked, place_of = np.zeros(len(distinct), bool), np.empty(len(distinct), np.uint32)
            out = {"part": [], "batch": [], "words": [], "per_word": [], "contexts": [], "places": [], "counts": []}
            for i, p in enumerate(present.tolist()):
                a, b, c, d = cut_words[i], cut_words[i + 1], cut_pairs[i], cut_pairs[i + 1]
                asked[context[c:d]] = True
                own = np.flatnonzero(asked)
                asked[own] = False
                place_of[own] = np.arange(len(own))
                out["part"].append(p)
                out["batch"].append(batch_id)
                out["words"].append(distinct[a:b].tobytes())
                out["per_word"].append(per_word[a:b].tobytes())
                out["contexts"].append(distinct[own].tobytes())
                out["places"].append(place_of[context[c:d]].astype(np.uint16 if len(own) <= 1 << 16 else np.uint32).tobytes())
                out["counts"].append(_pack(seen[c:d]))
            yield pa.RecordBatch.from_arrays([pa.array(out["part"], pa.int32()), pa.array(out["batch"], pa.string()),
                                              *(pa.array(out[k], pa.binary()) for k in list(out)[2:])], list(out))
    return docs.select("text", "held_out").mapInArrow(
        run, "part int, batch string, words binary, per_word binary, contexts binary, places binary, counts binary")


def _pack(n: np.ndarray) -> bytes:
    """Counts as bytes; larger ones follow as (position, count)."""
    big = np.flatnonzero(n >= 255)
    small = np.minimum(n, 255).astype(np.uint8)
    return np.uint32(len(big)).tobytes() + big.astype(np.uint32).tobytes() + n[big].astype(np.uint64).tobytes() + small.tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    k = int(np.frombuffer(raw, np.uint32, 1)[0])
    big, value = np.frombuffer(raw, np.uint32, k, 4), np.frombuffer(raw, np.uint64, k, 4 + 4 * k)
    out = np.frombuffer(raw, np.uint8, offset=4 + 12 * k).astype(np.int64)
    out[big] = value
    return out


def _pack_sorted(n: np.ndarray) -> bytes:
    return _pack(np.diff(n, prepend=0))


def _unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw))


def _flags(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _joined(arrays, kind=np.int64) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *arrays])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers (Stirling's series at ``x + 8``)."""
    y = x + 8.0
    out = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5)
    for k in range(8):
        out = out - np.log(x + k)
    return out


@lru_cache(maxsize=4)
def _stirling(discount: float) -> list[np.ndarray]:
    """Rows of the table of S as far as they are made; the Python worker keeps them from sweep to sweep."""
    return [np.zeros(0), np.zeros(1)]  # log S(c, 1..c), each less its largest


class TableCounts:
    """Draws of the number of tables of c customers of one dish, from ``P(t) ~ S(c, t) z^t``.

    S are the generalised Stirling numbers of the discount, so that every seating of all c
    customers has its weight.  Up to ``EXACT`` customers t is drawn from the table of S.
    Beyond, whole restaurants are seated anew in long runs of customers, and one of these ``PROPOSALS`` or the present t is taken by its weight, in which S cancels:
    a Markov chain that leaves the same distribution unchanged.
    """

    EXACT, PROPOSALS = 1024, 32

    def __init__(self, discount: float, rng: np.random.Generator):
        self.d, self.rng = discount, rng
        self.rows = _stirling(discount)

    def _row(self, c: int) -> np.ndarray:
        while len(self.rows) <= c:
            n, old = len(self.rows) - 1, self.rows[-1]
            row = np.logaddexp(np.r_[-np.inf, old], np.r_[old + np.log(n - self.d * np.arange(1, n + 1)), -np.inf])
            self.rows.append(row - row.max())
        return self.rows[c]

    def draw(self, count: np.ndarray, z: np.ndarray, now: np.ndarray) -> np.ndarray:
        """New numbers of tables of ``count`` (at least one) customers; ``now`` are the present ones."""
        out = np.ones(len(count), np.int64)
        log_z = np.log(np.maximum(z, 1e-300))
        order = np.argsort(np.minimum(count, self.EXACT + 1).astype(np.uint16), kind="stable")
        order = order[int((count < 2).sum()):]
        split = int((count[order] <= self.EXACT).sum())
        low, high = order[:split], order[split:]
        sizes, first = np.unique(count[low], return_index=True)
        for c, group in zip(sizes.tolist(), np.split(low, first[1:])):
            row, step = self._row(c), max(1, (1 << 16) // c)  # pairs at a time, for memory
            for at in range(0, len(group), step):
                some = group[at:at + step]
                weight = row[:, None] + log_z[some] * np.arange(c)[:, None]  # a column for each pair: most have few customers
                weight -= weight.max(0)
                total = np.cumsum(np.exp(weight), 0)
                out[some] = 1 + (total < self.rng.random(len(some)) * total[-1]).sum(0)
        for at in range(0, len(high), 4096):
            some = high[at:at + 4096]
            out[some] = self._draw_many(count[some], log_z[some], now[some])
        return out

    def _strength(self, count: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Strength of the proposed restaurants: weights are flat where they have most of their tables."""
        d, low = self.d, np.full(len(z), -self.d * (1 - 1e-9))
        high = np.maximum(low, z - d)
        for _ in range(40):
            mid = (low + high) / 2
            mean = (np.exp(log_gamma(mid + 1) - log_gamma(mid + d) + log_gamma(mid + d + count) - log_gamma(mid + count)) - mid) / d
            less = mean < (z - mid) / d
            low, high = np.where(less, mid, low), np.where(less, high, mid)
        return low

    def _seat(self, count: np.ndarray, strength: np.ndarray) -> np.ndarray:
        """Tables of ``count`` customers in empty restaurants.

        Customers come in runs.  The share of a run that sits at new tables is a beta variable, and
        these customers are seated like those of an empty restaurant of strength ``strength + d * t``.
        """
        d, seated = self.d, np.minimum(count, self.EXACT)
        t = self._seat_few(seated, strength)
        live = np.flatnonzero(seated < count)
        while len(live):
            own, old = strength[live] + d * t[live], seated[live] - d * t[live]
            run = np.minimum(count[live] - seated[live], np.maximum(1, self.EXACT / 2 * (own + old) / own)).astype(np.int64)
            new = self.rng.binomial(run, self.rng.beta(own, old))
            few = np.minimum(new, self.EXACT)
            more = self._seat_few(few, own)
            over = np.flatnonzero(new > self.EXACT)
            if len(over):
                more[over] = self._seat(new[over], own[over])
            t[live] += more
            seated[live] += run
            live = live[seated[live] < count[live]]
        return t

    def _seat_few(self, count: np.ndarray, strength: np.ndarray) -> np.ndarray:
        """The same for at most ``EXACT`` customers, from the table of S."""
        out = np.zeros(len(count), np.int64)
        some = np.flatnonzero(count)
        some = some[np.argsort(count[some], kind="stable")]
        for at in range(0, len(some), 64):
            part = some[at:at + 64]
            width = int(count[part[-1]])
            weight = np.full((len(part), width), -np.inf)
            for i, c in enumerate(count[part].tolist()):
                weight[i, :c] = self._row(c)
            weight[:, 1:] += np.cumsum(np.log(strength[part, None] + self.d * np.arange(1, width)), 1)
            total = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
            out[part] = 1 + (total < self.rng.random(len(part))[:, None] * total[:, -1:]).sum(1)
        return out

    def _draw_many(self, count: np.ndarray, log_z: np.ndarray, now: np.ndarray) -> np.ndarray:
        d, n, k = self.d, len(count), self.PROPOSALS
        strength = self._strength(count, np.exp(log_z))
        t = self._seat(np.repeat(count, k), np.repeat(strength, k))
        all_t = np.c_[t.reshape(n, k), now]
        x = strength[:, None] / d
        weight = (all_t - 1) * (log_z[:, None] - np.log(d)) - log_gamma(x + all_t) + log_gamma(x + 1)
        best = np.argmax(weight + self.rng.gumbel(size=weight.shape), 1)
        return all_t[np.arange(n), best]


class Shared(NamedTuple):
    """What a sweep needs of all parts: each restaurant's gamma variable, the root's customers and tables."""

    gamma: np.ndarray
    customers: float
    root_tables: float


def keyed_gamma(shape: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Gamma variables of ``shape`` (at least 1/3) that depend on shape and ``key`` alone (Marsaglia and Tsang's rejection)."""
    out, live, key = np.zeros(len(shape)), np.arange(len(shape)), key.copy()
    d = shape - 1 / 3
    while len(live):
        u = []
        for _ in range(3):
            key = mix(key + np.uint64(0x9E3779B97F4A7C15))
            u.append(((key >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53))
        x = np.sqrt(-2 * np.log(u[0])) * np.cos(2 * np.pi * u[1])
        v = (1 + x / np.sqrt(9 * d[live])) ** 3
        safe = np.maximum(v, 1e-300)
        taken = (v > 0) & (np.log(u[2]) < x * x / 2 + d[live] * (1 - safe + np.log(safe)))
        out[live[taken]] = d[live[taken]] * v[taken]
        live, key = live[~taken], key[~taken]
    return out


class Seating:
    """Numbers of tables of the pairs of one word part and of the words' dishes in the root.

    A sweep seats all customers anew.  Given the gamma variable of a restaurant and a draw of the
    root's measure, the pairs are independent; the sizes of tables are summed out.  ``alone`` are
    each word's pairs of one customer beside those given.
    """

    def __init__(self, word: np.ndarray, context: np.ndarray, count: np.ndarray, n_words: int, parts: int,
                 discount: float, root_discount: float, rng: np.random.Generator, alone: np.ndarray | int = 0):
        self.word, self.context, self.count, self.n_words, self.parts = word, context, count, n_words, parts
        self.d, self.d0, self.rng = discount, root_discount, rng
        self.many = np.flatnonzero(count > 1)
        c = count[self.many]
        self.tables = np.clip(np.round(c ** discount), 1, c).astype(np.int64)  # a first guess
        self.draws, self.root_draws = TableCounts(discount, rng), TableCounts(root_discount, rng)
        self.alone = np.bincount(word, count == 1, n_words) + alone
        self.root_tables = (self.totals()[1] > 0).astype(np.float64)

    @property
    def room(self) -> np.ndarray:
        """Number of tables of each pair of several customers."""
        return self.tables

    @property
    def first(self) -> np.ndarray:
        """Place of each such pair's first table in ``sizes``."""
        return np.cumsum(self.tables) - self.tables

    @property
    def sizes(self) -> np.ndarray:
        """Table sizes of one seating with these numbers of tables (none is kept)."""
        out = np.ones(int(self.tables.sum()), np.int64)
        out[self.first] += self.count[self.many] - self.tables
        return out

    def totals(self) -> tuple[np.ndarray, np.ndarray]:
        """Tables of each pair and root customers of each word."""
        t = (self.count > 0).astype(np.int64)
        t[self.many] = self.tables
        return t, (self.alone + np.bincount(self.word[self.many], self.tables, self.n_words)).astype(np.int64)

    def seat_root(self, customers: np.ndarray, known: int) -> None:
        """Seat the root's customers anew."""
        base = (1 - UNSEEN) / max(1, known)
        new = (ROOT_STRENGTH + self.d0 * self.shared.root_tables) * base
        some = np.flatnonzero(customers)
        self.root_tables = np.zeros(self.n_words)
        self.root_tables[some] = self.root_draws.draw(customers[some], np.full(len(some), new), np.ones(len(some), np.int64))

    def parent(self, customers: np.ndarray, known: int) -> np.ndarray:
        """A draw of each word's probability in the root."""
        base = (1 - UNSEEN) / max(1, known)
        own = self.rng.gamma(np.maximum(0, customers - self.d0 * self.root_tables))
        return (own + (ROOT_STRENGTH + self.d0 * self.shared.root_tables) * base) / (self.shared.customers + ROOT_STRENGTH)

    def sweep(self, known: int, shared: Shared | None = None) -> None:
        """Seat all customers of every pair anew, then those of the root; ``shared`` is needed if there are other parts."""
        t, customers = self.totals()
        if shared is None:
            if self.parts > 1:
                raise ValueError("the tables of the other parts are missing")
            gamma = self.rng.gamma(STRENGTH / self.d + np.bincount(self.context, t))
            shared = Shared(gamma, float(customers.sum()), float(self.root_tables.sum()))
        self.shared = shared
        if len(self.many):
            p = self.parent(customers, known)
            new = self.d * shared.gamma
            self.tables = self.draws.draw(self.count[self.many], new[self.context[self.many]] * p[self.word[self.many]], self.tables)
            customers = self.totals()[1]
        self.seat_root(customers, known)


def discount_of(ones: float, twos: float) -> float:
    """The usual estimate of a discount from the numbers of things seen once and twice."""
    return min(0.95, max(0.05, ones / max(1, ones + 2 * twos)))


def sample_part(word: np.ndarray, context: np.ndarray, count: np.ndarray, n_words: int, known: int, parts: int, seed: int):
    """Averages over sweeps of a corpus in one part: tables of each pair, root customers and root tables of each word; and the discounts."""
    rng = np.random.default_rng(seed)
    d = discount_of(int((count == 1).sum()), int((count == 2).sum()))
    first = np.bincount(word, count > 0, n_words)
    d0 = discount_of(int((first == 1).sum()), int((first == 2).sum()))
    seats = Seating(word, context, count, n_words, parts, d, d0, rng)
    tables, customers, root = np.zeros(len(word)), np.zeros(n_words), np.zeros(n_words)
    for turn in range(BURN_IN + SAMPLES):
        seats.sweep(known)
        if turn >= BURN_IN:
            t, c = seats.totals()
            tables += t
            customers += c
            root += seats.root_tables
    return tables / SAMPLES, customers / SAMPLES, root / SAMPLES, d, d0


#: Rows that parts send to each other: ``peer`` is the other side, ``batch`` that of a request, ``sums`` are for all.
COLUMNS = {"kind": "int", "part": "int", "peer": "int", "batch": "string", **dict.fromkeys("abcde", "binary"), "sums": "array<double>"}
ROWS = ", ".join(f"{c} {t}" for c, t in COLUMNS.items())
PAIRS, COUNTS, ASKED, WORDS, USES, INDEX, KNOWN, STATE, TABLES, REPLY, DONE = range(11)


def _row(kind: int, part: int, peer: int = -1, batch: str = "", sums=None, **data: bytes) -> list:
    return [kind, part, peer, batch, *(data.get(c) for c in "abcde"), sums]


def _frame(rows: list[list]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=list(COLUMNS))


def _of(frame: pd.DataFrame, kind: int) -> pd.DataFrame:
    return frame[frame["kind"] == kind].sort_values(["peer", "batch"], kind="stable")


def _merged(requests: DataFrame, parts: int) -> DataFrame:
    """Each part's pairs, what each batch asked, and for the owners the contexts that the part uses.

    ``sums`` are the numbers of pairs seen once and twice, of words with one and two contexts, of tokens and of known words.
    """
    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("batch", kind="stable")
        part = int(frame["part"].iloc[0])
        words = [np.frombuffer(x, np.uint64) for x in frame["words"]]
        distinct, number = np.unique(np.concatenate(words), return_inverse=True)
        per_word = [np.frombuffer(x, np.uint32) for x in frame["per_word"]]
        sizes = [int(x.sum()) for x in per_word]
        lists = [np.frombuffer(x, np.uint64) for x in frame["contexts"]]
        contexts, owner, place = in_part_order(np.concatenate(lists), parts)
        n, n_contexts, at = len(distinct), len(contexts), np.cumsum([0, *map(len, lists)])
        context = np.concatenate([place[at[i] + np.frombuffer(x, np.dtype(f"u{len(x) // max(1, size)}")).astype(np.int64)]
                                  for i, (x, size) in enumerate(zip(frame["places"], sizes))])
        del place, lists
        key, pair = np.unique(np.repeat(number, np.concatenate(per_word)) * n_contexts + context, return_inverse=True)
        count = np.bincount(pair, np.concatenate([_unpack(x) for x in frame["counts"]]), len(key)).astype(np.int64)
        word, context = key // n_contexts, key % n_contexts
        del key
        one, many = count == 1, count > 1
        alone = np.bincount(context[one], minlength=n_contexts)
        several = np.bincount(context[many], minlength=n_contexts) > 0
        first = np.bincount(word[count > 0], minlength=n)
        by_word = np.bincount(word, count, n).astype(np.int64)
        sums = [one.sum(), (count == 2).sum(), (first == 1).sum(), (first == 2).sum(), by_word.sum(), (by_word > 0).sum()]
        rows = [_row(WORDS, part, a=distinct.tobytes()), _row(COUNTS, part, a=_pack(count), b=_pack(by_word)),
                _row(PAIRS, part, sums=[float(x) for x in sums], a=_pack_sorted(word[many]), c=_pack(count[many]),
                     b=(np.cumsum(several) - 1)[context[many]].astype(np.uint32).tobytes(),
                     d=_pack(np.bincount(word[one], minlength=n)), e=contexts[several].tobytes())]
        used = np.flatnonzero(several | (alone > 0))
        owners, start = np.unique(owner[used], return_index=True)
        for q, mine in zip(owners.tolist(), np.split(used, start[1:])):
            rows.append(_row(USES, q, part, a=contexts[mine].tobytes(), b=_pack(alone[mine]), c=np.packbits(several[mine]).tobytes()))
        at_word, at_pair = np.cumsum([0, *map(len, words)]), np.cumsum([0, *sizes])
        for i, batch in enumerate(frame["batch"]):
            rows.append(_row(ASKED, part, batch=batch, a=_pack_sorted(number[at_word[i]:at_word[i + 1]]), b=_pack_sorted(pair[at_pair[i]:at_pair[i + 1]])))
        return _frame(rows)
    return requests.groupBy("part").applyInPandas(merge, ROWS)


def _index(merged: DataFrame) -> DataFrame:
    """Owners' lists: which of their words each part uses as contexts of pairs of several customers; and for the parts, what stays the same."""
    def index(frame: pd.DataFrame) -> pd.DataFrame:
        part = int(frame["part"].iloc[0])
        words = np.frombuffer(_of(frame, WORDS)["a"].iloc[0], np.uint64)
        uses = _of(frame, USES)
        lists = [np.searchsorted(words, np.frombuffer(x, np.uint64)) for x in uses["a"]]
        alone = np.bincount(_joined(lists), _joined(_unpack(x) for x in uses["b"]), len(words)).astype(np.int64)
        lists = [x[_flags(raw, len(x))] for x, raw in zip(lists, uses["c"])]
        numbers = _joined(lists)
        shared = np.bincount(numbers, minlength=len(words)) > 1
        rows = [_row(INDEX, part, a=numbers.astype(np.uint32).tobytes(), b=np.packbits(shared[numbers]).tobytes(), d=_pack(alone),
                     c=np.stack([uses["peer"].to_numpy(np.int64), np.array([len(x) for x in lists], np.int64)]).tobytes())]
        rows += [_row(KNOWN, p, part, a=_pack(alone[x]), b=np.packbits(shared[x]).tobytes()) for p, x in zip(uses["peer"], lists) if len(x)]
        return _frame(rows)
    return merged.where(F.col("kind").isin(WORDS, USES)).groupBy("part").applyInPandas(index, ROWS)


def _lists(row) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each part, the owner's words that it uses and whether others use them too."""
    numbers = np.frombuffer(row["a"], np.uint32).astype(np.int64)
    peers, sizes = np.frombuffer(row["c"], np.int64).reshape(2, -1)
    cut = np.cumsum(sizes)[:-1]
    return dict(zip(peers.tolist(), zip(np.split(numbers, cut), np.split(_flags(row["b"], len(numbers)), cut))))


def _summed(index: DataFrame, state: DataFrame) -> DataFrame:
    """Tables of the restaurants that several parts share: the parts' numbers, added by the owners and sent back."""
    def add(held: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
        if not len(held):
            return _frame([])
        row = held.iloc[0]
        lists = {p: x[shared] for p, (x, shared) in _lists(row).items()}
        total = np.zeros(1 + max((int(x.max()) for x in lists.values() if len(x)), default=0), np.int64)
        for p, raw in zip(came["peer"], came["a"]):
            total[lists[p]] += _unpack(raw)
        return _frame([_row(REPLY, p, int(row["part"]), a=_pack(total[x])) for p, x in lists.items() if len(x)])
    return index.groupBy("part").cogroup(state.where(F.col("kind") == TABLES).groupBy("part")).applyInPandas(add, ROWS)


def _swept(pairs: DataFrame, state: DataFrame, turn: int, parts: int, known: int, d: float, d0: float, totals: tuple) -> DataFrame:
    """State of every part after a sweep, and its tables for the owners; the first turn is -1 and only seats by a guess.

    ``sums`` are the root's customers and tables.
    """
    def sweep(held: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
        own, fixed = _of(held, PAIRS).iloc[0], _of(held, KNOWN)
        part, alone = int(own["part"]), _unpack(own["d"])
        word, count = _unpack_sorted(own["a"]), _unpack(own["c"])
        context, contexts = np.frombuffer(own["b"], np.uint32).astype(np.int64), np.frombuffer(own["e"], np.uint64)
        n, n_contexts = len(alone), len(contexts)
        elsewhere = [_unpack(x) for x in fixed["a"]]
        shared = _joined((_flags(raw, len(x)) for raw, x in zip(fixed["b"], elsewhere)), bool)
        seats = Seating(word, context, count, n, parts, d, d0, np.random.default_rng((part, turn + 1)), alone)
        sums = [np.zeros(len(word), np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)]
        if turn >= 0:
            before = _of(came, STATE).iloc[0]
            seats.tables, seats.root_tables = _unpack(before["a"]) + 1, _unpack(before["b"]).astype(np.float64)
            open_tables = np.bincount(context, seats.tables, n_contexts)
            open_tables[shared] = _joined(_unpack(x) for x in _of(came, REPLY)["a"])
            gamma = keyed_gamma(STRENGTH / d + open_tables + _joined(elsewhere), mix(contexts ^ mix(np.uint64([turn + 1]))))
            seats.sweep(known, Shared(gamma, *totals))
            if turn > BURN_IN:
                sums = [_unpack(before[c]) for c in "cde"]
        customers, root = seats.totals()[1], seats.root_tables.astype(np.int64)
        if turn >= BURN_IN:
            sums = [x + y for x, y in zip(sums, (seats.tables, customers, root))]
        told = {c: _pack(x) for c, x in zip("cde", sums)} if turn >= BURN_IN else {}
        rows = [_row(STATE, part, sums=[float(customers.sum()), float(root.sum())], a=_pack(seats.tables - 1), b=_pack(root), **told)]
        last = turn == BURN_IN + SAMPLES - 1
        tables = np.bincount(context, sums[0] if last else seats.tables, n_contexts).astype(np.int64)
        at = np.cumsum([len(x) for x in elsewhere])[:-1]
        for q, x, flag in zip(fixed["peer"], np.split(tables, at), np.split(shared, at)):
            if last:
                rows.append(_row(DONE, q, part, a=_pack(x)))
            elif flag.any():
                rows.append(_row(TABLES, q, part, a=_pack(x[flag])))
        return _frame(rows)
    return pairs.groupBy("part").cogroup(state.groupBy("part")).applyInPandas(sweep, ROWS)


class Sampled(NamedTuple):
    """The last state of all parts, with the tables of each restaurant; averages of the root's customers and tables; the discounts."""

    state: DataFrame
    customers: float
    root_tables: float
    d: float
    d0: float


def _sampled(merged: DataFrame, index: DataFrame, parts: int, known: int, d: float, d0: float) -> Sampled:
    # what stays the same lies on the executors by part: only tables travel in a sweep
    kept = [x.repartition(2 * parts, "part").persist(StorageLevel.DISK_ONLY) for x in (
        merged.where(F.col("kind") == PAIRS).unionByName(index.where(F.col("kind") == KNOWN)), index.where(F.col("kind") == INDEX))]
    try:
        state, totals, sums = merged.limit(0), (0.0, 0.0), np.zeros(2)
        for turn in range(-1, BURN_IN + SAMPLES):
            if turn >= 0:
                state = state.where(F.col("kind") == STATE).unionByName(_summed(kept[1], state))
            state = written(_swept(kept[0], state, turn, parts, known, d, d0, totals), "lm-state")
            totals = _sums(state, 2)
            if turn >= BURN_IN:
                sums += totals
    finally:
        for x in kept:
            x.unpersist()
    return Sampled(state, *(sums / SAMPLES).tolist(), d, d0)


def _sums(rows: DataFrame, n: int) -> tuple:
    return tuple(rows.agg(*[F.coalesce(F.sum(F.get("sums", F.lit(i))), F.lit(0.0)) for i in range(n)]).first())


def _answers(merged: DataFrame, index: DataFrame, state: DataFrame) -> DataFrame:
    """Per batch and part: counts of its pairs; sums over the samples of their tables beyond the first; count, root customers, root tables and restaurant's tables of its words."""
    def answer(held: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
        own, last, lists = _of(held, COUNTS).iloc[0], _of(came, STATE).iloc[0], _of(came, INDEX).iloc[0]
        count, part = _unpack(own["a"]), int(own["part"])
        more = np.zeros(len(count), np.int64)
        more[count > 1] = _unpack(last["c"]) - SAMPLES
        opened, used = _unpack(lists["d"]) * SAMPLES, _lists(lists)
        for p, raw in zip(*(_of(came, DONE)[c] for c in ("peer", "a"))):
            opened[used[p][0]] += _unpack(raw)
        of_word = np.stack([_unpack(own["b"]), _unpack(last["d"]), _unpack(last["e"]), opened])
        out = []
        for batch, words, pairs in zip(*(_of(held, ASKED)[c] for c in ("batch", "a", "b"))):
            pair = _unpack_sorted(pairs)
            out.append([part, batch, _pack(count[pair]), _pack(more[pair]), _pack(of_word[:, _unpack_sorted(words)].ravel())])
        return pd.DataFrame(out, columns=["part", "batch", "pairs", "tables", "words"])
    held = merged.where(F.col("kind").isin(COUNTS, ASKED)).groupBy("part")
    came = state.where(F.col("kind").isin(STATE, DONE)).unionByName(index.where(F.col("kind") == INDEX)).groupBy("part")
    return held.cogroup(came).applyInPandas(answer, "part int, batch string, pairs binary, tables binary, words binary")


def score(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row of ``docs(doc_id, text, held_out)``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "held_out")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(8, -(-size // PART_BYTES))
    merged = written(_merged(_requests(docs, parts), parts), "lm-merged")
    *seen, n_tokens, n_words = _sums(merged, 6)
    index = written(_index(merged), "lm-index")
    sampled = _sampled(merged, index, parts, int(n_words), discount_of(*seen[:2]), discount_of(*seen[2:]))
    _, all_customers, all_root_tables, d, d0 = sampled

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        for batch_id, rows in batches_of(batches, TaskContext.get().partitionId()):
            for part in rows.to_batches():
                yield pa.RecordBatch.from_arrays([pa.array([batch_id] * part.num_rows, pa.string()), *(part.column(c) for c in ("doc_id", "text", "held_out"))],
                                                 ["batch", "doc_id", "text", "held_out"])

    def judge(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        words, counts = tokens(pa.array(left["text"], pa.string()))
        distinct, _, word, context, pair = distinct_pairs(words, counts, parts)
        right = right.sort_values("part")
        count, more = (np.concatenate([_unpack(x) for x in right[c]]) for c in ("pairs", "tables"))
        c, customers, root, opened = np.concatenate([_unpack(x).reshape(4, -1) for x in right["words"]], 1)
        if len(count) != len(word) or len(c) != len(distinct):
            raise RuntimeError("a batch changed between two scans of its input")
        base = np.where(c > 0, (1 - UNSEEN) / max(1, n_words), UNSEEN)
        parent = (np.maximum(0, customers - d0 * root) / SAMPLES + (ROOT_STRENGTH + d0 * all_root_tables) * base) / (all_customers + ROOT_STRENGTH)
        seated = np.maximum(0, count - d * ((count > 0) + more / SAMPLES))
        # all customers of a restaurant are the tokens that follow its word, as many as the word itself
        p = (seated + (STRENGTH + d * opened[context] / SAMPLES) * parent[word]) / (STRENGTH + c[context])
        plain = np.log10((c + 0.5) / (n_tokens + 0.5 * (n_words + 1)))
        number = np.repeat(np.arange(len(counts)), counts)
        add = lambda x: np.bincount(number, x, len(counts))
        return pd.DataFrame({"doc_id": left["doc_id"], "held_out": left["held_out"], "n_tokens": counts, "n_known": add(c[word][pair] > 0).astype(np.int64),
                             "train_tokens": int(n_tokens), "base_score": add(plain[word][pair]), "score": add(np.log10(p)[pair])})

    left = docs.mapInArrow(texts, f"batch string, doc_id {kind}, text string, held_out boolean").groupBy("batch")
    right = _answers(merged, index, sampled.state).groupBy("batch")
    return left.cogroup(right).applyInPandas(
        judge, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark, sf_dir: str) -> DataFrame:
    """``op7_language_model``: every document, learnt from those outside fold 1 of 5."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold(F.col("doc_id"), 5) == 1).alias("held_out"))
    return score(docs)
