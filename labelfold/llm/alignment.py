"""Cross-tokenizer alignment by an associative fragment monoid (operator 12).

Tokenizer A is a byte-level BPE over space + text, B a SentencePiece model over the text
(it adds that space).  Token bytes are laid over the bytes of space + text; where a token of
A and a token of B both end, the tokens before form a closed group.

A byte range of a text gives a ``Fragment``: an open prefix (tokens up to the first common
end), closed groups, and an open suffix (tokens after the last common end).  ``compose`` joins
neighbouring fragments: the left one's suffix and the right one's prefix make a group.  It is
associative with ``EMPTY`` as its identity, so fragments may be reduced in any tree.  A text
of up to ``CHUNK`` characters is one fragment.  A longer one is cut into byte ranges that
different Spark tasks tokenise (``chunks``); groups of ``FAN`` neighbours are then composed,
round by round, until one fragment is left.

A range's tokens are those that end in it.  To get exactly the tokens of the whole text, a
task tokenises from the last safe cut before its range to the first one after it.  A safe cut is a
single space between two other characters that are no white space: A's pattern always starts
a word there, and no piece of B holds a space after another character (``can_cut`` looks).
Ranges between which there is no safe cut are one range.

A link is a pair of occurrences that end together.  Counts of (A id, B id) are summed over the
corpus; the counts come back to the documents by a broadcast join up to ``BROADCAST_PAIRS``
distinct pairs, and by a shuffled join beyond.

Cases: null and empty texts, and texts whose joined token bytes differ from space + text in A
or B, have no tokens (zeros, empty groups); null and repeated doc_ids are kept row by row; ties
for the highest count all count as best; an empty table gives an empty result; only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written
from .tokens import ByteIds, pieces, public_path, text_runs, token_bytes

CHUNK = 1 << 16
FAN = 16
CHUNKS_A_TASK = 64
BROADCAST_PAIRS = 1_000_000

LINKS = "array<struct<pair:long,n:long>>"
_LINKS = pa.list_(pa.struct([("pair", pa.int64()), ("n", pa.int64())]))
_PART = "cuts long, head_a array<int>, head_b array<int>, closed string, tail_a array<int>, tail_b array<int>"


class Fragment(NamedTuple):
    """Tokens of a byte range; without a common end all of them are in the prefix."""

    cuts: int
    head_a: list[int]
    head_b: list[int]
    closed: str
    tail_a: list[int]
    tail_b: list[int]


EMPTY = Fragment(0, [], [], "", [], [])


def group_text(a: list[int], b: list[int]) -> str:
    return ",".join(map(str, a)) + "|" + ",".join(map(str, b))


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring byte ranges."""
    if not x.cuts:
        return y._replace(head_a=x.head_a + y.head_a, head_b=x.head_b + y.head_b)
    if not y.cuts:
        return x._replace(tail_a=x.tail_a + y.head_a, tail_b=x.tail_b + y.head_b)
    middle = group_text(x.tail_a + y.head_a, x.tail_b + y.head_b)
    closed = ";".join(filter(None, (x.closed, middle, y.closed)))
    return Fragment(x.cuts + y.cuts, x.head_a, x.head_b, closed, y.tail_a, y.tail_b)


def groups_of(whole: Fragment) -> str:
    """All groups of a whole text: its fragment's prefix is the first group, and its suffix is empty."""
    return ";".join(filter(None, (group_text(whole.head_a, whole.head_b), whole.closed))) if whole.cuts else ""


@lru_cache(maxsize=2)
def _byte_tables(path_a: str, path_b: str):
    """For A and B: bytes and byte length by id; and the texts of ids followed by each separator."""
    a = token_bytes(path_a)
    model = pieces(path_b)
    b = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        b.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    sizes = tuple(np.array([len(x) for x in side], np.int64) for side in (a, b))
    texts = {s: np.array([f"{i}{s}" for i in range(max(len(a), len(b)))], object) for s in ",|;"}
    return a, b, sizes[0], sizes[1], texts


@lru_cache(maxsize=2)
def can_cut(path_b: str) -> bool:
    """Whether no piece of B holds a space after another character."""
    model = pieces(path_b)
    return not any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))


def fragment(a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray, texts: dict) -> tuple[Fragment, np.ndarray]:
    """The fragment of tokens with their end offsets, and the link pairs (A id above B id)."""
    common = np.intersect1d(ends_a, ends_b)
    # pairs that end together: all occurrences on both sides
    lo_a, hi_a = np.searchsorted(ends_a, common, "left"), np.searchsorted(ends_a, common, "right")
    lo_b, hi_b = np.searchsorted(ends_b, common, "left"), np.searchsorted(ends_b, common, "right")
    if (hi_a - lo_a == 1).all() and (hi_b - lo_b == 1).all():
        pairs = a[lo_a] << 32 | b[lo_b]
    else:  # tokens without bytes end where the one before them does
        pairs = np.array([int(x) << 32 | int(y) for k in range(len(common)) for x in a[lo_a[k]:hi_a[k]] for y in b[lo_b[k]:hi_b[k]]], np.int64)
    if not len(common):
        return Fragment(0, a.tolist(), b.tolist(), "", [], []), pairs
    ha, hb, ta, tb = hi_a[0], hi_b[0], hi_a[-1], hi_b[-1]
    ca, cb = a[ha:ta], b[hb:tb]
    closed = ""
    if len(ca):
        mark_a, mark_b = np.zeros(len(ca), bool), np.zeros(len(cb), bool)
        mark_a[hi_a[1:] - ha - 1] = True
        mark_b[hi_b[1:] - hb - 1] = True
        # A's tokens of a group, then B's: sort by group, A first
        group = np.concatenate([(np.cumsum(mark_a) - mark_a) * 2, (np.cumsum(mark_b) - mark_b) * 2 + 1])
        words = np.concatenate([np.where(mark_a, texts["|"][ca], texts[","][ca]), np.where(mark_b, texts[";"][cb], texts[","][cb])])
        closed = "".join(words[np.argsort(group, kind="stable")].tolist())[:-1]
    return Fragment(len(common), a[:ha].tolist(), b[:hb].tolist(), closed, a[ta:].tolist(), b[tb:].tolist()), pairs


class Aligner:
    """Both tokenizers of one task."""

    def __init__(self, path_a: str, path_b: str):
        self.encode, self.model = ByteIds(path_a, True), pieces(path_b)
        self.bytes_a, self.bytes_b, self.sizes_a, self.sizes_b, self.texts = _byte_tables(path_a, path_b)

    def ranges(self, texts: list[str], low: list[int] | None = None, high: list[int] | None = None):
        """Yield ``(ok, n_a, n_b, fragment, pairs)`` of each text; ``low`` and ``high``: bytes of space + text whose ends count."""
        for k, (text, a, b) in enumerate(zip(texts, self.encode([" " + t for t in texts]), self.model.encode(texts, num_threads=1))):
            a, whole = a.astype(np.int64), b" " + text.encode()
            if b"".join([self.bytes_a[i] for i in a.tolist()]) != whole or b"".join([self.bytes_b[i] for i in b]) != whole:
                yield False, 0, 0, EMPTY, np.zeros(0, np.int64)
                continue
            b = np.array(b, np.int64)
            ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
            if low is not None:
                in_a, in_b = (ends_a > low[k]) & (ends_a <= high[k]), (ends_b > low[k]) & (ends_b <= high[k])
                a, ends_a, b, ends_b = a[in_a], ends_a[in_a], b[in_b], ends_b[in_b]
            yield True, len(a), len(b), *fragment(a, ends_a, b, ends_b, self.texts)


def chunks(text: str, size: int) -> list[tuple[str, int, int]]:
    """Byte ranges of space + text: the text to tokenise (its leading space left off), and the range within space + it."""
    whole = " " + text

    def safe(at: int) -> bool:
        return 0 < at < len(whole) - 1 and not whole[at - 1].isspace() and not whole[at + 1].isspace()

    def before(at: int, floor: int) -> int | None:
        while (at := whole.rfind(" ", floor, at + 1)) >= 0:
            if safe(at):
                return at
            at -= 1
        return None

    def after(at: int) -> int:
        at -= 1
        while (at := whole.find(" ", at + 1)) >= 0:
            if safe(at):
                return at
        return len(whole)

    lines, starts = [0], [0]  # ends of ranges that have a safe cut since the last one, and that cut
    for line in range(size, len(whole) - 1, size):
        cut = before(line, lines[-1] + 1)
        if cut is not None:
            lines.append(line)
            starts.append(cut)
    lines.append(len(whole))
    out = []
    for k, start in enumerate(starts):
        stop = len(whole) if lines[k + 1] == len(whole) else after(lines[k + 1])
        inside = lambda line: len(whole[start:line].encode())  # noqa: E731, B023
        out.append((whole[start + 1:stop], inside(lines[k]) if k else -1, inside(lines[k + 1])))
    return out


def _link_array(all_pairs: list[np.ndarray]) -> pa.Array:
    counted = [np.unique(p, return_counts=True) for p in all_pairs]
    offsets = np.concatenate([[0], np.cumsum([len(v) for v, _ in counted])]).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(np.concatenate([v for v, _ in counted])), pa.array(np.concatenate([n for _, n in counted]))],
                                        fields=list(_LINKS.value_type))
    return pa.ListArray.from_arrays(offsets, values)


def align_texts(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = True, size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Documents ``key, doc_id, n_a, n_b, n_groups, n_links, groups_sha256[, groups]`` and links ``key, links``, both written."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    kept = ["groups"] if with_groups else []
    row = f"key long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string" + "".join(f", {g} string" for g in kept)
    cuttable = can_cut(path_b)
    n_chars = F.coalesce(F.char_length("text"), F.lit(0))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, key = Aligner(path_a, path_b), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in text_runs(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                keys = np.arange(key, key + len(texts), dtype=np.int64)
                key += len(texts)
                found = [(0, 0, 0, 0, "", "", np.zeros(0, np.int64))] * len(texts)
                filled = [i for i, t in enumerate(texts) if t]
                for i, (ok, n_a, n_b, whole, pairs) in zip(filled, aligner.ranges([texts[i] for i in filled])):
                    if ok:
                        groups = groups_of(whole)
                        found[i] = (n_a, n_b, whole.cuts, len(pairs), hashlib.sha256(groups.encode()).hexdigest(), groups, pairs)
                n_a, n_b, n_groups, n_links, digest, groups, pairs = zip(*found)
                columns = [pa.array(keys), part.column("doc_id"), *(pa.array(c, pa.int64()) for c in (n_a, n_b, n_groups, n_links)),
                           pa.array(digest, pa.string()), *([pa.array(groups, pa.string())] if with_groups else []), _link_array(pairs)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *kept, "links"])

    is_long = (n_chars > size) & F.lit(cuttable)
    done = written(docs.where(~is_long).mapInArrow(short, f"{row}, links {LINKS}"), "alignment-texts")
    parts = _long_fragments(docs.where(is_long), kind, path_a, path_b, size)
    if parts is None:
        return done.drop("links"), done.select("key", "links")
    whole = _reduced(parts)
    long_rows = whole.mapInArrow(_finish(with_groups), row)
    return done.drop("links").unionByName(written(long_rows, "alignment-long")), done.select("key", "links").unionByName(parts.where("ok").select("key", "links"))


def _long_fragments(docs: DataFrame, kind: str, path_a: str, path_b: str, size: int) -> DataFrame | None:
    """One written row for each byte range of the long texts; none if there are no long texts."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = -1 - (TaskContext.get().partitionId() << 40)  # below the keys of the short texts
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                rows = chunks(text.as_py(), size)
                for at in range(0, len(rows), 64):
                    some = rows[at:at + 64]
                    words, low, high = zip(*some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(some)), pa.array([doc_id.as_py()] * len(some), doc_id.type), pa.array(range(at, at + len(some)), pa.int64()),
                         pa.array([len(rows)] * len(some), pa.int64()), pa.array(words), pa.array(low, pa.int64()), pa.array(high, pa.int64())],
                        ["key", "doc_id", "chunk", "n_chunks", "text", "low", "high"])
                key -= 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        for batch in batches:
            for part in text_runs(batch):
                ok, n_a, n_b, parts, pairs = zip(*aligner.ranges(*(part.column(c).to_pylist() for c in ("text", "low", "high"))))
                columns = [part.column("key"), part.column("doc_id"), part.column("chunk"), part.column("n_chunks"), pa.array(ok),
                           pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array([len(p) for p in pairs], pa.int64()), _link_array(pairs)]
                columns += [pa.array(c, t) for c, t in zip(zip(*parts), _PART_TYPES)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "chunk", "n_chunks", "ok", "n_a", "n_b", "n_links", "links", *Fragment._fields])

    cuts = written(docs.mapInArrow(cut, f"key long, doc_id {kind}, chunk long, n_chunks long, text string, low long, high long"), "alignment-chunks")
    n = cuts.count()
    if not n:
        return None
    dealt = cuts.repartition(-(-n // CHUNKS_A_TASK), "key", "chunk")  # the ranges of a text go to many tasks
    parts = dealt.mapInArrow(run, f"key long, doc_id {kind}, chunk long, n_chunks long, ok boolean, n_a long, n_b long, n_links long, links {LINKS}, {_PART}")
    parts = written(parts, "alignment-ranges")
    bad = parts.where("not ok").select("key").distinct()  # one bad range leaves its whole text without tokens
    return (parts.join(bad.withColumn("bad", F.lit(True)), "key", "left").withColumn("ok", F.col("bad").isNull()).drop("bad"))


_PART_TYPES = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]


def _reduced(parts: DataFrame) -> DataFrame:
    """Rounds of composing ``FAN`` neighbours, until each text is one fragment."""
    schema = parts.drop("links").schema
    most = parts.agg(F.max("n_chunks")).first()[0]
    now = parts.drop("links")
    names = schema.names

    def join(key, rows):
        rows = rows.sort_by("chunk").to_pylist()
        whole = EMPTY
        for r in rows:
            whole = compose(whole, Fragment(*(r[f] for f in Fragment._fields)))
        out = rows[0] | whole._asdict() | {k: sum(r[k] for r in rows) for k in ("n_a", "n_b", "n_links")} | {"chunk": key[1].as_py()}
        return pa.Table.from_pydict({k: pa.array([out[k]], kinds[k]) for k in names})

    from pyspark.sql.pandas.types import to_arrow_type
    kinds = {f.name: to_arrow_type(f.dataType) for f in schema.fields}
    while most > 1:
        # a group is at most FAN fragments of one text, never a whole text of any length before the last round
        now = now.groupBy("key", F.expr(f"chunk div {FAN}").alias("next")).applyInArrow(join, schema)
        now, most = written(now, "alignment-round"), -(-most // FAN)
    return now


def _finish(with_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                groups = groups_of(Fragment(*(r[f] for f in Fragment._fields))) if r["ok"] else ""
                digest = hashlib.sha256(groups.encode()).hexdigest() if r["ok"] else ""
                counts = (r["n_a"], r["n_b"], r["cuts"], r["n_links"]) if r["ok"] else (0, 0, 0, 0)
                out.append((r["key"], r["doc_id"], *counts, digest, groups))
            key, doc_id, n_a, n_b, n_groups, n_links, digest, groups = zip(*out) if out else [()] * 8
            columns = [pa.array(key, pa.int64()), pa.array(doc_id, batch.schema.field("doc_id").type), *(pa.array(c, pa.int64()) for c in (n_a, n_b, n_groups, n_links)),
                       pa.array(digest, pa.string()), *([pa.array(groups, pa.string())] if with_groups else [])]
            yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["groups"] if with_groups else [])])
    return run


def pair_counts(links: DataFrame) -> DataFrame:
    """``pair, count, best``: links of each (A id, B id) in the corpus, and whether no pair of its B id has more."""
    each = links.select(F.explode("links").alias("l")).groupBy(F.col("l.pair").alias("pair")).agg(F.sum("l.n").alias("count"))
    each = written(each, "alignment-pairs").withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    top = each.groupBy("b").agg(F.max("count").alias("top"))  # a row for each B id
    return each.join(top, "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = True, size: int = CHUNK) -> DataFrame:
    """Every document with its groups and the figures of its links."""
    found, links = align_texts(docs, path_a, path_b, with_groups, size)
    counts = written(pair_counts(links), "alignment-counts")
    if counts.count() <= BROADCAST_PAIRS:
        counts = F.broadcast(counts)
    each = links.select("key", F.explode("links").alias("l")).select("key", "l.pair", "l.n").join(counts, "pair")
    sums = each.groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"]
    return found.join(sums, "key", "left").select(*columns, *(["groups"] if with_groups else []))


def query(spark, sf_dir: str) -> DataFrame:
    """``op12_alignment``: groups and links of every document under the two public tokenizers."""
    return align(table(spark, sf_dir, "documents").select("doc_id", "text"), public_path("byte_bpe_50k.json"),
                 public_path("piece_bpe_32k.model"), with_groups=False)
