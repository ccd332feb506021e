"""Term counts kept in blocks, and the array work of the TF-IDF operators on them.

A term table with a row for each document and term costs a hash lookup a row in every step that reads it.  A block
holds the documents of one task and one group (``by…`` and the split) as arrays: their keys and labels, the terms
that occur in them, each once, and a code and a count for each document and term.  The terms of a block are cut by
their hash into *cells*, one for each of a fixed number of parts.  A step that needs a term's rows of
all blocks together (its document frequency, IDF or weights) meets the cells of a part in one task; what it finds goes back to the
block as arrays aligned with the cells.  So terms travel once a block, not once a document, and no row arises for a
document and a term.  Tables of terms (IDF, model) are arrays by part, too.

Bounds: a block holds the texts of one task of ``session.spread_groups``, a part about as many terms.  Of scores, a task holds a
block's terms with at most ``LABELS`` labels.

Cases: rows of the same group, label and key are one document; a NULL label is a label; a document without
terms has no codes; groups with a NULL in ``by`` meet no model, as in a join.

Columns of a block table: by…, ``block``, the key and the label (an array each), ``ends`` (of the documents among the codes), ``codes``,
``tfs`` and ``cells`` (part, start, term, df, tf).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Documents that are cut into terms at once, labels that a block is scored with at once, and products summed at once.
DOCUMENTS, LABELS, PRODUCTS = 1024, 256, 1 << 22

CELLS = "array<struct<part:int,start:int,term:array<string>,df:array<int>,tf:array<bigint>>>"


def _give_memory_back() -> None:
    """Let this process return freed memory to the system: Python workers live on from task to task."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL(None)
        for option, value in ((-3, 1 << 20), (-1, 4 << 20)):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD
            libc.mallopt(option, value)
    except (AttributeError, OSError):
        pass  # another C library: nothing to set


_give_memory_back()


def is_packed(df: DataFrame) -> bool:
    return "part" in df.columns or "cells" in df.columns


def _schema(df: DataFrame, names: Sequence[str], more: str) -> T.StructType:
    rest = T._parse_datatype_string(more)
    return T.StructType([T.StructField(c, df.schema[c].dataType) for c in names] + rest.fields)


def _element(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.elementType.simpleString()


def _one(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _table(schema: T.StructType, columns: Sequence) -> pa.Table:
    kinds = to_arrow_schema(schema)
    return pa.Table.from_arrays([_one(c).cast(f.type) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type)
                                 for c, f in zip(columns, kinds)], schema=kinds)


def _ids(column) -> tuple[np.ndarray, int]:
    """A number for each value, equal for equal ones and for NULLs, and how many there are."""
    d = _one(column).dictionary_encode(null_encoding="encode")
    return np.asarray(d.indices).astype(np.int64), max(1, len(d.dictionary))


def _groups(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """A number for each row's values of the columns, 0 without columns."""
    out = np.zeros(table.num_rows, np.int64)
    for c in names:
        ids, n = _ids(table[c])
        out = np.unique(out * n + ids, return_inverse=True)[1]
    return out


def _lists(ends: np.ndarray, values: pa.Array) -> pa.Array:
    """Lists that end at ``ends``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values)


def _sizes(column) -> np.ndarray:
    return np.asarray(pc.list_value_length(_one(column))).astype(np.int64)


def _flat(column) -> pa.Array:
    return _one(pc.list_flatten(_one(column)))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start, ``sizes`` of them."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else starts, sizes) + np.arange(sizes.sum())


def _small(a: np.ndarray) -> bytes:
    most = a.max(initial=0)
    return a.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32).tobytes()


def _numbers(column, n: int) -> np.ndarray:
    raw = column[0].as_buffer() if n else b""
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(raw) // n] if n else np.uint8)


def _ascending(doc: np.ndarray, code: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts, each document's by ascending code; the documents lie in ascending order."""
    n, m = int(code.max(initial=0)) + 1, int(tf.max(initial=0)) + 1
    pair = doc.astype(np.int64) * n + code
    if (int(doc.max(initial=0)) + 1) * n * m < 1 << 63:  # one number sorts faster than an order is found
        pair = np.sort(pair * m + tf)
        return pair // m % n, pair % m
    order = np.argsort(pair)
    return code[order], tf[order]


def _steps(codes: np.ndarray) -> bytes:
    """Differences of the codes, their low bytes first: small ones leave runs of zeros, which writers and shuffles compress."""
    steps = np.diff(codes.astype(np.uint32), prepend=np.uint32(0))
    return steps.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _codes(column, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint32)
    planes = np.frombuffer(column[0].as_buffer(), np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


# --- building blocks -------------------------------------------------------------------------

def _counts(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, code and count of each row's words (between spaces), and the words the codes stand for."""
    lists = pc.split_pattern(words, " ")
    d = lists.flatten().dictionary_encode()
    code, n = np.asarray(d.indices).astype(np.int64), max(1, len(d.dictionary))
    row = np.repeat(np.arange(len(lists)), _sizes(lists))
    empty = pc.index(d.dictionary, "").as_py()
    if empty >= 0:
        row, code = row[code != empty], code[code != empty]
    pairs, counts = np.unique(row * n + code, return_counts=True)
    return pairs // n, pairs % n, counts, d.dictionary


def _blocks(rows: pa.Table, scalars: Sequence[str], label: str, key: str, row: np.ndarray, code: np.ndarray, tf: np.ndarray,
            terms: pa.Array, parts: int, task: int) -> list:
    """The columns of the blocks of one task."""
    group = _groups(rows, scalars)
    same = _groups(rows, [*scalars, label, key])
    doc_first, doc = np.unique(same, return_index=True, return_inverse=True)[1:]
    order = np.argsort(group[doc_first], kind="stable")  # documents by group
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    doc = place[doc]
    if len(order) < len(doc):  # rows of one document: their counts are summed
        pair, inverse = np.unique(doc[row] * max(1, len(terms)) + code, return_inverse=True)
        tf = np.bincount(inverse, tf, len(pair)).astype(np.int32)
        doc, code = pair // max(1, len(terms)), pair % max(1, len(terms))
    else:  # a row's counts lie together, and move with it
        sizes = np.bincount(row, minlength=len(doc))
        ahead, back = np.cumsum(sizes) - sizes, np.argsort(doc)
        taken = _ranges(ahead[back], sizes[back])
        doc, code, tf = np.repeat(np.arange(len(doc)), sizes[back]), code[taken], tf[taken]
    doc_group = group[doc_first][order]
    first = np.flatnonzero(np.diff(doc_group, prepend=-1))
    last = np.append(first[1:], len(doc_group))
    ends = np.cumsum(np.bincount(doc, minlength=len(order)))
    part = (pd.util.hash_array(np.asarray(terms.to_numpy(zero_copy_only=False), object), categorize=False) % np.uint64(parts)).astype(np.int64)
    blobs, local_ends, cells, ids, dfs, totals, per_block = [], [], [], [], [], [], []
    for a, b in zip(first, last):
        lo, hi = (ends[a - 1] if a else 0), ends[b - 1]
        mine = code[lo:hi]
        found, local = np.unique(mine, return_inverse=True)
        by_part = np.argsort(part[found], kind="stable")
        rank = np.empty(len(found), np.int64)
        rank[by_part] = np.arange(len(found))
        local, found = rank[local], found[by_part]
        starts = np.flatnonzero(np.diff(part[found], prepend=-1))
        cells.append((part[found][starts], starts, np.diff(np.append(starts, len(found)))))
        per_block.append(len(starts))
        ids.append(found)
        dfs.append(np.bincount(local, minlength=len(found)))
        totals.append(np.bincount(local, tf[lo:hi], len(found)).astype(np.int64))
        local_ends.append(ends[a:b] - lo)
        local, counts = _ascending(doc[lo:hi] - a, local, tf[lo:hi])
        blobs.append((_steps(local), _small(counts)))
    numbers, starts, sizes = (np.concatenate(x) for x in zip(*cells))
    inner = np.cumsum(sizes)
    made = pa.StructArray.from_arrays([
        pa.array(numbers, pa.int32()), pa.array(starts, pa.int32()), _lists(inner, terms.take(pa.array(np.concatenate(ids)))),
        _lists(inner, pa.array(np.concatenate(dfs), pa.int32())), _lists(inner, pa.array(np.concatenate(totals), pa.int64()))],
        ["part", "start", "term", "df", "tf"])
    at = pa.array(doc_first[order])
    of_block = pa.array(doc_first[order][first])
    return [*[_one(rows[c]).take(of_block) for c in scalars], (np.int64(task) << 32) + np.arange(len(first)),
            _lists(last, _one(rows[key]).take(at)), _lists(last, _one(rows[label]).take(at)), _lists(last, pa.array(np.concatenate(local_ends), pa.int32())),
            [x for x, _ in blobs], [x for _, x in blobs], _lists(np.cumsum(per_block), made)]


def pack(df: DataFrame, key: str, words: str, scalars: Sequence[str], label: str, parts: int) -> DataFrame:
    """Blocks of ``df(scalars…, label, key, words)``; all rows of a key must lie in one partition (``session.spread_groups``)."""
    scalars = list(scalars)
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, label)}
    schema = _schema(df, scalars, f"block bigint, `{key}` array<{kinds[key]}>, `{label}` array<{kinds[label]}>, ends array<int>, codes binary, tfs binary, cells {CELLS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, found, terms, n_rows, n_terms = [], [], [], 0, 0
        for batch in batches:
            text = batch.column(len(scalars) + 2)
            for at in range(0, batch.num_rows, DOCUMENTS):
                row, code, tf, names = _counts(text.slice(at, DOCUMENTS))
                found.append(((row + n_rows + at).astype(np.int32), (code + n_terms).astype(np.int32), tf.astype(np.int32)))
                terms.append(names.cast(pa.string()))
                n_terms += len(names)
            rows.append(batch.select(range(len(scalars) + 2)))
            n_rows += batch.num_rows
        if n_rows:
            d = pa.concat_arrays(terms).dictionary_encode()
            row, code, tf = (np.concatenate(x) for x in zip(*found))
            del found, terms
            code = np.asarray(d.indices)[code]
            columns = _blocks(pa.Table.from_batches(rows), scalars, label, key, row, code, tf, d.dictionary, parts, TaskContext.get().partitionId())
            yield from _table(schema, columns).combine_chunks().to_batches()

    return df.select(*scalars, label, key, words).mapInArrow(run, schema)


# --- terms of a part --------------------------------------------------------------------------

def cells(blocks: DataFrame, *columns: str) -> DataFrame:
    """A row for each cell: ``columns`` of its block and those of the cell."""
    return blocks.select(*columns, F.explode("cells").alias("_c")).select(*columns, "_c.*")


def _keyed(by: list[str], *tables: pa.Table) -> list[np.ndarray]:
    """For each table a number for each of its listed terms, equal for equal terms of equal groups; -1 where ``by`` has a NULL."""
    names = pa.concat_tables([t.select(by) for t in tables]) if by else None
    group = _groups(names, by) if by else np.zeros(sum(t.num_rows for t in tables), np.int64)
    for c in by:
        group = np.where(np.asarray(pc.is_null(_one(names[c]))), -1, group)
    term, n = _ids(pa.concat_arrays([_flat(t["term"]).cast(pa.string()) for t in tables]))
    out, at, at_term = [], 0, 0
    for t in tables:
        sizes = _sizes(t["term"])
        g = np.repeat(group[at:at + t.num_rows], sizes)
        out.append(np.where(g < 0, -1, g * n + term[at_term:at_term + len(g)]))
        at, at_term = at + t.num_rows, at_term + len(g)
    return out


def _find(wanted: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted number stands among the held ones, each of which occurs once, and whether it does."""
    if not len(held):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    order = np.argsort(held)
    at = order[np.minimum(np.searchsorted(held, wanted, sorter=order), len(held) - 1)]
    return at, (held[at] == wanted) & (wanted >= 0)


def document_counts(blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by…, part, term, df, tf_total) with arrays: documents and occurrences of each term of a group."""
    by = list(by)
    schema = _schema(blocks, by, "part int, term array<string>, df array<bigint>, tf_total array<bigint>")

    def add(table: pa.Table) -> pa.Table:
        table = table.filter(pc.is_valid(table["part"]))
        for c in by:
            table = table.filter(pc.is_valid(table[c]))
        if not table.num_rows:
            return to_arrow_schema(schema).empty_table()
        first, inverse = np.unique(_keyed(by, table)[0], return_index=True, return_inverse=True)[1:]
        df, tf = (np.bincount(inverse, np.asarray(_flat(table[c])), len(first)).astype(np.int64) for c in ("df", "tf"))
        row = np.repeat(np.arange(table.num_rows), _sizes(table["term"]))[first]
        group = _groups(table, by)[row]
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        ends, at = np.append(starts[1:], len(group)), pa.array(row[starts])
        return _table(schema, [*[_one(table[c]).take(at) for c in by], _one(table["part"]).take(at),
                               _lists(ends, _flat(table["term"]).take(pa.array(first))), _lists(ends, pa.array(df)), _lists(ends, pa.array(tf))])

    return cells(blocks, *by).select(*by, "part", "term", "df", "tf").groupBy("part").applyInArrow(add, schema)


def squared_norms(blocks: DataFrame, idf: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """(by…, key, _square): what each block's documents add to the square of their tf·idf vector's length."""
    by = list(by)
    sent = T._parse_datatype_string("block bigint, start int, value array<double>")

    def look(asked: pa.Table, held: pa.Table) -> pa.Table:
        wanted, known = _keyed(by, asked, held)
        at, found = _find(wanted, known)
        value = np.zeros(len(wanted))
        value[found] = np.maximum(np.asarray(_flat(held["idf"]))[at[found]], 0)
        return _table(sent, [asked["block"], asked["start"], _lists(np.cumsum(_sizes(asked["term"])), pa.array(value))])

    schema = _schema(blocks, by, f"`{key}` {_element(blocks, key)}, _square double")

    def add(block: pa.Table, told: pa.Table) -> pa.Table:
        if not block.num_rows or not told.num_rows:
            return to_arrow_schema(schema).empty_table()
        value = np.asarray(_flat(told.sort_by("start")["value"]))
        ends = np.asarray(_flat(block["ends"])).astype(np.int64)
        w = _numbers(block["tfs"], ends[-1]) * value[_codes(block["codes"], ends[-1])]
        square = np.bincount(np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)), w * w, len(ends))
        some = np.flatnonzero(square)
        return _table(schema, [*[_one(block[c]).take(pa.array(np.zeros(len(some), np.int64))) for c in by],
                               _flat(block[key]).take(pa.array(some)), square[some]])

    told = (cells(blocks, *by, "block").select(*by, "block", "part", "start", "term").groupBy("part")
            .cogroup(idf.select(*by, "part", "term", "idf").groupBy("part")).applyInArrow(look, sent))
    return blocks.select(*by, "block", key, "ends", "codes", "tfs").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(add, schema)


def prototypes(blocks: DataFrame, idf: DataFrame, norms: DataFrame, key: str, label: str, by: Sequence[str]) -> DataFrame:
    """(by…, part, term, idf, label, of_label, of_term, weight, squares): the sums of unit vectors, arrays by part.

    ``weight`` belongs to the term ``of_term`` and the label ``of_label`` of the row; ``squares`` has each label's sum of squared weights.
    """
    by = list(by)
    kind = _element(blocks, label)
    places = blocks.select(*by, "block", F.posexplode(key).alias("pos", key)).join(norms, by + [key]).select(F.col("block").alias("of_block"), "pos", "norm")
    sent = _schema(blocks, by, f"part int, term array<string>, `{label}` array<{kind}>, of_label array<int>, of_term array<int>, share array<double>")

    def add(block: pa.Table, lengths: pa.Table) -> pa.Table:
        if not block.num_rows or not lengths.num_rows:
            return to_arrow_schema(sent).empty_table()
        ends = np.asarray(_flat(block["ends"])).astype(np.int64)
        of_length = np.full(len(ends), np.inf)
        of_length[np.asarray(_one(lengths["pos"]))] = np.asarray(_one(lengths["norm"]))
        d = _flat(block[label]).dictionary_encode(null_encoding="encode")
        names, doc = d.dictionary, np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        pair = _codes(block["codes"], ends[-1]).astype(np.int64) * len(names) + np.asarray(d.indices)[doc]
        share = _numbers(block["tfs"], ends[-1]) / of_length[doc]
        pair, inverse = np.unique(pair, return_inverse=True)
        share = np.bincount(inverse, share, len(pair))
        pair, share = pair[share > 0], share[share > 0]
        term = pair // len(names)
        cell = _one(pc.list_flatten(_one(block["cells"])))
        start, terms = np.asarray(cell.field("start")).astype(np.int64), cell.field("term")
        ends = np.append(np.searchsorted(term, start)[1:], len(term))
        n = len(cell)
        return _table(sent, [*[_one(block[c]).take(pa.array(np.zeros(n, np.int64))) for c in by], cell.field("part"), terms,
                             _lists(np.arange(1, n + 1) * len(names), pa.concat_arrays([names] * n)),
                             _lists(ends, pa.array(pair % len(names), pa.int32())),
                             _lists(ends, pa.array(term - np.repeat(start, np.diff(ends, prepend=0)), pa.int32())), _lists(ends, pa.array(share))])

    schema = _schema(blocks, by, f"part int, term array<string>, idf array<double>, `{label}` array<{kind}>, "
                                 "of_label array<int>, of_term array<int>, weight array<double>, squares array<double>")

    def gather(given: pa.Table, held: pa.Table) -> pa.Table:
        if not given.num_rows or not held.num_rows:
            return to_arrow_schema(schema).empty_table()
        wanted, known = _keyed(by, given, held)
        at, found = _find(wanted, known)
        row_of = np.repeat(np.arange(held.num_rows), _sizes(held["term"]))  # a row of ``held`` a group
        sizes = _sizes(given["of_term"])
        before = lambda c: np.repeat(np.cumsum(n := _sizes(given[c])) - n, sizes)
        entry = np.asarray(_flat(given["of_term"])) + before("term")
        name, names = _ids(_flat(given[label]))
        name = name[np.asarray(_flat(given["of_label"])) + before(label)]
        values = np.asarray(_flat(held["idf"]))
        keep = found[entry]
        keep[keep] = values[at[entry[keep]]] > 0
        term, name, share = at[entry[keep]], name[keep], np.asarray(_flat(given["share"]))[keep]
        pair, inverse = np.unique(term * names + name, return_inverse=True)  # by group, as the terms held are
        if not len(pair):
            return to_arrow_schema(schema).empty_table()
        term, name = pair // names, pair % names
        weight = np.bincount(inverse, share, len(pair)) * values[term]
        terms, of_term = np.unique(term, return_inverse=True)
        labels, of_label = np.unique(row_of[term] * names + name, return_inverse=True)
        squares = np.bincount(of_label, weight * weight, len(labels))
        rows = np.unique(row_of[term])
        ends_t, ends_l, ends_p = (np.searchsorted(x, rows, "right") for x in (row_of[terms], labels // names, row_of[term]))
        shift = lambda ends: np.repeat(np.append(0, ends[:-1]), np.diff(ends_p, prepend=0))
        d = _flat(given[label]).dictionary_encode(null_encoding="encode")
        return _table(schema, [*[_one(held[c]).take(pa.array(rows)) for c in by], _one(held["part"]).take(pa.array(rows)),
                               _lists(ends_t, _flat(held["term"]).take(pa.array(terms))), _lists(ends_t, pa.array(values[terms])),
                               _lists(ends_l, d.dictionary.take(pa.array(labels % names))), _lists(ends_p, pa.array(of_label - shift(ends_l), pa.int32())),
                               _lists(ends_p, pa.array(of_term - shift(ends_t), pa.int32())), _lists(ends_p, pa.array(weight)), _lists(ends_l, pa.array(squares))])

    shares = (blocks.select(*by, "block", label, "ends", "codes", "tfs", F.transform("cells", lambda c: c.dropFields("df", "tf")).alias("cells"))
              .groupBy("block").cogroup(places.groupBy("of_block")).applyInArrow(add, sent))
    return shares.groupBy("part").cogroup(idf.select(*by, "part", "term", "idf").groupBy("part")).applyInArrow(gather, schema)


def lengths(model: DataFrame, label: str, by: Sequence[str]) -> DataFrame:
    """(by…, label, _length) of a model of ``prototypes``."""
    x = model.select(*by, F.explode(F.arrays_zip(label, "squares")).alias("_s")).select(*by, F.col("_s")[label].alias(label), "_s.squares")
    return x.groupBy(*by, label).agg(F.sqrt(F.sum("squares")).alias("_length"))


def dots(blocks: DataFrame, model: DataFrame, key: str, label: str, by: Sequence[str]) -> DataFrame:
    """(by…, key, label, _dot): what each block's documents have in common with the labels of a model of ``prototypes``; only sums over 0."""
    by = list(by)
    kind, most = _element(model, label), PRODUCTS
    buckets = -(-(model.agg(F.max(F.size(label))).first()[0] or 1) // LABELS)
    sent = T._parse_datatype_string(f"block bigint, bucket int, `{label}` array<{kind}>, of_label array<int>, code array<int>, value array<double>")

    def look(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return to_arrow_schema(sent).empty_table()
        wanted, known = _keyed(by, asked, held)
        at, found = _find(wanted, known)
        sizes = _sizes(held["weight"])
        ahead = np.cumsum(n := _sizes(held["term"])) - n
        of_term = np.asarray(_flat(held["of_term"])) + np.repeat(ahead, sizes)  # ascending: a term's weights lie together
        value = np.asarray(_flat(held["weight"])) * np.asarray(_flat(held["idf"]))[of_term]
        from_, to = np.searchsorted(of_term, at[found]), np.searchsorted(of_term, at[found], "right")
        taken = _ranges(from_, to - from_)
        lens = _sizes(asked["term"])
        row = np.repeat(np.repeat(np.arange(asked.num_rows), lens)[found], to - from_)
        place = np.arange(len(wanted)) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(np.asarray(_one(asked["start"])), lens)
        code = np.repeat(place[found], to - from_)
        of_label = np.asarray(_flat(held["of_label"]))[taken]
        group = np.repeat(np.arange(held.num_rows), sizes)[taken]
        out = row * buckets + of_label % buckets
        if buckets > 1:
            order = np.argsort(out, kind="stable")
            out, taken, code, of_label, group = (x[order] for x in (out, taken, code, of_label, group))
        starts = np.flatnonzero(np.diff(out, prepend=-1))
        ends = np.append(starts[1:], len(out))
        return _table(sent, [_one(asked["block"]).take(pa.array(out[starts] // buckets)), out[starts] % buckets, _one(held[label]).take(pa.array(group[starts])),
                             _lists(ends, pa.array(of_label)), _lists(ends, pa.array(code, pa.int32())), _lists(ends, pa.array(value[taken]))])

    schema = _schema(blocks, by, f"`{key}` {_element(blocks, key)}, `{label}` {kind}, _dot double")

    def score(block: pa.Table, told: pa.Table) -> pa.Table:
        if not block.num_rows or not told.num_rows:
            return to_arrow_schema(schema).empty_table()
        d = _flat(told[label]).dictionary_encode(null_encoding="encode")
        sizes, lens = _sizes(told["code"]), _sizes(told[label])
        name = np.asarray(d.indices)[np.asarray(_flat(told["of_label"])) + np.repeat(np.cumsum(lens) - lens, sizes)]
        code, n = np.asarray(_flat(told["code"])).astype(np.int64), len(d.dictionary)
        order = np.argsort(code, kind="stable")
        code, name, value = code[order], name[order], np.asarray(_flat(told["value"]))[order]
        ends = np.asarray(_flat(block["ends"])).astype(np.int64)
        codes, tfs = _codes(block["codes"], ends[-1]), _numbers(block["tfs"], ends[-1])
        per_code = np.bincount(code, minlength=int(codes.max(initial=0)) + 1)
        ahead = np.cumsum(per_code) - per_code
        products = np.append(0, np.cumsum(per_code[codes]))[ends]  # of the documents up to each
        found, at = [], 0
        while at < len(ends):
            done, lo = (products[at - 1], ends[at - 1]) if at else (0, 0)
            to = max(at + 1, min(int(np.searchsorted(products, done + most, "right")), at + max(1, most // n)))
            c, hi = codes[lo:ends[to - 1]], ends[to - 1]
            some = per_code[c]
            taken = _ranges(ahead[c], some)
            doc = np.repeat(np.repeat(np.arange(to - at), np.diff(ends[at:to], prepend=lo)), some)
            dot = np.bincount(doc * n + name[taken], np.repeat(tfs[lo:hi], some) * value[taken], (to - at) * n)
            pair = np.flatnonzero(dot)
            found.append((pair // n + at, pair % n, dot[pair]))
            at = to
        doc, name, dot = (np.concatenate(x) for x in zip(*found))
        return _table(schema, [*[_one(block[c]).take(pa.array(np.zeros(len(doc), np.int64))) for c in by],
                               _flat(block[key]).take(pa.array(doc)), d.dictionary.take(pa.array(name)), dot])

    told = (cells(blocks, *by, "block").select(*by, "block", "part", "start", "term").groupBy("part")
            .cogroup(model.select(*by, "part", "term", "idf", label, "of_label", "of_term", "weight").groupBy("part")).applyInArrow(look, sent))
    scored = blocks.select(*by, "block", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), key, "ends", "codes", "tfs")
    return scored.groupBy("block", "bucket").cogroup(told.groupBy("block", "bucket")).applyInArrow(score, schema)
