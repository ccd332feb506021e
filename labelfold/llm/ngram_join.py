"""N-gram Jaccard join by grouped prefixes (operator 1).

A document is the set of its distinct n-word shingles.  Two documents link when
``den * |A & B| >= num * |A | B|``.  Steps:

1. *Order.*  Shingles are ordered by a fixed-size frequency sketch of all shingles
   (``SKETCH`` counters, rarer classes first), then by hash.  Any total order
   gives the same result; a rare-first one keeps hot shingles out of prefixes.
2. *Prefix.*  Of a set of size s, the first ``s - ceil(s num / den) + 1`` shingles.
   Equal sets collapse into one representative, and representatives with equal
   prefix and size into one group.
3. *Star round.*  Within each shingle's list of groups, every group meets only the
   list's most central group (linear in the lists' length), and each group's
   members meet its first member.  Verified links give first components.
4. *Cross round.*  Lists whose groups aren't all in one component are joined again:
   groups outside the list's most frequent component meet all groups of the list.
   Pairs of one component are left out: they can change no component.
5. Group pairs that pass the size and position bounds are expanded to member pairs;
   a parity bitmap gives an exact lower bound of the difference; what is left is
   verified by exact set intersection.

So near copies cost time linear in their number, and no pair of different sets
that could join two components goes unverified.

Cases: null, empty and white-space texts have no shingle and link with nothing; a
text of fewer words is one shingle; rows are linked through their sets, so repeated
rows and ids need no care; a component is named by its smallest id (null only if
all of its ids are).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, rows_of, shingle_hashes, table, word_chunks, written

SKETCH = 1 << 24
PIECES = 64
BITMAP = 512
#: Order class from which a shingle's list may be long; lists of lower classes are no longer than about 2 ** (HOT / 2) mean counters.
HOT = 8


#: Pairs that one part of a hub verifies.
HUB_PAIRS = 2048
#: Places that sets are sent to, up to which one broadcast tells the scan (about 50 MB).
BROADCAST_PLACES = 1_000_000
SENDS = "array<struct<hub:long,part:long,is_hub:boolean>>"

#: Columns that tell sets apart: 128 bits and the size.
SET = ["d1", "d2", "n"]


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(40)).astype(np.int64) & (SKETCH - 1)


def doc_sets(column: pa.Array, size: int):
    """Yield ``(row, sorted distinct shingles)`` of every text."""
    for row, counts, words in word_chunks(column):
        at = 0
        for i, n in enumerate(counts):
            yield row + i, np.unique(shingle_hashes(words[at:at + n], size))
            at += n


def frequency_sketch(docs: DataFrame, size: int) -> np.ndarray:
    """Order class of each counter: the logarithm of how many documents' shingles fall into it.

    Every task adds up its counters and hands over ``PIECES`` compressed pieces;
    the pieces are summed by Spark into one byte per counter, a fixed size.  The
    classes are estimates: they order shingles, and any order gives the same links.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.uint8)  # up to 255 documents a task
        for batch in batches:
            for _, s in doc_sets(batch.column("text"), size):
                b = np.unique(_bucket(s))
                total[b] += total[b] < 255
        parts = [pa.compress(p, "zstd", asbytes=True) for p in np.split(total, PIECES)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(PIECES), pa.int32()), pa.array(parts, pa.binary())], ["piece", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, sums = SKETCH // PIECES, {}
        for batch in batches:
            for piece, raw in zip(batch.column("piece").to_pylist(), batch.column("counts")):
                sums.setdefault(piece, np.zeros(step, np.int64))[:] += np.frombuffer(pa.decompress(raw.as_buffer(), step, "zstd"), np.uint8)
        out = []
        for x in sums.values():
            # classes by powers of sqrt 2 above the load that hashing alone gives
            base = x.mean() + 4 * np.sqrt(x.mean()) + 1
            out.append(np.maximum(0, np.ceil(2 * np.log2(np.maximum(x, 1) / base))).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(out, pa.binary())], ["piece", "counts"])

    schema = "piece int, counts binary"
    rows = docs.select("text").mapInArrow(count, schema).repartition(PIECES, "piece").mapInArrow(add, schema).collect()  # of fixed size
    out = np.zeros(SKETCH, np.uint8)
    step = SKETCH // PIECES
    for r in rows:
        out[r["piece"] * step:(r["piece"] + 1) * step] = np.frombuffer(r["counts"], np.uint8)
    return out


def signatures(docs: DataFrame, classes: np.ndarray, size: int, num: int, den: int) -> DataFrame:
    """``(doc_id, n, d1, d2, cold, bitmap, prefix)`` of ``docs(doc_id, text)``; (d1, d2, n) tell sets apart, ``cold`` prefix shingles are below ``HOT``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, d1, d2, cold, bitmap, prefix = [], [], [], [], [], []
                for _, s in doc_sets(part.column("text"), size):
                    k = len(s)
                    take = k - -(-k * num // den) + 1 if k else 0
                    cls = classes[_bucket(s)]
                    order = np.argsort(cls, kind="stable")[:take]  # s is sorted by hash already
                    cold.append(int((cls[order] < HOT).sum()))
                    # a bit a shingle: far sets differ in about half of the bits, linked ones in fewer
                    width = max(BITMAP, 1 << (k - 1).bit_length() if k else 0)
                    places = ((s * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(24)) & np.uint64(width - 1)
                    bits = (np.bincount(places.astype(np.int64), minlength=width) & 1).astype(np.uint8)
                    n.append(k)
                    one, two = digest(s)
                    d1.append(one)
                    d2.append(two)
                    bitmap.append(np.packbits(bits).view(np.int64))
                    prefix.append(s[order].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(cold, pa.int32()),
                     pa.array(bitmap, pa.list_(pa.int64())), pa.array(prefix, pa.list_(pa.int64()))],
                    ["doc_id", "n", "d1", "d2", "cold", "bitmap", "prefix"])
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, d1 long, d2 long, cold int, bitmap array<long>, prefix array<long>")


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    if not len(s):
        return 0, 0
    other = np.bitwise_xor.reduce(s * s + (s >> np.uint64(7)) * np.uint64(0xD1B54A32D192ED03))
    return int(s.sum(dtype=np.uint64).astype(np.int64)), int(other.astype(np.int64))


def _sent_sets(docs: DataFrame, size: int) -> DataFrame:
    """``(hub, part, is_hub, node, shingles)``: the sets of ``docs(text, d1, d2, n, node, sends)`` for each place in ``sends``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [s for _, s in doc_sets(part.column("text"), size)]
                want = zip(*(part.column(c).to_pylist() for c in SET))
                # of rows that share an id, only those with the wanted set
                good = [i for i, (s, w) in enumerate(zip(sets, want)) if (*digest(s), len(s)) == w]
                take = pa.array(good, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("node").take(take), part.column("sends").take(take),
                                                  pa.array([sets[i].view(np.int64) for i in good], pa.list_(pa.int64()))], ["node", "sends", "shingles"])
    return (docs.select("text", *SET, "node", "sends").mapInArrow(run, f"node long, sends {SENDS}, shingles array<long>")
            .select("node", F.explode("sends").alias("to"), "shingles").select("to.*", "node", "shingles"))


def _enough(common: Column, n: Column, m: Column, num: int, den: int) -> Column:
    """den * common >= num * (n + m - common)"""
    return common * (den + num) >= (n + m) * num


def _folded(bitmap: str, words: Column) -> Column:
    """A parity bitmap folded to ``words`` (a power of two): parities of shingles by fewer bits of their hash."""
    b = F.col(bitmap)
    folds = F.transform(F.sequence(F.lit(0), words - 1), lambda i: F.aggregate(
        F.sequence(i, F.size(b) - 1, words), F.lit(0).cast("long"), lambda s, j: s.bitwiseXOR(F.get(b, j))))
    return F.when(F.size(b) == words, b).otherwise(folds)


class Join:
    """One similarity join; ``reps`` holds a row per distinct set (its node, a number, and its smallest doc_id)."""

    def __init__(self, docs: DataFrame, size: int, num: int, den: int):
        self.size, self.num, self.den = size, num, den
        self.docs = docs.select("doc_id", "text")
        classes = frequency_sketch(self.docs, size)
        self.signatures = written(signatures(self.docs, classes, size, num, den), "join-signatures")
        # numbers are small and shuffle well; they are written once, so they stay
        self.reps = written(self.signatures.where("n > 0").groupBy(*SET).agg(
            F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("cold", "bitmap", "prefix")])
            .withColumns({"p1": F.xxhash64("prefix", "n"), "node": F.monotonically_increasing_id()}), "join-reps")
        # groups of equal prefix and size: a row for each node of a group of several
        groups = self.reps.groupBy("n", "p1").agg(F.min("node").alias("gid"), F.count("*").alias("members")).where("members > 1")
        self.members = written(self.reps.select("node", "n", "p1").join(groups, ["n", "p1"]).select("node", "gid"), "join-members")
        heads = self.reps.join(self.members.where("node <> gid").select("node"), "node", "left_anti")
        lists = heads.select(F.col("node").alias("gid"), F.col("n").cast("int"), "cold", F.posexplode("prefix").alias("pos", "token"))
        lists = written(lists.select("gid", "n", "pos", "token", (F.col("pos") < F.col("cold")).alias("is_cold")), "join-lists")
        # short lists meet their pivots where one shuffle has dealt them; those that may be long are
        # combined before the shuffle, and joined so that a hot token can be split
        short, long_ = (lists.where(c).drop("is_cold") for c in ("is_cold", "not is_cold"))
        self.lists = written(self._shared(short.repartition("token")).unionByName(self._shared(long_)), "join-shared")

    @staticmethod
    def _shared(lists: DataFrame) -> DataFrame:
        """Lists of several groups, with the most central group of each."""
        shared = lists.groupBy("token").agg(F.count("*").alias("groups"), F.min(F.struct("pos", "gid", "n")).alias("pivot")).where("groups > 1")
        return lists.join(shared.select("token", "pivot"), "token")

    def _bounds(self, n: str, pos: str, m: str, other: str) -> Column:
        """Sizes and positions leave room for enough common shingles."""
        room = F.least(F.col(n) - F.col(pos), F.col(m) - F.col(other))
        return _enough(room.cast("long"), F.col(n), F.col(m), self.num, self.den)

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs of nodes ``(a, b)`` that link, by parity bitmaps and then exact intersection."""
        mine = lambda c: self.reps.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bitmap").alias(f"bits_{c}"))
        df = pairs.join(mine("a"), "a").join(mine("b"), "b")
        words = F.least(F.size("bits_a"), F.size("bits_b"))
        differ = F.aggregate(F.zip_with(_folded("bits_a", words), _folded("bits_b", words), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        # |A xor B| = n + m - 2 |A & B| is at least the number of differing parities
        df = df.where(_enough((F.col("n_a") + F.col("n_b") - differ) / 2, F.col("n_a"), F.col("n_b"), self.num, self.den))
        df = written(df.select("a", "b", "n_a", "n_b"), f"join-candidates-{name}")
        # each pair meets at its end with more pairs, the hub, a very large hub in parts; a set goes
        # straight from the scan of its text to where it is needed
        degree = df.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count()
        of = lambda c: degree.select(F.col("node").alias(c), F.col("count").alias(f"deg_{c}"))
        df = df.join(of("a"), "a").join(of("b"), "b")
        a_is_hub = F.col("deg_a") >= F.col("deg_b")
        parts = F.ceil(F.greatest("deg_a", "deg_b") / HUB_PAIRS)
        spokes = df.select(F.when(a_is_hub, F.col("b")).otherwise(F.col("a")).alias("node"), F.when(a_is_hub, F.col("a")).otherwise(F.col("b")).alias("hub"),
                           parts.alias("parts")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
        places = spokes.select("node", "hub", "part", F.lit(False).alias("is_hub")).unionByName(
            spokes.select(F.col("hub").alias("node"), "hub", "part", F.lit(True).alias("is_hub")).distinct())
        sends = places.groupBy("node").agg(F.collect_list(F.struct("hub", "part", "is_hub")).alias("sends"))
        sends = written(sends.join(self.reps.select("node", *SET, F.col("doc_id").alias("wanted_id")), "node"), f"join-sends-{name}")
        if sends.agg(F.coalesce(F.sum(F.size("sends") + 4), F.lit(0))).first()[0] <= BROADCAST_PLACES:
            sends = F.broadcast(sends)
        sets = _sent_sets(self.docs.join(sends, self.docs["doc_id"].eqNullSafe(sends["wanted_id"])), self.size)
        hubs = sets.where("is_hub").dropDuplicates(["hub", "part"]).select("hub", "part", F.col("shingles").alias("of_hub"))
        full = sets.where("not is_hub").join(hubs, ["hub", "part"])
        common = F.size(F.array_intersect("shingles", "of_hub")).cast("long")
        links = full.where(_enough(common, F.size("shingles").cast("long"), F.size("of_hub").cast("long"), self.num, self.den))
        return written(links.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), f"join-links-{name}")

    def _expand(self, pairs: DataFrame, both: bool) -> DataFrame:
        """Pairs of nodes of group pairs ``(g, h)``: all members with the other group's first, or with all if ``both``."""
        member = lambda g, name: self.members.select(F.col("gid").alias(g), F.col("node").alias(name))
        if both:
            out = pairs.join(member("g", "a"), "g", "left").join(member("h", "b"), "h", "left")
            out = out.select(F.coalesce("a", "g").alias("a"), F.coalesce("b", "h").alias("b"))
        else:
            two = pairs.union(pairs.select("h", "g"))
            out = two.join(member("g", "a"), "g", "left").select(F.coalesce("a", "g").alias("a"), F.col("h").alias("b"))
        return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()

    def star_pairs(self) -> DataFrame:
        """Every group with the most central group of each of its lists, and every member with its group's first."""
        near = (self.lists.where(self._bounds("n", "pos", "pivot.n", "pivot.pos") & (F.col("gid") != F.col("pivot.gid")))
                .select(F.least("gid", "pivot.gid").alias("g"), F.greatest("gid", "pivot.gid").alias("h")).distinct())
        inside = self.members.where("node <> gid").select(F.least("node", "gid").alias("a"), F.greatest("node", "gid").alias("b"))
        return self._expand(near, both=False).unionByName(inside).distinct()

    def cross_pairs(self, comp: DataFrame) -> DataFrame:
        """Pairs of nodes across the components ``comp(id, comp)`` that share a prefix shingle within the bounds."""
        groups = comp.join(self.members.select(F.col("node").alias("id"), "gid"), "id", "left")
        spans = groups.groupBy(F.coalesce("gid", "id").alias("gid")).agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"))
        lists = self.lists.drop("pivot").join(spans, "gid")
        mixed = lists.groupBy("token").agg(F.min("c1").alias("lo"), F.max("c2").alias("hi")).where("lo <> hi").select("token")
        lists = written(lists.join(mixed, "token"), "join-mixed")
        by_comp = lists.where("c1 = c2").groupBy("token", "c1").count()
        main = by_comp.groupBy("token").agg(F.max_by("c1", F.struct("count", "c1")).alias("main"))
        outside = lists.join(main, "token", "left").where("main is null or c1 <> main or c2 <> main")
        named = lambda df, g, k: df.select("token", F.col("gid").alias(g), *(F.col(c).alias(c + k) for c in ("n", "pos", "c1", "c2")))
        apart = (F.col("g") != F.col("h")) & ((F.col("c1x") != F.col("c2x")) | (F.col("c1y") != F.col("c2y")) | (F.col("c1x") != F.col("c1y")))
        met = named(outside, "g", "x").join(named(lists, "h", "y"), "token").where(apart & self._bounds("nx", "posx", "ny", "posy"))
        met = met.select(F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h"))
        own = spans.where("c1 <> c2").select(F.col("gid").alias("g"), F.col("gid").alias("h"))
        out = self._expand(met.unionByName(own).distinct(), both=True)
        side = lambda c: comp.select(F.col("id").alias(c), F.col("comp").alias(f"comp_{c}"))
        return out.join(side("a"), "a").join(side("b"), "b").where("comp_a <> comp_b").select("a", "b")

    def run(self) -> DataFrame:
        """``(id, comp)`` of every node."""
        nodes = self.reps.select(F.col("node").alias("id"))
        first = self.verified(self.star_pairs(), "star")
        comp = written(components(nodes, first), "join-comp")
        second = self.verified(self.cross_pairs(comp), "cross")
        return written(components(nodes, first.unionByName(second)), "join-result")


    def rows(self) -> DataFrame:
        """``(doc_id, node, n, comp, component_id)`` of every row; null ``comp`` where there is no shingle."""
        comp = self.run()
        ids = self.reps.select(F.col("node").alias("id"), "doc_id").join(comp, "id")
        least = ids.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
        named = ids.select(F.col("id").alias("node"), "comp").join(least, "comp")
        nodes = self.signatures.select("doc_id", *SET).join(self.reps.select(*SET, "node"), SET, "left")
        return (nodes.select("doc_id", "node", "n").join(named, "node", "left")
                .select("doc_id", "node", "n", "comp", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def jaccard_components(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row of ``docs(doc_id, text)``."""
    return Join(docs, size, num, den).rows().select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """``docs`` with one row of each component, of its smallest id; rows without shingles stay.

    The ids that go are few beside the texts and are dropped where the texts lie.  Rows whose id
    comes several times are matched by their sets; of such rows of one component the first by a
    hash of the text stays.
    """
    join = Join(docs, size, num, den)
    rows = written(join.rows(), "join-rows")
    stays = (F.col("n") == 0) | F.col("doc_id").eqNullSafe(F.col("component_id"))
    repeated = rows.groupBy("doc_id").count().where("count > 1").select("doc_id")
    once = rows_of(docs, rows.where(~stays).select("doc_id").unionByName(repeated), "doc_id", without=True)
    if repeated.isEmpty():
        return once
    kept = rows.where(stays & (F.col("n") > 0)).select("node", "comp").distinct()

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for _, s in doc_sets(batch.column("text"), size)]
            d = [digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in d], pa.int64()),
                                              pa.array([x for _, x in d], pa.int64())], ["row", "n", "d1", "d2"])

    some = rows_of(docs, repeated, "doc_id")
    kind = some.schema.simpleString()
    some = some.select(F.struct(*[F.col(f"`{c}`") for c in some.columns]).alias("row"), F.col("text")).mapInArrow(
        nodes, f"row {kind}, n long, d1 long, d2 long").join(join.reps.select(*SET, "node"), SET, "left")
    empty = some.where("n = 0").select("row")
    least = rows.select("comp", "component_id").where("comp is not null").distinct()
    named = some.where("n > 0").join(kept, "node").join(least, "comp").where(F.col("row.doc_id").eqNullSafe(F.col("component_id")))
    first = named.groupBy("comp").agg(F.min_by("row", F.xxhash64("row.text")).alias("row")).select("row")
    return once.unionByName(empty.unionByName(first).select("row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    """``op1_ngram_join``: components of Jaccard 0.9 on 3-word shingles."""
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 90, 100)
