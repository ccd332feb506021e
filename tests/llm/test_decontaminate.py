import random

import numpy as np

from labelfold.llm import decontaminate as d
from labelfold.llm.common import shingle_hashes, word_chunks

import pyarrow as pa
import pyarrow.compute as pc


def words(text):
    out = [h for _, _, h in word_chunks(pc.utf8_lower(pa.array([text], pa.string())), d._NORMAL)]
    return np.concatenate(out)


def brute(text, item):
    """Largest weighted similarity over all item-sized windows."""
    w, i = words(text), words(item)
    if not len(w) or not len(i):
        return 0.0
    b = shingle_hashes(i, d.SHINGLE)
    n = min(len(i), len(w))
    k = min(len(i), d.SHINGLE)
    if len(w) < k:
        return 0.0
    return max(d.weighted_similarity(shingle_hashes(w[a:a + n], k), b) for a in range(len(w) - n + 1))


def make(rng):
    vocabulary = [f"w{i}" for i in range(60)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 12, 30, 45]))) for _ in range(25)]
    docs = []
    for k in range(120):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(0, 200))]
        if k % 2:
            leak = rng.choice(items).split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                leak[rng.randrange(len(leak))] = "changed"
            at = rng.randint(0, len(body))
            body[at:at] = leak
        docs.append(" ".join(body))
    return items, docs


def test_equals_brute_force(spark):
    items, docs = make(random.Random(4))
    out = d.find(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"),
                 spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    hits = 0
    for r in out:
        expected = {i: s for i, x in enumerate(items) if (s := brute(docs[r.doc_id], x)) >= d.SIMILARITY}
        assert {f.item_id: round(f.similarity, 9) for f in r.found} == {i: round(s, 9) for i, s in expected.items()}
        hits += len(expected)
    assert hits > 40


def test_multi_index_holds_every_pair_within_the_radius():
    rng = np.random.default_rng(3)
    index = d.Index([0], [rng.integers(1, 1 << 60, 30).astype(np.uint64)])
    (n, (items, own, tables)), = index.groups.items()
    for distance in range(d.RADIUS + 1):
        flips = [rng.choice(64, distance, replace=False).astype(np.uint64) for _ in range(200)]
        prints = np.array([own[0] ^ np.bitwise_or.reduce(np.r_[np.uint64(0), np.uint64(1) << f]) for f in flips], np.uint64)
        assert len(index.candidates(n, prints)[0]) == 200


def test_long_text_and_odd_rows(spark):
    item = " ".join(f"item{i}" for i in range(40))
    rows = [(1, None, "mine"), (1, "", "mine"), (2, "?!", "x"), (None, "filler words here " * 60_000 + item.upper() + " more" * 10, "x"), (3, item, None), (3, item, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string")
    bench = spark.createDataFrame([(7, item), (7, item), (None, None), (8, "")], "item_id long, text string")
    out = d.find(docs, bench).collect()
    assert sorted(len(r.found) for r in out) == [0, 0, 0, 2, 2, 2]
    assert {f.item_id for r in out for f in r.found} == {7}
    assert all(len(r.found) == 0 for r in d.find(docs, bench.limit(0)).collect())
    assert d.find(docs.limit(0), bench).count() == 0


def test_parts_of_a_large_benchmark(spark, monkeypatch):
    items, docs = make(random.Random(5))
    left = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    right = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    key = lambda df: sorted((r.doc_id, sorted(f.item_id for f in r.found)) for r in df.collect())
    whole = key(d.find(left, right))
    monkeypatch.setattr(d, "MAX_ITEMS", 8)
    assert d._parts(right)[1] > 1 and key(d.find(left, right)) == whole


def test_ids_of_any_type_and_ties(spark):
    item = " ".join(f"w{i}" for i in range(30))
    for kind in ("smallint", "int", "bigint", "decimal(12,2)", "string", "date"):
        value = "'2024-01-01'" if kind == "date" else "'7'"
        items = spark.sql(f"select cast({value} as {kind}) as item_id, '{item}' as text union all select null, null")
        docs = spark.sql(f"select cast({value} as {kind}) as doc_id, 'so {item} it is {item}' as text")
        r = d.find(docs, items).first()
        assert [(f.item_id, round(f.similarity, 6), f.start_word) for f in r.found] == [(r.doc_id, 1.0, 1)]
