import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from labelfold.llm import ngram_join as j


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(rows, size, num, den):
    """Smallest id reachable by links, over all pairs of distinct sets."""
    sets = defaultdict(list)
    for i, t in rows:
        if s := shingles(t, size):
            sets[s].append(i)
    keys = list(sets)
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k
    for a, b in combinations(keys, 2):
        if den * len(a & b) >= num * len(a | b):
            parent[find(a)] = find(b)
    least = defaultdict(list)
    for k in keys:
        least[find(k)] += sets[k]
    return [(i, len(s := shingles(t, size)), min(least[find(s)]) if s else i) for i, t in rows]


def near_copies(rng, n):
    """Bodies, exact and near copies in chains and stars, shared passages and frequent words."""
    vocabulary = [f"w{i}" for i in range(400)] + ["the"] * 200
    passage = [rng.choice(vocabulary) for _ in range(50)]
    bodies = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 8, 40, 120]))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bodies))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            at = rng.randrange(len(words))
            words[at:at + 1] = rng.choice([[], ["x"], [words[at], "y"]])
            words = words or ["z"]
        if rng.random() < 0.2:
            words += passage
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words).upper() if rng.random() < 0.1 else " ".join(words)))
    return rows


@pytest.mark.parametrize("size, num, den", [(3, 90, 100), (5, 80, 100)])
def test_equals_brute_force(spark, size, num, den):
    rows = near_copies(random.Random(size), 400) + [(1000, None), (1001, ""), (1002, " \t"), (1003, "one two"), (1004, "One  TWO")]
    random.Random(1).shuffle(rows)
    out = j.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), size, num, den).collect()
    assert sorted(map(tuple, out)) == sorted(brute(rows, size, num, den))


def test_any_order_of_shingles_gives_the_same(spark, monkeypatch):
    rows = near_copies(random.Random(9), 150)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(j, "frequency_sketch", lambda docs, size: np.random.default_rng(1).integers(0, 9, j.SKETCH).astype(np.uint8))
    assert sorted(map(tuple, j.jaccard_components(df, 3, 90, 100).collect())) == sorted(brute(rows, 3, 90, 100))


def test_equal_prefixes_collapse_into_groups(spark, monkeypatch):
    """Without rare shingles first, sets that differ behind their prefixes share prefix and size."""
    monkeypatch.setattr(j, "frequency_sketch", lambda docs, size: np.zeros(j.SKETCH, np.uint8))
    rng = random.Random(2)
    base = [f"b{i}" for i in range(300)]
    rows = [(i, " ".join(base[:rng.randrange(290, 300)] + [f"t{rng.randrange(3)}"])) for i in range(60)]
    rows += [(100 + i, " ".join(base) + f" end{i}") for i in range(40)]
    join = j.Join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100)
    assert join.members.count() > 0
    out = j.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()
    assert sorted(map(tuple, out)) == sorted(brute(rows, 3, 90, 100))


def test_star_of_near_copies_makes_few_pairs(spark):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 300):
        w = list(base)
        w[rng.randrange(150)] = f"m{i}"
        rows.append((i, " ".join(w)))
    join = j.Join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100)
    assert join.star_pairs().count() < 30 * len(rows)  # all pairs: 150 a row
    comp = join.run()
    assert comp.select("comp").distinct().count() == 1


def test_keep_one(spark):
    b = " ".join(f"w{i}" for i in range(16))
    rows = [(3, b, "n"), (1, b.upper(), None), (1, b.upper(), None), (1, "quite other text here", None), (None, b, "q"), (None, None, "e"),
            (5, "", None), (5, "", None), (6, None, "z"), (7, "short", None), (8, "short", None), (9, b + " more", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    out = sorted(map(str, (tuple(r) for r in j.keep_one(docs, 5, 80, 100).collect())))
    assert out == sorted(map(str, [(1, b.upper(), None), (1, "quite other text here", None), (None, None, "e"), (5, "", None), (5, "", None),
                                   (6, None, "z"), (7, "short", None)]))
    assert j.keep_one(docs.limit(0), 5, 80, 100).count() == 0


def test_long_text(spark):
    long = " ".join(f"w{i % 5000}x{i}" for i in range(300_000))
    rows = [(1, long), (2, long + " tail"), (3, "w " * 500_000)]
    out = {r.doc_id: r for r in j.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()}
    assert (out[2].component_id, out[3].component_id, out[1].n_shingles, out[3].n_shingles) == (1, 3, 299_998, 1)
