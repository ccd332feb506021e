import numpy as np
import pytest

from labelfold.llm import vector_dedup as v


def brute(rows, threshold):
    ok = []
    for i, e, label in rows:
        a = None if e is None or label is None or not len(e) or any(x is None for x in e) else np.array(e, float)
        ok.append(a if a is not None and np.isfinite(a).all() and np.abs(a).max() > 0 else None)
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k
    n = [0] * len(rows)
    for x in range(len(rows)):
        for y in range(x):
            if ok[x] is not None and ok[y] is not None and rows[x][2] == rows[y][2] and len(ok[x]) == len(ok[y]):
                if ok[x] @ ok[y] / np.sqrt((ok[x] @ ok[x]) * (ok[y] @ ok[y])) >= threshold:
                    n[x] += 1
                    n[y] += 1
                    parent[find(x)] = find(y)
    least = {}
    for k, r in enumerate(rows):
        least[find(k)] = min(least.get(find(k), r[0]), r[0])
    return sorted((r[0], n[k], least[find(k)], least[find(k)] == r[0]) for k, r in enumerate(rows))


def vectors(rng, n, dim):
    centres = rng.normal(size=(20, dim))
    rows = []
    for i in range(n):
        kind = rng.integers(0, 4)
        x = centres[rng.integers(0, 20)] * rng.uniform(0.1, 10)
        if kind:
            x = x + rng.normal(size=dim) * [0, 0.02, 0.1, 0.4][kind] * np.abs(x).mean()
        rows.append((i, [float(np.float32(a)) for a in x], int(rng.integers(0, 3))))
    return rows


KIND = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("threshold", [0.98, 0.9])
def test_equals_brute_force(spark, threshold):
    rows = vectors(np.random.default_rng(1), 500, 16)
    rows += [(1000 + i, rows[3][1], 1) for i in range(30)] + [(2000, rows[5][1], None)]
    out = v.near_duplicates(spark.createDataFrame(rows, KIND).repartition(4), threshold).collect()
    assert sorted(map(tuple, out)) == brute(rows, threshold)


def test_index_on_a_small_sample_loses_nothing(spark, monkeypatch):
    rows = vectors(np.random.default_rng(2), 600, 12)
    _, classes = v.vector_classes(spark.createDataFrame(rows, KIND))
    monkeypatch.setattr(v, "BLOCK", 16)
    monkeypatch.setattr(v, "QUERY_BLOCK", 16)
    few = {tuple(r) for r in v.candidate_pairs(classes, 12, 0.98, sample=64, lists=8).collect()}
    exact = {tuple(r) for r in v.links(classes).collect()}
    assert exact and exact <= few and len(few) < len(rows) * (len(rows) - 1) / 12


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, [1.0, 1.0], None),
            (8, [1.0, 1.0], 1), (9, [2.0, 2.0], 1), (10, [1.0, 1.0, 1.0], 1), (11, [1e-40, 1e-40], 1), (12, [3e38, 3e38], 1), (13, [1.0, 1.0], 2), (14, [-1.0, -1.0], 1)]
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in v.near_duplicates(spark.createDataFrame(rows, KIND)).collect()}
    assert all(out[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 7, 10, 13, 14))
    assert [out[i] for i in (8, 9, 11, 12)] == [(3, 8, True), (3, 8, False), (3, 8, False), (3, 8, False)]
    twice = [(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1)]
    assert [tuple(r) for r in v.near_duplicates(spark.createDataFrame(twice, KIND)).collect()] == [(1, 1, 1, True)] * 2
    assert v.near_duplicates(spark.createDataFrame([], KIND)).count() == 0
    more = spark.createDataFrame([(1, [1.0], 1, "x")], KIND + ", node string")
    assert v.near_duplicates(more).count() == 1
