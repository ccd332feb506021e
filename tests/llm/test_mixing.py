import math
from collections import Counter

import pytest

from labelfold.llm import mixing as m

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")


def tokens(docs):
    return {r.doc_id: (r.source, len((r.text or "").encode().split())) for r in docs.collect()}


@pytest.mark.parametrize("kw", [{}, {"budget": 5_000}, {"budget": 300_000, "max_repeat": 6.0}, {"max_repeat": 1.05}, {"entropy": 2.0, "max_repeat": None}])
def test_quotas_and_limits(docs, kw):
    have = tokens(docs)
    total = Counter()
    for s, n in have.values():
        total[s] += n
    rows = m.mix(docs, **kw).collect()
    budget = kw.get("budget", sum(total.values()))
    got, weight = Counter(), {}
    copies = {}
    for r in rows:
        assert have[r.doc_id] == (r.source, r.n_tokens)
        got[r.source] += r.n_tokens
        weight[r.source] = r.weight
        copies.setdefault(r.doc_id, []).append(r.copy)
    for s, w in weight.items():
        longest = max(n for t, n in have.values() if t == s)
        assert got[s] <= w * budget * (1 + 1e-9) + 1e-6 and w * budget - got[s] <= longest  # within one document of the quota
    for c in copies.values():
        assert sorted(c) == list(range(len(c)))
    limit = kw.get("max_repeat", m.MAX_REPEAT)
    if limit is not None:
        assert all(w * budget / total[s] <= max(limit, budget / sum(total.values())) * (1 + 1e-6) for s, w in weight.items())
    exponent = rows[0].exponent
    p = {s: n / sum(total.values()) for s, n in total.items()}
    z = sum(x ** exponent for x in p.values())
    assert all(abs(weight[s] - p[s] ** exponent / z) < 1e-9 for s in weight)


def test_entropy_is_met(docs):
    total = Counter()
    for s, n in tokens(docs).values():
        total[s] += n
    p = [n / sum(total.values()) for n in total.values()]
    low, high = -sum(x * math.log(x) for x in p), math.log(len(p))
    goal = low + 0.3 * (high - low)
    rows = m.mix(docs, entropy=goal, max_repeat=None).collect()
    w = {r.source: r.weight for r in rows}.values()
    assert abs(-sum(x * math.log(x) for x in w) - goal) < 1e-6


def test_same_rows_again(docs):
    key = lambda df: sorted((r.doc_id, r.copy, r.block) for r in df.collect())
    assert key(m.mix(docs, budget=20_000)) == key(m.mix(docs.repartition(5), budget=20_000))


def test_odd_rows(spark):
    rows = [(1, None, "a b"), (1, None, "a b"), (2, "s", None), (None, "t", "x"), (3, "s", "")]
    out = m.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), budget=3, entropy=0.0, max_repeat=None).collect()
    assert sum(r.n_tokens for r in out) <= 3
    assert m.mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0
    assert m.mix(spark.createDataFrame(rows[2:3], "doc_id long, source string, text string")).count() == 0
