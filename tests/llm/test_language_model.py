import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from labelfold.llm import language_model as m

SF = "/root/testdata/sf0.001"


def test_query_counts_base_score_and_held_out_perplexity(spark):
    docs = {r.doc_id: (r.text or "").encode().lower().split() + ["END"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = m.query(spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    c = Counter(w for i, ws in docs.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    for r in out:
        ws = docs[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in c for w in ws), n)
        assert abs(r.base_score - sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) < 1e-6 * len(ws)
        assert r.score < 0
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_of_every_context_sum_to_one(spark):
    """With P of "u w", "u" and "" known, contexts that sum to one give p(u|start) by a linear system; the start must sum to one too."""
    words = ["a", "b", "c", "zzz"]
    rows = [(i, t, False) for i, t in enumerate(["a b a c", "b a b", "a a a b c", "c c"] * 3)]
    rows += [(100 + 10 * k + j, f"{u} {w}", True) for k, u in enumerate(words) for j, w in enumerate(words)]
    rows += [(200 + k, u, True) for k, u in enumerate(words)] + [(300, None, True), (301, "", True)]
    p = {r.doc_id: 10 ** r.score for r in m.score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")).collect()}
    assert p[300] == p[301]
    one = np.array([p[200 + k] for k in range(4)])
    two = np.array([[p[100 + 10 * k + j] for j in range(4)] for k in range(4)])
    start = np.linalg.solve(np.eye(4) - two / one, one)
    assert (start > 0).all() and abs(start.sum() + p[300] - 1) < 1e-5


def test_predictive_distribution_is_normalised():
    rng = np.random.default_rng(1)
    word = np.repeat(np.arange(50), 20)
    context = np.tile(np.arange(20), 50)
    count = rng.integers(0, 12, 1000)
    tables, customers, root, d, d0 = m.sample_part(word, context, count, 50, 50, 1, 7)
    assert (tables[count > 0] >= 1).all() and (tables <= count).all() and (tables[count == 1] == 1).all()
    known = np.bincount(word, count) > 0
    base = (1 - m.UNSEEN) / known.sum()
    grow = m.ROOT_STRENGTH + (d0 * root).sum()
    parent = (customers - d0 * root + grow * base) / (customers.sum() + m.ROOT_STRENGTH)
    unseen = grow * m.UNSEEN / (customers.sum() + m.ROOT_STRENGTH)
    assert abs(parent[known].sum() + unseen - 1) < 1e-9
    for u in range(20):
        mine = context == u
        total, open_ = count[mine].sum(), (d * tables[mine]).sum()
        p = (np.maximum(0, count[mine] - d * tables[mine]) + (m.STRENGTH + open_) * parent) / (m.STRENGTH + total)
        assert abs(p[known].sum() + unseen * (m.STRENGTH + open_) / (m.STRENGTH + total) - 1) < 1e-9


def test_seating_keeps_its_customers():
    rng = np.random.default_rng(2)
    count = np.r_[1, 2, 3, 50, 5000, rng.integers(0, 9, 400)]
    word, context = np.arange(405) % 90, np.arange(405) % 40
    s = m.Seating(word, context, count, 90, 1, 0.6, 0.5, rng)
    for _ in range(m.BURN_IN + m.SAMPLES):
        s.sweep(90)
        owner = np.repeat(np.arange(len(s.room)), s.room)
        assert (np.bincount(owner, s.sizes) == count[s.many]).all()
        assert (np.bincount(owner, s.sizes > 0) == s.tables).all()
        seat = np.arange(len(s.sizes)) - s.first[owner]
        assert ((s.sizes > 0) == (seat < s.tables[owner])).all()


def test_gibbs_agrees_with_the_exact_number_of_tables():
    """Mean tables of a pair with three customers against its exact distribution."""
    n, d, known = 4000, 0.5, 4000
    s = m.Seating(np.arange(n), np.zeros(n, np.int64), np.full(n, 3), n, 1, d, 0.5, np.random.default_rng(3))
    s.parent = lambda customers, known: np.full(n, 0.002)  # a fixed parent
    mean = []
    for turn in range(60):
        open_ = s.tables.sum()
        s.sweep(known)
        if turn >= 30:
            mean.append((s.tables.mean(), (m.STRENGTH + d * open_) * 0.002))
    new = np.mean([x for _, x in mean])
    w = np.array([(1 - d) * (2 - d), 3 * (1 - d) * new, new * new])  # one, two and three tables
    assert abs(np.mean([t for t, _ in mean]) - (w * [1, 2, 3]).sum() / w.sum()) < 0.1


def test_batches_cover_every_row_in_order():
    table = pa.RecordBatch.from_pydict({"text": ["x" * n for n in [5, 0, 9_000_000, 4_000_000, 1, 20_000_000, 3]] , "doc_id": list(range(7))})
    got = [(i, t.column("doc_id").to_pylist()) for i, t in m.batches_of([table, table], 4)]
    assert sum((x for _, x in got), []) == list(range(7)) * 2 and len({i for i, _ in got}) == len(got) > 2


def test_pack():
    n = np.array([0, 1, 254, 255, 256, 100_000], np.uint32)
    assert m._unpack(m._pack(n)).tolist() == n.tolist() and m._unpack(m._pack(n[:0])).tolist() == []


@pytest.mark.parametrize("rows", [[], [(1, None, False)], [(1, "a b", True), (1, "a b", True)], [(None, "x " * 300_000, False), (2, "é", True)]])
def test_odd_rows(spark, rows):
    out = m.score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")).collect()
    assert len(out) == len(rows) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in out)
    if rows and rows[0][2]:
        assert all(r.train_tokens == 0 and r.n_known == 0 for r in out)


@pytest.mark.parametrize("count, z", [(3000, 0.5), (3000, 40.0), (1500, 400.0), (700, 30.0)])
def test_tables_of_frequent_pairs_agree_with_the_exact_counts(count, z):
    """Mean and spread of all customers seated anew against the recursion of the generalised Stirling numbers."""
    d, n, rng = 0.6, 150, np.random.default_rng(5)
    log_s = np.zeros(1)
    for c in range(1, count):
        log_s = np.logaddexp(np.r_[-np.inf, log_s], np.r_[log_s + np.log(c - d * np.arange(1, c + 1)), -np.inf])
    p = log_s + np.arange(count) * np.log(z)
    p = np.exp(p - p.max())
    p /= p.sum()
    mean = (p * np.arange(1, count + 1)).sum()
    spread = math.sqrt((p * (np.arange(1, count + 1) - mean) ** 2).sum())
    draws, t, got = m.TableCounts(d, rng), np.ones(n, np.int64), []
    for turn in range(m.BURN_IN + m.SAMPLES):
        t = draws.draw(np.full(n, count), np.full(n, z), t)
        if turn >= m.BURN_IN:
            got.append(t)
    assert abs(np.mean(got) - mean) < 5 * spread / math.sqrt(n) and abs(np.std(got) / spread - 1) < 0.15


def test_frequent_pairs_leave_their_start():
    """All customers move: a pair of thousands under a strong parent opens far more than 64 + 16 tables."""
    n = 20
    s = m.Seating(np.zeros(n, np.int64), np.arange(n), np.full(n, 4000), 1, 1, 0.6, 0.5, np.random.default_rng(3))
    s.parent = lambda customers, known: np.ones(1)
    for _ in range(m.BURN_IN):
        s.sweep(1)
    assert s.tables.mean() > 100


def test_runs_do_not_depend_on_arrow_batches(monkeypatch):
    import pyarrow as pa
    from labelfold.llm import language_model as lm
    monkeypatch.setattr(lm, "BATCH_BYTES", 50)
    texts = ["a" * n for n in (10, 0, 45, 5, 50, 51, 200, 0, 1, 20, 30, 1, 49, 2)] + [None, "b" * 49]
    runs = set()
    for step in (1, 2, 3, 5, 16):
        rows = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
        cut = [rows.slice(i, step) for i in range(0, len(texts), step)]
        runs.add(str([(i, t.column("text").to_pylist()) for i, t in lm.batches_of(iter(cut), 3)]))
    assert len(runs) == 1


def test_every_context_word_has_a_restaurant_of_its_own():
    """More context words than any fixed number of hashed restaurants: none are merged, and the end starts a text."""
    n = 70_000
    words, counts = m.tokens(pa.array([" ".join(f"w{i}" for i in range(n)), "w0"]))
    distinct, _, word, context, pair = m.distinct_pairs(words, counts, 8)
    assert len(distinct) == n + 1 and len(np.unique(context)) == n + 1
    before = np.r_[m.END, words[:n], m.END, words[0]]
    assert (distinct[context[pair]] == before).all() and (distinct[word[pair]] == words).all()


def test_gamma_variables_follow_their_key_and_shape():
    shape, key = np.repeat([1.2, 3.0, 40.0], 20_000), np.arange(60_000, dtype=np.uint64)
    x = m.keyed_gamma(shape, key)
    assert (m.keyed_gamma(shape[::-1], key[::-1])[::-1] == x).all()
    for k, a in enumerate((1.2, 3.0, 40.0)):
        some = x[20_000 * k:20_000 * (k + 1)]
        assert abs(some.mean() / a - 1) < 0.03 and abs(some.var() / a - 1) < 0.06


def test_score_agrees_with_one_sampler_of_the_whole_corpus(spark):
    """Restaurants whose pairs lie in many parts are seated as by one process that holds them all."""
    rng = np.random.default_rng(8)
    follow = rng.integers(0, 400, (400, 6))
    docs = []
    for _ in range(500):
        w = [int(rng.zipf(1.4)) % 400]
        for _ in range(40):
            w.append(int(follow[w[-1], int(rng.zipf(1.7)) % 6]) if rng.random() < 0.7 else int(rng.zipf(1.4)) % 400)
        docs.append(w)
    rows = [(i, " ".join(f"w{x}" for x in w), i % 5 == 1) for i, w in enumerate(docs)]
    got = {r.doc_id: r.score for r in m.score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")).collect()}
    pairs = Counter((w, u) for i, d in enumerate(docs) if i % 5 != 1 for u, w in zip([400] + d, d + [400]))
    at = {p: k for k, p in enumerate(pairs)}
    word, context = np.array(list(pairs)).T
    count = np.array(list(pairs.values()))
    known = len(set(word.tolist()))
    tables, customers, root, d, d0 = m.sample_part(word, context, count, 401, known, 1, 3)
    parent = (customers - d0 * root + (m.ROOT_STRENGTH + d0 * root.sum()) * np.where(np.bincount(word, count, 401) > 0, (1 - m.UNSEEN) / known, m.UNSEEN))
    parent /= customers.sum() + m.ROOT_STRENGTH
    total, opened = np.bincount(context, count, 401), np.bincount(context, d * tables, 401)
    off = []
    for i, text in enumerate(docs):
        want = 0.0
        for u, w in zip([400] + text, text + [400]):
            k = at.get((w, u))
            want += math.log10(((count[k] - d * tables[k] if k is not None else 0) + (m.STRENGTH + opened[u]) * parent[w]) / (m.STRENGTH + total[u]))
        off.append((got[i] - want) / (len(text) + 1))
    assert max(map(abs, off)) < 0.05 and abs(np.mean(off)) < 0.003
