import math
import random
import re
from collections import Counter

import duckdb
import numpy as np

from labelfold.llm import ranked_search as r

from tests.conftest import SF


def terms_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, top=10):
    held = [(i, Counter(terms_of(t)), len(terms_of(t))) for i, t in docs if terms_of(t)]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc_id, counts, n in held:
            m = 10 + (90 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 8 * m))
                    for t in set(terms_of(text)) if counts[t])
            if s > 0:
                scored.append((-s, doc_id is None, doc_id or 0))
        out += [(str(item), k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def got(df):
    return sorted(((str(x.item_id), x.rank, x.doc_id, x.score) for x in df.collect()), key=str)


def fixture():
    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)] + ["Straße", "NAÏVE", "x_y", "漢字"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 80)))) for i in range(400)]
    docs += [(i, docs[5][1]) for i in range(1000, 1030)]  # more ties than places
    docs += [(50, None), (51, ""), (52, " ,.;"), (None, docs[5][1]), (53, "w1 " * 20_000), (5, docs[5][1])]
    items = [(k, docs[7 * k][1]) for k in range(1, 30)] + [(1, "w1"), (100, None), (101, "?!"), (102, "absent"), (103, docs[5][1].upper()), (None, "w2 w3")]
    items.append((104, " ".join(f"w{k}" for k in range(300))))  # a mask of many words
    return docs, items


def test_equals_brute_force(spark, monkeypatch):
    docs, items = fixture()
    d = spark.createDataFrame(docs, "doc_id int, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id int, text string")
    want = brute(docs, items)
    assert got(r.search(d, i)) == want
    monkeypatch.setattr(r, "BLOCK", 37)
    monkeypatch.setattr(r, "BLOCK_POSTINGS", 300)
    monkeypatch.setattr(r, "MAX_ITEMS", 9)  # several parts and many small blocks
    found = r.search(d, i)
    assert got(found) == want
    assert found.select("item_no", "rank").distinct().count() == len(want)


def test_masks_below_the_tenth_best_are_not_evaluated():
    rng = np.random.default_rng(4)
    counts = rng.integers(1, 30, 4000)
    terms = np.concatenate([np.sort(rng.choice(200, c, replace=False)) for c in counts])
    weights = (8000 / np.arange(1, 201)).astype(np.int64)
    block = r.Block(counts * 3, counts, terms, np.ones(len(terms), np.int64), weights, 4000, int(counts.sum() * 3))
    item = np.arange(0, 60, 4)
    docs, scores, evaluated = block.top(item, np.arange(4000), 1, 10)
    whole = np.zeros(4000, np.int64)
    held = np.isin(terms, item)
    np.add.at(whole, np.repeat(np.arange(4000), counts)[held], block.scores[held])
    best = np.lexsort((np.arange(4000), -whole))[:10]
    assert docs.tolist() == best.tolist() and scores.tolist() == whole[best].tolist()
    assert evaluated < 0.5 * len({tuple(x) for x in np.split(terms, np.cumsum(counts)[:-1])})


def test_equals_the_sql_twin(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = con.execute(r.ORACLE_SQL).fetchall()
    assert sorted(tuple(x) for x in r.query(spark, SF).collect()) == sorted(want) and want


def test_empty_tables_and_other_ids(spark):
    docs, items = fixture()
    d = spark.createDataFrame([(str(i), t, 1) for i, t in docs], "doc_id string, text string, n int")
    i = spark.createDataFrame(items[:3], "item_id int, text string").selectExpr("cast(item_id as decimal(5,0)) item_id", "text", "1 as rank")
    assert r.search(d, i.limit(0)).count() == 0 and r.search(d.limit(0), i).count() == 0
    assert r.search(d, i).count() == 30
