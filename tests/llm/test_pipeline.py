import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from labelfold.llm import secret_scan
from labelfold.llm.common import components, written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        out[name] = (docs, written(stage(spark, docs, SF), f"test-{name}"))
        docs = out[name][1]
    return out


def test_order_and_columns(spark, stages):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "ngram_join", "decontamination", "secrets", "mixing"]
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(stages[n][1].columns == columns for n, _ in cp.STAGES[:-1])


def test_toxicity_keeps_clean_documents(spark, stages):
    before, after = stages["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    gone = before.join(after, "doc_id", "left_anti").join(labels, "doc_id")
    assert gone.where("toxic = 1").count() > 0 and gone.where("toxic = 0").count() <= 1


def test_one_of_each_group_stays(stages):
    before, after = stages["ngram_join"]

    def shingles(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    rows = sorted((r.doc_id, shingles(r.text)) for r in before.collect())
    parent = {i: i for i, _ in rows}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k
    for x, (i, a) in enumerate(rows):
        for j, b in rows[:x]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    assert sorted(r.doc_id for r in after.collect()) == sorted({find(i) for i, _ in rows})


def test_secrets_are_redacted_and_documents_stay(stages):
    before, after = stages["secrets"]
    old = {r.doc_id: r for r in before.collect()}
    rows = after.collect()
    assert len(rows) == len(old)
    for r in rows:
        if secret_scan.find_secrets(old[r.doc_id].text or ""):
            assert "[SECRET]" in r.text and r.n_chars == len(r.text)
        else:
            assert r == old[r.doc_id]


def test_run_equals_the_stages(spark, stages):
    key = lambda df: sorted((r.doc_id, r.copy) for r in df.collect())
    assert key(cp.run(spark, SF)) == key(stages["mixing"][1])


def test_odd_rows_and_clashing_columns(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "s", 0), (2, "a b c " * 50_000, "en", "s", 5),
            (3, "token=abcdefghijklmnop", None, "t", 1), (4, "token=abcdefghijklmnop", None, "t", 1)]
    extra = ("score", "found", "node")
    for start in (rows, []):
        docs = spark.createDataFrame([(*r, "m", "m", None) for r in start], "doc_id long, text string, lang string, source string, n_chars long, "
                                     + ", ".join(f"{c} string" for c in extra))
        for _, stage in cp.STAGES[:-1]:
            docs = written(stage(spark, docs, SF), "test-odd")
            assert docs.columns[-3:] == list(extra)
        out = docs.collect()
        assert len(out) == (5 if start else 0) and all((r.score, r.found, r.node) == ("m", "m", None) for r in out)
        assert cp.mixed(spark, docs, SF).count() >= 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(150, 300), (7, 7)]
    nodes = sorted({x for e in edges for x in e} | {999})
    out = components(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "a long, b long"))
    assert {r.id: r.comp for r in out.collect()} == {n: 0 if n <= 40 else 100 if n < 999 else 999 for n in nodes}
    assert out.where(F.col("id") == 999).count() == 1
