import re
import uuid

from pyspark.sql import functions as F

from labelfold.llm import secret_scan as s

KEY = "AKIA" + "ABCDEFGHIJKLMN0P"
TEXTS = [(1, f"a token=abcdefghijkl1 b {KEY} c"), (2, None), (3, ""), (4, f"é password : 'short' PassWD:\"{'x' * 12}\""),
         (5, "deadbeef" * 4), (5, "deadbeef" * 4), (None, "secret=secret : abcdefghijklmnop"), (6, "api_key==" + "Z" * 20),
         (7, "pad é " * 50_000 + KEY), (8, "AKIA" + "A" * 13), (9, "0123456789abcde"), (10, "ſecret=abcdefghijklmnop")]


def base(text):
    """The contract's three patterns, taken literally."""
    out = []
    for m in re.finditer(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or ""):
        if len(m[1]) >= 12 and m[0][0] != "ſ":
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 16]
    return sorted(out)


def test_base_spans_equal_the_literal_patterns(spark):
    for _, text in TEXTS:
        assert [(a, k, e) for a, e, k in s.find_secrets(text or "") if k < 3] == base(text)


def test_scan_joins_findings_to_every_row(spark):
    rows = s.scan(spark.createDataFrame(TEXTS, "doc_id int, text string")).collect()
    assert len(rows) == len(TEXTS)
    got = sorted((str(r.doc_id), [(x.start, x.end, x.kind) for x in r.found]) for r in rows)
    assert got == sorted((str(i), [tuple(x) for x in s.find_secrets(t or "")]) for i, t in TEXTS)


def test_ledger_scans_only_unseen_blobs_and_versions(spark):
    path = s.ledger_path(spark, "test-" + uuid.uuid4().hex)
    docs = spark.createDataFrame(TEXTS, "doc_id int, text string")
    s.scan(docs, path).count()
    n = spark.read.parquet(path).count()
    assert n == len({t or "" for _, t in TEXTS})
    s.scan(docs.union(spark.createDataFrame([(99, "new text")], "doc_id int, text string")), path).count()
    assert spark.read.parquet(path).count() == n + 1
    s.scan(docs, path, rule_version="next").count()
    assert spark.read.parquet(path).where(F.col("rule_version") == "next").count() == n


def test_redact(spark):
    docs = spark.createDataFrame([(i, t, len(t or "") or None, "mine") for i, t in TEXTS], "doc_id int, text string, n_chars int, found string")
    assert all(r.found == "mine" for r in s.redact(docs).collect())
    for r in s.redact(docs.drop("found")).collect():
        assert not s.find_secrets((r.text or "").replace("[SECRET]", " "))
        if r.doc_id == 2:
            assert r.text is None and r.n_chars is None
        if r.doc_id == 1:
            assert r.text == "a [SECRET] b [SECRET] c" and r.n_chars == len(r.text)


def test_empty_table(spark):
    assert s.scan(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_jwt_spans_equal_the_plain_pattern_and_long_runs_take_linear_time():
    import random
    import time
    plain = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+")
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(["eyJ", "eyJ", "abcdefgh", "x", ".", ".", " ", "eyJabcdefgh."]) for _ in range(rng.randint(1, 25)))
        assert list(s._jwt_spans(text)) == [m.span() for m in plain.finditer(text)], text
    t0 = time.time()
    for long in ("eyJ" * 700_000, "eyJ" * 300_000 + "." + "eyJ" * 300_000, "eyJabcdefgh." * 100_000 + "!"):
        s.find_secrets(long)
    assert time.time() - t0 < 10
