import hashlib
import random
from collections import Counter
from functools import reduce

import numpy as np
import sentencepiece
from tokenizers import Tokenizer

from labelfold.llm import alignment as al
from labelfold.llm.tokens import public_path

A, B = public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model")


def texts():
    rng = random.Random(5)
    words = ["the", "straße", "naïve", "12345", "foo_bar", "漢字仮名", "can't", "x", "supercalifragilistic", "🙂", "...", "<|endoftext|>", "<s>"]
    made = [" ".join(rng.choices(words, k=rng.randint(1, 60))) + rng.choice(["", "\n", "  ", "\t.", " "]) for _ in range(60)]
    return made + ["", None, " ", "  a", "a\r\n\r\nb   c", "\x00\x01", "▁ under", "é" * 300, "same text", "same text", "a" * 3000,
                   " ".join(rng.choices(words, k=3000)), "no_spaces_at_all" * 900, "漢字 " * 2000, "word " * 500 + "z" * 4000 + " word" * 500]


def one_by_one(rows):
    """Groups and links of each text, token by token."""
    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    a_bytes, b_bytes = al._byte_tables(A, B)[:2]
    out, counts = [], Counter()
    for text in rows:
        whole = b" " + (text or "").encode()
        a = tok.encode(" " + (text or ""), add_special_tokens=False).ids
        b = sp.encode(text or "")
        if not text or b"".join(a_bytes[i] for i in a) != whole or b"".join(b_bytes[i] for i in b) != whole:
            out.append(None)
            continue
        ends = [dict(zip(np.cumsum([len(t[i]) for i in ids]).tolist(), ids)) for t, ids in ((a_bytes, a), (b_bytes, b))]
        links = [(ends[0][e], ends[1][e]) for e in ends[0] if e in ends[1]]
        counts.update(links)
        groups, at = [], [0, 0]
        for e in sorted(set(ends[0]) & set(ends[1])):
            sides = [[ids[x] for x in ids if at[k] < x <= e] for k, ids in enumerate(ends)]
            groups.append("|".join(",".join(map(str, s)) for s in sides))
            at = [e, e]
        out.append((len(a), len(b), ";".join(groups), links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(0, 0, 0, 0, 0, 0, "", "") if r is None else
            (r[0], r[1], r[2].count(";") + 1, len(r[3]), sum(counts[p] == best[p[1]] for p in r[3]), sum(counts[p] for p in r[3]),
             hashlib.sha256(r[2].encode()).hexdigest(), r[2]) for r in out]


def got(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.groups) for r in df.collect())


def test_equals_token_by_token_at_any_chunk_size(spark, monkeypatch):
    rows = texts()
    want = sorted((str(i), *r) for i, r in enumerate(one_by_one(rows)))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    assert got(al.align(docs, A, B)) == want
    monkeypatch.setattr(al, "FAN", 3)
    monkeypatch.setattr(al, "CHUNKS_A_TASK", 5)
    monkeypatch.setattr(al, "BROADCAST_PAIRS", 0)
    for size in (37, 1000):  # ranges end inside words, and many rounds are needed
        assert got(al.align(docs, A, B, size=size)) == want
    assert any(r[1] for r in want) and any(not r[1] for r in want)


def test_fragments_form_a_monoid():
    rng = np.random.default_rng(1)
    texts_by = al._byte_tables(A, B)[4]
    for _ in range(200):
        n = int(rng.integers(1, 60))
        ends_a, ends_b = (np.unique(np.append(rng.integers(1, n + 1, rng.integers(0, n + 1)), n)) for _ in "ab")
        a, b = rng.integers(0, 900, len(ends_a)), rng.integers(0, 900, len(ends_b))
        whole, pairs = al.fragment(a, ends_a, b, ends_b, texts_by)
        lines = [0, *sorted(rng.choice(np.arange(1, n + 1), min(n, 4), replace=False).tolist()), n]
        parts, links = [], []
        for lo, hi in zip(lines, lines[1:]):
            x, y = (ends_a > lo) & (ends_a <= hi), (ends_b > lo) & (ends_b <= hi)
            f, p = al.fragment(a[x], ends_a[x], b[y], ends_b[y], texts_by)
            parts.append(f)
            links += p.tolist()
        assert reduce(al.compose, parts) == whole and sorted(links) == sorted(pairs.tolist())
        assert reduce(lambda x, y: al.compose(y, x), parts[::-1]) == whole
        assert al.compose(al.EMPTY, whole) == whole == al.compose(whole, al.EMPTY)
        cut = int(rng.integers(0, len(parts)))
        assert al.compose(reduce(al.compose, parts[:cut], al.EMPTY), reduce(al.compose, parts[cut:], al.EMPTY)) == whole


def test_ranges_cover_texts_without_reading_them_many_times():
    for text in (t for t in texts() if t):
        for size in (5, 100):
            rows = al.chunks(text, size)
            assert sum(hi - max(lo, 0) for _, lo, hi in rows) == len(text.encode()) + 1
            assert sum(len(t) for t, _, _ in rows) <= 4 * len(text) + 4 * size


def test_empty_table_other_ids_and_other_columns(spark):
    assert al.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
    docs = spark.createDataFrame([(None, "a b", 1), ("x", None, 2), ("x", None, 2)], "doc_id string, text string, links int")
    rows = al.align(docs, A, B).collect()
    assert sorted((r.doc_id or "", r.n_groups) for r in rows) == [("", 2), ("x", 0), ("x", 0)]
