import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from labelfold.llm import packing as p
from labelfold.llm.tokens import public_path

PATH = public_path("byte_bpe_50k.json")


def served_one_by_one(rounds):
    """Deficit round-robin taken literally: (queue, quantum number) in the order served, with the position of each."""
    credit, sent = [0] * len(rounds.totals), [0] * len(rounds.totals)
    order, at, left = [], 0, [int(t) for t in rounds.totals]
    while any(left):
        for q in range(len(left)):
            credit[q] += int(rounds.credit[q])
            while left[q] and credit[q] >= rounds.cost:
                credit[q] -= rounds.cost
                n = min(left[q], rounds.quantum)
                order.append((q, sent[q], at))
                sent[q], left[q], at = sent[q] + 1, left[q] - n, at + n
    return order


@pytest.mark.parametrize("totals, shares", [([1], [1]), ([5000], [1]), ([3000, 1000, 17], [3000, 1000, 17]), ([700, 700, 700], [1, 5, 2]),
                                            ([9000, 40, 300, 1], [1, 1, 1, 0]), ([256, 512, 2048], [0, 0, 0])])
def test_closed_form_equals_rounds_one_by_one(totals, shares):
    rounds = p.Rounds(totals, shares, 512, 64)
    queue, number, at = map(np.array, zip(*served_one_by_one(rounds)))
    assert rounds.places(queue, number).tolist() == at.tolist()


def test_huge_totals_do_not_overflow():
    rounds = p.Rounds([20 * 10**12, 5 * 10**12, 3], [4, 1, 1e-9])
    last = np.array([(t - 1) // p.QUANTUM for t in rounds.totals])
    at = rounds.places(np.arange(3), last)
    assert (at >= 0).all() and (at < rounds.total).all()
    assert at.max() + (rounds.totals[at.argmax()] - 1) % p.QUANTUM + 1 == rounds.total


def docs_of(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]), " ".join(rng.choices(["token", "é", "zebra", "1 2", "\n"], k=rng.randint(0, 400)))) for i in range(300)]
    rows += [(7, "b", "again"), (7, "b", "again"), (None, None, None), (1000, "long", "one long text " * 4000), (1001, "a", "<|endoftext|> x"), (1002, "c", "")]
    return rows, spark.createDataFrame(rows, "doc_id int, source string, text string").withColumnsRenamed({}).repartition(5)


def check_layout(rows, pieces):
    by_sequence = {}
    for r in pieces:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    fills = []
    for s in sorted(by_sequence):
        at = 0
        for offset, length in sorted(by_sequence[s]):
            assert offset == at and length > 0
            at += length
        fills.append(at)
    full = [x for x in fills if x == p.WINDOW]
    assert all(x.bit_count() == 1 and x < p.WINDOW for x in fills[len(full):])  # no padding at all
    return fills


def test_every_token_lies_in_one_piece(spark):
    rows, docs = docs_of(spark)
    pieces = p.pack(docs, PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted((str(i), str(s), tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for i, s, t in rows)
    check_layout(rows, pieces)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in pieces)
    # documents put together again from their pieces; repeated rows are told apart by their places
    got, held = [], {}
    for r in pieces:
        held.setdefault((str(r.doc_id), str(r.source), r.doc_tokens), {}).setdefault(r.start, []).append(r.ids)
    for (i, s, n), by_start in held.items():
        for k in range(len(by_start[0])):
            ids = [x for start in sorted(by_start) for x in by_start[start][min(k, len(by_start[start]) - 1)]]
            assert len(ids) == n
            got.append((i, s, ids))
    assert sorted(got) == want


def test_windows_hold_the_target_mixture(spark):
    rows = [(i, "big" if i % 4 else "small", "some words of a text " * 60) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id int, source string, text string")
    pieces = p.pack(docs, PATH, with_ids=False).collect()
    total = sum(r.length for r in pieces)
    share = sum(r.length for r in pieces if r.source == "small") / total
    for last in range(1, total // p.WINDOW):  # deficits are carried: every prefix of windows keeps the shares
        held = sum(r.length for r in pieces if r.source == "small" and r.sequence_id < last)
        assert abs(held - share * last * p.WINDOW) <= 2 * p.QUANTUM
    equal = p.pack(docs, PATH, {"small": 1, "big": 1}, with_ids=False).collect()
    both = 2 * share * total // p.WINDOW - 2
    for w in range(int(both)):
        assert abs(sum(r.length for r in equal if r.source == "small" and r.sequence_id == w) - p.WINDOW / 2) <= 2 * p.QUANTUM


def test_sequences_and_odd_tables(spark, monkeypatch):
    _, docs = docs_of(spark)
    pieces = p.pack(docs, PATH)
    whole = p.sequences(pieces, pad=9).collect()
    assert {len(r.ids) for r in whole} <= {1 << b for b in range(12)}
    assert sum(r.n_tokens for r in whole) == sum(r.length for r in pieces.collect())
    assert p.pack(docs.limit(0), PATH).count() == 0
    clash = docs.selectExpr("doc_id", "source", "text", "1 as queue", "2 as start", "3 as ids")
    assert p.pack(clash, PATH).count() == pieces.count()
    monkeypatch.setattr(p, "MAX_QUEUES", 3)  # the smaller sources share a queue
    monkeypatch.setattr(p, "BROADCAST_ROWS", 0)
    check_layout(None, p.pack(docs, PATH, with_ids=False).collect())
    with pytest.raises(ValueError):
        p.pack(docs, PATH, quantum=300)
