import hashlib
import math
from collections import Counter

import numpy as np

from labelfold.operators import features as FE

TEXTS = [(1, "Small ring"), (2, "small  RING "), (3, "copper wire, 5 m"), (4, ""), (5, None), (6, "emoji \U0001F600\U0001F600 ok"), (7, "a")]


def _vectors(spark, n_parts, texts=TEXTS):
    df = spark.createDataFrame(texts, "k long, t string").repartition(n_parts)
    idf = FE.idf_table(FE.char_grams(df, "k", "t"), df.select("k"), "k")
    return {r["k"]: np.array(r["embedding"]) for r in FE.project_text(df, "k", "t", idf).collect()}


def _brute(texts, dim=FE.PROJECTED):
    grams = {}
    for k, t in texts:
        t = f" {' '.join((t or '').lower().split())} "
        grams[k] = Counter(t[i:i + 3] for i in range(len(t) - 2))
    df = Counter(g for c in grams.values() for g in c)
    out = {}
    for k, c in grams.items():
        v = np.zeros(dim)
        for g, n in c.items():
            h = hashlib.md5(g.encode()).hexdigest()
            v[int(h[:4], 16) % dim] += n * math.log((len(texts) + 1) / (df[g] + 1)) * (1 if int(h[4], 16) % 2 == 0 else -1)
        out[k] = v
    return out


def test_vectors_equal_brute_force_on_any_partitioning(spark):
    want, one, many = _brute(TEXTS), _vectors(spark, 1), _vectors(spark, 7)
    assert want.keys() == one.keys() == many.keys()
    for k in want:
        assert np.allclose(one[k], want[k]) and np.allclose(many[k], want[k])
    assert np.allclose(one[1], one[2]) and not one[4].any() and not one[5].any()


def test_a_long_text_takes_linear_time(spark):
    """200 000 characters: substrings by position would take minutes."""
    import time
    text = " ".join(f"wörd{i}" for i in range(25_000))
    t0 = time.time()
    v = _vectors(spark, 1, [(1, text), (2, "short one")])
    assert time.time() - t0 < 30 and v[1].any()
    assert np.allclose(v[1], _brute([(1, text), (2, "short one")])[1])


def test_unseen_grams_weigh_most_and_clean_names_match(spark):
    fit = spark.createDataFrame([(1, "red ring"), (2, "red bolt"), (3, "red nut")], "k long, t string")
    idf = FE.idf_table(FE.char_grams(fit, "k", "t"), fit.select("k"), "k")
    names = spark.createDataFrame([("Ring",), ("BOLT",), ("zzz",)], "name string")
    n = {r["name"]: np.array(r["embedding"]) for r in FE.project_text(names, "name", "name", idf).collect()}
    x = {r["k"]: np.array(r["embedding"]) for r in FE.project_text(fit, "k", "t", idf).collect()}
    cos = lambda a, b: a @ b / (np.linalg.norm(a) * np.linalg.norm(b))
    assert cos(x[1], n["Ring"]) > cos(x[1], n["BOLT"]) and cos(x[2], n["BOLT"]) > cos(x[2], n["Ring"])
    assert np.isclose(np.abs(n["zzz"]).max() % math.log(4), 0) or n["zzz"].any()
