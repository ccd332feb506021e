import numpy as np

from labelfold.operators.neighbors import similar_items

SF = "/root/testdata/sf0.001"


def test_lsh_neighbours_recall_against_brute_force(spark):
    emb = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    queries = emb.filter("vec_id < 60")
    got = similar_items(queries, emb, "vec_id", "embedding", k=5, bucket_length=2.0,
                        num_hash_tables=12, max_distance=2.0)
    rows = emb.collect()
    ids = np.array([r["vec_id"] for r in rows])
    X = np.array([r["embedding"] for r in rows], dtype=float)
    X /= np.linalg.norm(X, axis=1, keepdims=True)
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], set()).add(r["item_id"])
        assert abs(r["cosine"] - X[ids == r["query_id"]][0] @ X[ids == r["item_id"]][0]) < 1e-9
    hits = total = 0
    for qi in range(60):
        sims = X @ X[ids == qi][0]
        order = [ids[j] for j in np.argsort(-sims) if ids[j] != qi][:5]
        hits += len(set(order) & found.get(qi, set()))
        total += 5
    assert hits / total >= 0.5


def _brute(qs, cs, k):
    out = {}
    for qid, qv in qs:
        qv = np.asarray(qv, float) / np.linalg.norm(qv)
        sims = sorted(((round(float(qv @ (np.asarray(v, float) / np.linalg.norm(v))), 9), cid)
                       for cid, v in cs), key=lambda t: (-t[0], t[1]))
        out[qid] = [cid for _, cid in sims[:k]]
    return out


def test_exact_neighbours_match_brute_force(spark):
    from labelfold.operators.neighbors import nearest_exact
    emb = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    q = emb.filter("vec_id % 5 = 0")
    c = emb.filter("vec_id % 5 != 0")
    got = {}
    for r in nearest_exact(q, c, "vec_id", "embedding", k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["item_id"]))
    ref = _brute([(r[0], r[1]) for r in q.collect()], [(r[0], r[1]) for r in c.collect()], 5)
    assert {k: [i for _, i in sorted(v)] for k, v in got.items()} == ref


def _got(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["item_id"]))
    return {k: [i for _, i in sorted(v)] for k, v in got.items()}


def _clustered(n, clusters, d=32, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(clusters, d))
    return [(i, [float(x) for x in centers[i % clusters] + rng.normal(size=d) * 0.02]) for i in range(n)]


def test_few_pairs_are_scored_on_clustered_vectors_and_their_share_falls(spark):
    from labelfold.operators.vector_index import Index
    shares = []
    for n, clusters in ((2000, 40), (8000, 160)):
        rows = _clustered(n, clusters)
        df = spark.createDataFrame(rows, "id long, v array<double>").repartition(8)
        q, c = df.filter("id < 60"), df.filter("id >= 60")
        index = Index(c, "id", "v", 3)
        assert _got(index.search(q, "id", "v")) == _brute(rows[:60], rows[60:], 3)
        shares.append(index.pairs_scored / (60 * (n - 60)))
    assert shares[1] <= 0.05 and shares[1] < 0.6 * shares[0], shares


def test_first_round_alone_says_what_is_certain(spark):
    from labelfold.operators.vector_index import Index
    emb = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    q, c = emb.filter("vec_id % 5 = 0"), emb.filter("vec_id % 5 != 0")
    want = _brute([(r[0], r[1]) for r in q.collect()], [(r[0], r[1]) for r in c.collect()], 5)
    index = Index(c, "vec_id", "embedding", 5)
    found = index.search(q, "vec_id", "embedding", first=7, go_on=False).cache()
    got, certain = _got(found), {r.query_id for r in found.filter("certified").collect()}
    assert all(got[i] == want[i] for i in certain)
    recall = sum(len(set(got[i]) & set(want[i])) for i in want) / sum(map(len, want.values()))
    assert recall >= 0.9  # these vectors have little structure: five of the eight or so buckets give 0.8
    assert _got(index.search(q, "vec_id", "embedding")) == want


def test_copies_zero_vectors_and_hot_buckets(spark, monkeypatch):
    from labelfold.operators import vector_index as V
    monkeypatch.setattr(V, "BUCKET", 16)
    monkeypatch.setattr(V, "QUERIES", 8)
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(i, [0.0, 0.0, 0.0]) for i in range(300, 320)]
    rows += [(i, [1.0 + 1e-6 * float(rng.normal()), 2.0, 3.0]) for i in range(320, 700)] + [(i, [float(x) for x in rng.normal(size=3)]) for i in range(700, 900)]
    df = spark.createDataFrame(rows + [(5000, None)], "id long, v array<double>")
    queries = [(10_000 + i, v) for i, (_, v) in enumerate(rows[::9])]
    q = spark.createDataFrame(queries + [(20_000, None)], "id long, v array<double>")

    def brute(qs):
        unit = lambda v: np.asarray(v) / (np.linalg.norm(v) or 1)
        corpus = np.array([unit(v) for _, v in rows])
        return {i: [rows[j][0] for j in np.lexsort(([r for r, _ in rows], -np.round(corpus @ unit(v), 9)))[:4]] for i, v in qs}

    index = V.Index(df, "id", "v", 4)
    assert index.boxes.count() > 10 and index.rows.groupBy("code", "sub").count().agg({"count": "max"}).first()[0] <= 16
    assert _got(index.search(q, "id", "v", first=2)) == brute(queries)
    assert V.Index(df.limit(0), "id", "v", 4).search(q, "id", "v").count() == 0
    assert index.search(q.limit(0), "id", "v").count() == 0


def test_vectors_without_structure_meet_in_blocks(spark, monkeypatch):
    """Boxes rule nothing out: no row for each query and bucket, the same answers, ties by id over blocks."""
    from labelfold.operators import vector_index as V
    monkeypatch.setattr(V, "BLOCK_VALUES", 24 * 150)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-1, 2, 24)]) for i in range(1500)]
    rows += [(2000 + i, rows[i][1]) for i in range(0, 90, 3)] + [(5000, [0.0] * 24)]
    c = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    queries = [(-1 - i, [float(x) for x in rng.integers(-1, 2, 24)]) for i in range(200)] + [(-1000 - i, rows[i][1]) for i in range(30)]
    q = spark.createDataFrame(queries, "id long, v array<double>")
    index = V.Index(c, "id", "v", 4)
    wanted = []
    monkeypatch.setattr(V.Index, "_scored", lambda self, w, v, real=V.Index._scored: wanted.append(w.count()) or real(self, w, v))
    unit = np.array([np.asarray(v) / (np.linalg.norm(v) or 1) for _, v in rows])
    want = {i: [rows[j][0] for j in np.lexsort(([r for r, _ in rows], -np.round(unit @ (np.asarray(v) / np.linalg.norm(v)), 9)))[:4]] for i, v in queries}
    assert _got(index.search(q, "id", "v")) == want
    assert sum(wanted) <= 4 * V.PROBES and index.pairs_scored == len(queries) * 1530
