"""Queries: features, prototype models, scoring, personalised and fallback models, flagship job."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import classify as C
from ..operators import features as FE
from ..operators import neighbors as NB
from ..operators import metrics, split
from ..operators.labels import class_weights
from ..operators.linear import fit_linear_by_group
from ..operators.quality import validate
from ..sources import tables
from ..sources.columns import map_columns
from ..functions.text import has_content, py_strip
from . import sqlgen as S
from ..session import materialize, spread, spread_groups
from ..streaming.feedback_stream import pack_model, score_packed
from .registry import r6, register

T = C.TEMPERATURE
MIN_USER_TRAIN_DOCS = 40      # users with fewer training documents get no own model
MIN_ACTIVE_DOCS = 8           # a user's category is active with at least this many train docs


# ============================ dense vectors (embeddings) ==================================

def _vectors_split(spark, d):
    v = tables.vectors(spark, d)
    return materialize(split.split_random(v, "vec_id", label="label", test_size=0.2, val_size=0.0))


def _dense_scored(spark, d):
    """Test vectors with all their label scores in the row."""
    s = _vectors_split(spark, d)
    model = C.dense_prototypes(s.filter(F.col("split") == "train"), "embedding", "label")
    return C.score_rows(s.filter(F.col("split") == "test"), model, "embedding", "label")


def _dense_sql(body: str, extra=()) -> str:
    ctes = [("src", "SELECT vec_id, embedding, label FROM embeddings")]
    ctes += S.split_ctes("vec_id", "label", [], 0.2, 0.0, 42, False)
    ctes += [
        ("tr", "SELECT vec_id, label, embedding FROM assigned WHERE split = 'train'"),
        ("te", "SELECT vec_id, label, embedding FROM assigned WHERE split = 'test'"),
        ("tri", "SELECT label, i, CAST(embedding[i] AS DOUBLE) AS x FROM "
                "(SELECT label, embedding, unnest(generate_series(1, len(embedding))) AS i FROM tr)"),
        ("cen", "SELECT label, i, avg(x) AS c FROM tri GROUP BY label, i"),
        ("tei", "SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS x FROM "
                "(SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM te)"),
        ("dt", "SELECT vec_id, label, sum(x * c) AS d FROM tei JOIN cen USING (i) GROUP BY vec_id, label"),
        ("qn", "SELECT vec_id, sqrt(sum(x * x)) AS qn FROM tei GROUP BY vec_id"),
        ("cn", "SELECT label, sqrt(sum(c * c)) AS cn FROM cen GROUP BY label"),
        ("sc", "SELECT vec_id, label, CASE WHEN qn * cn = 0 THEN 0.0 ELSE d / (qn * cn) END AS score "
               "FROM dt JOIN qn USING (vec_id) JOIN cn USING (label)"),
        ("rks", "SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, label) AS rn, "
               f"exp((score - max(score) OVER (PARTITION BY vec_id)) / {T!r}) AS e FROM sc"),
        ("pr", "SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS probability FROM rks"),
    ]
    return S.with_roles([], body, ctes + list(extra))


@register("prototype_predict", _dense_sql(
    "SELECT te.vec_id, te.label, pr.label AS predicted, round(pr.score, 6) AS score "
    "FROM te JOIN pr ON pr.vec_id = te.vec_id AND pr.rn = 1"))
def prototype_predict(spark, d):
    """Nearest-prototype classifier on stored vectors (CLS-5)."""
    return r6(C.rank_rows(_dense_scored(spark, d)).select("vec_id", "label", "predicted", "score"))


@register("predict", _dense_sql(
    "SELECT vec_id, label AS predicted, round(probability, 6) AS confidence FROM pr WHERE rn = 1"))
def predict(spark, d):
    """Predicted label + confidence = max probability (CLS-8, CLS-10, SORT-3)."""
    return r6(C.rank_rows(_dense_scored(spark, d)).select("vec_id", "predicted", "confidence"))


@register("predict_proba", _dense_sql(
    "SELECT vec_id, label, round(probability, 6) AS probability FROM pr"))
def predict_proba(spark, d):
    """Softmax of the cosine scores over all labels (CLS-9, MATH-3)."""
    return r6(C.probability_rows(_dense_scored(spark, d), "vec_id"))


@register("topk_accuracy", _dense_sql(
    "SELECT count(*) AS n, round(avg(CASE WHEN hit3 THEN 1.0 ELSE 0.0 END), 6) AS top3_accuracy, "
    "round(avg(CASE WHEN hit1 THEN 1.0 ELSE 0.0 END), 6) AS top1_accuracy FROM ("
    "SELECT te.vec_id, bool_or(pr.label = te.label AND pr.rn <= 3) AS hit3, "
    "bool_or(pr.label = te.label AND pr.rn = 1) AS hit1 FROM te JOIN pr USING (vec_id) GROUP BY te.vec_id)"))
def topk_accuracy(spark, d):
    """Top-3 (and top-1) accuracy of the prototype scores (AGG-19, SORT-4)."""
    return r6(metrics.topk_accuracy(C.rank_rows(_dense_scored(spark, d)), k=3, y_true="label"))


FEW_SHOTS = (5, 10, 20)
MIN_CATEGORY_EXAMPLES = 50


def _few_shot_sql() -> str:
    parts = []
    for n in FEW_SHOTS:
        parts.append(
            f"SELECT {n} AS n_shots, count(*) AS n_test, round(avg(CASE WHEN p.label = t.label THEN 1.0 "
            f"ELSE 0.0 END), 6) AS accuracy FROM (SELECT * FROM rk WHERE rn > {n}) t JOIN ("
            f"SELECT vec_id, label FROM (SELECT s.vec_id, s.label, row_number() OVER (PARTITION BY s.vec_id "
            f"ORDER BY round(s.score, 9) DESC, s.label) AS r FROM (SELECT q.vec_id, c.label, "
            f"CASE WHEN q.qn * c.cn = 0 THEN 0.0 ELSE sum(q.x * c.c) / (q.qn * c.cn) END AS score "
            f"FROM (SELECT ti.*, sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS qn FROM ti "
            f"WHERE vec_id IN (SELECT vec_id FROM rk WHERE rn > {n})) q JOIN "
            f"(SELECT label, i, c, sqrt(sum(c * c) OVER (PARTITION BY label)) AS cn FROM "
            f"(SELECT label, i, avg(x) AS c FROM ti WHERE vec_id IN (SELECT vec_id FROM rk WHERE rn <= {n}) "
            f"GROUP BY label, i)) c USING (i) GROUP BY q.vec_id, c.label, q.qn, c.cn) s) WHERE r = 1) p "
            f"USING (vec_id)")
    return (
        "WITH el AS (SELECT * FROM embeddings WHERE label IN (SELECT label FROM embeddings GROUP BY label "
        f"HAVING count(*) >= {MIN_CATEGORY_EXAMPLES})), "
        "rk AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM el), "
        "ti AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS x FROM "
        "(SELECT vec_id, label, embedding, unnest(generate_series(1, len(embedding))) AS i FROM el)) "
        + " UNION ALL ".join(parts))


@register("few_shot", _few_shot_sql())
def few_shot(spark, d):
    """Accuracy with the first n examples per category as training set (AGG-22, WIN-4, SET-5)."""
    v = tables.vectors(spark, d)
    big = (v.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
           .filter(F.col("n") >= MIN_CATEGORY_EXAMPLES).select("label"))
    v = v.join(big, "label", "left_semi")
    rank = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    # at most max(FEW_SHOTS) rows a label: Spark trims each group before the shuffle
    first = materialize(v.withColumn("rn", rank).filter(F.col("rn") <= max(FEW_SHOTS)), "first_examples")
    # a row among a label's first n trains the model of n and is a test row of the smaller ones
    tests = v.join(first.select("vec_id", "rn"), "vec_id", "left")
    for n in FEW_SHOTS:
        model = C.dense_prototypes(first.filter(F.col("rn") <= n), "embedding", "label")
        tests = C.rank_rows(C.score_rows(tests, model, "embedding", "label")).withColumn(
            f"hit{n}", F.when(F.col("rn").isNull() | (F.col("rn") > n), (F.col("predicted") == F.col("label")).cast("double"))
        ).drop("predicted", "score", "confidence", "top_labels")
    facts = tests.agg(F.array(*[F.struct(F.lit(n).alias("n_shots"), F.count(f"hit{n}").alias("n_test"), F.avg(f"hit{n}").alias("accuracy"))
                                for n in FEW_SHOTS]).alias("f"))
    return r6(facts.select(F.inline("f")))


# ============================ sparse text (documents) ======================================

def _raw_docs(spark, d):
    """documents mapped to (doc_id, source, product_title, category); empty titles dropped
    with the cheap raw-text check (cleaning never makes a title non-empty)."""
    docs = tables.read(spark, d, "documents").select("doc_id", "text", "lang", "source")
    p = map_columns(docs, {"product_title": "text", "category": "lang"}, keep=("doc_id", "source"))
    return p.filter(has_content("product_title"))


def _labelled(spark, d, by_user: bool):
    """Narrow (doc_id, [user_id], label): all the split needs — no text is carried.

    Written once, so the split's several branches read three narrow columns
    instead of re-reading whole texts for the emptiness check.
    """
    p = _raw_docs(spark, d).select("doc_id", F.col("source").alias("user_id"),
                                   py_strip("category").alias("label"))
    return materialize(p if by_user else p.drop("user_id"), "labelled_docs")


def _split_terms(spark, d, split_tbl, by_user: bool):
    """The job's term table (…, doc_id, label, split, term, tf) in blocks, from whole texts tokenised once.

    Label and split join the texts before they are cut, so nothing later looks a document up again.
    """
    by = ["user_id"] if by_user else []
    p = _raw_docs(spark, d).select("doc_id", F.col("source").alias("user_id"), "product_title")
    sizes = p.groupBy(*by).agg(F.sum(F.char_length(F.col("product_title").cast("string"))).alias("chars"))
    x = p.select("doc_id", "product_title").join(split_tbl.select(*by, "doc_id", "label", "split"), "doc_id")
    x, tasks = spread_groups(x, sizes, by, "doc_id")
    return materialize(FE.term_counts(x, "doc_id", "product_title", [*by, "label", "split"], clean=True, label="label", parts=tasks), "split_terms")


def sparse_predict(split_tbl, terms, by, key="doc_id"):
    """Scores of the test documents by TF-IDF prototypes (IDF on train), and the number of labels of each model.

    ``terms`` are ``FE.term_counts`` with columns label and split, as rows or in blocks.  IDF, norms and model are written:
    their measured sizes then decide how the joins run.
    """
    by = list(by)
    labelled = split_tbl.filter(F.col("split") == "train")
    train, test = terms.filter(F.col("split") == "train"), terms.filter(F.col("split") == "test")
    idf = materialize(FE.idf_table(train, labelled, key, by).drop("df", "tf_total", "m"), "idf")
    norms = materialize(FE.tfidf_norms(terms, idf, key, by), "document_norms")
    model = materialize(C.sparse_prototypes(train, idf, norms, key, "label", by), "term_model")
    scores = C.score_sparse(test, model, norms, key, "label", by)
    return scores, C.label_counts(labelled, by=by)


def _sparse_sql(p: str, by: list[str], sd: str) -> list[tuple[str, str]]:
    """CTEs `<p>pred(by…, doc_id, predicted, score)` over a CTE `sd(by…, doc_id, label, split, title)`."""
    b = S.cols(by)
    k = by + ["doc_id"]
    mjoin = f"JOIN {p}m {S.using(by)}" if by else f", {p}m"
    return [
        (f"{p}tf", f"SELECT {b}doc_id, term, count(*) AS tf FROM (SELECT {b}doc_id, "
                   f"unnest({S.tokens('title')}) AS term FROM {sd}) GROUP BY ALL"),
        (f"{p}trd", f"SELECT {b}doc_id, label FROM {sd} WHERE split = 'train'"),
        (f"{p}m", f"SELECT {b}count(*) AS m FROM {p}trd" + (" GROUP BY ALL" if by else "")),
        (f"{p}dfq", f"SELECT {b}term, count(*) AS df FROM {p}tf JOIN {p}trd {S.using(k)} GROUP BY ALL"),
        (f"{p}idf", f"SELECT {b}term, ln((m + 1.0) / (df + 1.0)) AS idf FROM {p}dfq {mjoin}"),
        (f"{p}w0", f"SELECT {b}doc_id, term, tf * idf AS w FROM {p}tf JOIN {p}idf {S.using(by + ['term'])} "
                   f"WHERE tf * idf > 0"),
        (f"{p}vec", f"SELECT {b}doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY {', '.join(k)})) AS w "
                    f"FROM {p}w0"),
        (f"{p}ps", f"SELECT {b}label, term, sum(w) AS s FROM {p}vec JOIN {p}trd {S.using(k)} GROUP BY ALL"),
        (f"{p}proto", f"SELECT {b}label, term, s / sqrt(sum(s * s) OVER (PARTITION BY {S.cols(by + ['label'], False)})) "
                      f"AS weight FROM {p}ps"),
        (f"{p}sc", f"SELECT {b}doc_id, label, sum(w * weight) AS score FROM {p}vec "
                   f"JOIN (SELECT {b}doc_id FROM {sd} WHERE split = 'test') {S.using(k)} "
                   f"JOIN {p}proto {S.using(by + ['term'])} GROUP BY ALL"),
        (f"{p}pred", f"SELECT {b}doc_id, label AS predicted, score FROM (SELECT *, row_number() OVER "
                     f"(PARTITION BY {', '.join(k)} ORDER BY round(score, 9) DESC, label) AS rn FROM {p}sc) "
                     f"WHERE rn = 1"),
    ]


def _sd_sql(by_user: bool, split_kind: str) -> list[tuple[str, str]]:
    """Cleaned documents with a split column as CTE `sd`."""
    uid = "source AS user_id, " if by_user else ""
    src = (f"SELECT doc_id, {uid}{S.clean('text')} AS product_title, {S.strip('lang')} AS category "
           f"FROM documents WHERE length({S.clean('text')}) > 0")
    by = ["user_id"] if by_user else []
    if split_kind == "stratified":
        sp = S.split_ctes("doc_id", "category", by, 0.2, 0.1, 42, True)
    else:
        sp = S.split_ctes("doc_id", "category", by, 0.2, 0.0, 42, False)
    return ([("src", src)] + sp +
            [("sd", f"SELECT doc_id, {'user_id, ' if by_user else ''}category AS label, split, "
                    f"product_title AS title FROM assigned")])


def _flagship_split(spark, d):
    return materialize(split.split_stratified(_labelled(spark, d, False), "doc_id", label="label",
                                              test_size=0.2, val_size=0.1), "split_docs")


@register("flagship", S.with_roles([], (
    "SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, "
    "CAST(support AS BIGINT) AS support FROM pc "
    "UNION ALL SELECT 'accuracy', NULL, NULL, round(correct / n, 6), CAST(s_sup AS BIGINT) FROM tot, av "
    "UNION ALL SELECT 'macro avg', round(macro_precision, 6), round(macro_recall, 6), round(macro_f1, 6), "
    "CAST(s_sup AS BIGINT) FROM av "
    "UNION ALL SELECT 'weighted avg', round(w_precision, 6), round(w_recall, 6), round(w_f1, 6), "
    "CAST(s_sup AS BIGINT) FROM av"),
    _sd_sql(False, "stratified") + _sparse_sql("g_", [], "sd") + [
        ("src2", "SELECT sd.label AS y_true, g_pred.predicted AS y_pred FROM sd LEFT JOIN g_pred "
                 "USING (doc_id) WHERE sd.split = 'test'")]
    + [(n, q.replace("FROM src", "FROM src2")) for n, q in S.per_class_ctes([])]))
def flagship(spark, d):
    """The training job end to end (CLS-12/13): load → validate → clean → stratified split →
    TF-IDF prototypes → score the test part → classification report."""
    validate(_raw_docs(spark, d))
    docs = _flagship_split(spark, d)
    scores, k = sparse_predict(docs, _split_terms(spark, d, docs, False), [])
    pred = C.rank_scores(scores, "doc_id", "label", k_labels=k)
    test = docs.filter(F.col("split") == "test").select("doc_id", F.col("label").alias("y_true"))
    scored = test.join(pred.select("doc_id", F.col("predicted").alias("y_pred")), "doc_id", "left")
    return r6(metrics.classification_report(scored))


@register("tfidf_terms", (
    f"WITH t AS (SELECT doc_id, unnest({S.tokens(S.clean('text'))}) AS term FROM documents "
    f"WHERE length({S.clean('text')}) > 0), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), "
    f"m AS (SELECT count(*) AS m FROM documents WHERE length({S.clean('text')}) > 0) "
    "SELECT term, count(*) AS df, sum(tf) AS tf_total, round(ln((m + 1.0) / (count(*) + 1.0)), 6) AS idf "
    "FROM tf, m GROUP BY term, m"))
def tfidf_terms(spark, d):
    """Document frequency, total term count and IDF per term over whole texts (EMB-3)."""
    raw = _raw_docs(spark, d)
    tf = FE.term_counts(spread(raw.select("doc_id", "product_title"), "doc_id", text="product_title"), "doc_id", "product_title", clean=True)
    idf = FE.idf_table(tf, raw.select("doc_id"), "doc_id")
    return r6(idf.select("term", "df", "tf_total", "idf"))


def _user_split(spark, d):
    return materialize(split.split_random(_labelled(spark, d, True), "doc_id", label="label",
                                          by=["user_id"], test_size=0.2, val_size=0.0), "split_docs")


@register("score_model_table", S.with_roles([], (
    "SELECT t.doc_id, t.user_id, u.predicted, round(u.score, 6) AS score FROM (SELECT doc_id, user_id FROM sd "
    "WHERE split = 'test') t LEFT JOIN u_pred u ON u.doc_id = t.doc_id AND u.user_id = t.user_id"),
    _sd_sql(True, "random") + _sparse_sql("u_", ["user_id"], "sd")))
def score_model_table(spark, d):
    """Per-user prototype model table scored through the model join (CLS-7, §7.2).

    A document that shares no term with its user's model has a NULL prediction.
    """
    docs = _user_split(spark, d)
    scores, k = sparse_predict(docs, _split_terms(spark, d, docs, True), ["user_id"])
    r = C.rank_scores(scores, "doc_id", "label", by=["user_id"], k_labels=k)
    return r6(_all_test_rows(docs, r.select("doc_id", "user_id", "predicted", "score")))


def _all_test_rows(docs, found):
    """Every test document with its result, NULL where it has none."""
    return docs.filter(F.col("split") == "test").select("doc_id", "user_id").join(found, ["doc_id", "user_id"], "left")


_COLD_SQL = S.with_roles([], (
    "SELECT t.doc_id, coalesce(u.predicted, g.predicted) AS predicted, "
    "CASE WHEN u.predicted IS NOT NULL THEN 'user_model' ELSE 'fallback' END AS source "
    "FROM (SELECT doc_id FROM sd WHERE split = 'test') t LEFT JOIN g_pred g USING (doc_id) "
    "LEFT JOIN (SELECT * FROM u_pred WHERE user_id IN (SELECT user_id FROM sd WHERE split = 'train' "
    f"GROUP BY user_id HAVING count(*) >= {MIN_USER_TRAIN_DOCS})) u USING (doc_id)"),
    _sd_sql(True, "random") + _sparse_sql("u_", ["user_id"], "sd")
    + [("sdg", "SELECT doc_id, label, split, title FROM sd")] + _sparse_sql("g_", [], "sdg"))


@register("cold_start", _COLD_SQL)
def cold_start(spark, d):
    """User model when the user has enough training data, else the global model (JOIN-9)."""
    docs = _user_split(spark, d)
    terms = _split_terms(spark, d, docs, True)
    enough = (docs.filter(F.col("split") == "train").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
              .filter(F.col("n") >= MIN_USER_TRAIN_DOCS).select("user_id"))
    enough = materialize(enough, "large_users")  # its measured size decides how the blocks meet it
    u_scores, u_k = sparse_predict(docs.join(enough, "user_id", "left_semi"),
                                   terms.join(enough, "user_id", "left_semi"), ["user_id"])
    u = C.rank_scores(u_scores, "doc_id", "label", by=["user_id"], k_labels=u_k)
    g_scores, g_k = sparse_predict(docs, terms, [])
    g = C.rank_scores(g_scores, "doc_id", "label", k_labels=g_k)
    test = docs.filter(F.col("split") == "test").select("doc_id")
    out = C.with_fallback(test, u, g, "doc_id")
    return out.select("doc_id", "predicted", "source")


@register("active_categories", S.with_roles([], (
    "SELECT t.doc_id, t.user_id, a.predicted FROM (SELECT doc_id, user_id FROM sd WHERE split = 'test') t LEFT JOIN "
    "(SELECT doc_id, user_id, label AS predicted FROM (SELECT sc.*, row_number() OVER (PARTITION BY "
    "user_id, doc_id ORDER BY round(score, 9) DESC, label) AS rn FROM u_sc sc WHERE (user_id, label) IN "
    f"(SELECT user_id, label FROM sd WHERE split = 'train' GROUP BY ALL HAVING count(*) >= {MIN_ACTIVE_DOCS})) "
    "WHERE rn = 1) a ON a.doc_id = t.doc_id AND a.user_id = t.user_id"),
    _sd_sql(True, "random") + _sparse_sql("u_", ["user_id"], "sd")))
def active_categories(spark, d):
    """Arg-max restricted to each user's own active categories (JOIN-11)."""
    docs = _user_split(spark, d)
    scores, _ = sparse_predict(docs, _split_terms(spark, d, docs, True), ["user_id"])
    active = (docs.filter(F.col("split") == "train").groupBy("user_id", "label")
              .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_ACTIVE_DOCS))
    s = C.restrict_labels(scores, active, "label", ["user_id"])
    r = C.rank_scores(s, "doc_id", "label", by=["user_id"])
    return _all_test_rows(docs, r.select("doc_id", "user_id", "predicted"))


# ============================ similar items (exact) ==========================================

@register("knn_exact", _dense_sql(
    "SELECT query_id, item_id, rank, round(cosine, 6) AS cosine FROM ("
    "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, item_id) AS rank FROM ("
    "SELECT q.vec_id AS query_id, t.vec_id AS item_id, "
    "CASE WHEN qn.n * tn.n = 0 THEN 0.0 ELSE sum(q.x * t.x) / (qn.n * tn.n) END AS cosine "
    "FROM tei q JOIN tri2 t USING (i) JOIN qn2 qn ON qn.vec_id = q.vec_id JOIN tn ON tn.vec_id = t.vec_id "
    "GROUP BY q.vec_id, t.vec_id, qn.n, tn.n)) WHERE rank <= 5",
    extra=[("tri2", "SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS x FROM "
                    "(SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM tr)"),
           ("tn", "SELECT vec_id, sqrt(sum(x * x)) AS n FROM tri2 GROUP BY vec_id"),
           ("qn2", "SELECT vec_id, sqrt(sum(x * x)) AS n FROM tei GROUP BY vec_id")]))
def knn_exact(spark, d):
    """Top-5 most similar training vectors of every test vector, exact (JOIN-10, SORT-5)."""
    s = _vectors_split(spark, d)
    q = s.filter(F.col("split") == "test").select("vec_id", "embedding")
    c = s.filter(F.col("split") == "train").select("vec_id", "embedding")
    out = NB.nearest_exact(q, c, "vec_id", "embedding", k=5)
    return r6(out.select("query_id", "item_id", "rank", "cosine"))


@register("user_linear_models", (
    "WITH c AS (SELECT vec_id % 25 AS user_id, label, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY ALL) "
    "SELECT user_id, label, n, round(CAST(sum(n) OVER u AS DOUBLE) / (count(*) OVER u * n), 6) AS weight, "
    "round(1.0 / count(*) OVER u, 6) AS mean_probability, true AS converged FROM c WINDOW u AS (PARTITION BY user_id)"))
def user_linear_models(spark, d):
    """One logistic regression per user, scored over the user's rows (CLS-7, CLS-9).

    At the optimum the free intercepts make every label's weighted mean probability equal its share
    of the weight, 1/k under balanced weights: a fact of the fit that SQL can state.
    """
    rows = tables.vectors(spark, d).withColumn("user_id", F.col("vec_id") % 25).filter(F.col("label").isNotNull())
    model = materialize(fit_linear_by_group(rows, "embedding", "label", ["user_id"], tol=1e-8), "user_linear_models")
    weights = class_weights(rows, "label", ["user_id"])
    p = C.linear_probabilities(rows.join(weights.select("user_id", "label", "weight"), ["user_id", "label"])
                               .withColumn("row", F.struct("vec_id", "weight")), model, "row", "embedding", "label", ["user_id"])
    p = p.select("user_id", "row.weight", F.explode("probabilities").alias("p"))
    mean = p.groupBy("user_id", F.col("p.label").alias("label")).agg(
        (F.sum(F.col("weight") * F.col("p.probability")) / F.sum("weight")).alias("mean_probability"))
    facts = model.select("user_id", "label", "converged").join(weights.select("user_id", "label", "n", "weight"), ["user_id", "label"])
    return r6(facts.join(mean, ["user_id", "label"]).select("user_id", "label", "n", "weight", "mean_probability", "converged"))


# ============================ zero-shot (category names as models) ========================

def _grams_sql(rel: str) -> str:
    return (f"SELECT k, substr(t, i, {FE.GRAM}) AS term, count(*) AS tf FROM "
            f"(SELECT k, t, unnest(range(1, length(t) - {FE.GRAM - 2})) AS i FROM {rel}) GROUP BY ALL")


def _projected_sql(grams: str) -> str:
    return (f"SELECT k, CAST('0x' || substr(md5(term), 1, 4) AS INT) % {FE.PROJECTED} AS i, "
            "sum(tf * coalesce(idf, ln(m + 1.0)) * CASE WHEN CAST('0x' || substr(md5(term), 5, 1) AS INT) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS w "
            f"FROM {grams} LEFT JOIN idf USING (term), m GROUP BY ALL")


@register("zero_shot", (
    f"WITH titles AS (SELECT p_partkey AS k, ' ' || {S.clean('p_name')} || ' ' AS t FROM part), "
    f"names AS (SELECT DISTINCT p_type AS k, ' ' || {S.clean('p_type')} || ' ' AS t FROM part WHERE p_type IS NOT NULL), "
    f"tg AS ({_grams_sql('titles')}), ng AS ({_grams_sql('names')}), m AS (SELECT count(*) AS m FROM titles), "
    "idf AS (SELECT term, ln((m + 1.0) / (count(*) + 1.0)) AS idf FROM tg, m GROUP BY term, m), "
    f"tv AS ({_projected_sql('tg')}), nv AS ({_projected_sql('ng')}), "
    "tn AS (SELECT k, sqrt(sum(w * w)) AS norm FROM tv GROUP BY k), nn AS (SELECT k, sqrt(sum(w * w)) AS norm FROM nv GROUP BY k), "
    "dots AS (SELECT tv.k, nv.k AS label, sum(tv.w * nv.w) AS dot FROM tv JOIN nv USING (i) GROUP BY ALL), "
    "sc AS (SELECT titles.k, names.k AS label, coalesce(dot / nullif(tn.norm * nn.norm, 0), 0) AS s FROM titles CROSS JOIN names "
    "LEFT JOIN dots ON dots.k = titles.k AND dots.label = names.k LEFT JOIN tn ON tn.k = titles.k LEFT JOIN nn ON nn.k = names.k), "
    "b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(s, 9) DESC, label) AS rn, "
    "first_value(s) OVER (PARTITION BY k ORDER BY round(s, 9) DESC, label) AS top FROM sc) "
    "SELECT k AS p_partkey, max(label) FILTER (rn = 1) AS predicted, "
    f"round(1.0 / sum(exp((s - top) / {T})), 6) AS confidence FROM b GROUP BY k"))
def zero_shot(spark, d):
    """Titles against the names of the categories, both projected by the same encoder (CLS-6, EMB-1, EMB-2)."""
    scan = tables.products_short(spark, d)
    names = scan.filter("category IS NOT NULL").select("category").distinct()
    titles = spread(scan.select("p_partkey", "product_title"), "p_partkey", text="product_title", chars=1_000_000)  # a gram at each character
    idf = FE.idf_table(FE.char_grams(titles, "p_partkey", "product_title"), titles.select("p_partkey"), "p_partkey")
    idf = materialize(idf, "gram_idf")
    x = FE.project_text(titles, "p_partkey", "product_title", idf)
    models = FE.project_text(names, "category", "category", idf).select(F.col("category").alias("label"), F.col("embedding").alias("coef"))
    return r6(score_packed(x, pack_model(models), "embedding").select("p_partkey", "predicted", "confidence"))
