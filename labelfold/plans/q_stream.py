"""Queries: Structured Streaming jobs replayed with ``availableNow`` (STRM-1..7).

Each returns the sink's content read back as a DataFrame, to be compared with
the batch SQL over the same table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import classify as C
from ..session import checkpoint_path
from ..streaming import feedback_stream as FS
from ..sources import tables
from ..streaming import retrain_trigger as RT
from ..streaming import latency_sketches as LS
from ..streaming import retraining as RE
from . import q_models
from . import sqlgen as S
from .registry import r6, register

WFMT = "yyyy-MM-dd HH:mm:ss"

register("stream_feedback", S.with_roles(["feedback"], (
    "SELECT event_id, user_id, CASE WHEN feedback_type = 'correction' THEN correct_category_id "
    "ELSE predicted_category_id END AS label, CASE WHEN feedback_type = 'correction' THEN 'user_feedback' "
    "ELSE 'auto_confirmed' END AS source FROM feedback "
    "WHERE feedback_type IN ('confirmation', 'correction') AND is_used_for_training")))(
    lambda spark, d: FS.run_ingest(FS.ingest_training_rows(FS.table_stream(spark, d, "events")),
                                   "stream_feedback"))


@register("stream_acceptance", S.with_roles(["feedback"], (
    "SELECT strftime(date_trunc('day', created_at), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, "
    "round(avg(CASE WHEN feedback_type IS NULL OR feedback_type = 'confirmation' THEN 1.0 ELSE 0.0 END), 6) "
    "AS acceptance_rate, round(avg(CASE WHEN feedback_type = 'correction' THEN 1.0 ELSE 0.0 END), 6) "
    "AS correction_rate FROM feedback GROUP BY ALL")))
def stream_acceptance(spark, d):
    out = FS.run_complete(FS.live_acceptance(FS.table_stream(spark, d, "events")), "stream_acceptance")
    return r6(out.select(F.date_format("w.start", WFMT).alias("window_start"), "n",
                         "acceptance_rate", "correction_rate"))


@register("stream_latency_counts", (
    "WITH e AS (SELECT ts, value, event_type = 'error' AS is_error, "
    "time_bucket(INTERVAL 15 MINUTES, ts) AS b FROM events), "
    "x AS (SELECT *, b - k * INTERVAL 15 MINUTES AS ws FROM e, range(0, 4) r(k)) "
    f"SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, "
    f"strftime(ws + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, count(*) AS n, "
    "sum(CASE WHEN is_error THEN 1 ELSE 0 END) AS n_errors, round(avg(value), 6) AS avg_latency_ms "
    "FROM x GROUP BY ws"))
def stream_latency_counts(spark, d):
    out = FS.run_complete(FS.live_latency(FS.table_stream(spark, d, "events")), "stream_latency")
    return r6(out.select(F.date_format("w.start", WFMT).alias("window_start"),
                         F.date_format("w.end", WFMT).alias("window_end"), "n", "n_errors",
                         "avg_latency_ms"))


_NTH = "list_sort(list(value) FILTER (value IS NOT NULL))[CAST(greatest(1, ceil({p} * count(value))) AS BIGINT)]"


@register("stream_latency", (
    "WITH e AS (SELECT ts, value, event_type = 'error' AS is_error, "
    f"time_bucket(INTERVAL {LS.PANE_MINUTES} MINUTES, ts) AS b FROM events), "
    f"x AS (SELECT *, b - k * INTERVAL {LS.PANE_MINUTES} MINUTES AS ws FROM e, range(0, 4) r(k)) "
    "SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, "
    "CAST(sum(CASE WHEN is_error THEN 1 ELSE 0 END) AS BIGINT) AS n_errors, round(avg(value), 6) AS avg_latency_ms, "
    + ", ".join(f"round({_NTH.format(p=p)}, 6) AS p{p * 100:g}" for p in LS.PERCENTILES) + " FROM x GROUP BY ws"))
def stream_latency(spark, d):
    """Live p50/p95/p99 of one-hour windows, merged from the sketches of all batches (STRM-3); exact
    up to ``LS.K`` latencies a window, beyond within the sketch's rank error."""
    parts = LS.run_panes(FS.table_stream(spark, d, "events"), "stream_latency_panes", error=F.col("event_type") == "error")
    return r6(LS.merged(parts).withColumn("window_start", F.date_format("window_start", WFMT)))


@register("retrain_triggers", S.with_roles(["feedback"], (
    "SELECT user_id, count(*) AS n_examples, count(*) // 10 AS fires FROM feedback "
    "WHERE feedback_type IN ('confirmation', 'correction') AND is_used_for_training GROUP BY user_id")))
def retrain_triggers(spark, d):
    rows = FS.ingest_training_rows(FS.table_stream(spark, d, "events"))
    job = checkpoint_path(spark, f"streams/retrain_triggers-{uuid.uuid4().hex[:12]}")
    FS.run_ingest(rows, "retrain_rows", job)
    once = FS.ingested_stream(spark, rows, "retrain_rows", job)
    out = FS.run_update_latest(FS.retrain_trigger_stream(once, every=10), "retrain_triggers", "user_id")
    return out.select("user_id", "n_examples", "fires")


_FIRES = """WITH RECURSIVE {roles},
ex AS (SELECT user_id, epoch_us(created_at) AS t, row_number() OVER (PARTITION BY user_id ORDER BY created_at, event_id) AS i
  FROM feedback WHERE feedback_type IN ('confirmation', 'correction') AND is_used_for_training),
st AS (
  SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS n, t AS last, CAST(0 AS BIGINT) AS fires, CAST(NULL AS BIGINT) AS aged_at,
    CAST(NULL AS VARCHAR) AS reason FROM ex WHERE i = 1
  UNION ALL
  SELECT user_id, i, CASE WHEN reason IS NULL THEN n ELSE 0 END, CASE WHEN reason IS NULL THEN last ELSE t END,
    fires + CASE WHEN reason IS NULL THEN 0 ELSE 1 END, aged_at, reason
  FROM (SELECT *, CASE WHEN n >= {every} THEN 'feedback_threshold' WHEN t >= last + {day} THEN 'periodic' END AS reason
    FROM (SELECT ex.user_id, ex.i, ex.t, CASE WHEN st.n > 0 AND ex.t >= st.last + {day} THEN 1 ELSE st.n + 1 END AS n,
            CASE WHEN st.n > 0 AND ex.t >= st.last + {day} THEN st.last + {day} ELSE st.last END AS last,
            st.fires + CASE WHEN st.n > 0 AND ex.t >= st.last + {day} THEN 1 ELSE 0 END AS fires,
            CASE WHEN st.n > 0 AND ex.t >= st.last + {day} THEN st.last + {day} END AS aged_at
          FROM st JOIN ex ON ex.user_id = st.user_id AND ex.i = st.i + 1))),
fired AS (
  SELECT user_id, fires - CASE WHEN reason IS NULL THEN 0 ELSE 1 END AS fire, aged_at AS fired_us, 'periodic' AS reason FROM st WHERE aged_at IS NOT NULL
  UNION ALL SELECT user_id, fires, last, reason FROM st WHERE reason IS NOT NULL
  UNION ALL SELECT user_id, fires + 1, last + {day}, 'periodic'
  FROM (SELECT user_id, max(i) AS i FROM st GROUP BY user_id) JOIN st USING (user_id, i)
  WHERE n > 0 AND last + {day} <= (SELECT max(t) FROM ex) - 3600000000)
SELECT user_id, fire, strftime(make_timestamp(fired_us), '%Y-%m-%d %H:%M:%S.%f') AS fired_at, reason FROM fired"""


@register("retrain_fires", _FIRES.format(roles=S.with_roles(["feedback"], "").strip().removeprefix("WITH "), every=3, day=RT.DAY_US))
def retrain_fires(spark, d):
    """Every fire of every user: the third example since the last fire, or a model of 24 h with new examples."""
    rows = FS.ingest_training_rows(FS.table_stream(spark, d, "events"), with_time=True)
    job = checkpoint_path(spark, f"streams/retrain_fires-{uuid.uuid4().hex[:12]}")
    FS.run_ingest(rows, "retrain_fire_rows", f"{job}/ingest")
    once = FS.ingested_stream(spark, rows, "retrain_fire_rows", f"{job}/ingest")
    fires = FS.run_append(RT.retrain_fires(once, every=3), "retrain_fires", f"{job}/fires")
    return fires.select("user_id", "fire", F.date_format("fired_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("fired_at"), "reason")


@register("retrain_history", S.with_roles(["feedback"], (
    "WITH ex AS (SELECT user_id, event_id, created_at, feedback_type = 'correction' AS corrected, user_id * 1000 + event_id % 40 AS tx, "
    "CASE WHEN feedback_type = 'correction' THEN correct_category_id ELSE predicted_category_id END AS label FROM feedback "
    "WHERE feedback_type IN ('confirmation', 'correction') AND is_used_for_training), "
    "s AS (SELECT * FROM ex QUALIFY row_number() OVER (PARTITION BY tx ORDER BY corrected DESC, created_at DESC, label) = 1) "
    "SELECT user_id, CASE WHEN count(DISTINCT label) >= 2 THEN 'completed' ELSE 'failed' END AS status, count(*) AS n_samples, "
    "count(DISTINCT label) AS n_categories, CASE WHEN count(DISTINCT label) >= 2 THEN count(DISTINCT label) ELSE 0 END AS n_coefs FROM s "
    "WHERE user_id IN (SELECT user_id FROM ex GROUP BY user_id HAVING count(*) >= 10) GROUP BY user_id")))
def retrain_history(spark, d):
    """The training run of every due user: SET-4 size, labels, status, and rows of its model (STRM-5)."""
    vectors = tables.vectors(spark, d).select("vec_id", "embedding")
    n = vectors.select(F.count("*")).scalar()
    events = FS.ingest_training_rows(FS.table_stream(spark, d, "events"), with_time=True).drop("day")
    # examples carry the vector's id; the vectors join where a model is fitted
    rows = (events.withColumn("vec_id", F.pmod(F.col("event_id"), n)).join(vectors.select("vec_id"), "vec_id")
            .select((F.col("user_id") * 1000 + F.col("event_id") % 40).alias("transaction_id"), "user_id", "label", "source", "created_at", "vec_id"))
    root = checkpoint_path(spark, f"streams/retrain_history-{uuid.uuid4().hex[:12]}")
    RE.retrain_stream(rows, root, every=10, vectors=vectors.dropDuplicates(["vec_id"]), vector_key="vec_id").awaitTermination()
    states, models = RE.run_states(spark, root), RE.current_models(spark, root)
    sizes = models.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_coefs"))
    return (states.join(sizes, "user_id", "left").filter("converged IS NULL OR converged")
            .select("user_id", "status", "n_samples", "n_categories", F.coalesce("n_coefs", F.lit(0)).cast("long").alias("n_coefs")))


@register("prototype_incremental", (
    "WITH t AS (SELECT label, i, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT label, embedding, "
    "unnest(generate_series(1, len(embedding))) AS i FROM embeddings)) "
    "SELECT label, CAST(count(*) AS BIGINT) AS n, i, round(avg(x), 6) AS c FROM t GROUP BY label, i"))
def prototype_incremental(spark, d):
    st = FS.incremental_prototypes(FS.table_stream(spark, d, "embeddings"), "prototype_incremental")
    return r6(st.select("label", F.col("n").cast("bigint").alias("n"),
                        F.posexplode("centroid").alias("i", "c"))
              .withColumn("i", F.col("i") + 1))


@register("stream_score", q_models._dense_sql(
    "SELECT vec_id, label AS predicted, round(probability, 6) AS confidence FROM pr WHERE rn = 1"))
def stream_score(spark, d):
    """Stream–static scoring against the trained global prototype table (STRM-6)."""
    s = q_models._vectors_split(spark, d)
    model = C.dense_prototypes(s.filter(F.col("split") == "train"), "embedding", "label")
    test_ids = s.filter(F.col("split") == "test").select("vec_id")
    stream = FS.table_stream(spark, d, "embeddings").join(test_ids, "vec_id")
    scored = FS.score_packed(stream.select("vec_id", "embedding"), FS.pack_model(model), "embedding")
    out = FS.run_append(scored.select("vec_id", "predicted", "confidence"), "stream_score")
    return r6(out)
