import numpy as np

from labelfold.streaming import feedback_stream as FS


def _write_batches(spark, root, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "user_id long, vec_id long, embedding array<float>, label string") \
            .coalesce(1).write.parquet(f"{root}/part{i}")


def test_retrain_due_users(spark, tmp_path):
    rng = np.random.default_rng(0)
    batches = []
    vid = 0
    for sizes in ({1: 6, 2: 2}, {1: 3, 2: 4}, {2: 5}):
        rows = []
        for u, n in sizes.items():
            for _ in range(n):
                rows.append((u, vid, [float(x) for x in rng.normal(size=4)], "ab"[vid % 2]))
                vid += 1
        batches.append(rows)
    src = str(tmp_path / "src")
    for i, b in enumerate(batches):
        _write_batches(spark, f"{src}/b{i}", [b])
    schema = "user_id long, vec_id long, embedding array<float>, label string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", "true").parquet(src)
    q = FS.retrain_due_users(stream, str(tmp_path / "train"), str(tmp_path / "models"), every=5)
    q.awaitTermination()
    models = spark.read.parquet(str(tmp_path / "models"))
    versions = {(r["user_id"], r["model_version"]) for r in models.select("user_id", "model_version").distinct().collect()}
    # user 1: 6 rows in batch 0 → refit at 0; user 2: 2+4=6 at batch 1 → refit; 5 more at batch 2 → refit
    assert versions == {(1, 0), (2, 1), (2, 2)}
    act = FS.active_models(spark, str(tmp_path / "models"))
    allrows = spark.read.parquet(str(tmp_path / "train")).filter("user_id = 2").collect()
    for r in act.filter("user_id = 2").collect():
        vecs = np.array([x["embedding"] for x in allrows if x["label"] == r["label"]], dtype=float)
        assert np.allclose(r["coef"], vecs.mean(0))


def test_duplicates_go_and_triggers_fire(spark, tmp_path):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    ev = [(i, t0 + dt.timedelta(minutes=i), i % 2, "purchase" if i % 3 else "error", 1.0, '{"k": 7}')
          for i in range(40)]
    ev += ev[:10]  # replayed duplicates
    src = str(tmp_path / "events")
    spark.createDataFrame(ev, "event_id long, ts timestamp_ntz, user_id long, event_type string, "
                          "value double, props string").coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).parquet(src)
    job = str(tmp_path / "job")
    rows = FS.run_ingest(FS.ingest_training_rows(stream), "t_ingest", job)
    assert rows.count() == 40 and rows.select("event_id").distinct().count() == 40
    trig = FS.run_update_latest(FS.retrain_trigger_stream(
        FS.ingested_stream(spark, FS.ingest_training_rows(stream), "t_ingest", job), every=7),
                                "t_trig", "user_id")
    got = {r["user_id"]: (r["n_examples"], r["fires"]) for r in trig.collect()}
    assert got == {0: (20, 2), 1: (20, 2)}


def test_live_windows_append_mode_emits_closed_windows(spark):
    d = "/root/testdata/sf0.001"
    closed = FS.run_append(FS.live_acceptance(FS.table_stream(spark, d, "events")), "t_live_append")
    full = FS.run_complete(FS.live_acceptance(FS.table_stream(spark, d, "events")), "t_live_complete")
    n_closed, n_full = closed.count(), full.count()
    assert 0 < n_closed < n_full                      # the still-open last window is not emitted
    assert closed.join(full, "w").filter(closed["n"] != full["n"]).count() == 0
