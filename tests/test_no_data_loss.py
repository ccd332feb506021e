"""Cases that one file, one batch and small trees cannot show."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from labelfold.operators import ledger
from labelfold.plans import jobs
from labelfold.sources.csv_source import read_labelled_csv
from labelfold.streaming import feedback_stream as FS

SF = "/root/testdata/sf0.001"
EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _events(n=400):
    t0 = dt.datetime(2024, 1, 1)
    return [(i, t0 + dt.timedelta(hours=i), i % 7, "purchase" if i % 3 else "error", 1.0, '{"k": 7}') for i in range(n)]


def test_stream_of_a_folder_table_reads_all_rows(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    one = FS.run_ingest(FS.ingest_training_rows(FS.table_stream(spark, SF, "events")), "t_file")
    many = FS.run_ingest(FS.ingest_training_rows(FS.table_stream(spark, str(tmp_path), "events")), "t_folder")
    assert one.count() > 0 and sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_late_rows_stay_and_duplicates_go(spark, tmp_path):
    events = _events()
    src = str(tmp_path / "events.parquet")
    for part in (events[300:], events[:100] + events[350:], events[200:300], events[100:200] + events[:20]):  # not in time order
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(src)
    stream = FS.table_stream(spark, str(tmp_path), "events")
    rows = FS.run_ingest(FS.ingest_training_rows(stream), "t_late")
    assert rows.count() == 400 == rows.select("event_id").distinct().count()


def test_ingest_resumes_from_its_folder(spark, tmp_path):
    events, src, job = _events(), str(tmp_path / "events.parquet"), str(tmp_path / f"job-{uuid.uuid4().hex}")
    for part in (events[:150], events[100:]):
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(src)
        n = FS.run_ingest(FS.ingest_training_rows(FS.table_stream(spark, str(tmp_path), "events")), "t_resume", job).count()
    assert n == 400


def _retrain(spark, tmp_path, job):
    schema = "user_id long, vec_id long, embedding array<float>, label string"
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "src"))
    FS.retrain_due_users(stream, str(tmp_path / "train"), str(tmp_path / "models"), every=5, job=job).awaitTermination()
    return spark.read.parquet(str(tmp_path / "train")).count()


@pytest.mark.parametrize("fixed", [True, False])
def test_two_starts_keep_all_training_rows(spark, tmp_path, fixed):
    counts = []
    for run in range(2):
        rows = [(1, 10 * run + i, [float(i), 1.0], "ab"[i % 2]) for i in range(6)]
        path = str(tmp_path / "src" / f"b{run}") if fixed else str(tmp_path / "src")
        spark.createDataFrame(rows, "user_id long, vec_id long, embedding array<float>, label string") \
            .coalesce(1).write.mode("overwrite").parquet(path)
        counts.append(_retrain(spark, tmp_path, str(tmp_path / "job") if fixed else str(tmp_path / f"job{run}")))
    assert counts == [6, 12]
    active = FS.active_models(spark, str(tmp_path / "models"))
    assert active.select("model_version").distinct().count() == 1


def test_tree_of_any_depth_and_faults(spark):
    chain = [(str(i), str(i - 1) if i else None) for i in range(80)]
    odd = [("x", "y"), ("y", "x"), ("z", "x"), ("o", "gone"), ("p", "o")]
    nodes = spark.createDataFrame(chain + odd, "id string, parent_id string")
    rows = {r.id: r for r in ledger.tree_paths(nodes).collect()}
    assert len(rows) == 80 and rows["79"].depth == 79 and rows["79"].path == "/".join(str(i) for i in range(80))
    faults = {r.id: r.fault for r in ledger.tree_faults(nodes).collect()}
    assert faults == {"x": "cycle", "y": "cycle", "z": "cycle", "o": "missing parent", "p": "missing parent"}


def test_tree_of_over_a_million_nodes(spark):
    n = 1_200_000
    nodes = spark.range(n).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") > 0, F.floor((F.col("id") - 1) / 50).cast("string")).alias("parent_id"))
    assert ledger.tree_paths(nodes).count() == n


@pytest.mark.parametrize("row", ["B,y,,lost", "C,z,", 'D,"a,b",c'])
@pytest.mark.parametrize("multi_line", [True, False])
def test_over_long_csv_rows_fail(spark, tmp_path, row, multi_line):
    path = tmp_path / "a.csv"
    path.write_text(f"t,c\nA,x\n{row}\n")
    with pytest.raises(Exception, match="more fields"):
        read_labelled_csv(spark, str(path), multi_line=multi_line).collect()
    path.write_text('t,c\nA,x\nB\n"q,""r",y\n')
    assert [tuple(r) for r in read_labelled_csv(spark, str(path), multi_line=multi_line).collect()] == [("A", "x"), ("B", None), ('q,"r', "y")]


def test_row_keys_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("text").alias("product_title"), F.col("lang").alias("category"))
    docs = docs.unionByName(docs.limit(20))
    key = lambda df: sorted((r._row, r.category) for r in jobs.content_keys(df).collect())
    rows = key(docs.repartition(2))
    assert rows == key(docs.repartition(7)) and len({k for k, _ in rows}) == docs.count()


def test_checkpoint_folder_of_one_machine_is_refused(spark, monkeypatch):
    from labelfold import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()
    with pytest.raises(ValueError, match="share"):
        session.ensure_checkpoint_dir(Session())
