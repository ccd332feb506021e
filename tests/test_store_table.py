import threading

from labelfold.sources.commits import TableSet
from labelfold.sources.store_table import merge_stores, stores


def _batch(spark, rows):
    return spark.createDataFrame(rows, "user_id long, name string")


def _all(table):
    return sorted((r["user_id"], r["name"], r["store_key"]) for r in stores(table).collect())


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    table = TableSet(spark, str(tmp_path / "t"))
    assert stores(table).count() == 0
    rows = [(1, "Lidl"), (1, "Lidl"), (2, "Lidl"), (1, "Ä б"), (1, ""), (None, "x"), (1, None)]
    assert merge_stores(table, _batch(spark, rows)) == 4
    before, version = _all(table), table.manifest()["version"]
    assert [r[:2] for r in before] == [(1, ""), (1, "Lidl"), (1, "Ä б"), (2, "Lidl")]
    assert merge_stores(table, _batch(spark, rows)) == 0 and merge_stores(table, _batch(spark, [])) == 0
    assert _all(table) == before and table.manifest()["version"] == version


def test_known_keys_stay_and_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = TableSet(spark, str(tmp_path / "t"))
    known = spark.createDataFrame([(1, f"s{i}", str(i)) for i in range(200)], "user_id long, name string, store_key string")
    assert merge_stores(table, known) == 200
    old = table.manifest()["tables"]
    assert merge_stores(table, _batch(spark, [(1, "s7"), (1, "new")])) == 1
    now = table.manifest()["tables"]
    assert sum(old.get(k) != v for k, v in now.items()) == 1
    got = {r[1]: r[2] for r in _all(table)}
    assert len(got) == 201 and got["s7"] == "7" and got["new"].startswith("new-")


def test_concurrent_batches_leave_one_row_a_name(spark, tmp_path, monkeypatch):
    """Both look their names up before either publishes; the loser must look again, or only publish again."""
    root, meet, first = str(tmp_path / "t"), threading.Barrier(2), threading.local()
    real = TableSet.commit

    def commit(self, *args):
        if not getattr(first, "done", False):
            first.done = True
            meet.wait(60)
        return real(self, *args)
    monkeypatch.setattr(TableSet, "commit", commit)
    made, faults = {}, []

    def run(k, rows):
        try:
            made[k] = merge_stores(TableSet(spark, root), _batch(spark, rows))
        except Exception as e:  # a thread's failure must fail the test
            faults.append(e)
            meet.abort()
    shared = [(1, f"s{i}") for i in range(5)]
    jobs = [threading.Thread(target=run, args=(k, shared + [(k, f"own{k}")])) for k in (1, 2)]
    [j.start() for j in jobs]
    [j.join(120) for j in jobs]
    assert not faults and sorted(made.values()) == [1, 6]
    rows = _all(TableSet(spark, root))
    assert len(rows) == len({r[:2] for r in rows}) == 7


def test_a_writer_that_dies_before_its_commit_leaves_no_row(spark, tmp_path, monkeypatch):
    import pytest
    table = TableSet(spark, str(tmp_path / "t"))
    merge_stores(table, _batch(spark, [(1, "a")]))
    before = _all(table)

    def dies(self, *args):
        raise RuntimeError("killed")
    with monkeypatch.context() as m:
        m.setattr(TableSet, "commit", dies)
        with pytest.raises(RuntimeError):
            merge_stores(table, _batch(spark, [(1, "a"), (1, "b")]))
    assert _all(table) == before
    assert merge_stores(table, _batch(spark, [(1, "a"), (1, "b")])) == 1 and len(_all(table)) == 2
