import datetime as dt
import random

import pytest

from labelfold.streaming import feedback_stream as FS
from labelfold.streaming import retrain_trigger as RT

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "user_id long, created_at timestamp, event_id long"
DAY = dt.timedelta(days=1)


def simulate(batches, every, watermark_at_end):
    """The rule taken literally: examples in order of arrival, a batch's by time; the clock is looked at before each."""
    state, fires = {}, []

    def fire(user, at, reason):
        s = state[user]
        s["fires"], s["n"], s["last"] = s["fires"] + 1, 0, at
        fires.append((user, s["fires"], at, reason))

    for batch in batches:
        for user, t, _ in sorted(batch, key=lambda r: (r[1], r[2])):
            s = state.setdefault(user, {"n": 0, "last": t, "latest": t, "fires": 0})
            t = s["latest"] = max(t, s["latest"])
            if s["n"] and t >= s["last"] + DAY:
                fire(user, s["last"] + DAY, "periodic")
            s["n"] += 1
            if s["n"] >= every:
                fire(user, t, "feedback_threshold")
            elif t >= s["last"] + DAY:
                fire(user, t, "periodic")
    for user, s in state.items():
        if s["n"] and s["last"] + DAY <= watermark_at_end:
            fire(user, s["last"] + DAY, "periodic")
    return sorted(fires)


def made(seed, users=6, days=9, n=260):
    rng = random.Random(seed)
    rows = [(min(int(rng.expovariate(0.5)), users), T0 + dt.timedelta(seconds=rng.randint(0, days * 86400)), i) for i in range(n)]
    return sorted(rows, key=lambda r: r[1])


def run(spark, folder, job, every=4):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    out = FS.run_append(RT.retrain_fires(stream, every=every), "t_fires", job)
    return sorted((r.user_id, r.fire, r.fired_at, r.reason) for r in out.collect())


def put(spark, folder, k, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/b{k}")


@pytest.mark.parametrize("cuts", [1, 4])
def test_fires_do_not_depend_on_batches(spark, tmp_path, cuts):
    rows = made(1)
    folder = str(tmp_path / "in")
    size = -(-len(rows) // cuts)
    parts = [rows[i:i + size] for i in range(0, len(rows), size)]
    for k, part in enumerate(parts):
        put(spark, folder, k, part)
    want = simulate([rows], 4, rows[-1][1] - dt.timedelta(hours=1))
    got = run(spark, folder, str(tmp_path / "job"))
    assert got == want
    assert {r for *_, r in got} == {"feedback_threshold", "periodic"}


def test_restart_goes_on_and_late_examples_count(spark, tmp_path):
    rows, folder, job = made(2), str(tmp_path / "in"), str(tmp_path / "job")
    half = len(rows) // 2
    put(spark, folder, 0, rows[:half])
    first = run(spark, folder, job)
    assert first == simulate([rows[:half]], 4, rows[half - 1][1] - dt.timedelta(hours=1))
    assert run(spark, folder, job) == first  # nothing new, nothing twice
    # a late batch: days behind the watermark, for a user of its own and for others
    late = [(9, T0 + dt.timedelta(minutes=k), 1000 + k) for k in range(9)] + [(0, T0, 2000)]
    put(spark, folder, 1, late)
    got = run(spark, folder, job)
    assert [r[:2] + r[3:] for r in got if r[0] == 9][:2] == [(9, 1, "feedback_threshold"), (9, 2, "feedback_threshold")]
    assert len([r for r in got if r[0] == 9]) == 3  # the ninth example waits a day; the watermark has passed it
    put(spark, folder, 2, rows[half:])
    got = run(spark, folder, job)
    assert all(f in got for f in first)
    numbers = {}
    for user, fire, *_ in got:
        numbers.setdefault(user, []).append(fire)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in numbers.values())
    # without the late rows of other users the answer would be that of one run
    others = {u for u, *_ in late}
    assert [r for r in got if r[0] not in others] == [r for r in simulate([rows], 4, rows[-1][1] - dt.timedelta(hours=1)) if r[0] not in others]
