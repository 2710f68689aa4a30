"""Streams over a table of many files in no order of time."""

import os
import shutil

import pytest

from attesta.plans import streams

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query", [streams.stream_once, streams.stream_counters])
def test_many_batches_count_all_events(spark, tmp_path, query):
    rows = spark.read.parquet(f"{SF}/events.parquet").toPandas().sort_values("ts", ascending=False)
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    folder = tmp_path / "sf" / "events.parquet"
    folder.mkdir(parents=True)
    step = len(rows) // 4 + 1
    for i in range(4):  # the newest events come first; Spark drops late rows from the third batch on
        spark.createDataFrame(rows[i * step : (i + 1) * step], schema).coalesce(1).write.parquet(str(tmp_path / f"{i}"))
        shutil.copy(next((tmp_path / f"{i}").glob("*.parquet")), folder / f"{i}.parquet")
        os.utime(folder / f"{i}.parquet", (1_700_000_000 + 100 * i,) * 2)
    got = sorted(map(tuple, query(spark, str(tmp_path / "sf"), per_batch=1).collect()))
    assert got == sorted(map(tuple, query(spark, SF).collect()))


CALLS = "event_id long, ts timestamp, network long, workspace_id string, kind string"


def some_calls(hours):
    from datetime import datetime, timedelta

    out = []
    for k in range(60 * len(hours)):
        at = datetime(2024, 1, 1) + timedelta(hours=hours[k // 60], seconds=53 * (k % 60))
        out.append((k + 1000 * hours[0], at, k * 7 % 5, f"w{k % 3}", ["stance", "draft", "other"][k % 3 % 2 + k % 2]))
    return out


def put(spark, rows, schema, folder, name, at):
    """One Parquet file of the rows, as old as ``at`` says."""
    tmp = folder / f"tmp-{name}"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp))
    (folder / "in").mkdir(exist_ok=True)
    shutil.copy(next(tmp.glob("*.parquet")), folder / "in" / f"{name}.parquet")
    os.utime(folder / "in" / f"{name}.parquet", (1_700_000_000 + 100 * at,) * 2)


def test_admission_keeps_open_windows_only_and_restarts(spark, tmp_path):
    from attesta.operators.limits import Caps, admitted
    from attesta.streaming import jobs, state

    state.use_state_store(spark)
    caps = Caps(network=9, kinds=(("stance", 6), ("draft", 8)), hour=20, day=60)
    batches = [some_calls([0]), some_calls([0, 1]), some_calls([2, 3]), some_calls([26])]
    batches[1] = [(i + 5000, *x) for i, *x in batches[1]]
    like = spark.createDataFrame([], CALLS)

    def run():
        stream = jobs.folder_stream(spark, f"{tmp_path}/in/*.parquet", like, 1)
        q = state.stream_admitted(stream, caps, "0 minutes").writeStream.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).format("parquet").option("path", f"{tmp_path}/out").start()
        q.awaitTermination()
        return q

    for k, rows in enumerate(batches[:2]):
        put(spark, rows, CALLS, tmp_path, f"{k}", k)
    run()
    # A new query goes on from the checkpoint: places taken before are still taken.
    for k, rows in enumerate(batches[2:], 2):
        put(spark, rows, CALLS, tmp_path, f"{k}", k)
    late = [(99_999, some_calls([2])[5][1], 1, "w1", "other")]
    put(spark, late, CALLS, tmp_path, "late", 9)
    q = run()
    got = {r.event_id: r.refused_by for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    prior, want = None, {}
    for rows in batches:
        new = admitted(spark.createDataFrame(rows, CALLS), caps, prior)
        new = spark.createDataFrame(new.collect(), new.schema)
        prior = new if prior is None else prior.unionByName(new)
    want = {r.event_id: r.refused_by for r in prior.collect()}
    assert set(want.values()) == {None, "network", "workspace", "hour", "day"}
    assert got == want and 99_999 not in got
    assert sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"]) == 1
    # Of the hour caps' keys, those of the last, still open hour are left; the first day's state is gone as well.
    last = q.recentProgress[-1]["stateOperators"]
    assert sorted(o["numRowsTotal"] for o in last)[:2] <= [2, 2] and max(o["numRowsTotal"] for o in last) <= 2 * 5 + 2 * 9


CLAIMS = "item_id long, ts timestamp, event_id long, event string"


def test_claims_are_told_without_input(spark, tmp_path):
    import time
    from datetime import datetime

    from attesta.streaming import jobs, state

    state.use_state_store(spark)
    put(spark, [(1, datetime.now(), 1, "claimed"), (2, datetime.now(), 2, "claimed"), (2, datetime.now(), 3, "done")], CLAIMS, tmp_path, "0", 0)
    stream = jobs.folder_stream(spark, f"{tmp_path}/in/*.parquet", spark.createDataFrame([], CLAIMS))
    q = state.stream_claims(stream, minutes=0.02, attempts=3, late=None).writeStream.option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="1 second").format("parquet").option("path", f"{tmp_path}/out").start()
    for _ in range(40):
        time.sleep(1)
        got = sorted((r.item_id, r.attempts, r.state) for r in spark.read.schema("item_id long, at timestamp, state string, attempts int").parquet(f"{tmp_path}/out").collect()) if (tmp_path / "out").exists() else []
        if len(got) >= 3:
            break
    q.stop()
    assert got == [(1, 1, "pending"), (1, 2, "pending"), (1, 3, "failed")]


@pytest.mark.parametrize("per_batch", [1, 10])
def test_claims_do_not_depend_on_batches(spark, tmp_path, per_batch):
    from datetime import datetime, timedelta

    from attesta.streaming import jobs, state

    state.use_state_store(spark)
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    rows = [[(1, at(0), 1, "claimed"), (2, at(1), 2, "claimed")], [(1, at(6), 3, "done"), (3, at(7), 4, "claimed")], [(2, at(8), 5, "claimed"), (3, at(8), 6, "done")], [(9, at(60), 7, "done")]]
    for k, r in enumerate(rows):
        put(spark, r, CLAIMS, tmp_path, str(k), k)
    stream = jobs.folder_stream(spark, f"{tmp_path}/in/*.parquet", spark.createDataFrame([], CLAIMS), per_batch)
    jobs.run_to_folder(state.stream_claims(stream), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = sorted((r.item_id, int((r["at"] - at(0)).total_seconds() // 60), r.state, r.attempts) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, 5, "pending", 1), (2, 6, "pending", 1), (2, 13, "failed", 3)]


def test_a_key_of_many_windows_has_one_timer():
    import pandas as pd

    from attesta.streaming import state

    class Handle:
        timers, held = [], None
        getValueState = lambda self, *_: self
        get = lambda self: self.held
        clear = lambda self: setattr(self, "held", None)
        update = lambda self, v: setattr(self, "held", v)
        registerTimer = lambda self, at: self.timers.append(at)
        deleteTimer = lambda self, at: self.timers.remove(at)
        getCurrentWatermarkInMs = lambda self: 7_200_000
        getExpiryTimeInMs = lambda self: self.timers.pop()

    step, handle = state.WindowCap("network", "hour_ends", 1), Handle()
    step.init(handle)
    for hours in ((5, 2, 5), (1,)):
        ends = pd.to_datetime([h * 3_600_000 for h in hours], unit="ms")
        rows = pd.DataFrame({"event_id": range(len(hours)), "ts": ends, "hour_ends": ends, "refused_by": pd.Series([None] * len(hours), dtype="object")})
        got = pd.concat(step.handleInputRows((1,), iter([rows]), None))
        assert handle.timers == [min(hours) * 3_600_000] and got["refused_by"].notna().sum() == len(hours) - len(set(hours))
    # What is over by the watermark goes at once, and the timer moves on.
    assert list(step.handleExpiredTimer((1,), handle, handle)) == []
    assert handle.timers == [18_000_000] and handle.held == ([18_000_000], [2])
