"""Sessions as a stream against the batch fold, upserts that are replayed, and versions that collide."""

import os
import random
from datetime import datetime, timedelta
from pathlib import Path

import pandas as pd
import pytest

from archlens.sources import snapshots
from archlens.streaming import runtime

COLUMNS = "session string, component string, event string, ts timestamp, seq long, duration double, route string"
DAY = datetime(2024, 1, 1)


def events(n, rng):
    out = []
    for i in range(n):
        kind = rng.choice(["mount", "render", "render", "unmount", "route"])
        ts = DAY + timedelta(seconds=rng.randrange(5000))
        out.append((rng.choice("st"), rng.choice("abc"), kind, ts, i, rng.choice([None, 1.0, 2.5]) if kind == "render" else None, rng.choice(["/x", "/y", "/z"]) if kind == "route" else None))
    return out


def streamed(spark, folder, parts, keys=("session", "component"), **options):
    runtime.with_state_store(spark)
    for number, part in enumerate(parts):
        spark.createDataFrame(part, COLUMNS).coalesce(1).write.parquet(f"{folder}/in/{number}")
        os.utime(next(Path(f"{folder}/in/{number}").glob("*.parquet")), (1_700_000_000 + number,) * 2)
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    return runtime.collected(runtime.sessions(stream, **options), keys, f"{folder}/out")


def key(df):
    return sorted(map(str, df.select("session", "component", "mount_count", "unmount_count", "render_count", "average_render", "last_mounted", "last_unmounted", "routes").collect()))


def test_events_out_of_order_equal_the_batch(spark, tmp_path):
    rows = events(120, random.Random(1))
    got = streamed(spark, tmp_path, [rows[:40], rows[40:80], rows[80:]], delay="2 hours")
    assert key(got) == key(runtime.session_fold(spark.createDataFrame(rows, COLUMNS)))


def test_events_in_order_are_added_as_the_watermark_passes(spark, tmp_path):
    rows = sorted(events(90, random.Random(2)), key=lambda r: r[3])
    swapped = [rows[:20] + rows[25:30], rows[20:25] + rows[30:60], rows[60:]]  # late by less than the delay
    got = streamed(spark, tmp_path, swapped, delay="15 minutes")
    assert key(got) == key(runtime.session_fold(spark.createDataFrame(rows, COLUMNS)))


def test_idle_sessions_begin_anew(spark, tmp_path):
    at = lambda d: DAY + timedelta(days=d)
    parts = [[("s", "a", "route", at(0), 1, None, "/x"), ("s", "a", "mount", at(0), 2, None, None)], [("t", "b", "mount", at(9), 3, None, None)], [("s", "a", "mount", at(10), 4, None, None)]]
    got = {r.session: (r.mount_count, r.routes) for r in streamed(spark, tmp_path / "1", parts, delay="1 hour", idle=86400).collect()}
    assert got == {"s": (1, ["/"]), "t": (1, ["/"])}
    got = {r.session: (r.mount_count, r.routes) for r in streamed(spark, tmp_path / "2", parts, delay="1 hour").collect()}
    assert got == {"s": (2, ["/x"]), "t": (1, ["/"])}


def test_upserts_take_each_batch_once(spark, tmp_path):
    table = snapshots.KeyedTable(spark, f"{tmp_path}/t", ["k"], buckets=3)
    df = lambda *rows: spark.createDataFrame(rows, "k int, v string")
    with pytest.raises(LookupError):
        table.read()
    assert table.merge(df(*((i, "old") for i in range(10))), 0)
    before = table.store.latest("table")
    # a batch that stops after its files are written isn't seen
    broken = snapshots.KeyedTable(spark, f"{tmp_path}/t", ["k"], buckets=3)
    broken.store.publish = lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        broken.merge(df((1, "half"), (11, "half")), 1)
    assert table.store.latest("table") == before and table.read().where("v = 'half'").count() == 0
    assert table.merge(df((1, "new"), (11, "new")), 1)
    once = sorted(map(tuple, table.read().collect()))
    assert once == sorted([(i, "old") for i in range(10) if i != 1] + [(1, "new"), (11, "new")])
    assert table.batch == 1 and not table.merge(df((1, "again"), (12, "again")), 1) and sorted(map(tuple, table.read().collect())) == once
    assert table.merge(spark.createDataFrame([], "k int, v string"), 2, gone=spark.createDataFrame([(i,) for i in range(9)], "k int"))
    assert sorted(map(tuple, table.read().collect())) == [(9, "old"), (11, "new")]


def test_a_restarted_stream_goes_on_where_it_was(spark, tmp_path):
    rows = events(60, random.Random(3))
    first = key(streamed(spark, tmp_path, [rows[:30], rows[30:45]], delay="2 hours"))
    stream = spark.readStream.schema(COLUMNS).parquet(f"{tmp_path}/in/*")
    again = lambda: key(runtime.collected(runtime.sessions(stream, delay="2 hours"), ("session", "component"), f"{tmp_path}/out"))
    assert again() == first == key(runtime.session_fold(spark.createDataFrame(rows[:45], COLUMNS)))
    spark.createDataFrame(rows[45:], COLUMNS).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    assert again() == key(runtime.session_fold(spark.createDataFrame(rows, COLUMNS)))


def test_versions_are_published_once(spark, tmp_path):
    one, two = snapshots.Versions(spark, f"{tmp_path}/v"), snapshots.Versions(spark, f"{tmp_path}/v")
    df = spark.range(3)
    assert one.write("t", df, after="") == "t:000001"
    with pytest.raises(snapshots.Conflict):
        two.write("t", spark.range(5), after="")
    assert one.read(one.latest("t")).count() == 3
    assert two.write("t", spark.range(5), after="t:000001") == "t:000002" and one.write("t", df) == "t:000003"
    # the number is taken between listing and publishing
    numbers = iter([[1, 2], [1, 2, 3]])
    late = snapshots.Versions(spark, f"{tmp_path}/v")
    late.versions = lambda kind: next(numbers)
    assert late.write("t", spark.range(7)) == "t:000004" and one.read("t:000003").count() == 3 and one.read("t:000004").count() == 7
    # a failed write has no number
    bad = spark.range(2).selectExpr("raise_error('no')")
    with pytest.raises(Exception):
        one.write("t", bad)
    assert one.versions("t") == [1, 2, 3, 4] and not list(Path(f"{tmp_path}/v/t/versions").glob(".*[!c]"))


class Calls:
    """A handle and states that hold nothing, and count what they are asked."""

    def __init__(self):
        self.names = []

    def getValueState(self, *_):  # noqa: N802
        return self

    getMapState = getListState = getValueState

    def __getattr__(self, name):
        return lambda *_: self.names.append(name)

    def exists(self):
        self.names.append("exists")
        return False

    def listTimers(self):  # noqa: N802
        self.names.append("listTimers")
        return iter([])

    def containsKey(self, _):  # noqa: N802
        self.names.append("containsKey")
        return False


def test_a_new_session_asks_its_state_four_times():
    handle, processor = Calls(), runtime.Sessions()
    processor.init(handle)
    rows = [("abc"[i % 3], "mount", pd.Timestamp(DAY), i, None, None) for i in range(9)]
    out = list(processor.handleInputRows(("s",), iter([pd.DataFrame(rows, columns=["component", "event", "ts", "seq", "duration", "route"])]), None))
    assert sorted(out[0]["mount_count"]) == [3, 3, 3] and sorted(handle.names) == ["get", "put", "registerTimer", "update"]
