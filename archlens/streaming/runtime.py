"""Component telemetry: counts, last times, mean render time and routes per component.

Events have component, event (mount, unmount, render), duration, ts, session and seq
(breaks ties of ts).  What comes before a component's first mount is ignored; the
first mount counts as a render.  ``fold`` is the batch form and ``fold_stream`` the same over a
stream; with routes (a ``route`` column: where a mount happens, see ``current_route``), the distinct ones
of a component's mounts are kept.

``sessions`` folds whole sessions as a stream: route changes and component events come in any order
between batches, as far as the watermark lets them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from archlens.operators.keep import distinct_sorted, keep_last, shared_folder
from archlens.sources.snapshots import KeyedTable

STATE = "first_mount timestamp, first_seq long, mounts long, unmounts long, renders long, timed long, total double, last_mount timestamp, last_unmount timestamp, latest long"
RESULT = "component string, mount_count long, unmount_count long, render_count long, average_render double, last_mounted timestamp, last_unmounted timestamp"


def fold(events: DataFrame, keys: Sequence[str] = ("component",)) -> DataFrame:
    """One row for each component that was mounted, with routes if the events have a route.

    The first mount is an aggregate joined back, so a component with very many events is no single task's work.
    """
    keys = list(keys)
    first = events.where("event = 'mount'").groupBy(*keys).agg(F.min(F.struct("ts", "seq")).alias("first"))
    live = events.join(first, keys).where(F.struct("ts", "seq") >= F.col("first"))
    is_ = lambda kind: F.col("event") == kind
    routes = [distinct_sorted(F.when(is_("mount"), F.col("route"))).alias("routes")] if "route" in events.columns else []
    return live.groupBy(*keys).agg(
        F.count_if(is_("mount")).alias("mount_count"), F.count_if(is_("unmount")).alias("unmount_count"),
        (F.count_if(is_("render")) + 1).alias("render_count"),
        F.coalesce(F.avg(F.when(is_("render"), F.col("duration"))), F.lit(0.0)).alias("average_render"),
        F.max(F.when(is_("mount"), F.col("ts"))).alias("last_mounted"), F.max(F.when(is_("unmount"), F.col("ts"))).alias("last_unmounted"), *routes)


def merge(old: DataFrame, new: DataFrame, compat: bool = False) -> DataFrame:
    """Two folds as one: counts add up, a newer time wins, means are weighted by their renders, routes are united.

    Each fold counts the first mount as a render; it is counted once here.  ``compat``
    adds the counts up as they are and keeps the older mean.
    """
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, "component", "full")
    n = lambda side, c: F.coalesce(F.col(f"{side}.{c}"), F.lit(0))
    total = lambda c: (n("a", c) + n("b", c)).alias(c)
    newer = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c)
    counted = F.col("a.component").isNotNull() & F.col("b.component").isNotNull()
    if compat:
        renders, mean = n("a", "render_count") + n("b", "render_count"), F.coalesce("a.average_render", "b.average_render")
    else:
        renders = n("a", "render_count") + n("b", "render_count") - counted.cast("long")
        seen = [F.greatest(n(s, "render_count") - 1, F.lit(0)) for s in "ab"]
        weighted = seen[0] * n("a", "average_render") + seen[1] * n("b", "average_render")
        mean = F.when(seen[0] + seen[1] > 0, weighted / (seen[0] + seen[1])).otherwise(0.0)
    none = F.array().cast("array<string>")
    routes = [F.array_sort(F.array_union(F.coalesce("a.routes", none), F.coalesce("b.routes", none))).alias("routes")] if "routes" in old.columns and "routes" in new.columns else []
    return both.select(
        "component", total("mount_count"), total("unmount_count"), renders.alias("render_count"), mean.alias("average_render"),
        newer("last_mounted"), newer("last_unmounted"), *routes)


def current_route(mounts: DataFrame, changes: DataFrame, key: str, value: str, default: str | None = "/") -> DataFrame:
    """As-of join: each mount with the last value of its key at or before it.

    Both have key, ts and seq; a change at the same (ts, seq) counts.  One window over
    the union, so nothing is compared pair by pair.
    """
    rest = [c for c in mounts.columns if c not in (key, "ts", "seq")]
    left = mounts.select(key, "ts", "seq", F.lit(1).alias("_side"), F.struct(*rest, F.lit(0).alias("_")).alias("_rest"), F.lit(None).cast(dict(changes.dtypes)[value]).alias(value))
    kind = left.schema["_rest"].dataType
    right = changes.select(key, "ts", "seq", F.lit(0).alias("_side"), F.lit(None).cast(kind).alias("_rest"), value)
    before = Window.partitionBy(key).orderBy("ts", "seq", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = left.unionByName(right).withColumn(value, F.last(value, ignorenulls=True).over(before)).where("_side = 1")
    picked = F.coalesce(F.col(value), F.lit(default)) if default is not None else F.col(value)
    return found.select(key, "ts", "seq", *(F.col(f"_rest.{c}").alias(c) for c in rest), picked.alias(value))


def _update(key: tuple, batches: Iterator[pd.DataFrame], state, idle: int | None) -> Iterator[pd.DataFrame]:
    """Add a micro-batch's rows of one component to its state, each Arrow batch by column sums.

    Arrow batches come in no order, so they are held while the first mount is not known:
    the rows of one component in one micro-batch at most, once in its life.
    """
    if state.hasTimedOut:
        state.remove()
        return
    known = state.get if state.exists else None
    if known and idle is not None and state.getCurrentWatermarkMs() > known[-1] + idle:
        known = None
    first, seq, mounts, unmounts, renders, timed, total, last_mount, last_unmount, latest = known or (None, None, 0, 0, 0, 0, 0.0, None, None, 0)
    if first is None:
        held = list(batches)
        starts = pd.concat([b.loc[b["event"] == "mount", ["ts", "seq"]] for b in held]).dropna().sort_values(["ts", "seq"])
        if starts.empty:
            return
        first, seq, renders, batches = starts["ts"].iloc[0].to_pydatetime(), int(starts["seq"].iloc[0]), 1, held
    for rows in batches:
        rows = rows[(rows["ts"] > first) | ((rows["ts"] == first) & (rows["seq"] >= seq))]
        if rows.empty:
            continue
        times = {kind: rows.loc[rows["event"] == kind, "ts"] for kind in ("mount", "unmount")}
        spent = rows.loc[rows["event"] == "render", "duration"]
        mounts, unmounts, renders = mounts + len(times["mount"]), unmounts + len(times["unmount"]), renders + len(spent)
        timed, total, latest = timed + int(spent.count()), total + float(spent.sum()), max(latest, int(rows["at"].max()))
        if len(times["mount"]):
            last_mount = max(times["mount"].max().to_pydatetime(), last_mount or first)
        if len(times["unmount"]):
            last_unmount = max(times["unmount"].max().to_pydatetime(), last_unmount or first)
    state.update((first, seq, mounts, unmounts, renders, timed, total, last_mount, last_unmount, latest))
    if idle is not None:
        state.setTimeoutTimestamp(max(latest + idle, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame([{
        "component": key[0], "mount_count": mounts, "unmount_count": unmounts, "render_count": renders,
        "average_render": total / timed if timed else 0.0, "last_mounted": last_mount, "last_unmounted": last_unmount,
    }])


def fold_stream(events: DataFrame, idle: int | None = None) -> DataFrame:
    """The fold as a stream in update mode: the state of every component that a batch touched.

    Events must come in order of (ts, seq) between batches, as they do from one source; within
    a batch any order does.  With ``idle``, in seconds, it is also the watermark's delay, and the state of a component without
    an event for that long before the watermark is dropped: its next mount begins anew.
    """
    facts = events.select("component", "event", "ts", "seq", "duration", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    if idle is None:
        return facts.groupBy("component").applyInPandasWithState(partial(_update, idle=None), RESULT, STATE, "update", "NoTimeout")
    late = facts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{idle} seconds")
    return late.groupBy("component").applyInPandasWithState(partial(_update, idle=idle * 1000), RESULT, STATE, "update", "EventTimeTimeout")


PART = "first timestamp, first_seq long, mounts long, unmounts long, renders long, timed long, total double, last_mount timestamp, last_unmount timestamp, routes array<string>"
EVENT = "component string, event string, ts timestamp, seq long, duration double, route string"
HEAD = "route string, last long, wake long, waits boolean, kept boolean"
SESSION = "session string, component string, mount_count long, unmount_count long, render_count long, average_render double, last_mounted timestamp, last_unmounted timestamp, routes array<string>"


class Sessions(StatefulProcessor):
    """A session's current route and its components, in the order of event time.

    Events wait until the watermark has passed them and are then added to the state in the order
    of (ts, seq); a result counts the waiting ones too, without adding them.  So the order of arrival
    doesn't matter, and what waits is what the watermark's delay holds.  A gap of more than ``idle``
    milliseconds between two events of a session ends it: what comes behind begins anew.
    """

    def __init__(self, default: str = "/", idle: int | None = None):
        self.default, self.idle = default, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", HEAD)  # says what else there is, so that nothing is asked for in vain: every call crosses to the JVM and back
        self.parts = handle.getMapState("parts", "component string", PART)
        self.waiting = handle.getListState("waiting", EVENT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        route, last, wake, waits, kept = self._known()
        columns = ["component", "event", "ts", "seq", "duration", "route"]
        plain = lambda v: None if pd.isna(v) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v
        new = [tuple(plain(v) for v in r) for batch in rows for r in batch[columns].astype(object).itertuples(index=False, name=None)]
        new = [(c, e, t, int(q), None if d is None else float(d), r) for c, e, t, q, d, r in new]
        waiting = [tuple(r) for r in self.waiting.get()] + new if waits else new
        self.waiting.appendList(new) if waits else self.waiting.put(new)
        soonest = _ms(min(r[2] for r in waiting))
        if soonest != wake:  # one timer at a time
            if wake is not None:
                self.handle.deleteTimer(wake)
            self.handle.registerTimer(soonest)
        self.head.update((route, last, soonest, True, kept))
        parts, _, changed, _ = self._added(waiting, route, last, kept)
        yield self._rows(key, parts, changed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        route, last, _, waits, kept = self._known()  # the timer that has expired is gone
        waiting = [tuple(r) for r in self.waiting.get()] if waits else []
        due, rest = [r for r in waiting if _ms(r[2]) <= now], [r for r in waiting if _ms(r[2]) > now]
        if due:
            parts, route, changed, anew = self._added(due, route, last, kept)
            if anew and kept:
                self.parts.clear()
            for component in changed:
                self.parts.updateValue((component,), parts[component])
            last, kept = max(_ms(r[2]) for r in due), True
            self.waiting.put(rest) if rest else self.waiting.clear()
        wake = min(_ms(r[2]) for r in rest) if rest else None
        if not rest and self.idle is not None:
            wake = (now if last is None else last) + self.idle
            if now >= wake:
                self.head.clear(), self.parts.clear(), self.waiting.clear()
                yield pd.DataFrame()
                return
        if wake is not None:
            self.handle.registerTimer(wake)
        self.head.update((route, last, wake, bool(rest), kept))
        yield pd.DataFrame()

    def _known(self) -> tuple:
        """The route, the time of the last event added, that of the timer, whether events wait and whether any were added."""
        head = self.head.get()
        return (self.default, None, None, False, False) if head is None else tuple(head)

    def _added(self, events: list[tuple], route: str | None, last: int | None, kept: bool) -> tuple[dict[str, tuple], str, set[str], bool]:
        """The components, the current route, which components changed, and whether the session began anew, after some events; the state stays."""
        parts: dict[str, tuple] = {}
        changed: set[str] = set()
        anew = False
        for component, event, ts, seq, duration, target in sorted(events, key=lambda r: (r[2], r[3], r[1] != "route")):
            if self.idle is not None:
                if last is not None and _ms(ts) - last > self.idle:
                    route, parts, changed, anew = self.default, {}, set(), True
                last = _ms(ts)
            if event == "route":
                route = target
                continue
            if component not in parts and kept and not anew:
                before = self.parts.getValue((component,))
                if before is not None:
                    parts[component] = tuple(before)
            if component not in parts:
                if event != "mount":
                    continue
                parts[component] = (ts, seq, 0, 0, 1, 0, 0.0, None, None, [])
            first, at, mounts, unmounts, renders, timed, total, mounted, unmounted, routes = parts[component]
            if event == "mount":
                mounts, mounted, routes = mounts + 1, ts, sorted({*routes, route}) if route is not None else routes
            elif event == "unmount":
                unmounts, unmounted = unmounts + 1, ts
            elif event == "render":
                renders, timed, total = renders + 1, timed + (duration is not None), total + (duration or 0.0)
            parts[component] = (first, at, mounts, unmounts, renders, timed, total, mounted, unmounted, list(routes))
            changed.add(component)
        return parts, route, changed, anew

    def _rows(self, key: tuple, parts: dict[str, tuple], changed: set[str]) -> pd.DataFrame:
        rows = [(key[0], c, p[2], p[3], p[4], p[6] / p[5] if p[5] else 0.0, p[7], p[8], list(p[9])) for c, p in parts.items() if c in changed]
        out = pd.DataFrame(rows, columns=["session", "component", "mount_count", "unmount_count", "render_count", "average_render", "last_mounted", "last_unmounted", "routes"])
        for c in ("last_mounted", "last_unmounted"):
            out[c] = pd.to_datetime(out[c])
        return out

    def close(self) -> None:
        pass


def _ms(ts: datetime) -> int:
    return (ts - datetime(1970, 1, 1)) // timedelta(milliseconds=1)


def sessions(events: DataFrame, delay: str = "1 hour", default: str = "/", idle: int | None = None) -> DataFrame:
    """(session, component, ...) as a stream in update mode: the fold of whole sessions, routes included.

    Events have session, component, event (mount, unmount, render, or route with its target in
    ``route``), ts, seq and duration; they come in any order as long as none is later than ``delay``
    behind the latest.  ``idle``, in seconds, is the longest gap inside a session.  Needs the RocksDB state store (``with_state_store``).
    """
    facts = events.select("session", "component", "event", F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long").alias("seq"), "duration", "route").withWatermark("ts", delay)
    processor = Sessions(default, None if idle is None else 1000 * idle)
    return facts.groupBy("session").transformWithStateInPandas(processor, SESSION, "Update", "EventTime")


def with_state_store(spark: SparkSession) -> None:
    """Use the state store that ``sessions`` needs, for the streams that begin afterwards."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def session_fold(events: DataFrame, default: str = "/") -> DataFrame:
    """What ``sessions`` gives after all events, as a batch: the as-of join, then the fold by session and component."""
    changes = events.where("event = 'route'").select("session", "ts", "seq", "route")
    others = events.where("event <> 'route'").select("session", "component", "event", "ts", "seq", "duration")
    return fold(current_route(others, changes, "session", "route", default), ("session", "component"))


def collected(stream: DataFrame, keys: Sequence[str] = ("component",), folder: str | None = None) -> DataFrame:
    """Run an update-mode stream over what is there now, and return the last row of each key.

    Batches are merged into a table in ``folder`` (a new one in the session's shared folder); a restart with
    the same folder goes on where the stream was, and a replayed batch changes nothing.
    """
    spark = stream.sparkSession
    folder = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    table = KeyedTable(spark, f"{folder}/rows", keys)

    def merged(batch: DataFrame, number: int) -> None:
        last = batch.withColumn("_n", F.monotonically_increasing_id())  # a key may come twice in a batch: the later row has counted more
        table.merge(keep_last(last, list(keys), ["_n"]).drop("_n"), number)

    query = stream.writeStream.outputMode("update").foreachBatch(merged).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return table.read()


def running_mean(events: DataFrame) -> DataFrame:
    """Render events with the mean of their component's durations so far."""
    so_far = Window.partitionBy("component").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.where("event = 'render'").withColumn("average_render", F.avg("duration").over(so_far))
