"""Named queries over telemetry with routes, each with its DuckDB SQL: users are sessions, signups change a session's route."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archlens.plans.catalog import query, table
from archlens.streaming import runtime

#: Every user has five components; signups go to one of seven routes.
_SQL = """
WITH e AS (SELECT user_id, event_id AS seq, ts, 'c' || event_id % 5 AS component, value, CASE event_type WHEN 'view' THEN 'mount' WHEN 'click' THEN 'render' WHEN 'error' THEN 'unmount' WHEN 'signup' THEN 'route' END AS event FROM events),
r AS (SELECT *, coalesce(last_value(CASE WHEN event = 'route' THEN '/r' || floor(value)::BIGINT % 7 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), '/') AS route FROM e WHERE event IS NOT NULL),
f AS (SELECT user_id, component, min(struct_pack(ts := ts, seq := seq)) AS first FROM r WHERE event = 'mount' GROUP BY ALL),
l AS (SELECT r.* FROM r JOIN f USING (user_id, component) WHERE event <> 'route' AND struct_pack(ts := ts, seq := seq) >= first)
"""
_COUNTS = """count(*) FILTER (event = 'mount') AS mount_count, count(*) FILTER (event = 'unmount') AS unmount_count, count(*) FILTER (event = 'render') + 1 AS render_count,
  round(coalesce(avg(value) FILTER (event = 'render'), 0), 6) AS average_render, max(ts) FILTER (event = 'mount') AS last_mounted, max(ts) FILTER (event = 'unmount') AS last_unmounted,
  list_sort(list_distinct(list(route) FILTER (event = 'mount'))) AS routes"""
_SESSIONS = _SQL + f"SELECT user_id::VARCHAR AS session, component, {_COUNTS} FROM l GROUP BY ALL"


def _events(rows: DataFrame) -> DataFrame:
    kind = F.create_map(*(F.lit(x) for x in ("view", "mount", "click", "render", "error", "unmount", "signup", "route")))
    event = F.try_element_at(kind, "event_type")
    route = F.when(event == "route", F.concat(F.lit("/r"), (F.floor("value") % 7).cast("string")))
    return rows.select(
        F.col("user_id").cast("string").alias("session"), F.concat(F.lit("c"), (F.col("event_id") % 5).cast("string")).alias("component"), event.alias("event"),
        "ts", F.col("event_id").alias("seq"), F.col("value").alias("duration"), route.alias("route")).where("event IS NOT NULL")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("average_render", F.round("average_render", 6))


@query(_SESSIONS)
def runtime_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, times and routes of every session's components, as a batch."""
    return _rounded(runtime.session_fold(_events(table(spark, sf_dir, "events"))))


@query(_SESSIONS)
def runtime_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the stream whose state is a session's route and components."""
    runtime.with_state_store(spark)
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    return _rounded(runtime.collected(runtime.sessions(_events(stream)), ("session", "component")))


@query(_SQL + f""", x AS (SELECT r.*, r.component || '@' || r.user_id AS id, r.seq % 2 AS half FROM r WHERE event <> 'route'),
h AS (SELECT id, half, min(struct_pack(ts := ts, seq := seq)) AS first FROM x WHERE event = 'mount' GROUP BY ALL),
y AS (SELECT x.* FROM x JOIN h USING (id, half) WHERE struct_pack(ts := ts, seq := seq) >= first)
SELECT id AS component, count(*) FILTER (event = 'mount') AS mount_count, count(*) FILTER (event = 'unmount') AS unmount_count, count(*) FILTER (event = 'render') + 1 AS render_count,
  round(coalesce(avg(value) FILTER (event = 'render'), 0), 6) AS average_render, list_sort(list_distinct(list(route) FILTER (event = 'mount'))) AS routes FROM y GROUP BY id""")
def runtime_routes_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two exports of telemetry, of even and of odd events, as one, with the union of their routes."""
    events = _events(table(spark, sf_dir, "events"))
    changes = events.where("event = 'route'").select("session", "ts", "seq", "route")
    placed = runtime.current_route(events.where("event <> 'route'").drop("route"), changes, "session", "route")
    placed = placed.withColumn("component", F.concat("component", F.lit("@"), "session"))
    halves = [runtime.fold(placed.where(F.col("seq") % 2 == i)) for i in (0, 1)]
    return _rounded(runtime.merge(*halves)).drop("last_mounted", "last_unmounted")
