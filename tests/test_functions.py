"""Column functions, rules, edges, graph loops, telemetry, snapshots and sinks on small cases."""

import json
import os
import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from archlens.functions import extract, names, paths, rules
from archlens.operators import checks, edges, intel, reach, views
from archlens.sources import files, inject, sinks, snapshots
from archlens.streaming import runtime


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string").coalesce(1)
    return [r.y for r in df.select(column(F.col("x")).alias("y")).collect()]


def test_names(spark):
    assert one(spark, names.id_path, "a#b#C", "plain") == ["a#b", "plain"]
    assert one(spark, names.id_name, "a#b#C", "plain") == ["C", "default"]
    assert one(spark, names.is_component_name, "Foo", "URL", "URL2", "foo", "Foo.bar") == [True, False, True, False, True]
    assert one(spark, names.pascal_case, "data-grid_rowID", "") == ["DataGridRowID", ""]
    assert one(spark, names.inferred_name, "app/(shop)/cart/page.tsx", "app/(shop)/page.tsx", "a/data-grid.tsx") == ["CartPage", "ShopPage", "DataGrid"]
    assert one(spark, names.is_builtin_hook, "useState", "useRouter", "useMine") == [True, True, False]


def test_paths(spark):
    assert one(spark, paths.route_path, "(m)/users/[id]", "a/@s/b", "f/(.)p", "f/(...)p", "") == ["/users/[id]", "/a/b", "/f/(.)p", "/f/(...)p", "/"]
    kinds = ["/d/[[...s]]", "/d/[...s]", "/d/[s]", "/f/(.)p", "/f/(...)p", "/x"]
    assert one(spark, paths.segment_type, *kinds) == ["optional-catch-all", "catch-all", "dynamic", "intercepting", "intercepting", "static"]
    assert one(spark, lambda x: paths.segment_type(x, compat=True), "/f/(...)p") == ["static"]
    assert one(spark, paths.parent_route, "/", "/a", "/a/b") == [None, "/", "/a"]
    assert one(spark, paths.route_params, "/u/[id]/p/[postId]", "/d/[[...slug]]", "/x/[user-id]") == [["id", "postId"], ["slug"], []]
    assert one(spark, paths.collapsed, "a/./b/../c", "../x", "a/b/../../..") == ["a/c", "../x", ".."] or one(spark, paths.collapsed, "a/./b/../c") == ["a/c"]
    assert one(spark, paths.is_excluded, "x/node_modules/y", "src/a.ts") == [True, False]
    assert one(spark, paths.is_param_name, "page", "then", "get", "1a") == [True, False, False, False]
    assert one(spark, lambda x: views.last_segments(x), "a/b/c/d", "a/b") == ["b/c/d", "a/b"]


@pytest.mark.parametrize(
    ("name", "imports", "tags", "path", "kind"),
    [
        ("UserDialogProvider", [], [], "x.tsx", "provider"), ("ConfirmModal", [], [], "x.tsx", "dialog"), ("Users", [], ["TableRow"], "x.tsx", "grid"),
        ("Sales", ["d3-scale"], [], "x.tsx", "chart"), ("GraphqlView", [], [], "x.tsx", "component"), ("Home", [], [], "app/page.tsx", "page"),
        ("Home", ["@radix-ui/react-dialog"], [], "app/page.tsx", "dialog"), ("Plain", [], [], "a/b.tsx", "component"),
    ],
)
def test_rules(spark, name, imports, tags, path, kind):
    df = spark.createDataFrame([(name, imports, tags, path)], "n string, i array<string>, t array<string>, p string")
    assert df.select(rules.classify(F.col("n"), F.col("i"), F.col("t"), F.col("p"))).first()[0] == kind
    first = rules.classify(F.col("n"), F.col("i"), F.col("t"), F.col("p"), custom=[rules.Rule("mine", ["^."])])
    assert df.select(first).first()[0] == "mine"


def test_export_kinds(spark):
    df = spark.createDataFrame([("useX", "a"), ("useState", "a"), ("XProvider", "a"), ("Foo", "a"), ("fmt", "src/utils/a.ts"), ("URL", "hooks/a"), ("fmt", "a"), ("_x", "a")], "n string, p string")
    got = [r.k for r in df.coalesce(1).select(rules.classify_export(F.col("n"), F.col("p")).alias("k")).collect()]
    assert got == ["hook", "unknown", "provider", "component", "util", "hook", "util", "unknown"]
    assert one(spark, rules.has_provider_sign, "<X.Provider value={1}>", "createContext<T>(", "x") == [True, True, False]


def test_extraction(spark):
    text = """"use client"
import React, { useState as S, type T } from "react"
import * as NS from './ns'
import type { Only } from '../types'
import './style.css'
// import { Gone } from './gone'
const L = import("x")
export const A = memo(function () { return <Menu.Item><B.C /></Menu.Item> })
export const n = 5
export default () => { useThing(); useStore.getState(); useState<T>(1); return <Foo<T> /> }
"""
    df = spark.createDataFrame([("src/my-view.tsx", text)], "path string, content string")
    rows = {(r.kind, r.name, r.alias, r.specifier, r.type_only) for r in extract.import_facts(df).collect()}
    assert rows == {
        ("default", "React", None, "react", False), ("named", "useState", "S", "react", False), ("named", "T", None, "react", True),
        ("namespace", "NS", None, "./ns", False), ("named", "Only", None, "../types", True), ("side_effect", None, None, "./style.css", False),
    }
    declared = {r["name"]: (r["form"], r["line"]) for r in extract.declarations(df).collect()}
    assert declared == {"A": ("variable", 8), "MyView": ("default", 10)}
    code = extract.lexed(df)
    assert code.select(extract.hook_calls("code")).first()[0] == ["useThing", "useStore.getState"]
    assert code.select(extract.dotted_tags("code")).first()[0] == ["Menu.Item"]
    assert code.select("client", extract.has_dynamic_import(F.col("code"))).first()[:] == (True, True)
    lazy = spark.createDataFrame([("a", 'import d from "next/dynamic"'), ("b", '"from \'next/dynamic\'"; // import(')], "path string, content string")
    assert {r.path: r.d for r in extract.lexed(lazy).select("path", extract.has_dynamic_import(F.col("code")).alias("d")).collect()} == {"a": True, "b": False}
    signals = spark.createDataFrame([("a", "Menu.Item = 1; React.Foo = 2; Object.assign(Card, { Head, Body: B, x: 1 })")], "path string, content string")
    assert {(r.root, r["sub"]) for r in extract.composite_signals(signals).collect()} == {("Menu", "Item"), ("Card", "Head"), ("Card", "Body")}


def graph(spark, pairs):
    return spark.createDataFrame(pairs, "source long, target long")


def test_depths_and_cycles_against_brute_force(spark):
    rng = random.Random(1)
    for _ in range(3):
        pairs = [(rng.randrange(18), rng.randrange(18)) for _ in range(24)]
        nodes = range(18)
        reach_ = {n: {n: 0} for n in nodes}
        for n in nodes:
            frontier, d = {n}, 0
            while frontier:
                d += 1
                frontier = {b for a, b in pairs if a in frontier} - set(reach_[n])
                reach_[n] |= dict.fromkeys(frontier, d)
        seeds = spark.createDataFrame([(n, n) for n in (0, 3, 5)], "root long, node long")
        got = {(r.root, r.node): r.depth for r in reach.depths(graph(spark, pairs), seeds).collect()}
        assert got == {(n, m): d for n in (0, 3, 5) for m, d in reach_[n].items()}
        on_cycle = {n for n in nodes if any(a == n and n in reach_[b] for a, b in pairs)}
        cycles = reach.cycle_nodes(graph(spark, pairs)).collect()
        assert {r.node for r in cycles} == on_cycle
        same = {(x.node, y.node) for x in cycles for y in cycles if x.component == y.component}
        assert same == {(x, y) for x in on_cycle for y in on_cycle if y in reach_[x] and x in reach_[y]}
    assert reach.cycle_nodes(graph(spark, [])).count() == 0


def test_edges(spark):
    rows = [("a", "b", "renders", 2), ("a", "b", "renders", 1), ("a", "b", "owns", 5), ("x", "y", "odd", 1)]
    df = spark.createDataFrame(rows, "source string, target string, relationship string, seq long")
    once = edges.unified(df)
    assert {tuple(r) for r in once.collect()} == {("a", "b", "renders", 1), ("a", "b", "owns", 5), ("x", "y", "odd", 1)}
    assert edges.unified(once).count() == once.count()
    assert {r.relationship: r.graph for r in edges.routed(once).collect()} == {"renders": "render", "owns": "composite-ownership", "odd": "import"}
    assert {k: v.count() for k, v in edges.separated(once).items()} == {"import": 0, "render": 1, "composite-ownership": 1, "runtime-mount": 0}
    routes = spark.createDataFrame([("/a/[id]", "/a", 0), ("/a", "/", 1)], "path string, parent string, ord long")
    assert edges.parent_edges(routes).count() == 1 and edges.parent_edges(routes, compat=True).count() == 0
    order = spark.createDataFrame([(s, "t", "r", 1) for s in ("A", "[id]", "_x", "a")], "source string, target string, relationship string, seq long")
    assert [r.source for r in edges.sorted_edges(order).collect()] == ["_x", "[id]", "a", "A"]


def test_contested_parts_and_prefixes(spark):
    groups = spark.createDataFrame([("A", ["A.X", "AX"]), ("B", ["B.X", "AX"])], "root string, full_names array<string>")
    assert [(r.node, r.message) for r in checks.contested_parts(groups).collect()] == [("B", "AX belongs to A")]
    named = spark.createDataFrame([(n,) for n in ("Menu", "MenuItem", "MenuList", "MenuItemIcon", "MenuItemText", "MenuProvider", "Menus", "Tab", "TabA", "TabB")], "name string")
    assert {(r.root, r["sub"]) for r in intel.prefixes(named).collect()} == {("Menu", "Item"), ("Menu", "List"), ("Menu", "ItemIcon"), ("Menu", "ItemText")}
    assert intel.prefixes(named, named.where("name = 'MenuList'")).count() == 3


T0 = datetime(2024, 1, 1)
EVENTS = "component string, event string, duration double, ts timestamp, seq long"


def events(spark, rows):
    return spark.createDataFrame([(c, e, d, T0 + timedelta(seconds=i), i) for i, (c, e, d) in enumerate(rows)], EVENTS)


def test_fold(spark):
    df = events(spark, [("a", "render", 9.0), ("a", "mount", None), ("a", "render", 2.0), ("a", "render", 4.0), ("a", "unmount", None), ("b", "mount", None), ("c", "unmount", None)])
    got = {r.component: (r.mount_count, r.unmount_count, r.render_count, r.average_render) for r in runtime.fold(df).collect()}
    assert got == {"a": (1, 1, 3, 3.0), "b": (1, 0, 1, 0.0)}


def test_merge(spark):
    schema = "component string, mount_count long, unmount_count long, render_count long, average_render double, last_mounted timestamp, last_unmounted timestamp"
    at = lambda n: T0 + timedelta(seconds=n)
    old, new = spark.createDataFrame([("a", 2, 0, 3, 3.0, at(5), None)], schema), spark.createDataFrame([("a", 1, 0, 2, 9.0, at(4), None)], schema)
    row = runtime.merge(old, new).first()
    assert (row.mount_count, row.render_count, row.average_render, row.last_mounted) == (3, 4, 5.0, at(4))
    row = runtime.merge(old, new, compat=True).first()
    assert (row.render_count, row.average_render) == (5, 3.0)


def test_merge_of_halves_is_the_fold_of_a_first_mount(spark):
    rng = random.Random(2)
    rows = [("a", "mount", None)] + [("a", rng.choice(["mount", "render", "unmount"]), 1.0 * rng.randint(1, 9)) for _ in range(40)] + [("a", "mount", None)]
    df = events(spark, rows)
    halves = runtime.merge(runtime.fold(df.where("seq < 41")), runtime.fold(df.where("seq >= 41")))
    whole = runtime.fold(df).first()
    assert (halves.first().mount_count, halves.first().render_count) == (whole.mount_count, whole.render_count)


def test_running_mean(spark):
    df = events(spark, [("a", "render", 2.0), ("b", "render", 8.0), ("a", "render", 4.0), ("a", "mount", None)])
    assert [r.average_render for r in runtime.running_mean(df).orderBy("seq").collect()] == [2.0, 8.0, 3.0]


def test_as_of(spark):
    mounts = spark.createDataFrame([("s", T0, 1, "m1"), ("s", T0 + timedelta(seconds=5), 5, "m2"), ("t", T0, 1, "m3")], "session string, ts timestamp, seq long, id string")
    changes = spark.createDataFrame([("s", T0 + timedelta(seconds=2), 2, "/a"), ("s", T0 + timedelta(seconds=5), 4, "/b")], "session string, ts timestamp, seq long, route string")
    assert {r.id: r.route for r in runtime.current_route(mounts, changes, "session", "route").collect()} == {"m1": "/", "m2": "/b", "m3": "/"}


def test_snapshots(spark, tmp_path):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content string")
    before = snapshots.hashed(spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "path string, content string"))
    assert {r.path: r.status for r in snapshots.difference(snapshots.hashed(now), before).collect()} == {"a": "unchanged", "b": "changed", "c": "new", "d": "removed"}
    assert {r.path for r in snapshots.changed(now, before).collect()} == {"b", "c"}
    after = snapshots.updated(before, snapshots.hashed(now))
    assert after.count() == 4 and snapshots.changed(now, after).count() == 0
    assert snapshots.without(after, now).count() == 1 and snapshots.load(spark, f"{tmp_path}/none").count() == 0
    store = snapshots.Versions(spark, f"{tmp_path}/versions")
    assert store.latest("nodes") is None
    assert [store.write("nodes", now), store.write("nodes", now.limit(1))] == ["nodes:000001", "nodes:000002"]
    assert store.latest("nodes") == "nodes:000002" and store.read("nodes:000001").count() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "é")], "b int, a string")
    sinks.write_summary(df, f"{tmp_path}/out/summary.json")
    assert (tmp_path / "out/summary.json").read_text() == '{\n  "a": "é",\n  "b": 2\n}\n'
    assert json.loads(sinks.document({"z": [2, 1], "a": {"d": 1, "c": 2}})) == {"a": {"c": 2, "d": 1}, "z": [2, 1]}
    row = [("a", "b", "owns", 1), ("a", "c", "renders", 1)]
    sinks.write_tables({"edges": spark.createDataFrame(row, "source string, target string, relationship string, seq long"), "s": df}, f"{tmp_path}/t")
    assert (tmp_path / "t/edges/relationship=owns").is_dir() and spark.read.json(f"{tmp_path}/t/edges").count() == 2
    assert files.manifest(spark, f"{tmp_path}/out/summary.json").first()["a"] == "é"


def test_inject(spark):
    text = "'use client'\nexport default function Home({ a }: P) {\n  return 1\n}\nexport const Side = (p) => {\n}\nexport const other = () => {\n}\n"
    df = spark.createDataFrame([("app/$1.tsx", text), ("b.tsx", text.replace("'use client'", "")), ("c.tsx", "'use client' export function One() {")], "path string, content string")
    rows = {r.path: r for r in inject.registered(df).collect()}
    a = rows["app/$1.tsx"]
    assert a.injected == ["Home", "Side"] and a.transformed and a.code.startswith("'use client'\nimport { useComponentRegistration }")
    assert a.code.count('canonicalId: "app/$1.tsx#') == 2 and 'exportName: "Side"' in a.code
    assert not rows["b.tsx"].transformed and rows["c.tsx"].code.index("import {") > 0
    again = df.sparkSession.createDataFrame([(a.path, a.code)], "path string, content string")
    assert not inject.registered(again).first().transformed
    assert one(spark, inject.with_js_suffix, 'from "./a"', "import('../b')", 'from "./c.js"', 'from "./d.json"', 'from "pkg"') == [
        'from "./a.js"', "import('../b.js')", 'from "./c.js"', 'from "./d.json"', 'from "pkg"']


def test_views(spark):
    tree = {r.path: (r.parent, r.depth, r.is_route) for r in views.route_tree(spark.createDataFrame([("/a/b",), ("/",), ("/a/c/",)], "path string")).collect()}
    assert tree == {"/": (None, 0, True), "/a": ("/", 1, False), "/a/b": ("/a", 2, True), "/a/c": ("/a", 2, True)}
    placed = [(r.x, r.y) for r in views.grid(spark.range(5), "id").orderBy("id").collect()]
    assert placed == [(0, 0), (300, 0), (600, 0), (0, 200), (300, 200)]


def _streamed(spark, folder, parts, **options):
    """The last state of each component after the events of ``parts``, a micro-batch each."""
    columns = "component string, event string, duration double, ts timestamp, seq long"
    for number, part in enumerate(parts):
        spark.createDataFrame(part, columns).coalesce(1).write.parquet(f"{folder}/{number}")
        os.utime(next(Path(f"{folder}/{number}").glob("*.parquet")), (1_700_000_000 + number,) * 2)  # files are taken by their time
    stream = spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    rows = runtime.collected(runtime.fold_stream(stream, **options)).collect()
    return {r.component: (r.mount_count, r.unmount_count, r.render_count, r.average_render, r.last_mounted, r.last_unmounted) for r in rows}


def test_stream_of_many_arrow_batches_and_of_nulls_equals_the_batch(spark, tmp_path):
    day = datetime(2024, 1, 1)
    rows = [("a", "render", 1.0 * i, day + timedelta(seconds=i), i) for i in range(50)] + [("a", "mount", None, day + timedelta(seconds=20), 20)]
    rows += [("a", "render", None, day + timedelta(seconds=30), 99), ("a", "unmount", None, day + timedelta(seconds=40), 100), ("b", "render", 1.0, day, 1)]
    parts = [rows[::-1], [("a", "mount", None, day + timedelta(seconds=90), 200), ("a", "render", 7.0, day + timedelta(seconds=91), 201), ("b", "unmount", None, day, 9)]]
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = _streamed(spark, tmp_path, parts)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    whole = spark.createDataFrame(sum(parts, []), "component string, event string, duration double, ts timestamp, seq long")
    want = {r.component: (r.mount_count, r.unmount_count, r.render_count, r.average_render, r.last_mounted, r.last_unmounted) for r in runtime.fold(whole).collect()}
    assert got == want and got["a"][:3] == (2, 1, 33) and set(got) == {"a"}


def test_stream_drops_the_state_of_an_idle_component(spark, tmp_path):
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    parts = [[("a", "mount", None, day(0), 1)], [("b", "mount", None, day(10), 2)], [("a", "render", 5.0, day(11), 3), ("b", "render", 4.0, day(11), 4)], [("a", "mount", None, day(12), 5)]]
    assert {k: v[:4] for k, v in _streamed(spark, tmp_path, parts).items()} == {"a": (2, 0, 2, 5.0), "b": (1, 0, 2, 4.0)}
    again = _streamed(spark, tmp_path / "idle", parts, idle=86400)
    assert {k: v[:4] for k, v in again.items()} == {"a": (1, 0, 1, 0.0), "b": (1, 0, 2, 4.0)}
