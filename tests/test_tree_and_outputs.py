"""The data source for source trees, ordered outputs, incremental runs, cycles with their ways and re-exports."""

import json
import random

import pytest
from pyspark.sql import functions as F

from archlens.operators import reach, symbols
from archlens.plans import incremental
from archlens.plans.session import Config, Session
from archlens.sources import files, sinks, tree


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    texts = {f"src/d{i % 3}/f{i}.ts": f"export const x{i} = {'1' * i}\n" for i in range(30)} | {"app/page.tsx": "export default function Home() { return <A /> }\n", "notes.md": "x" * 1000}
    texts |= {f"node_modules/m{i}/index.js": "y" * 1000 for i in range(50)} | {"src/dist/out.js": "z", "empty.ts": ""}
    for path, text in texts.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "src/bad.ts").write_bytes(b"\xff\xfe = 1")
    return root


def test_tree_equals_the_scan(spark, project):
    got = {r.path: r.content for r in tree.tree(spark, str(project)).collect()}
    assert len(got) == 33 and got["empty.ts"] == "" and got["src/bad.ts"] == "\ufffd\ufffd = 1"
    assert got == {r.path: r.content for r in files.scan(spark, str(project)).collect()}
    assert [r.path for r in files.scan(spark, str(project), [r"\.md$"]).collect()] == ["notes.md"]
    assert {r.path for r in tree.tree(spark, f"file:{project}", folder="src/d1").collect()} == {p for p in got if p.startswith("src/d1/")}
    assert spark.read.format("source_tree").load(str(project)).where("content LIKE '%Home%' AND size > 5").select("path").first().path == "app/page.tsx"


def test_listing_skips_what_filters_leave_out(project):
    from pyspark.sql.datasource import EqualTo, In, IsNotNull, StringStartsWith

    reader = tree.TreeReader(str(project), 1 << 20, tree.NEVER.split(","))
    left = list(reader.pushFilters([In(("extension",), (".ts",)), StringStartsWith(("path",), "src/d1/"), EqualTo(("content",), "x"), IsNotNull(("path",))]))
    assert [type(f) for f in left] == [EqualTo, IsNotNull] and reader._folders() == ["src/d1"]
    assert len(list(reader.listed())) == 10
    small = tree.TreeReader(str(project), 100, tree.NEVER.split(","))
    parts = small.partitions()
    assert len(parts) > 5 and all(len(p.files) == 1 or sum(s for _, s in p.files) <= 100 for p in parts)
    assert not any("node_modules" in f or "dist" in f for p in parts for f, _ in p.files)  # so bytes read don't grow with them


def test_filters_reach_the_reader(spark, project):
    plan = tree.tree(spark, str(project), folder="src")._jdf.queryExecution().executedPlan().toString()
    above = plan.split("BatchScan")[0]
    assert "extension" not in above and "StartsWith" not in above and "startswith" not in above.lower()


def test_ordered_outputs_are_the_same_bytes_each_time(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "B", "_x", "[id]", "é", "Z", "b"]) + str(rng.randrange(9)), rng.choice("tuv"), rng.choice(["imports", "renders", "owns"]), i) for i in range(500)] + [(None, "t", "owns", 1)] * 2
    df = spark.createDataFrame(rows, "source string, target string, relationship string, seq long")
    for run, n in (("1", 3), ("2", 7)):
        sinks.write_tables({"edges": df.repartition(n)}, f"{tmp_path}/{run}")
    assert sinks.write_ordered(df, f"{tmp_path}/parts", ["source", "target"], rows=100) == 6
    read = lambda folder: {p.relative_to(folder).as_posix(): p.read_bytes() for p in sorted(folder.rglob("*.json"))}
    one = read(tmp_path / "1")
    assert one == read(tmp_path / "2") and set(one) == {"edges/000000.json", "graphs/import/000000.json", "graphs/render/000000.json", "graphs/composite-ownership/000000.json"}
    assert (tmp_path / "1/graphs/runtime-mount").is_dir()
    lines = [json.loads(x) for x in one["edges/000000.json"].decode().splitlines()]
    assert len(lines) == 502 and list(lines[0]) == ["relationship", "seq", "source", "target"] and lines[0]["source"] is None
    heads = list(dict.fromkeys(x["source"][:-1] for x in lines if x["source"]))
    assert heads == ["_x", "[id]", "a", "b", "B", "é", "Z"]
    assert b"".join(v for _, v in sorted(read(tmp_path / "parts").items())).count(b"\n") == 502
    sinks.write_ordered(df.limit(1), f"{tmp_path}/parts", ["source"])
    assert len(read(tmp_path / "parts")) == 1


TEXTS = {
    "app/page.tsx": 'import { Nav } from "@/lib";\nexport default function Home() { return <Nav />; }\n',
    "app/b/page.tsx": 'import { Nav as N } from "@/lib";\nexport default function B() { return <N />; }\n',
    "lib/index.ts": 'export { Menu as Nav } from "./menu";\n',
    "lib/menu.tsx": "export function Menu() { return <MenuItem />; }\nexport function MenuItem() { return <li />; }\n",
}


def table(spark, texts):
    return spark.createDataFrame(list(texts.items()), "path string, content string")


def test_a_name_counts_where_it_is_declared(spark):
    used = lambda t: {r["name"]: (r.used_in_files, r.is_reusable) for r in t["components"].collect()}
    now = used(Session(spark).analyse(table(spark, TEXTS)))
    assert now["Menu"] == (["app/b/page.tsx", "app/page.tsx"], True) and now["MenuItem"] == ([], False)
    assert used(Session(spark, Config(compat=True)).analyse(table(spark, TEXTS)))["Menu"] == ([], False)


def test_incremental_runs_equal_full_ones(spark, tmp_path):
    runs = incremental.Incremental(Session(spark), f"{tmp_path}/facts", buckets=4)
    assert runs.update(table(spark, TEXTS)) == (4, 0)
    after = {k: v for k, v in TEXTS.items() if k != "app/b/page.tsx"} | {"lib/menu.tsx": "export function Menu() { return <p />; }\n", "lib/new.tsx": "export const New = () => <Menu />;\n"}
    second = runs.run(table(spark, after))
    assert (second.analysed, second.removed) == (2, 1)
    rows = lambda t, name: sorted(map(str, t[name].drop("ord", "seq").collect()))
    full = Session(spark).analyse(table(spark, after))
    for name in ("components", "edges", "diagnostics", "routes", "summary", "route_intelligence", "composites", "params"):
        assert rows(second.tables, name) == rows(full, name), name
    assert runs.update(table(spark, after)) == (0, 0) and runs.table.batch == 1


def test_shortest_cycles_against_brute_force(spark):
    rng = random.Random(3)
    for _ in range(2):
        pairs = {(rng.randrange(14), rng.randrange(14)) for _ in range(20)}
        edges = spark.createDataFrame(list(pairs), "source long, target long")
        members = {}
        for r in reach.cycle_nodes(edges).collect():
            members.setdefault(r.component, set()).add(r.node)
        found = {r.component: (r.length, r.path) for r in reach.cycle_paths(edges).collect()}
        assert set(found) == set(members)
        for c, (length, path) in found.items():
            start, frontier, steps = min(members[c]), {min(members[c])}, 0
            while True:
                frontier, steps = {b for a, b in pairs if a in frontier}, steps + 1
                if start in frontier:
                    break
            assert path[0] == start and len(path) == length == steps and all(x in pairs for x in zip(path, path[1:] + path[:1]))
    assert reach.cycle_paths(spark.createDataFrame([], "source long, target long")).count() == 0


def test_origins_of_long_chains_stars_and_circles(spark):
    chain = [(f"c{i}", "x", "x", f"c{i + 1}") for i in range(40)] + [("s0", None, None, "s1"), ("s1", None, None, "s0"), ("s1", None, None, "c0"), ("o", "a", "b", "p"), ("p", "b", "a", "o"), ("d", "D", "default", "e")]
    exports = spark.createDataFrame(chain, "file string, name string, original string, target string")
    declared = spark.createDataFrame([("c40", "x", False), ("e", "Thing", True), ("c7", "own", False)], "file string, name string, is_default boolean")
    wanted = spark.createDataFrame([("c0", "x"), ("s0", "x"), ("o", "a"), ("d", "D"), ("e", "default"), ("c7", "own"), ("s0", "own"), ("zz", "x")], "file string, name string")
    got = {(r.file, r.name): (r.origin_file, r.origin_name) for r in symbols.origins(wanted, exports, declared).collect()}
    assert got == {("c0", "x"): ("c40", "x"), ("s0", "x"): ("c40", "x"), ("d", "D"): ("e", "Thing"), ("e", "default"): ("e", "Thing"), ("c7", "own"): ("c7", "own")}
    assert symbols.star_closure(exports.where(F.col("name").isNotNull())).count() == 0


def test_origins_with_circles_keep_the_plan_small(spark):
    exports = [(f"c{i}", "A", "A", f"c{i + 1}") for i in range(20)] + [("r1", "R", "R", "r2"), ("r2", "R", "R", "r1"), ("c0", "R", "R", "r1")]
    exports = spark.createDataFrame(exports, "file string, name string, original string, target string")
    declared = spark.createDataFrame([("c20", "A")] + [(f"x{i}", "X") for i in range(1000)], "file string, name string")
    wanted = spark.createDataFrame([("c0", "A"), ("c0", "R"), ("x1", "X")], "file string, name string")
    found = symbols.origins(wanted, exports, declared)
    assert {(r.file, r.name): (r.origin_file, r.origin_name) for r in found.collect()} == {("c0", "A"): ("c20", "A"), ("x1", "X"): ("x1", "X")}
    assert int(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 10**9  # it squared in each round, also after the last name had ended
