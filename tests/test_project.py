"""The whole analysis over a small project whose tables were worked out by hand."""

import pytest
from pyspark.sql import functions as F

from archlens.plans.session import Session

FILES = {
    "app/page.tsx": 'import { Nav } from "../components/nav";\nexport default function HomePage() { return <Nav />; }\n',
    "app/layout.tsx": 'import { ThemeProvider } from "../components/theme";\nexport default function RootLayout() { return <ThemeProvider></ThemeProvider>; }\n',
    "app/users/page.tsx": 'import { Nav } from "../../components/nav";\nimport { DataGrid } from "../../components/data-grid";\nexport default function UsersPage() { return <div><Nav /><DataGrid /></div>; }\n',
    "app/users/[id]/page.tsx": 'import { Nav } from "../../../components/nav";\nimport { useUser } from "../../../components/use-user";\nexport default function UserPage() { useUser(); return <div><Nav /><UserDialog /></div>; }\n',
    "app/users/settings/page.tsx": 'import { Nav } from "@/components/nav";\nexport default function SettingsPage() { return <Nav />; }\n',
    "components/nav.tsx": '"use client"\nimport { formatName } from "./utils/format";\nexport const Nav = () => { return <a>x</a>; };\n',
    "components/data-grid.tsx": "export function DataGrid() { return <DataGridRow />; }\nexport function DataGridRow() { return <DataGridCell />; }\nexport function DataGridCell() { return <td />; }\n",
    "components/theme.tsx": "export function ThemeProvider() { return <div />; }\n",
    "components/use-user.ts": "export function useUser() { return 1; }\n",
    "components/utils/format.ts": "export function formatName(x: string) { return x; }\n",
    "components/orphan.tsx": "export function Orphan() { return <p />; }\n",
    "components/tree.tsx": "export function Tree() { return <Tree />; } // <Ghost />\n",
    "node_modules/x/index.ts": "export function Hidden() { return 1; }\n",
}


@pytest.fixture(scope="module")
def tables(spark):
    return Session(spark).analyse(spark.createDataFrame(list(FILES.items()), "path string, content string"))


def test_routes(tables):
    rows = {r.path: (r.segment_type, r.layout, r.parent) for r in tables["routes"].collect()}
    assert rows == {
        "/": ("static", "app/layout.tsx", None), "/users": ("static", None, "/"),
        "/users/[id]": ("dynamic", None, "/users"), "/users/settings": ("static", None, "/users"),
    }


def test_components(tables):
    types = {r["name"]: r["type"] for r in tables["components"].collect()}
    assert types == {
        "HomePage": "page", "RootLayout": "layout", "UsersPage": "grid", "UserPage": "dialog", "SettingsPage": "page", "Nav": "component", "DataGrid": "grid",
        "DataGridRow": "grid", "DataGridCell": "grid", "ThemeProvider": "provider", "Orphan": "component", "Tree": "component",
    }
    assert {r["name"] for r in tables["components"].where("rendering = 'client'").collect()} == {"Nav"}
    assert {r["name"] for r in tables["components"].where("is_reusable").collect()} == {"Nav"}


def test_composite(tables):
    (row,) = tables["composites"].collect()
    assert (row.root, row.sub_components, row.evidence, row.score) == ("DataGrid", ["Cell", "Row"], ["module-ownership"], 0.9)
    assert row.full_names == ["DataGrid.Cell", "DataGrid.Row", "DataGridCell", "DataGridRow"]


def test_edges(tables):
    counts = {r["relationship"]: r["count"] for r in tables["edges"].groupBy("relationship").count().collect()}
    assert counts == {"imports": 8, "renders": 9, "owns": 2, "routes-to": 5, "parent-child": 3, "reuses": 4}


def test_route_intelligence(tables):
    rows = {r.path: r for r in tables["route_intelligence"].collect()}
    assert rows["/"].components == ["HomePage", "Nav", "RootLayout", "ThemeProvider"]
    assert rows["/users"].components == ["DataGrid", "Nav", "UsersPage"]
    assert rows["/users"].grids == ["DataGrid", "UsersPage"]
    assert rows["/users/[id]"].hooks == ["useUser"] and rows["/users/[id]"].dialogs == ["UserPage"] and rows["/users/[id]"].dynamic_params == ["id"]
    assert {p: r.dependencies for p, r in rows.items()} == {
        "/": ["Nav", "ThemeProvider", "formatName"], "/users": ["DataGrid", "Nav", "formatName"],
        "/users/[id]": ["Nav", "formatName", "useUser"], "/users/settings": ["Nav", "formatName"],
    }
    assert {r.depth for r in rows.values()} == {2}


def test_summary(tables):
    (row,) = tables["summary"].collect()
    assert row.asDict() == {
        "screens": 4, "components": 12, "reusable_components": 1, "dialogs": 1, "grids": 4, "charts": 0, "providers": 1, "layouts": 1, "pages": 2,
        "hooks": 1, "utils": 1, "client_components": 1, "server_components": 11, "avg_complexity": 6, "max_complexity": 7,
    }


def test_diagnostics(tables):
    rows = {(r.category, r.severity, r.node.split("#")[1]) for r in tables["diagnostics"].select("category", "severity", "node").collect()}
    assert rows == {
        ("orphan-node", "info", "Orphan"), ("orphan-node", "info", "Tree"), ("unresolved-jsx", "warning", "UserPage"), ("impossible-render-tree", "warning", "Tree"),
    }


def test_runtime_mismatch(spark, tables):
    from archlens.operators import checks

    mounted = spark.createDataFrame([("components/nav.tsx#Nav",), ("gone.tsx#Gone",)], "component string")
    assert [r.node for r in checks.unknown_at_runtime(mounted, tables["components"]).collect()] == ["gone.tsx#Gone"]


def test_compat_root_page(spark):
    from archlens.plans.session import Config

    out = Session(spark, Config(compat=True)).analyse(spark.createDataFrame(list(FILES.items()), "path string, content string"))
    assert {r.path for r in out["routes"].select("path").collect()} == {"/page.tsx", "/users", "/users/[id]", "/users/settings"}
    assert out["edges"].where("relationship = 'parent-child'").count() < 3


def test_scan(spark, tmp_path):
    from archlens.sources import files

    for path, text in FILES.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "notes.md").write_text("x")
    found = {r.path: r.content for r in files.scan(spark, str(tmp_path)).collect()}
    assert found == {p: t for p, t in FILES.items() if not p.startswith("node_modules")}


def test_graph_views(tables):
    from archlens.operators import graph_views

    nodes, links = graph_views.view("detail", tables, "/users")
    at = {r.id: (r.x, r.y) for r in nodes.collect()}
    assert at == {"route::/users": (300, 0), "component::Nav": (300, 140), "grid::DataGrid": (210, 260), "grid::UsersPage": (390, 260), "util::formatName": (300, 380)}
    pairs = {(r.source, r.target) for r in links.select("source", "target").collect()}
    assert pairs == {("route::/users", i) for i in at if i != "route::/users"} | {("grid::UsersPage", "component::Nav")}
    nodes, links = graph_views.view("reuse", tables)
    assert nodes.count() == 5 and links.count() == 4 and nodes.where("x = 0").count() == 2
    nodes, links = graph_views.view("architecture", tables)
    assert nodes.where("y = 0").count() == 4 and links.count() == nodes.where("y > 0").join(links, nodes["id"] == links["target"]).count()
    nodes, links = graph_views.view("detail", tables)
    assert {r.label: (r.x, r.y, r.badges, r.deps, r.comp, r.hooks, r.depth) for r in nodes.collect()} == {
        "/": (0, 0, ["provider"], 3, 4, 0, 2), "/users": (300, 0, ["grid"], 3, 3, 0, 2), "/users/[id]": (0, 200, ["dialog"], 3, 2, 1, 2), "/users/settings": (300, 200, [], 2, 2, 0, 2)}
    drawn = {(r.source, r.target, r.label) for r in links.collect()}
    assert {x for x in drawn if x[2] == "child"} == {("route::/users", "route::/users/[id]", "child"), ("route::/users", "route::/users/settings", "child")}
    assert len([x for x in drawn if x[2] == "Nav"]) == 6 and len(drawn) == 8


def test_symbols(spark):
    from archlens.functions import extract
    from archlens.operators import symbols

    tree = {
        "a.tsx": 'import { Button as B, Late } from "./lib"\nimport D from "./d"\nimport * as NS from "./d"\nexport function Own() { return <B><D/><NS.X/><Own/><Nope/><Late/></B> }\n',
        "lib/index.ts": 'export { Button } from "./button"\nexport * from "./more"\n', "lib/button.tsx": 'export { Inner as Button } from "./inner"\n',
        "lib/inner.tsx": "export function Inner() { return 1 }\n", "lib/more.ts": "export function Late() { return 1 }\nexport { Loop } from './index'\n", "d.tsx": "export default function D() { return 1 }\n",
    }
    files = spark.createDataFrame(list(tree.items()), "path string, content string")
    imports, declared = extract.resolved(extract.import_facts(files), files), extract.declarations(files)
    exports = extract.resolved(symbols.re_exports(files), files).select("file", "name", "original", F.col("resolved").alias("target"))
    names = files.where("path = 'a.tsx'").select(F.col("path").alias("file"), F.explode(extract.all_of(F.col("content"), r"<([A-Z][\w.]*)")).alias("name"))
    got = {r["name"]: (r.id, r.confidence) for r in symbols.resolve(names, imports, declared, exports).collect()}
    assert got == {
        "B": ("lib/inner.tsx#Inner", 0.85), "Late": ("lib/more.ts#Late", 0.85), "D": ("d.tsx#D", 0.8), "NS.X": ("d.tsx#NS", 0.75), "Own": ("a.tsx#Own", 0.95),
    }
    assert symbols.resolve(names, imports, declared).where("name = 'B'").first().id == "lib/index.ts#Button"


def test_command_writes_once(spark, tmp_path):
    from archlens.plans import cli

    for path, text in FILES.items():
        (tmp_path / "src" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / path).write_text(text)
    run = lambda: cli.analyse(spark, f"{tmp_path}/src", "app", f"{tmp_path}/out")
    assert [run(), run()] == ["written", "unchanged"]
    assert (tmp_path / "out/graphs/import/000000.json").is_file() and (tmp_path / "out/summary.json").read_text().startswith("{")
    (tmp_path / "src/components/nav.tsx").write_text(FILES["components/nav.tsx"] + "export function Extra() { return 1; }\n")
    assert run() == "written"
    assert spark.read.json(f"{tmp_path}/out/components").count() == 13
    a = cli.parser().parse_args(["--root", "x", "--no-cache"])
    assert (a.root, a.app_dir, a.no_cache) == ("x", "app", True)


def test_params(spark):
    from archlens.functions import extract

    text = """
const { a, b: c } = await searchParams
const q = searchParams.page + searchParams["sort"] + searchParams.get("x")
const sp = useSearchParams(); sp.get('tab'); other.get('no')
const p = useParams(); p.slug
function f({ params }) { return params.id }
"""
    rows = extract.params(spark.createDataFrame([("x.tsx", text)], "path string, content string"))
    found = {(r.param, r.pattern) for r in rows.collect()}
    assert {("a", "searchParams"), ("b", "searchParams"), ("page", "searchParams"), ("sort", "searchParams"), ("tab", "useSearchParams"), ("slug", "useParams"), ("id", "params")} <= found
    assert not {n for n, _ in found} & {"no", "get"}
    old = {r.param for r in extract.params(spark.createDataFrame([("x.tsx", text)], "path string, content string"), compat=True).collect()}
    assert "get" in old


def test_empty_project(spark):
    out = Session(spark).analyse(spark.createDataFrame([], "path string, content string"))
    assert out["components"].count() == 0 and out["edges"].count() == 0
    assert out["summary"].first()["components"] == 0


def test_keep_order(spark):
    from archlens.operators.keep import keep_first, keep_last

    df = spark.range(20).select((F.col("id") % 3).alias("k"), "id")
    assert {r.k: r.id for r in keep_first(df, ["k"], ["id"]).collect()} == {0: 0, 1: 1, 2: 2}
    assert {r.k: r.id for r in keep_last(df, ["k"], ["id"]).collect()} == {0: 18, 1: 19, 2: 17}
