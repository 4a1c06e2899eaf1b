"""Work is dealt to all tasks, and a table asks only for the steps that it needs."""

import os

import pytest
from pyspark.sql import functions as F

from archlens.functions import extract, lexical
from archlens.operators import graph_views
from archlens.plans.samples import project
from archlens.plans.session import Session

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_texts_of_one_small_file_are_made_by_many_tasks(spark):
    rows = project(spark, SF).where("path LIKE '%/c%/page.tsx'").groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert len(rows) > 8 and rows.max() * 4 < rows.sum()


def test_nodes_need_no_walk_and_no_edges(spark):
    files = [("app/page.tsx", 'import { Nav } from "@/nav";\nexport default function Home() { return <Nav />; }\n'), ("nav.tsx", "export function Nav() { return <a />; }\n")]
    tables = Session(spark).analyse(spark.createDataFrame(files, "path string, content string"))
    assert {r.id for r in tables["nodes"].collect()} == {"app/page.tsx#Home", "nav.tsx#Nav", "route::/"}
    assert not {"_depth", "edges", "components"} & set(tables.__dict__)
    assert {r.relationship for r in tables["edges"].collect()} == {"imports", "renders", "routes-to"} and tables["edges"].count() == 3  # Nav has one user: no reuse
    assert set(tables) == set(tables.NAMES)


def test_a_specifier_means_the_first_ending_that_exists(spark):
    paths = ["a.ts", "a.tsx", "a/index.ts", "b/index.js", "c.css", "d", "d.ts"]
    asked = [("x/f.ts", s) for s in ("../a", "../b", "../c.css", "../d", "../none", "react")]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    found = extract.resolved(spark.createDataFrame(asked, "file string, specifier string"), files)
    assert {r.specifier: r.resolved for r in found.collect()} == {"../a": "a.tsx", "../b": "b/index.js", "../c.css": "c.css", "../d": "d", "../none": None, "react": None}


SOURCES = [("app/page.tsx", 'import { Nav } from "@/nav";\nexport default function Home() { return <Nav />; }\n'), ("app/a/b/page.tsx", "export default function B() { return <i />; }\n"), ("app/a/page.tsx", "export default function A() { return <b />; }\n"), ("nav.tsx", "export function Nav() { return <a />; }\n")]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_statements_come_from_a_file_s_own_row(spark, monkeypatch):
    monkeypatch.setattr(lexical, "settled", lambda df: df)
    text = "export const a = (b) => { if (b) { c(); } };\nexport const [d, e] = f;\nclass G { h() {} }\nexport default async function I({ j }: K) { return { l: 1 }; } m();\nexport type N = { o: string }\n"
    found = lexical.statements(lexical.lexed(spark.createDataFrame([("x.ts", text)], "path string, content string")))
    assert not any(word in _plan(found) for word in ("Window", "Join", "Repartition", "Sort "))
    got = {r.pos: (r.line, r.body is not None, r.code.strip()) for r in found.collect()}
    lines = text.split("\n")
    assert got == {1: (1, True, lines[0][:-1]), 2: (2, False, lines[1]), 3: (3, False, lines[2]), 4: (4, True, lines[3][:-5]), 5: (5, False, lines[4])}


def test_a_file_s_facts_meet_once(spark):
    facts = Session(spark).facts(spark.createDataFrame(SOURCES, "path string, content string"))
    assert _plan(facts).count("Join ") <= 2 and facts.count() == len(SOURCES)


def test_what_a_route_has_meets_once_and_views_ask_for_what_they_show(spark):
    tables = Session(spark).analyse(spark.createDataFrame(SOURCES, "path string, content string"))
    children = graph_views.overview_children(tables["routes"])
    assert {(r.source, r.target, r.label) for r in children.collect()} == {("route::/a", "route::/a/b", "child")}
    assert not {"_depth", "components", "edges"} & set(tables.__dict__)
    assert {r.id for r in graph_views.nodes("detail", tables).collect()} == {"route::/", "route::/a", "route::/a/b"}
    assert {r.id for r in graph_views.nodes("detail", tables, "/").collect()} == {"route::/", "component::Home", "component::Nav"}
    assert not {"components", "edges"} & set(tables.__dict__)
    whole = graph_views.view("overview", tables)
    assert {(r.source, r.target) for r in whole[1].where("label = 'child'").collect()} == {("route::/a", "route::/a/b")}
