"""Tokens, literals, statements and bodies of sources with strings, comments, types and helpers in the way."""

import random

import pytest
from pyspark.sql import functions as F

from archlens.functions import extract, lexical
from archlens.sources import inject

TEXT = r'''"use client"
/* head { "
 */
import X, { a } from "src/*.ts"
import { Nav } from "./nav" // import { Gone } from './gone'
const url = "http://x/*"; const re = /["'{]/g;
export function A({ x }: P): { a: number } {
  const s = `t ${x} {`; return <p>Don't <Nav /> {"<Ghost/>"}</p>;
}
function helper() { useHidden(); return <Hidden /> }
// export function Dead() {
export const B: (p: P) => { b: number } = ({ y = 1 }: { y: number }) => {
  useThing(); return <Foo/> ;
}
B.displayName = "x {"
Object.assign(B, { Item })
reg.assign(C, { Other })
export const Wrapped = memo(function () { return <Menu.Item/> })
export async function* Gen<T extends { q: 1 }>(a: T) : Promise<T> { return 1 / 2 / 3 }
export default () => { return a < b ? <Home /> : x / 2 }
export const n = 5, m = { a: 1 };
export const Last = () => <Leaf />;
'''


def files(spark, *texts):
    return spark.createDataFrame([(f"p/v{i}.tsx" if i else "p/v.tsx", t) for i, t in enumerate(texts)], "path string, content string")


def test_tokens_make_up_the_text(spark):
    rng = random.Random(4)
    parts = ["\"", "'", "`", "/", "*", "//", "\\", "${", "{", "}", "(", ")", "\n", " ", "a", "export ", "=>", "=", ";", "<", ">", "don't", "é"]
    texts = [TEXT, "", "/* open", "`open ${", '"open\n"', "'" + "x" * 50_000 + "'", "(" * 2000] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 80))) for _ in range(300)]
    rows = lexical.lexed(files(spark, *texts)).collect()
    assert sorted("".join(r.tokens) for r in rows) == sorted(texts)
    assert all(r.code.count("\n") <= "".join(r.tokens).count("\n") for r in rows)


def test_code_has_no_literals_and_keeps_lines(spark):
    row = lexical.lexed(files(spark, TEXT)).first()
    assert row.client and "Ghost" not in row.code and "Dead" not in row.code and "http" not in row.code and "Don't" in row.code and "1 / 2 / 3" in row.code
    assert row.code.count("\n") == TEXT.count("\n")


def test_statements_end_with_their_bodies(spark):
    rows = {r.line: r.code for r in lexical.statements(files(spark, TEXT)).collect()}
    assert list(sorted(rows)) == [4, 5, 6, 7, 10, 12, 18, 19, 20, 21, 22]
    assert rows[7].startswith("export function A(") and rows[7].endswith("</p>;\n}") and rows[10] == "function helper() { useHidden(); return <Hidden /> }"
    assert rows[12].endswith("<Foo/> ;\n}") and rows[22] == "export const Last = () => <Leaf />;"


def test_declarations_have_their_own_tags(spark):
    rows = extract.declarations(files(spark, TEXT)).select("name", "form", "line", extract.tags(F.col("body")).alias("tags"), extract.hook_calls(F.col("body")).alias("hooks")).collect()
    assert {r.name: (r.form, r.line, r.tags, r.hooks) for r in rows} == {
        "A": ("function", 7, ["Nav"], []), "B": ("variable", 12, ["Foo"], ["useThing"]), "Wrapped": ("variable", 18, ["Menu.Item"], []), "Gen": ("function", 19, [], []),
        "V": ("default", 20, ["Home"], []), "Last": ("variable", 22, ["Leaf"], []),
    }
    assert {(r.kind, r.name, r.specifier) for r in extract.import_facts(files(spark, TEXT)).collect()} == {("default", "X", "src/*.ts"), ("named", "a", "src/*.ts"), ("named", "Nav", "./nav")}
    assert {(r.root, r["sub"], r.evidence) for r in extract.composite_signals(files(spark, TEXT)).collect()} == {("B", "Item", "object-assign"), ("Menu", "Item", "dotted-jsx")}


def test_calls_are_injected_behind_the_body_s_brace(spark):
    row = inject.registered(files(spark, TEXT)).first()
    assert row.injected == ["A", "B", "Gen"]
    for head in ("{ a: number } {", "{ y: number }) => {", "Promise<T> {"):
        assert f"{head}\n  useComponentRegistration(" in row.code
    assert row.code.count("useComponentRegistration({") == 3 and "// export function Dead() {\nexport" in row.code
    plain = row.code.replace("import { useComponentRegistration } from \"archlens/runtime\";\n/* archlens: registered */\n", "")
    import re

    assert re.sub(r"\n  useComponentRegistration\(\{[^}]*\}\);", "", plain) == TEXT


@pytest.mark.parametrize("text", ["export class K { m() { return <Inner /> } }\nexport function F() { return <Own /> }", "export function F() { return <Own /> }\nclass K { m() { return <Inner /> } }"])
def test_a_class_is_a_statement_of_its_own(spark, text):
    rows = extract.declarations(files(spark, text)).select("name", extract.tags(F.col("body")).alias("tags")).collect()
    assert [(r.name, r.tags) for r in rows] == [("F", ["Own"])]


def test_many_exports_in_one_file(spark):
    text = "".join(f"export function F{i}() {{ return <T{i} /> }}\n" for i in range(3000))
    rows = extract.declarations(files(spark, text)).select("name", "line", extract.tags(F.col("body")).alias("t")).collect()
    assert {(r.name, r.line, tuple(r.t)) for r in rows} == {(f"F{i}", i + 1, (f"T{i}",)) for i in range(3000)}
