"""Rewriting source texts with built-in string functions: registration calls and module suffixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archlens.functions.extract import declarations
from archlens.functions.lexical import content, once
from archlens.functions.names import canonical_id
from archlens.functions.rules import classify

#: Stands in every rewritten file; a file that has it is left alone.
MARKER = "/* archlens: registered */"
#: Names that are registered, as they are declared.
_NAMED = r"^\s*export\s+(?:default\s+)?(?:async\s+)?(?:function\s*\*?|const)\s+([A-Z][a-zA-Z0-9]*)"


def injected(files: DataFrame, content: str, anchor: str, addition: str) -> DataFrame:
    """``files`` with code (the addition behind every anchor) and transformed."""
    return files.withColumn("code", F.replace(content, F.lit(anchor), F.lit(anchor + addition))).withColumn("transformed", F.contains(content, F.lit(anchor)))


def registered(files: DataFrame, module: str = "archlens/runtime") -> DataFrame:
    """(path, code, transformed, injected): a registration call at the head of every exported client component.

    Files without a client directive, without components or with the marker stay as they are.
    """
    lexed_files = once(files.select("path", "content"))
    able = lexed_files.where(F.col("client") & ~F.exists("tokens", lambda t: t == MARKER))
    # a declaration's body begins with the brace that bracket depth finds, so types, comments and strings don't matter
    declared = declarations(able).where("brace IS NOT NULL").withColumn("name", F.regexp_extract("body", _NAMED, 1)).where("name <> ''")
    calls = declared.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("brace", "name"))).alias("calls"))
    rows = lexed_files.join(calls, lexed_files["path"] == calls["file"], "left").withColumn("calls", F.coalesce("calls", F.array().cast("array<struct<brace: int, name: string>>")))
    rows = rows.withColumn("injected", F.array_distinct(F.transform("calls", lambda c: c["name"])))
    at = F.map_from_arrays(F.transform("calls", lambda c: c["brace"]), F.transform("calls", lambda c: F.concat(F.lit("\n  "), _call(F.col("path"), c["name"]))))
    rows = rows.withColumn("at", at)
    code = F.array_join(F.transform("tokens", lambda t, i: F.concat(t, F.coalesce(F.try_element_at("at", i), F.lit("")))), "")
    line = F.lit(f'import {{ useComponentRegistration }} from "{module}";\n{MARKER}\n')
    end = F.instr(code, "\n")
    headed = F.when(end > 0, F.concat(F.substring(code, F.lit(1), end), line, F.substring(code, end + 1, F.length(code)))).otherwise(F.concat(code, F.lit("\n"), line))
    done = F.size("injected") > 0
    return rows.select("path", F.when(done, headed).otherwise(content()).alias("code"), done.alias("transformed"), "injected")


def _call(path: Column, name: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.concat(
        F.lit('useComponentRegistration({ canonicalId: "'), canonical_id(path, name), F.lit('", type: "'), classify(name, none, none, path),
        F.lit('", sourceFile: "'), path, F.lit('", exportName: "'), name, F.lit('", compositeRoot: null });'))


def with_js_suffix(content: Column) -> Column:
    """Relative module specifiers end in ``.js`` unless they end in ``.js`` or ``.json``."""
    return F.regexp_replace(content, r"""((?:from|import)\s*\(?\s*["'])(\.{1,2}/[^"']*?)(?<!\.js)(?<!\.json)(["'])""", "$1$2.js$3")
