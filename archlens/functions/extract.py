"""Facts from source texts, by regular expressions over their code.

Code comes from ``lexical``: comments are blank and literals are numbers in quotes, so nothing
inside them counts; what a literal says is looked up by its number.  Tables of
files may have content (path, content), or tokens and code from ``lexical.lexed``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archlens.functions.lexical import is_client, lexed, literal, once, statements  # noqa: F401 (is_client is used from here)
from archlens.functions.names import inferred_name, is_builtin_hook, is_component_name
from archlens.functions.paths import collapsed, folder, is_param_name
from archlens.operators.intel import GLOBALS
from archlens.operators.keep import keep_first, settled

EXTENSIONS = [".tsx", ".ts", ".jsx", ".js"]


def all_of(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def has_dynamic_import(code: Column, tokens: Column | str = "tokens") -> Column:
    loader = F.exists(all_of(code, r'\bfrom\s*"(\d+)"'), lambda n: literal(n, tokens) == "next/dynamic")
    return loader | code.rlike(r"\bimport\s*\(")


def tags(text: Column) -> Column:
    """Distinct component-like tags, dotted ones included."""
    return F.filter(F.array_distinct(all_of(text, r"(?<![\w)])<([A-Z][\w.]*)")), is_component_name)


def dotted_tags(text: Column) -> Column:
    return F.filter(tags(text), lambda t: F.contains(t, F.lit(".")))


def hook_calls(text: Column) -> Column:
    """Called hooks that aren't built in, member calls kept whole."""
    return F.filter(F.array_distinct(all_of(text, r"(?<![\w.])(use[A-Z][\w]*(?:\.\w+)*)\s*(?:<[^<>()]*>)?\(")), lambda h: ~is_builtin_hook(h))


def import_facts(files: DataFrame) -> DataFrame:
    """(file, pos, kind, name, alias, specifier, type_only): one row for each imported name; side effects have none."""
    files, text = once(files), F.col("code")
    head = r'\bimport\s+(type\s+)?([\w$*{][^";]*?)\s*from\s*"(\d+)"'
    # what a match holds is read from the match, so a text is searched once for it and once for its literals
    found = F.arrays_zip(all_of(text, head, 0).alias("m"), F.transform(all_of(text, head, 3), lambda n: literal(n)).alias("s"))
    rows = files.select(F.col("path").alias("file"), F.posexplode(found).alias("pos", "x")).select(
        "file", "pos", (F.regexp_extract("x.m", head, 1) != "").alias("type_only"), F.regexp_extract("x.m", head, 2).alias("clause"), F.col("x.s").alias("specifier"))
    listed = F.filter(F.transform(F.split(F.regexp_extract("clause", r"\{([^}]*)\}", 1), ","), lambda n: F.trim(n)), lambda n: n != "")
    plain = lambda n: F.regexp_replace(n, r"^type\s+", "")
    part = lambda kind, name, alias, only: F.struct(kind.alias("kind"), name.alias("name"), alias.alias("alias"), only.alias("only"))
    none = F.lit(None).cast("string")
    named = F.transform(listed, lambda n: part(
        F.lit("named"), F.regexp_extract(plain(n), r"^([\w$]+)", 1), F.nullif(F.regexp_extract(plain(n), r"\bas\s+([\w$]+)", 1), F.lit("")), n.rlike(r"^type\s")))
    default = F.regexp_extract("clause", r"^([\w$]+)", 1)
    space = F.regexp_extract("clause", r"\*\s*as\s+([\w$]+)", 1)
    found = F.concat(
        F.filter(F.array(part(F.lit("default"), default, none, F.lit(False))), lambda p: p["name"] != ""),
        F.filter(F.array(part(F.lit("namespace"), space, none, F.lit(False))), lambda p: p["name"] != ""), named)
    bound = rows.select("file", "pos", "specifier", "type_only", F.explode(found).alias("p")).select(
        "file", "pos", "p.kind", "p.name", "p.alias", "specifier", (F.col("type_only") | F.col("p.only")).alias("type_only"))
    bare = files.select(F.col("path").alias("file"), F.posexplode(F.transform(all_of(text, r'\bimport\s*"(\d+)"'), lambda n: literal(n))).alias("pos", "specifier"))
    return bound.unionByName(bare.select("file", "pos", F.lit("side_effect").alias("kind"), none.alias("name"), none.alias("alias"), "specifier", F.lit(False).alias("type_only")))


def resolved(imports: DataFrame, files: DataFrame, roots: dict[str, str] | None = None) -> DataFrame:
    """``imports`` with resolved, the scanned file that a specifier means (null: none).

    Relative specifiers and the prefixes in ``roots`` ("@/": "src/") are tried as they
    are, with each extension and as a folder's index file; the first that exists counts.
    """
    specifier = F.col("specifier")
    base = F.when(specifier.rlike(r"^\.\.?(/|$)"), collapsed(F.concat_ws("/", folder(F.col("file")), specifier)))
    for prefix, place in (roots or {"@/": ""}).items():
        base = base.when(F.startswith(specifier, F.lit(prefix)), collapsed(F.concat(F.lit(place), F.substring(specifier, len(prefix) + 1, 1 << 30))))
    # each file is known by what a specifier may leave out of its path, so one row of an import meets one of a file
    endings = [(rank, end) for rank, end in enumerate(["", *EXTENSIONS, *(f"/index{e}" for e in EXTENSIONS)])]
    stems = F.array(*(F.when(F.endswith("path", F.lit(end)), F.struct(F.lit(rank).alias("rank"), F.expr(f"substring(path, 1, length(path) - {len(end)})").alias("_base"))) for rank, end in endings))
    known = files.select(F.col("path").alias("resolved"), F.explode(F.filter(stems, lambda s: s.isNotNull())).alias("s")).select("s._base", "s.rank", "resolved")
    known = keep_first(known, ["_base"], ["rank"]).select("_base", "resolved")
    based = imports.withColumn("_base", base)
    # the others stay out of the join, where no base would be one key
    found = based.where("_base IS NOT NULL").join(known, "_base", "left").drop("_base")
    return found.unionByName(based.where("_base IS NULL").drop("_base").withColumn("resolved", F.lit(None).cast("string")))


def declarations(files: DataFrame) -> DataFrame:
    """(file, pos, name, form, is_default, line, column, body, last, brace): exported functions, and values that are functions or calls.

    body is the declaration's own code, up to the brace that closes it; brace is the number of the token
    that opens a function's body.  A default export without a name is named after its file.
    """
    own = F.col("code")
    rows = statements(files).where(own.rlike(r"^\s*export\b"))
    is_default = own.rlike(r"^\s*export\s+default\b")
    function = F.regexp_extract("code", r"^\s*export\s+(?:default\s+)?(?:async\s+)?function\s*\*?\s*([\w$]*)", 1)
    value = F.regexp_extract("code", r"^\s*export\s+(?:const|let|var)\s+([\w$]+)", 1)
    called = own.rlike(r"^\s*export\s+(?:const|let|var)\s+[\w$]+\s*(?::[^=]+(?:=>[^=]+)*)?=\s*(?:async\s*)?(?:function\b|(?:<[^;=()]*>\s*)?\([^)]*\)\s*(?::[^=]+)?=>|[\w$]+\s*=>|[\w$.]+\s*(?:<[^;=]*>)?\()") | F.col("body").isNotNull()
    form = F.when(value != "", F.when(called, "variable")).when(own.rlike(r"^\s*export\s+(?:default\s+)?(?:async\s+)?function\b"), F.when(is_default, "default").otherwise("function"))
    form = form.otherwise(F.when(is_default & own.rlike(r"^\s*export\s+default\s*\("), "default"))
    name = F.coalesce(F.nullif(function, F.lit("")), F.nullif(value, F.lit("")), F.when(is_default, inferred_name(F.col("file"))))
    out = rows.select("file", "pos", name.alias("name"), form.alias("form"), is_default.alias("is_default"), "line", "column", own.alias("body"), "last", F.col("body").alias("brace"))
    return out.where("form IS NOT NULL AND name IS NOT NULL")


_NAME = r"[A-Za-z_$][\w$]*"
#: An identifier before a member: the member, the string that it is called with, and whether it is assigned to, or the key in brackets.
#: An identifier is tried once, from its first letter to its end.
_MEMBER = rf"""\.\s*({_NAME})(?:\s*\(\s*"(\d+)"\s*\))?(\s*=(?![=>]))?|\[\s*"(\d+)"\s*\]"""
_ACCESS = rf"""(?<![A-Za-z_$])({_NAME}+)\s*(?=({_MEMBER}))"""
#: A pattern of names, and the identifier that it takes apart.
_TAKEN = rf"\{{([^{{}}]+)\}}\s*=\s*(?:await\s+)?({_NAME})"
#: A variable, and the hook whose result it holds.
_HELD = rf"(?<![A-Za-z_$])({_NAME}+)\s*=\s*(use[A-Z]\w*)\s*\("
#: The first argument of an assignment of many members, and the members.
_MEMBERS = r"\bObject\s*\.\s*assign\s*\(\s*([A-Z]\w*)\s*,\s*\{([^{}]+)\}"


def _matches(files: DataFrame, pattern: str, *names: str, literals: Sequence[str] = ()) -> DataFrame:
    """Rows (file, ...) of all matches of a pattern, a column for each of its groups; ``literals`` are groups of numbers that are looked up."""
    files = lexed(files)
    group = lambda n, i: F.transform(all_of(F.col("code"), pattern, i), lambda n: literal(n)) if n in literals else all_of(F.col("code"), pattern, i)
    groups = F.arrays_zip(*(group(n, i).alias(n) for i, n in enumerate(names, 1)))
    return files.select(F.col("path").alias("file"), F.explode(groups).alias("x")).select("file", "x.*")


def accesses(files: DataFrame) -> DataFrame:
    """(file, variable, kind, name, argument): how members of variables are read or written.

    kind is member, assigned, key or taken; argument is the string that a member is called with.
    """
    # a text is searched for variables and for what stands behind them; that is taken apart in rows of its own
    behind = F.transform(all_of(F.col("code"), _ACCESS, 2), lambda m: F.struct(m.alias("m"), literal(F.regexp_extract(m, r'"(\d+)"', 1)).alias("said")))
    seen = lexed(files).select(F.col("path").alias("file"), F.explode(F.arrays_zip(all_of(F.col("code"), _ACCESS, 1).alias("variable"), behind.alias("b"))).alias("x"))
    seen = seen.select("file", "x.variable", F.col("x.b.m").alias("m"), F.col("x.b.said").alias("said"))
    is_key = F.startswith("m", F.lit("["))
    kind = F.when(is_key, "key").when(F.endswith("m", F.lit("=")), "assigned").otherwise("member")
    seen = seen.select(
        "file", "variable", kind.alias("kind"), F.when(is_key, F.col("said")).otherwise(F.regexp_extract("m", _MEMBER, 1)).alias("name"), F.when(~is_key, F.col("said")).alias("argument"))
    taken = _matches(files, _TAKEN, "names", "variable").select("file", "variable", F.explode(_listed("names")).alias("name"))
    return seen.unionByName(taken.select("file", "variable", F.lit("taken").alias("kind"), "name", F.lit(None).cast("string").alias("argument")))


def _listed(names: str) -> Column:
    """The names of a pattern or an object: what stands before a colon or an equals sign in each part."""
    return F.filter(F.transform(F.split(names, ","), lambda n: F.trim(F.regexp_replace(n, "(?s)[:=].*$", ""))), lambda n: n != "")


def composite_signals(files: DataFrame) -> DataFrame:
    """(root, sub, evidence): dotted tags, assigned members and members assigned together."""
    return signals_by_file(files).drop("file").distinct()


def signals_by_file(files: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """``composite_signals`` with the file of each; ``read`` are the files' ``accesses``, if they were worked out before."""
    component = r"^[A-Z][a-zA-Z0-9]*$"
    files = once(files)
    read = accesses(files) if read is None else read
    dotted = files.select(F.col("path").alias("file"), F.explode(dotted_tags(F.col("code"))).alias("tag")).select(
        "file", F.substring_index("tag", ".", 1).alias("root"), F.get(F.split("tag", r"\."), F.lit(1)).alias("sub"), F.lit("dotted-jsx").alias("evidence"))
    static = read.where(F.col("kind") == "assigned").select("file", F.col("variable").alias("root"), F.col("name").alias("sub"), F.lit("static-property").alias("evidence")).where(~F.col("root").isin(GLOBALS))
    together = _matches(files, _MEMBERS, "root", "names").select("file", "root", F.explode(_listed("names")).alias("sub"), F.lit("object-assign").alias("evidence"))
    made = static.unionByName(together).where(F.col("root").rlike(component) & F.col("sub").rlike(component))
    return dotted.unionByName(made).distinct()


def params(files: DataFrame, compat: bool = False, read: DataFrame | None = None) -> DataFrame:
    """(file, seq, param, pattern, scope): search and route parameters that a file reads.

    The variables that matter are the two that a page is given and those that hold what
    a hook returned; they are matched with all accesses by an equi-join on (file, variable).
    ``read`` are the files' ``accesses``, if they were worked out before.
    """
    given = {"searchParams": "search", "params": "route"}
    hooks = {"useSearchParams": "search", "useParams": "route"}
    files = once(files)
    read = settled(accesses(files)) if read is None else read
    scope = lambda of, c: F.element_at(F.create_map(*(F.lit(x) for pair in of.items() for x in pair)), F.col(c))
    direct = read.where(F.col("variable").isin(*given)).select(
        "file", F.when(F.col("kind") == "key", 1).when(F.col("kind") == "taken", 2).otherwise(0).alias("seq"), F.col("name").alias("param"), F.col("variable").alias("pattern"),
        scope(given, "variable").alias("scope")).where("scope = 'search' OR seq <> 1")
    held = _matches(files, _HELD, "variable", "hook").where(F.col("hook").isin(*hooks)).distinct()
    through = read.where("kind IN ('member', 'assigned')").join(held, ["file", "variable"])
    asked = (F.col("hook") == "useSearchParams") & F.col("name").isin("get", "getAll", "has") & F.col("argument").isNotNull()
    through = through.where(asked | (F.col("hook") == "useParams")).select(
        "file", F.when(asked, 3).otherwise(6).alias("seq"), F.when(asked, F.col("argument")).otherwise(F.col("name")).alias("param"), F.col("hook").alias("pattern"), scope(hooks, "hook").alias("scope"))
    found = direct.withColumn("seq", F.when(F.col("scope") == "route", F.when(F.col("seq") == 2, 5).otherwise(4)).otherwise(F.col("seq"))).unionByName(through)
    return found.where(F.col("seq").isin(1, 3) | is_param_name(F.col("param"), compat))
