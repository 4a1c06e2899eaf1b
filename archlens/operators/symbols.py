"""What a name in a file stands for: local declarations, imports, and re-exports followed to their origin.

Facts are import rows (file, pos, kind, name, alias, resolved) and declarations
(file, name); re-exports are rows (file, name, target, original), name null for ``export *``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archlens.functions.extract import all_of
from archlens.functions.lexical import literal, once
from archlens.functions.names import canonical_id
from archlens.operators.keep import keep_first, settled, stored

#: How sure each way of resolving a name is.
CONFIDENCE = {"local": 0.95, "named": 0.85, "default": 0.80, "namespace": 0.75}


def re_exports(files: DataFrame) -> DataFrame:
    """(file, name, original, specifier): ``export { a as b } from`` and ``export * from``."""
    files, text = once(files), F.col("code")
    head = r'\bexport\s*(?:type\s*)?\{([^}]*)\}\s*from\s*"(\d+)"'
    listed = files.select(F.col("path").alias("file"), F.explode(F.arrays_zip(all_of(text, head, 1).alias("c"), F.transform(all_of(text, head, 2), lambda n: literal(n)).alias("s"))).alias("x"))
    part = F.explode(F.filter(F.transform(F.split("x.c", ","), lambda n: F.trim(n)), lambda n: n != ""))
    named = listed.select("file", part.alias("n"), F.col("x.s").alias("specifier")).select(
        "file", F.regexp_extract("n", r"([\w$]+)$", 1).alias("name"), F.regexp_extract("n", r"^(?:type\s+)?([\w$]+)", 1).alias("original"), "specifier")
    star = files.select(F.col("path").alias("file"), F.explode(F.transform(all_of(text, r'\bexport\s*(?:type\s*)?\*\s*from\s*"(\d+)"'), lambda n: literal(n))).alias("specifier"))
    none = F.lit(None).cast("string")
    return named.unionByName(star.select("file", none.alias("name"), none.alias("original"), "specifier"))


def star_closure(exports: DataFrame, most: int = 64) -> DataFrame:
    """(file, target): the files that ``export *`` leads to over any number of steps.

    The steps known double in every round, so a chain of n files takes log2(n) joins.
    They are stored, as Spark's estimate of a table that is joined with itself squares in every
    round otherwise: a number of millions of digits, of which every plan holds many.
    """
    known = stored(exports.where("name IS NULL AND file <> target").select("file", "target").distinct())
    count = known.count()
    if not count:
        return known
    for _ in range(most):
        further = known.select("file", F.col("target").alias("via")).join(known.select(F.col("file").alias("via"), "target"), "via").select("file", "target")
        known = stored(known.unionByName(further).where("file <> target").distinct())
        now = known.count()
        if now == count:
            return known
        count = now
    raise RuntimeError(f"a chain of more than 2**{most} re-exports")


def origins(wanted: DataFrame, exports: DataFrame, declared: DataFrame) -> DataFrame:
    """(file, name, origin_file, origin_name) of exported names: where each is declared, through any chain of re-exports.

    A declaration in the file itself comes first (``default`` stands for a declared default if
    ``declared`` has is_default), then a named re-export, then ``export *``, of several
    the least file.  exports: (file, name, original, target); names that lead nowhere, or in a circle, are left out.
    Every name points at the next place; pointers are joined with themselves, so they double in length each round
    (and are stored, see ``star_closure``).  All places of a way have pointers of their own, so a round
    after which as many are open as before leaves only those that go in a circle.
    """
    exports = exports.where("target IS NOT NULL").select("file", "name", "original", "target")
    own = declared.select("file", "name", F.col("name").alias("as"))
    if "is_default" in declared.columns:
        own = own.unionByName(declared.where("is_default").select("file", F.lit("default").alias("name"), F.col("name").alias("as")))
    own = keep_first(own, ["file", "name"], ["as"])
    own = own.select("file", "name", F.col("file").alias("at"), "as", F.lit(True).alias("ends"))
    named = keep_first(exports.where("name IS NOT NULL").select("file", "name", "target", "original"), ["file", "name"], ["target", "original"])
    named = named.join(own, ["file", "name"], "left_anti").select("file", "name", F.col("target").alias("at"), F.col("original").alias("as"), F.lit(False).alias("ends"))
    known = settled(own.unionByName(named))
    asked = wanted.select("file", "name").unionByName(known.where("NOT ends").select(F.col("at").alias("file"), F.col("as").alias("name"))).distinct()
    open_ = asked.where("name <> 'default'").join(known, ["file", "name"], "left_anti")
    offered = open_.join(star_closure(exports), "file").join(known.select(F.col("file").alias("target"), "name"), ["target", "name"])
    by_star = offered.groupBy("file", "name").agg(F.min("target").alias("at")).select("file", "name", "at", F.col("name").alias("as"), F.lit(False).alias("ends"))
    pointer = stored(known.unionByName(by_star))
    left, before = pointer.where("NOT ends").count(), None
    while left and left != before:
        onward = pointer.select(F.col("file").alias("at"), F.col("name").alias("as"), F.col("at").alias("at2"), F.col("as").alias("as2"), F.col("ends").alias("ends2"))
        moved = pointer.where("NOT ends").join(onward, ["at", "as"]).select("file", "name", F.col("at2").alias("at"), F.col("as2").alias("as"), F.col("ends2").alias("ends"))
        pointer = stored(pointer.where("ends").unionByName(moved))
        left, before = pointer.where("NOT ends").count(), left
    # what still doesn't end goes in a circle
    ended = pointer.where("ends").join(wanted.select("file", "name").distinct(), ["file", "name"], "left_semi")
    return ended.select("file", "name", F.col("at").alias("origin_file"), F.col("as").alias("origin_name"))


def through_exports(bound: DataFrame, exports: DataFrame, declared: DataFrame) -> DataFrame:
    """``bound`` (resolved, imported, kind, ...) with the file and name that declare what is imported, where it is found."""
    if exports.isEmpty() and "is_default" not in declared.columns:
        return bound
    asked = F.when(F.col("kind") == "default", "default").otherwise(F.col("imported"))
    bound = settled(bound.withColumn("_asked", asked))
    wanted = bound.where("kind <> 'namespace'").select(F.col("resolved").alias("file"), F.col("_asked").alias("name"))
    source = origins(wanted, exports, declared).select(F.col("file").alias("resolved"), F.col("name").alias("_asked"), "origin_file", "origin_name")
    found = bound.join(source, ["resolved", "_asked"], "left")
    return found.withColumn("resolved", F.coalesce("origin_file", "resolved")).withColumn("imported", F.coalesce("origin_name", "imported")).drop("_asked", "origin_file", "origin_name")


def resolve(names: DataFrame, imports: DataFrame, declared: DataFrame, exports: DataFrame | None = None) -> DataFrame:
    """``names`` (file, name) with id, via and confidence; unknown names are left out.

    A dotted name is resolved by what stands before its dot.  The first import that binds
    a name counts, by position and then named, default, namespace; a local declaration is next.
    """
    names = names.select("file", "name").distinct().withColumn("local", F.substring_index("name", ".", 1))
    rank = F.when(F.col("kind") == "named", 0).when(F.col("kind") == "default", 1).otherwise(2)
    bound = imports.where("kind <> 'side_effect' AND resolved IS NOT NULL").select(
        "file", F.coalesce("alias", "name").alias("local"), "pos", rank.alias("rank"), "kind", "resolved", F.col("name").alias("imported"))
    bound = keep_first(bound, ["file", "local"], ["pos", "rank"])
    if exports is not None:
        bound = through_exports(bound, exports, declared)
    through = names.join(bound, ["file", "local"]).select("file", "name", canonical_id(F.col("resolved"), F.col("imported")).alias("id"), F.col("kind").alias("via"))
    rest = names.join(through.select("file", "name"), ["file", "name"], "left_anti")
    own = rest.join(declared.select("file", F.col("name").alias("local")).distinct(), ["file", "local"]).select("file", "name", canonical_id(F.col("file"), F.col("local")).alias("id"), F.lit("local").alias("via"))
    sure = F.element_at(F.create_map(*(F.lit(x) for pair in CONFIDENCE.items() for x in pair)), F.col("via"))
    return through.unionByName(own).withColumn("confidence", sure)
