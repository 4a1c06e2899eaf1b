"""Sources as tokens: literals, comments, brackets, statement heads and the code between them.

One alternation cuts a text into tokens whose concatenation is the text.  ``lexed`` keeps
them with the file's ``code``: comments are blanks (line feeds stay), and every
string, template and regular expression stands as its token's number in its quotes, so no
pattern can match inside one; ``literal`` gives back what a number stands for.

``statements`` finds top-level statements and their bodies by bracket depth: one fold over the
structural tokens of a file.  A file is one row from the scan on, and its statements come from that row
alone, so nothing is sorted or sent.

An expression inside a template counts as part of it.  An apostrophe behind a letter or digit opens
no string (as in text between tags).  A literal with more than 2000 escapes is cut there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archlens.operators.keep import settled, spread

#: Words that begin a top-level statement.
HEADS = "export|import|function|const|let|var|class|type|interface|enum|async|declare|namespace|abstract"
_MANY = "{0,2000}+"
_STRING = rf"""\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+){_MANY}\"|(?<!\w)'[^'\\\n]*+(?:\\.[^'\\\n]*+){_MANY}'"""
_INSIDE = rf"\$\{{[^{{}}`]*+(?:(?:`[^`]*+`|\{{[^{{}}]*+\}})[^{{}}`]*+){_MANY}\}}"
_TEMPLATE = rf"`[^`\\$]*+(?:(?:\\.|{_INSIDE}|\$)[^`\\$]*+){_MANY}`"
#: Only where an operand may stand; elsewhere a slash divides or closes a tag.
_PATTERN = rf"(?<=[(,=:\[!&|?{{;]\s{{0,9}}|\breturn\s{{1,9}})/(?![/*>])[^/\\\[\n]*+(?:(?:\\.|\[[^\]\\\n]*+(?:\\.[^\]\\\n]*+){_MANY}\])[^/\\\[\n]*+){_MANY}/[a-z]*+"
_COMMENT = r"(?<!:)//[^\n]*+|/\*.*?(?:\*/|\z)"
_HEAD = rf"""(?<![^\n;}}"'/])[ \t]*+(?:{HEADS})(?![\w$])"""
TOKEN = rf"""(?s){_COMMENT}|{_STRING}|{_TEMPLATE}|{_PATTERN}|{_HEAD}|[{{}}()\[\];\n]|[^"'`/{{}}()\[\];\n]++|."""


def kind(token: Column) -> Column:
    """comment, string, template, pattern, or null for code."""
    first, two = F.substring(token, 1, 1), F.substring(token, 1, 2)
    whole = F.length(token) > 1
    return (
        F.when(two.isin("//", "/*"), "comment").when(whole & first.isin('"', "'"), "string").when(whole & (first == "`"), "template").when(whole & (first == "/"), "pattern"))


def _interned(token: Column, number: Column) -> Column:
    n = number.cast("string")
    quoted = lambda q: F.concat(F.lit(q), n, F.lit(q))
    is_ = kind(token)
    blank = F.concat(F.lit(" "), F.regexp_replace(token, r"[^\n]+", ""))
    told = F.when(is_ == "comment", blank).when(is_ == "string", quoted('"')).when(is_ == "template", quoted("`")).when(is_ == "pattern", quoted("/")).otherwise(token)
    return F.when(F.substring(token, 1, 1).isin('"', "'", "`", "/"), told).otherwise(token)  # most tokens are code, which one look tells


#: White space as the sources' language sees it, the byte order mark included.
_SPACE = r"[\s\x{FEFF}\x{00A0}]"


def is_client(text: Column) -> Column:
    """Whether a text begins with the client directive."""
    return text.rlike(rf"^{_SPACE}*(?:\"use client\"|'use client')")


def lexed(files: DataFrame) -> DataFrame:
    """``files`` with client (see ``is_client``), tokens, marks (the tokens as they stand in the code) and code in place of content; files that have them stay as they are."""
    if "tokens" in files.columns:
        return files
    cut = files.withColumn("client", is_client(F.coalesce("content", F.lit("")))).withColumn("tokens", F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(TOKEN), F.lit(0))).drop("content")
    return cut.withColumn("marks", F.transform("tokens", _interned)).withColumn("code", F.array_join("marks", ""))


def once(files: DataFrame) -> DataFrame:
    """Lexed files that are read several times: written first, unless they were lexed before.

    They are dealt by path, so whatever is grouped, joined or put in order by file stays where the file is.
    """
    return files if "tokens" in files.columns else settled(lexed(spread(files, "path")))


def content(tokens: Column | str = "tokens") -> Column:
    return F.array_join(tokens, "")


def literal(number: Column, tokens: Column | str = "tokens") -> Column:
    """The text between the quotes of the literal that ``code`` has under a number; null for an empty number."""
    token = F.get(tokens, F.nullif(number, F.lit("")).cast("int"))
    return F.substring(token, F.lit(2), F.length(token) - 2)


def _structure() -> Column:
    """(i, what, before) of a file's brackets, semicolons, heads and assignments; i is the token's number, before the last two characters before a brace."""
    one = lambda t: F.when(t.isin("{", "}", ";", "(", "[", ")", "]", "="), F.translate(t, "[]", "()"))
    more = lambda t: F.when(t.rlike(rf"^[ \t]*(?:{HEADS})$"), "head").when(F.contains(t, F.lit("=")) & kind(t).isNull() & t.rlike(r"(?<![=<>!])=(?![=>])"), "=")
    what = lambda t: F.when(F.length(t) == 1, one(t)).otherwise(more(t))
    around = lambda i: F.array_join(F.slice("tokens", F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), "")
    every = F.transform("tokens", lambda t, i: F.struct(i.alias("i"), what(t).alias("what"), F.when(t == "{", F.regexp_extract(around(i), r"(\S{1,2})\s*$", 1)).alias("before")))
    return F.filter(every, lambda s: s["what"].isNotNull())


#: What is known of a statement: the numbers of the tokens where its parts begin and where its bodies close.
_PARTS = ["first", "assign", "listed", "arrow", "plain", "klass", "semicolon", "arrow_close", "plain_close", "klass_close"]


def _changed(statement: Column, **parts: Column) -> Column:
    return F.struct(*(parts.get(p, statement[p]).alias(p) for p in _PARTS))


def _step(seen: Column, token: Column) -> Column:
    """The fold's state after a structural token: depth (the braces around what follows), parens (the other brackets since the last
    brace of depth 0), head (the last token that counted, if it is a head), own (the statement so far) and done (those before it)."""
    none, i, what, own = F.lit(None).cast("int"), token["i"], token["what"], seen["own"]
    flat = seen["depth"] <= 0
    top = flat & (seen["parens"] <= 0)
    # of what lies deeper only the brackets that close a body count
    counts = (flat & (seen["parens"] <= 1)) | ((seen["depth"] <= 1) & (what == "}"))
    # a head right behind another (export const) belongs to it
    starts = top & (what == "head") & (seen["head"].isNull() | (seen["head"] != i - 1))
    first = lambda p, condition=None: F.when(own[p].isNull() if condition is None else own[p].isNull() & condition, i).otherwise(own[p])
    block = ~token["before"].rlike(r"[:|&<,(=?]$")
    # parameters, an arrow's body and a function's body come behind the assignment, a function's body behind its parameters; a class has none
    brace = F.when(token["before"] == "=>", _changed(own, arrow=first("arrow"))).when(block, _changed(own, klass=first("klass"), plain=first("plain", own["listed"].isNotNull()))).otherwise(own)
    closed = _changed(own, **{f"{p}_close": first(f"{p}_close", own[p].isNotNull()) for p in ("arrow", "plain", "klass")})
    assigned = _changed(own, assign=i, listed=none, arrow=none, arrow_close=none, plain=none, plain_close=none)
    further = (
        F.when(what == "}", closed).when(what == ")", _changed(own, listed=first("listed"))).when(top & (what == "{"), brace)
        .when(top & (what == ";"), _changed(own, semicolon=first("semicolon"))).when(top & (what == "=") & own["assign"].isNull(), assigned).otherwise(own))
    fresh = F.struct(*((i if p == "first" else none).alias(p) for p in _PARTS))
    turn = F.when(~flat, 0).when(what == "(", 1).when(what == ")", -1).otherwise(0)
    return F.struct(
        (seen["depth"] + F.when(what == "{", 1).when(what == "}", -1).otherwise(0)).alias("depth"), (seen["parens"] + turn).alias("parens"),
        F.when(counts, F.when(what == "head", i)).otherwise(seen["head"]).alias("head"),
        F.when(starts, fresh).when(counts & own.isNotNull(), further).otherwise(own).alias("own"),
        F.when(starts & own.isNotNull(), F.array_append(seen["done"], own)).otherwise(seen["done"]).alias("done"))


def _heads() -> Column:
    """The statements of a file (see ``_PARTS``), in their order, from its column ``structure``."""
    row = f"struct<{','.join(f'{p}:int' for p in _PARTS)}>"
    zero = F.struct(
        F.lit(0).alias("depth"), F.lit(0).alias("parens"), F.lit(None).cast("int").alias("head"), F.lit(None).cast(row).alias("own"), F.array().cast(f"array<{row}>").alias("done"))
    return F.aggregate("structure", zero, _step, lambda s: F.when(s["own"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["own"])))


def statements(files: DataFrame) -> DataFrame:
    """(file, pos, first, last, body, line, column, code): top-level statements that begin with a head.

    first and last are token numbers (last is not inside), body that of the brace of a function's
    body, null if there is none.  A function ends with its body, another statement with a semicolon; else
    the next head ends it.  code is that part of the file's code.  The table is written once.
    """
    files = once(files)
    own = files.select(F.col("path").alias("file"), "tokens", "marks", _structure().alias("structure")).withColumn("all", _heads()).drop("structure")
    end = lambda n: F.coalesce(F.get("all", n + 1)["first"], F.size("tokens"))
    own = own.withColumn("all", F.transform("all", lambda s, n: F.struct(*(s[p].alias(p) for p in _PARTS), end(n).alias("end"))))
    feeds = lambda a, b: F.size(F.split(F.array_join(F.slice("tokens", a + 1, b - a), ""), "\n")) - 1
    lines = F.aggregate(  # the line of each statement, and of what comes behind the last
        "all", F.array(feeds(F.lit(0), F.get("all", F.lit(0))["first"]) + 1), lambda known, s: F.array_append(known, F.element_at(known, -1) + feeds(s["first"], s["end"])))
    own = own.withColumn("lines", lines)
    # a part before its parameters counts only if it has none
    bare = lambda s, p: F.when(s["listed"].isNull(), s[p.replace("plain", "klass")]).otherwise(s[p])
    cut = F.transform("all", lambda s, n: F.struct(
        (n + 1).alias("pos"), F.get("lines", n).alias("line"), *((bare(s, p) if p.startswith("plain") else s[p]).alias(p) for p in _PARTS), s["end"].alias("end"),
        F.slice("marks", s["first"] + 1, s["end"] - s["first"]).alias("own")))
    out = own.select("file", F.explode(cut).alias("s")).select("file", "s.*").withColumn("whole", F.array_join("own", ""))
    begins = lambda words: F.col("whole").rlike(rf"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:{words})\b")
    is_function, is_class = begins("function"), begins("class|interface|enum|namespace")
    is_arrow = F.col("arrow").isNotNull() & ~is_function & ~is_class & (F.col("semicolon").isNull() | (F.col("semicolon") > F.col("arrow")))
    is_value = F.col("whole").rlike(r"\bfunction\b") & F.col("plain").isNotNull() & (F.col("plain") > F.col("assign"))
    shape = F.when(is_function, "function").when(is_class, "class").when(is_arrow, "arrow").when(is_value, "function")
    out = out.withColumn("shape", shape)
    pick = lambda end: F.when(F.col("shape") == "function", F.col(f"plain{end}")).when(F.col("shape") == "class", F.col(f"klass{end}")).when(F.col("shape") == "arrow", F.col(f"arrow{end}"))
    close, body = pick("_close"), F.when(F.col("shape") != "class", pick(""))
    stop = F.when(close.isNotNull(), close).otherwise(F.coalesce("semicolon", F.col("end") - 1)) + 1
    out = out.withColumn("last", F.least(stop, "end")).withColumn("body", body)
    return settled(out.select(
        "file", F.col("pos").cast("long").alias("pos"), "first", "last", "body", "line", (F.length(F.regexp_extract("whole", r"^([ \t]*)", 1)) + 1).alias("column"),
        F.array_join(F.slice("own", F.lit(1), F.col("last") - F.col("first")), "").alias("code")))
