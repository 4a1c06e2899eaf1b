"""Quality rules by cross-document line frequency, in DataFrame functions only.

A line is normalised (outer white space cut, inner white space made one space,
lower case) and hashed.  Per host, the documents that hold a line are counted;
a line above the limit is boilerplate and is removed.  A document is depleted,
and rejected, when too few or too small a share of its words is left.

Texts are scanned once: each row's statistics and the hashes of its lines go to a work
table, which gives the row its number.  The shuffles carry line hashes (pre-aggregated
to one row per line and document) and then one number per row.  A line that a third of
all documents hold is counted by partial sums and joined from the side of the few
frequent lines.

Defined results: a null or empty text has no words, fails the base rules and is
not kept; a null host is a host of its own; rows that repeat a doc_id count as one
document when the documents of a line are counted, but each row loses its own lines only;
a row without a doc_id counts as a document of its own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archlens.llm.common import WHITE, saved

#: Java's form of the contracts' white space.
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: A line is removed if more documents of its host hold it than both of these allow.
MOST_DOCUMENTS = 10
MOST_SHARE = 0.005
#: A document is depleted with fewer words left than this number, or than this share of its words.
LEAST_WORDS = 10
LEAST_SHARE = 0.3


def words(text: Column) -> Column:
    """The words of a text as an array."""
    return F.filter(F.split(text, GAP), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once; a lambda would work it out for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(tokens: Column, window: int = 5) -> Column:
    """Words that lie in a window found twice or more in the same text.

    Windows are compared by a 64-bit hash.  Only a text with a repeated window pays for the sort.
    """
    def hashed(words: Column) -> Column:
        n = F.size(words) - window + 1
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(words, i, window)))).otherwise(F.array().cast("array<bigint>"))

    def places(ordered: Column) -> Column:
        found = F.transform(ordered, lambda x, k: F.when(
            ((k > 0) & (F.get(ordered, k - 1)["h"] == x["h"])) | (F.get(ordered, k + 1)["h"] == x["h"]), x["i"]))
        return F.array_sort(F.filter(found, lambda i: i.isNotNull()))

    def length(starts: Column) -> Column:
        return F.aggregate(
            starts, F.struct(F.lit(0).alias("words"), F.lit(-window).alias("at")),
            lambda a, p: F.struct((a["words"] + F.least(F.lit(window), p - a["at"])).alias("words"), p.alias("at")),
            lambda a: a["words"])

    def covered(hashes: Column) -> Column:
        return let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), lambda o: length(places(o)))

    return let(tokens, lambda w: let(hashed(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), GAP, " "))


def facts(docs: DataFrame, host: str = "source") -> DataFrame:
    """Per row: doc_id, host, the five base counts and ``held``, the hash and the words of each distinct normalised line."""
    kept = docs.select("doc_id", F.col(host).alias("host"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kept = kept.withColumn("tokens", words(F.col("text")))
    solid = F.translate(F.col("text"), WHITE, "")
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: F.translate(x, WHITE, "") != "")
    kept = kept.withColumn("lines", lines)
    held = F.transform("lines", lambda x: F.struct(F.xxhash64(normalised(x)).alias("line"), F.size(words(x)).alias("n")))
    return kept.select(
        "doc_id", "host",
        F.size("tokens").cast("bigint").alias("n_words"),
        F.length(solid).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate(F.col("text"), SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("tokens")).cast("bigint").alias("n_repeat_words"),
        held.alias("held"),
    )


def removed_words(rows: DataFrame, most: int = MOST_DOCUMENTS, share: float = MOST_SHARE) -> DataFrame:
    """Per row with a line above the limits: row and the words of those lines (n_removed); rows as from ``facts``, with row."""
    host = [F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("no_host")]
    document = [F.coalesce("doc_id", "row").alias("document"), F.col("doc_id").isNull().alias("nameless")]
    place, known = ["host", "no_host"], ["document", "nameless"]
    lines = rows.select("row", *host, *document, F.explode("held").alias("x")).select("row", *place, *known, "x.line", "x.n")
    documents = rows.select(*host, *document).distinct().groupBy(*place).agg(F.count("*").alias("docs"))
    held = lines.select(*place, "line", *known).distinct().groupBy(*place, "line").agg(F.count("*").alias("held")).where(F.col("held") > most)
    frequent = held.join(documents, place).where(F.col("held") > F.col("docs") * share).select(*place, "line")
    return lines.join(saved(frequent, "frequent_lines", narrow=True), [*place, "line"], "left_semi").groupBy("row").agg(F.sum("n").alias("n_removed"))


def judge(docs: DataFrame, host: str = "source", most: int = MOST_DOCUMENTS, share: float = MOST_SHARE) -> DataFrame:
    """Base counts of every row, and whether it is kept (see the module's text)."""
    rows = saved(facts(docs, host).withColumn("row", F.monotonically_increasing_id()), "line_facts")
    out = rows.join(removed_words(rows, most, share), "row", "left")
    removed = F.coalesce("n_removed", F.lit(0))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - removed
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (left >= LEAST_WORDS) & (left >= LEAST_SHARE * F.col("n_words"))).alias("kept"),
        removed.cast("bigint").alias("n_removed"),
    )


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, md5(array_to_string(w[i:i + 4], ' ')) AS h FROM t, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i)),
rep AS (SELECT DISTINCT rid, i + o AS p FROM (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, h) > 1), range(5) r(o)),
nrep AS (SELECT rid, count(*) AS n FROM rep GROUP BY rid),
l AS (SELECT rid, coalesce('i' || doc_id, 'r' || rid) AS doc, source, trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')) AS line, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT rid, doc_id, source, unnest(lines) AS x FROM t)),
hosts AS (SELECT source, count(DISTINCT coalesce('i' || doc_id, 'r' || rid)) AS docs FROM d GROUP BY source),
freq AS (SELECT l.source, line FROM l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source GROUP BY l.source, line, docs
  HAVING count(DISTINCT doc) > {MOST_DOCUMENTS} AND count(DISTINCT doc) > docs * {MOST_SHARE}),
gone AS (SELECT rid, sum(n) AS n FROM l JOIN freq f ON l.source IS NOT DISTINCT FROM f.source AND l.line = f.line GROUP BY rid),
r AS (SELECT t.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(nrep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS n_removed
  FROM t LEFT JOIN nrep USING (rid) LEFT JOIN gone USING (rid))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - n_removed >= {LEAST_WORDS} AND n_words - n_removed >= {LEAST_SHARE} * n_words AS kept,
  n_removed::BIGINT AS n_removed
FROM r"""
