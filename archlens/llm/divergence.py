"""Source divergence audit: how the sources of a language differ in the words that they use.

Terms are runs of letters and non-ASCII characters, ASCII letters in lower case.  The first
pass counts in how many documents of its language each term is; those in at least LEAST
documents are kept.  The second pass looks the kept terms up again: texts are held
in units of a few MB of one language, and an Aho-Corasick automaton of the kept terms
that a unit has, each between two blanks, counts every occurrence by source.  Which of a unit's terms are
kept is asked of a bitmap of a fixed size; a join with the kept terms then drops the few that
it lets through wrongly.  The result is one sparse row for each term, its counts by source; from these
rows come the probabilities (count + 1 in N + V, in billionths, rounded down, plus one), the
divergence of every pair of sources and each source's most unusual terms.

An automaton holds the terms of one unit, not the vocabulary, which grows with the corpus and
is only ever joined and grouped by Spark.  A pair's sum is taken over the terms that both
sources have; terms that one of them has, or neither, follow from how often a source has
each count, so zero counts are never spelled out.

Defined results: null texts, languages and sources are read as ''.  A group without terms, or
of a language without kept terms, has pairs (value 0 where the language has no kept term) and
no terms.  A language with one source has no pairs.  Repeated rows count as often as they
are there.  An empty table gives no rows.  Columns besides text, lang and source are not read.
A text of any length is held whole, in a unit of its own if it is longer than one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import compress, repeat
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archlens.llm.common import saved, sketch, tidied

#: A term is kept in this many documents of its language, and probabilities are in these units.
LEAST, UNIT = 3, 1_000_000_000
#: Terms of a source that are returned.
TOP = 200
#: Bytes of text in a unit (a longer document is a unit of its own), and in all open units of a task.
UNIT_BYTES, OPEN_BYTES = 12 << 20, 24 << 20
#: Different terms that a task of the first pass holds before it passes their counts on.
HELD_TERMS = 300_000
#: Rows of a batch that the second pass returns.
ROWS = 20_000
#: Cells of a matrix of terms by sources.
MOST_CELLS = 1 << 18
#: Bits of the bitmap of kept terms (8 MB).
BITS = 26
#: Sources of all languages whose sizes are broadcast; beyond that they are joined.
MOST_GROUPS = 100_000

#: What each byte becomes: letters small ones, other ASCII a blank; bytes of longer characters stay.
PLAIN = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _terms(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(lang, term, docs): in how many of a task's documents each term is."""
    counts: dict[str, Counter[bytes]] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            counts.setdefault(lang, Counter()).update(set(_plain(text).split()))
            if sum(map(len, counts.values())) >= most:
                yield from _rows(counts)
                counts = {}
    yield from _rows(counts)


def _rows(counts: dict[str, Counter[bytes]]) -> Iterator[pa.RecordBatch]:
    for lang, own in counts.items():
        yield pa.record_batch([pa.repeat(pa.scalar(lang, pa.string()), len(own)), pa.array(list(own), pa.binary()).cast(pa.string()), pa.array(list(own.values()), pa.int64())], ["lang", "term", "docs"])


def _plain(text: pa.Scalar) -> bytes:
    buffer = text.as_buffer()
    return buffer.to_pybytes().translate(PLAIN) if buffer is not None else b""


def _recounted(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray, unit: int, most: int) -> Iterator[pa.RecordBatch]:
    """(lang, term, has): for each unit and term that the bitmap has, the sources that have it there and how often."""
    held: dict[str, dict[str, list[bytes]]] = {}
    sizes: Counter[str] = Counter()

    def counted(lang: str) -> Iterator[pa.RecordBatch]:
        del sizes[lang]
        by_source = held.pop(lang)
        seed = xxhash.xxh64_intdigest(lang.encode(), 42)
        found = list(set().union(*(text.split() for texts in by_source.values() for text in texts)))
        at = np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(seed)), np.uint64, len(found)).astype(np.int64) & ((1 << BITS) - 1)
        terms = [term.decode() for term in compress(found, bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1)]
        if not terms:
            return
        automaton = ahocorasick.Automaton()
        for at, term in enumerate(terms):
            automaton.add_word(f" {term} ", at)
        automaton.make_automaton()
        found, times, whose = [], [], []
        for place, texts in enumerate(by_source.values()):
            text = b" ".join([b"", *texts, b""]).decode()  # neighbours share the blank between them
            counts = np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(text)), np.int64), minlength=len(terms))
            found.append(np.flatnonzero(counts))
            times.append(counts[found[-1]])
            whose.append(np.full(len(found[-1]), place))
        at = np.concatenate(found)
        order = np.argsort(at, kind="stable")  # by term
        ends = np.append(0, np.cumsum(np.bincount(at, minlength=len(terms)))).astype(np.int32)
        source = pa.array(list(by_source), pa.string()).take(pa.array(np.concatenate(whose)[order]))
        has = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([source, pa.array(np.concatenate(times)[order])], ["source", "n"]))
        whole = pa.record_batch([pa.repeat(pa.scalar(lang, pa.string()), len(terms)), pa.array(terms, pa.string()), has], ["lang", "term", "has"])
        yield from (whole.slice(i, ROWS) for i in range(0, len(terms), ROWS))

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text")):
            own = _plain(text)
            held.setdefault(lang, {}).setdefault(source, []).append(own)
            sizes[lang] += len(own) + 64
            if sizes[lang] >= unit:
                yield from counted(lang)
            elif sizes.total() >= most:
                yield from counted(max(sizes, key=sizes.get))
    for lang in list(held):
        yield from counted(lang)


def rows_of(docs: DataFrame) -> DataFrame:
    """(lang, source, text) of documents, nulls as ''."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c)
    return docs.select(text("lang"), text("source"), text("text"))


def vocabulary(rows: DataFrame, least: int = LEAST, held: int = HELD_TERMS) -> DataFrame:
    """The first pass: (lang, term, docs) of the kept terms."""
    found = rows.select("lang", "text").mapInArrow(tidied(partial(_terms, most=held)), "lang string, term string, docs long")
    return saved(found.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least), "divergence-kept", narrow=True)


def bitmap_of(kept: DataFrame) -> np.ndarray:
    """A bit for the hash of every kept term: 2**BITS bits, however many terms there are."""
    words = sketch(kept.select(F.xxhash64("lang", "term").alias("h")), "h", BITS).toArrow()
    bits = np.zeros(1 << (BITS - 6), np.int64)
    bits[words.column("_word").to_numpy()] = words.column("_set").to_numpy()
    return bits.astype("<i8").view(np.uint8)


def postings(rows: DataFrame, kept: DataFrame, unit: int = UNIT_BYTES, most: int = OPEN_BYTES) -> DataFrame:
    """The second pass: (lang, term, has), has the sources that have a kept term and how often."""
    task = tidied(partial(_recounted, bitmap=bitmap_of(kept), unit=unit, most=most))
    counted = rows.mapInArrow(task, "lang string, term string, has array<struct<source: string, n: long>>")
    # one exchange of a row for each unit and term; the aggregates below keep the join's partitioning by language and term
    exact = counted.join(kept.select("lang", "term"), ["lang", "term"], "left_semi")
    flat = exact.select("lang", "term", F.explode("has").alias("x")).select("lang", "term", "x.*")
    by_source = flat.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    return saved(by_source.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("has")), "divergence-postings")


#: A count's probability; the product may pass 64 bits, so it is a decimal.  m is N + V.
_P = f"1 + ({UNIT}BD * CAST(n + 1 AS DECIMAL(20, 0))) DIV CAST(m AS DECIMAL(20, 0))"
_P0 = f"1 + {UNIT} DIV m"


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) DIV {q}"


def measured(found: DataFrame, groups: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, p, q), p and q the probabilities in the source and in the language, and the groups
    (lang, source, v, m, p0, terms): p0 is the probability of zero counts, terms how many terms a group has."""
    v = kept.groupBy("lang").agg(F.count("*").alias("v"))
    flat = found.select("lang", "term", F.explode("has").alias("x"), F.aggregate("has", F.lit(0).cast("long"), lambda t, x: t + x["n"]).alias("all")).select("lang", "term", "x.*", "all")
    sizes = flat.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    known = groups.join(v, "lang", "left").join(sizes, ["lang", "source"], "left").select("lang", "source", zero("v"), zero("total"), zero("terms"))
    known = known.withColumn("m", F.nullif(F.col("total") + F.col("v"), F.lit(0))).withColumn("p0", F.expr(_P0))
    of_lang = known.groupBy("lang").agg((F.sum("total") + F.max("v")).alias("lang_m"))
    known = saved(known.join(of_lang, "lang"), "divergence-groups", narrow=True)  # a row for each source of a language
    with_p = flat.join(_bounded(known.select("lang", "source", "m", "lang_m")), ["lang", "source"])
    q = _P.replace("n + 1", "all + 1").replace("CAST(m AS", "CAST(lang_m AS")
    return with_p.select("lang", "source", "term", F.expr(_P).alias("p"), F.expr(q).alias("q")), known


def _bounded(known: DataFrame) -> DataFrame:
    """Broadcast if the groups are few enough, which is counted; else left to a join by key."""
    return F.broadcast(known) if known.count() <= MOST_GROUPS else known


def pairs(found: DataFrame, with_p: DataFrame, known: DataFrame) -> DataFrame:
    """(lang, source, item, value): the divergence of each source from each other source of its language."""
    a = known.select("lang", "source", F.col("p0").alias("a0"), F.col("terms").alias("na"), "v")
    b = known.select("lang", F.col("source").alias("item"), F.col("p0").alias("b0"), F.col("terms").alias("nb"))
    both = saved(a.join(b, "lang").where("source <> item"), "divergence-pairs", narrow=True)
    # terms that only one side has: its counts are few different numbers
    counts = saved(with_p.groupBy("lang", "source", "p").agg(F.count("*").alias("k")), "divergence-counts", narrow=True)
    left = counts.join(both.select("lang", "source", "item", "b0"), ["lang", "source"]).groupBy("lang", "source", "item").agg(F.expr(f"sum(k * ({_f('p', 'b0')}))").alias("x"))
    right = counts.withColumnRenamed("source", "item").join(both.select("lang", "source", "item", "a0"), ["lang", "item"]).groupBy("lang", "source", "item").agg(F.expr(f"sum(k * ({_f('a0', 'p')}))").alias("y"))
    # terms that both have, less what the two sums above counted for them
    many = found.where(F.size("has") > 1)
    if known.count() <= MOST_GROUPS:
        sizes = {(r.lang, r.source): r.m for r in known.select("lang", "source", "m").collect()}
    else:
        sizes = None
        flat = many.select("lang", "term", F.explode("has").alias("x")).select("lang", "term", "x.*").join(known.select("lang", "source", "m"), ["lang", "source"])
        many = flat.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n", "m")).alias("has"))
    shared = many.select("lang", "has").mapInArrow(tidied(partial(_shared, sizes=sizes)), "lang string, source string, item string, z long, k long").groupBy("lang", "source", "item").agg(
        F.sum("z").alias("z"), F.sum("k").alias("both"))
    n = lambda c: F.coalesce(c, F.lit(0))
    neither = (F.col("v") - F.col("na") - F.col("nb") + n("both")) * F.coalesce(F.expr(_f("a0", "b0")), F.lit(0))
    keys = ["lang", "source", "item"]
    return both.join(left, keys, "left").join(right, keys, "left").join(shared, keys, "left").select(*keys, (n("x") + n("y") + n("z") + neither).alias("value"))


def _shared(batches: Iterator[pa.RecordBatch], sizes: dict[tuple[str, str], int] | None) -> Iterator[pa.RecordBatch]:
    """(lang, source, item, z, k): sums of a task's terms over the pairs of sources that have them, and how many terms those are.

    A task adds terms up per pair of sources before anything leaves it; the result has a row for each pair at any rate.
    """
    sums: dict[tuple[str, str, str], list[int]] = {}
    step = lambda x, y: (x - y) * (x - y) // y

    def added(lang: str, names: list[str], row: np.ndarray, at: np.ndarray, value: np.ndarray, zero: np.ndarray) -> None:
        """Some terms of a language as a matrix by source: each source against all others at once."""
        shape = int(row[-1] - row[0]) + 1, len(names)
        p, p0, has = np.ones(shape, np.int64), np.ones(shape, np.int64), np.zeros(shape, bool)
        cells = row - row[0], at
        p[cells], p0[cells], has[cells] = value, zero, True
        for i, name in enumerate(names):
            some = has[:, i]
            mine, mine0, p_, p0_, other = p[some, i, None], p0[some, i, None], p[some], p0[some], has[some]
            z = np.where(other, step(mine, p_) - step(mine, p0_) - step(mine0, p_), 0).sum(0)
            k = other.sum(0)
            for j in np.flatnonzero(k):
                if i != j:
                    total = sums.setdefault((lang, name, names[j]), [0, 0])
                    total[0], total[1] = total[0] + int(z[j]), total[1] + int(k[j])

    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("has")
        flat, lengths = lists.flatten(), np.diff(lists.offsets.to_numpy())
        langs, sources = batch.column("lang").dictionary_encode(), flat.field("source").dictionary_encode()
        lang_of = np.repeat(langs.indices.to_numpy().astype(np.int64), lengths)
        # a place for each source of each language, the sources of a language side by side
        width = max(len(sources.dictionary), 1)
        places, at = np.unique(lang_of * width + sources.indices.to_numpy(), return_inverse=True)
        lang_names, source_names = langs.dictionary.to_pylist(), sources.dictionary.to_pylist()
        pairs_ = [(lang_names[x // width], source_names[x % width]) for x in places.tolist()]
        n = flat.field("n").to_numpy()
        m = flat.field("m").to_numpy() if sizes is None else np.array([sizes[x] for x in pairs_], np.int64)[at]
        big = len(n) and n.max() >= (1 << 63) // UNIT - 1
        p = np.array([1 + UNIT * (int(a) + 1) // int(b) for a, b in zip(n, m)], np.int64) if big else 1 + UNIT * (n + 1) // m
        p0 = 1 + UNIT // m
        for i, lang in enumerate(lang_names):
            own = np.flatnonzero(lang_of == i)
            first, last = np.searchsorted(places, [i * width, (i + 1) * width])
            row = np.cumsum(np.append(0, np.diff(np.repeat(np.arange(len(lengths)), lengths)[own]) != 0))  # 0, 1, ... for the terms of this language
            names = [source for _, source in pairs_[first:last]]
            most = max(MOST_CELLS // len(names), 1)
            for start in range(0, int(row[-1]) + 1, most):
                lo, hi = np.searchsorted(row, [start, start + most])
                some = own[lo:hi]
                added(lang, names, row[lo:hi], at[some] - first, p[some], p0[some])
    if sums:
        lang, source, item = zip(*sums)
        z, k = zip(*sums.values())
        yield pa.record_batch([pa.array(lang), pa.array(source), pa.array(item), pa.array(z, pa.int64()), pa.array(k, pa.int64())], ["lang", "source", "item", "z", "k"])


def unusual(with_p: DataFrame) -> DataFrame:
    """(lang, source, item, value): terms that are more frequent in a source than in its language."""
    return with_p.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))


def audit(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of all sources of all languages."""
    rows = rows_of(docs)
    kept = vocabulary(rows)
    found = postings(rows, kept)
    with_p, known = measured(found, rows.select("lang", "source").distinct(), kept)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    ranked = lambda df, part: df.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    terms = ranked(unusual(with_p), "term").where(F.col("rank") <= top)
    return ranked(pairs(found, with_p, known), "pair").unionByName(terms)


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
o AS (SELECT i, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT i) >= {LEAST}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
full_ AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
m AS (SELECT lang, source, sum(n)::HUGEINT + any_value(v) AS m FROM full_ JOIN v USING (lang) GROUP BY ALL),
p AS (SELECT lang, source, term, n, (1 + ({UNIT}::HUGEINT * (n + 1)) // m)::HUGEINT AS p FROM full_ JOIN m USING (lang, source)),
l AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL),
q AS (SELECT lang, term, (1 + ({UNIT}::HUGEINT * (n + 1)) // (s + v))::HUGEINT AS q FROM l JOIN v USING (lang) JOIN (SELECT lang, sum(n)::HUGEINT AS s FROM l GROUP BY 1) USING (lang)),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM v)
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM x) WHERE part = 'pair' OR rank <= {TOP}"""
