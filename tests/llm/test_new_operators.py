"""Vector codes, personal data and the divergence audit against brute force, SQL and planted cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from archlens.llm import divergence, pii, vectorcodes
from archlens.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def key(df: pd.DataFrame) -> list:
    return sorted(map(str, df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", ["op11_va_codes", "op13_divergence_audit"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    assert len(want) > 100 and key(got) == key(want[got.columns])


# --- vector codes ---------------------------------------------------------------------------


def brute_codes(vectors: list, start: int, rounds: int, parts: int):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64)
    width = x.shape[1] // parts
    cut = [x[:, p * width : (p + 1) * width] for p in range(parts)]
    books = [c[:start].copy() for c in cut]
    near = lambda p: ((cut[p][:, None] - books[p][None]) ** 2).sum(2)
    for _ in range(rounds):
        for p in range(parts):
            code = near(p).argmin(1)
            for e in set(code.tolist()):
                own = cut[p][code == e]
                books[p][e] = [int(s) // len(own) for s in own.sum(0)]
    apart = [near(p) for p in range(parts)]
    return ["".join(f"{a[i].argmin():02x}" for a in apart) for i in range(len(x))], [int(sum(a[i].min() for a in apart)) for i in range(len(x))], books


@pytest.mark.parametrize("bits", [0, 2, 5])
def test_cells_find_the_nearest_entry(bits):
    rng = np.random.default_rng(3)
    for n, e, width, spread in [(40, 1, 3, 5), (300, 256, 4, 3), (100, 30, 16, 9000), (50, 7, 5, 1 << 27)]:
        entries, vectors = rng.integers(-spread, spread, (e, width)), rng.integers(-spread, spread, (n, width))
        code, least, _ = vectorcodes.Cells(entries, bits).nearest(vectors)
        apart = ((vectors[:, None] - entries[None]) ** 2).sum(2)
        assert (code == apart.argmin(1)).all() and (least == apart.min(1)).all()  # ties to the lower index
    lower, upper = vectorcodes.Cells(entries, bits).bounds(vectors)
    assert (lower <= apart.T).all() and (apart.T <= upper).all()


def test_cells_leave_entries_out():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 300, (256, 16)).astype(np.int64)
    vectors = centres[rng.integers(0, 256, 500)] + rng.integers(-20, 20, (500, 16))
    _, _, refined = vectorcodes.Cells(centres).nearest(vectors)
    assert refined < 0.05 * 500 * 256


def test_codes_with_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, -0.001, 0.0, 0.25, rng.random()]) for _ in range(8)], rng.choice([None, 1, 2])) for i in range(60)]
    rows += [(3, rows[3][1], 1), (None, rows[4][1], 2)]  # a repeated row and one without an id
    odd = [(100, None, 1), (101, [1.0] * 7 + [None], 1), (102, [float("nan")] * 8, None), (103, [float("inf")] * 8, None), (205, [0.5] * 4, 1), (-6, [], None)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' AS code", "1 AS error", "label AS label_error")
    got = vectorcodes.compress(df.repartition(3)).toPandas()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    codes, errors, books = brute_codes([np.float32(r[1]) for r in order], 256, 4, 4)
    assert set(got.codebooks_sha256) == {hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()}
    by_label = Counter()
    for r, e in zip(order, errors):
        by_label[r[2]] += e
    none = lambda v: None if pd.isna(v) else int(v)
    want = sorted(str((r[0], c, e, by_label[r[2]])) for r, c, e in zip(order, codes, errors)) + [str((205, None, None, by_label[1])), str((-6, None, None, by_label[None]))]
    assert sorted(str((none(r.vec_id), r.code if isinstance(r.code, str) else None, none(r.error), none(r.label_error))) for r in got.itertuples()) == sorted(want)
    assert vectorcodes.compress(df.limit(0)).count() == 0
    assert vectorcodes.compress(df.where("vec_id IN (205, -6)")).where("code IS NULL").count() == 1  # the empty vector; four components are a length by themselves
    with pytest.raises(ValueError):
        vectorcodes.encode(df, np.zeros((4, 1, 2), np.int64), "embedding")


def test_frequent_labels(spark, monkeypatch):
    monkeypatch.setattr(vectorcodes, "FREQUENT", 0.2)
    df = spark.createDataFrame([(i, "00", i, 1 if i % 2 else (None if i % 4 else i)) for i in range(40)], "vec_id long, code string, error long, label int")
    got = {r.vec_id: r.label_error for r in vectorcodes.with_label_error(df).collect()}
    assert got == {i: sum(j for j in range(40) if j % 2) if i % 2 else (sum(j for j in range(40) if j % 4 == 2) if i % 4 else i) for i in range(40)}


# --- personal data ----------------------------------------------------------------------------


def brute_spans(t: str) -> list:
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_the_contract():
    rng = random.Random(7)
    for _ in range(20000):
        alphabet = rng.choice(["a1.@-_%+ ", "0123456789 -.", "+01 ().-9", "ab@.c-1é", "49 -16", "at dot(.)@9one "])
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 70)))
        assert list(pii.detected(t)) == brute_spans(t)
        assert [x[:3] for x in pii.found(t) if x[3]] == brute_spans(t)


CASES = [
    ("mail joe (at) example (dot) com now", "joe (at) example (dot) com", "email"),
    ("joe.smith[at]mail.example.org.", "joe.smith[at]mail.example.org", "email"),
    ("reach jane at example dot com, ok", "jane at example dot com", "email"),
    ("jоhn@example.com", "jоhn@example.com", "email"),
    ("é joe​@exam​ple.com é", "joe​@exam​ple.com", "email"),
    ("joe&#64;example&#x2e;com", "joe&#64;example&#x2e;com", "email"),
    ("ruf plus vier neun drei null eins zwei drei vier fünf an", "plus vier neun drei null eins zwei drei vier fünf", "phone"),
    ("call +one 202 five five five 1234", "+one 202 five five five 1234", "phone"),
    ("ip one nine two dot one six eight dot one dot two five", "one nine two dot one six eight dot one dot two five", "ip"),
    ("４９１３１８７１９６６７０９３２ x", "４９１３１８７１９６６７０９３２", "card"),
]


@pytest.mark.parametrize("text,span,kind", CASES)
def test_disguised_spans_point_into_the_source(text, span, kind):
    added = [(k, text[s:e]) for k, s, e, base, _ in pii.found(text) if not base]
    assert added == [(kind, span)]


@pytest.mark.parametrize("text", ["look at the example dot com", "meet at noon.", "vier fünf sechs Tage", "one of two, three people", "a point at the end", "Почта и дом.", "x " * 50, "(at) (dot)"])
def test_clean_texts_stay_clean(text):
    assert pii.found(text) == []


def test_offsets_through_all_layers():
    for text in (c[0] for c in CASES):
        plain, layers = pii.normalised("ab " + text)
        places = range(len(plain) + 1)
        for layer in reversed(layers):
            places = [layer.start(p) for p in places]
        assert places[0] == 0 and places[3] == 3 and list(places) == sorted(places)


def test_long_texts_take_linear_time():
    for text in ["a" * 300_000, "1 " * 150_000, "a" + " " * 300_000 + "@", "(at " * 75_000, "one " * 75_000, "x at y dot z " * 20_000, "+1" + "(" * 300_000]:
        pii.found(text)


def test_digest_and_masks(spark):
    texts = [None, "", "a@b.cc 1.2.3.4 joe (at) b dot cc", "+1 229 555 4838 and 4913187196670932", "no data"]
    df = spark.createDataFrame([(None if i == 4 else i, t) for i, t in enumerate(texts)] + [(2, texts[2])], "doc_id long, text string").selectExpr("*", "1 AS n_email", "2 AS spans")
    got = pii.digest(pii.spans(df)).collect()
    assert len(got) == 6
    for r in got:
        t = texts[4 if r.doc_id is None else r.doc_id] or ""
        place = lambda xs: ",".join(f"{x[0]}:{x[1]}:{x[2]}" for x in xs)
        base = [x for x in pii.found(t) if x[3]]
        assert r.base_sha256 == hashlib.sha256(place(base).encode()).hexdigest() and r.spans == place(pii.found(t))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[0] == k for x in base) for k in pii.KINDS)
    clean = {r.doc_id: r.clean for r in pii.masked(df).collect()}
    assert clean[2] == "[email] [ip] [email]" and clean[3] == "[phone] and [card]" and clean[1] == "" and clean[None] == "no data"
    assert pii.digest(pii.spans(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        pii.spans(df, keep=["spans"])


# --- divergence audit -------------------------------------------------------------------------


def brute_audit(rows: list, top: int = 200) -> list:
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    df, out = defaultdict(Counter), []
    for lang, _, terms in docs:
        df[lang].update(set(terms))
    for lang in {d[0] for d in docs}:
        kept = [t for t, n in df[lang].items() if n >= 3]
        count = defaultdict(Counter)
        for x, source, terms in docs:
            if x == lang:
                count[source].update(t for t in terms if t in set(kept))
        total = sum(count.values(), Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))
        f = lambda a, b: (a - b) * (a - b) // b
        for s in count:
            pair = [(b, sum(f(p(count[s], t), p(count[b], t)) for t in kept)) for b in count if b != s]
            term = [(t, f(p(count[s], t), p(total, t))) for t in kept if count[s][t] and p(count[s], t) > p(total, t)]
            for part, found in (("pair", pair), ("term", term)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(ranked, 1) if part == "pair" or r <= top]
    return out


@pytest.mark.parametrize("sizes", [(200, 600, 5, 0), (divergence.UNIT_BYTES, divergence.OPEN_BYTES, divergence.HELD_TERMS, divergence.MOST_GROUPS)])
def test_audit_equals_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(divergence.postings, "__defaults__", sizes[:2])
    monkeypatch.setattr(divergence.vocabulary, "__defaults__", (divergence.LEAST, sizes[2]))
    monkeypatch.setattr(divergence, "MOST_GROUPS", sizes[3])
    rng = random.Random(11)
    words = ["Alpha", "béta", "GAMMA", "delta", "Éps", "zeta", "x", "日本", "a1b"] + [f"w{chr(97 + i)}" for i in range(26)]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", None]), rng.choice([" ", "\n", "-", "\x00"]).join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for _ in range(150)]
    rows += [("fr", "s1", "only one"), ("fr", "s2", None), ("xx", "alone", "same same"), ("en", "s9", "")] + [("en", "s1", "copy of copies")] * 40 + [("en", "s4", "Alpha " * 3000)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 AS term", "2 AS unit", "3 AS rank")
    got = [tuple(r) for r in divergence.audit(df.repartition(3)).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert sorted(got) == sorted(brute_audit(rows))
    assert divergence.audit(df.limit(0)).count() == 0


def test_counts_beyond_64_bits(spark):
    n = {"a": 2**45, "b": 5}
    found = spark.createDataFrame([("en", "x", list(n.items()))], "lang string, term string, has array<struct<source: string, n: long>>")
    kept = spark.createDataFrame([("en", "x", 3), ("en", "y", 3)], "lang string, term string, docs long")
    with_p, known = divergence.measured(found, spark.createDataFrame([("en", "a"), ("en", "b")], "lang string, source string"), kept)
    p = {s: 1 + 10**9 * (c + 1) // (c + 2) for s, c in n.items()}
    assert {r.source: r.p for r in with_p.collect()} == p
    assert {r.q for r in with_p.collect()} == {1 + 10**9 * (2**45 + 6) // (2**45 + 7)}
    zero = {s: 1 + 10**9 // (c + 2) for s, c in n.items()}
    want = {(s, t): (p[s] - p[t]) ** 2 // p[t] + (zero[s] - zero[t]) ** 2 // zero[t] for s, t in (("a", "b"), ("b", "a"))}
    assert {(r.source, r.item): r.value for r in divergence.pairs(found, with_p, known).collect()} == want
