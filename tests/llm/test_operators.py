"""Every operator against a brute-force version, on texts that are awkward in every way we know."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from archlens.llm import components, contexttree, decontamination, jaccard, language, packing, quality, repeats, sharding, substrings, suffixes, tokencounts

tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_hash string, key string, label int, start int, row string"


def prose(rng: random.Random, n: int, vocabulary: int = 60) -> str:
    words = ["w%d" % rng.randrange(vocabulary) if rng.random() < 0.5 else "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(n)]
    return " ".join(w + rng.choice(["", "", "", ".", ",\n", "\n", "\t", "!"]) for w in words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    passage, long = prose(rng, 60), prose(rng, 20_000)
    texts = [None, "", " \n\t ", "a", "A", "short one.", "!!!", "x" * 700, "ab " * 400, long, long, "ÀÉ   \x1c ǅ", "the cat " * 50]
    base = [prose(rng, rng.randint(20, 300)) for _ in range(25)]
    texts += base + base[:5]
    for b in base[5:15]:  # near copies
        words = b.split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [prose(rng, 30) + " " + passage + " " + prose(rng, rng.randint(0, 30)) for _ in range(12)]
    texts += [base[0].upper(), passage, passage + " " + passage]
    out = [(i, t, ["en", "fr", None][i % 3], "h%d" % (i % 2) if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    out += [out[20], (out[20][0], "another text of the same id", "en", "h0", 5), (None, base[3], "en", "h0", 3), (None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 2, "z") for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text, lower=False):
    data = (text or "").encode()
    return WORD.findall(data.translate(LOWER) if lower else data)


def multiset(rows):
    return Counter(rows)


def test_quality_base(docs, rows, empty):
    def repeated(w):
        starts = defaultdict(list)
        for i in range(len(w) - 4):
            starts[tuple(w[i : i + 5])].append(i)
        return len({p + k for s in starts.values() if len(s) > 1 for p in s for k in range(5)})

    want = []
    for r in rows:
        t, w = r[1] or "", words(r[1])
        lines = [x for x in t.split("\n") if words(x)]
        n = repeated(w)
        want.append((r[0], len(w), len(b"".join(w).decode()), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), n, len(w) < 10 or 100 * n > 20 * len(w)))
    got = quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert multiset(map(tuple, got.collect())) == multiset(want)
    assert quality.judge(empty).count() == 0


def test_quality_depletes_boilerplate(spark):
    line = "one two three four five six seven eight nine ten eleven"
    mine = lambda i: f"alpha{i} beta{i} gamma{i} delta{i} eps{i} zeta{i} eta{i} theta{i} iota{i} kappa{i} lam{i} mu{i}"
    rows = [(i, f"{line}\n{mine(i)}", "a") for i in range(20)] + [(100 + i, f"{line.upper()}\n{line}\nx{i}", "a") for i in range(5)] + [(200, f"{line}\nx", "b")]
    got = {r.doc_id: (r.kept, r.n_removed) for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i] == (True, 11) for i in range(20)) and all(got[100 + i] == (False, 22) for i in range(5)) and got[200] == (True, 0)


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    got = packing.pack(docs, path).collect()
    library = Tokenizer.from_file(path)
    ids = Counter()
    for r in rows:
        x = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        for a in range(0, len(x), 4096):
            ids[r[0], a, len(x[a : a + 4096]), zlib.crc32(x[a : a + 4096].tobytes()), len(x)] += 1
    assert Counter((g.doc_id, g.start, g.length, g.ids_crc32, g.doc_tokens) for g in got) == ids
    windows = defaultdict(list)
    for g in got:
        windows[g.sequence_id].append((g.offset, g.length))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(empty, path).count() == 0


def test_packing_plan_uses_up_any_histogram():
    rng = random.Random(3)
    for _ in range(5):
        histogram = {rng.choice([rng.randint(1, 255), 16 * rng.randint(16, 256)]): rng.randint(1, 5000) for _ in range(80)}
        plan = packing.plan(histogram, 4096)
        used = Counter()
        for parts, repeats_ in plan:
            assert sum(x * c for x, c in parts.items()) <= 4096 and repeats_ > 0
            for x, c in parts.items():
                used[x] += c * repeats_
        assert used == histogram
    usual = {x: int(2e6 / (x + 300)) for x in [*range(1, 256), *range(256, 4097, 16)]}
    assert sum(n for _, n in packing.plan(usual, 4096)) <= 1.01 * sum(x * c for x, c in usual.items()) / 4096


def test_nnls_is_optimal():
    rng = np.random.default_rng(1)
    a, b = rng.random((12, 30)), rng.random(12)
    x = packing.nnls(a, b)
    gain = a.T @ (b - a @ x)
    assert (x >= 0).all() and (gain < 1e-6).all() and np.abs(gain[x > 0]).max() < 1e-6


def test_token_counts(docs, rows, empty):
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = tokencounts.prefix_counts(docs, path, limit=100, store=True).collect()
    want = [(r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "")), len(library.encode(r[1] or "")) > 100) for r in rows]
    assert multiset((g.doc_id, g.n_bytes, g.n_tokens, g.over_limit) for g in got) == multiset(want)
    by_id = {r[0]: r[1] or "" for r in rows[:60]}
    rng = random.Random(5)
    for g in got:
        text = by_id.get(g.doc_id)
        if text is None or len(text) != len(g.deltas):
            continue
        for p in {0, len(text), *(rng.randrange(len(text) + 1) for _ in range(3))}:
            assert tokencounts.count_at(g.deltas, p) == len(library.encode(text[:p]))
        assert len(library.encode(text[: g.cut_at])) <= 100
        assert g.cut_at == len(text) or len(text) > 5000 or all(len(library.encode(text[:p])) > 100 for p in range(g.cut_at + 1, len(text) + 1))
    assert tokencounts.prefix_counts(empty, path).count() == 0


def test_remembered_chunks_are_bounded_by_bytes():
    rng, path = random.Random(3), tokenizers.path("piece_bpe_32k.model")
    few, all_ = tokencounts.PrefixCounter(path, most=60_000), tokencounts.PrefixCounter(path)
    for _ in range(60):  # texts without spaces are one chunk, ordinary ones are many
        for text in ("".join(rng.choices("\u6587\u5b57abc+/", k=2000)), " ".join("".join(rng.choices("abcde", k=3)) for _ in range(300))):
            assert (few.prefix_deltas(text) == all_.prefix_deltas(text)).all()
            assert few.held <= few.most and few.held == sum(tokencounts.ENTRY_BYTES + sys.getsizeof(c) + sys.getsizeof(d) for c, d in few.known.items())
    assert len(few.known) < len(all_.known) and len(few.known) > 0


def test_language(spark, docs, empty):
    rng = random.Random(2)
    sound = {"aa": "aeiou", "bb": "bcdfg", "cc": "äöüßt"}
    rows = []
    for i in range(300):
        lang = rng.choice(list(sound))
        rows.append((i, " ".join("".join(rng.choice(sound[lang]) for _ in range(5)) for _ in range(30)), lang))
    rows += [(1000, None, "aa"), (1001, "123 !!", "aa"), (1002, "", None)]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in rows[:300])
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(300))
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert language.identify(docs).count() == docs.count() and language.identify(empty).count() == 0


def test_language_filters_have_no_false_negatives():
    f = language.Filter(["a"], np.zeros((1, 1024), np.uint64), np.zeros(1))
    codes = np.arange(50, dtype=np.int64) * 977
    for at in language.cells_of(codes, 1024):
        f.cells[0, at] |= np.uint64(1)
    assert language.shares(f, codes, np.zeros(50, np.int64), 1)[0, 0] == 1.0


def brute_grams(text):
    folded = "".join(chr(b + 32) if 65 <= b <= 90 else chr(b) if 97 <= b <= 122 or b >= 128 else " " for b in (text or "").encode())
    folded = re.sub(" +", " ", f" {folded} ")
    return [tuple(map(ord, folded[i : i + 3])) for i in range(len(folded) - 2)]


def test_language_against_the_definition(spark):
    rng = random.Random(31)
    alphabet = {"aa": "abcdeé", "bb": "cdefgü", "cc": "efghiß"}
    text = lambda lang, n: " ".join("".join(rng.choice(alphabet[lang]) for _ in range(rng.randint(1, 6))) for _ in range(n))
    rows = [(i, text(lang, 25), lang) for i, lang in enumerate(rng.choice(list(alphabet)) for _ in range(120))]
    rows += [(200 + i, text("aa", 20), "bb") for i in range(3)] + [(300, "Solo", "cc"), (301, None, "aa"), (302, text("cc", 9), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    counts = {x: Counter(g for _, t, lang in rows if lang == x and t is not None for g in brute_grams(t)) for x in alphabet}
    f = language.learn(df)
    code = lambda g: (g[0] << 16) + (g[1] << 8) + g[2]
    grams = sorted(set().union(*counts.values()))
    found = language.sets(f, np.array([code(g) for g in grams]))
    assert f.languages == sorted(alphabet)
    wrong = 0
    for k, g in enumerate(grams):  # every language of every gram, and few others
        for i, lang in enumerate(f.languages):
            for level, least in enumerate(language.LEVELS):
                bit = int(found[0, k]) >> (i * len(language.LEVELS) + level) & 1
                held = counts[lang][g] > 0 and counts[lang][g] / counts[lang].total() >= least
                assert bit or not held
                wrong += bit and not held
    assert wrong <= 0.1 * len(grams)
    exact = lambda t, lang: sum(sum(counts[lang][g] > 0 and counts[lang][g] / counts[lang].total() >= x for x in language.LEVELS) for g in brute_grams(t)) / len(brute_grams(t)) / len(language.LEVELS)
    for r in language.predict(df, f).collect():
        t = next(t for i, t, _ in rows if i == r.doc_id)
        if t:
            best = sorted((exact(t, x) for x in f.languages), reverse=True)
            assert r.score == pytest.approx(best[0], abs=0.05)
            assert best[0] - best[1] < 0.1 or exact(t, r.lang_pred) == best[0]


def morse(n, a, b):
    """A word of 2**n letters, and the same with its letters changed: polynomial hashes modulo 2**64 can't tell them apart."""
    bits = [bin(i).count("1") % 2 for i in range(1 << n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def test_words_that_polynomial_hashes_confuse(spark):
    one, other = morse(10, "a", "b")
    rng = random.Random(17)
    filler = lambda: [prose(rng, 1).strip() + "%d" % rng.randrange(10**9) for _ in range(30)]
    rest = [x for x in filler() if len(x.split()) == 1]
    texts = [" ".join([*rest, one, *rest[::-1]]), " ".join([*rest, other, *rest[::-1]])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {g.doc_id: (g.n_removed, g.kept_sha256) for g in substrings.remove_repeats(df).collect()}
    assert got == {i: (0, hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(texts)}
    assert not any(map(any, brute_repeats([words(t) for t in texts], 35)))
    check_components(spark, [one + " a b c d", other + " a b c d", one, other])
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    crc = {g.doc_id: g.ids_crc32 for g in packing.pack(df, path).where("start = 0").collect()}
    want = {i: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")[:4096].tobytes()) for i, t in enumerate(texts)}
    assert crc == want and crc[0] != crc[1]
    pair = spark.createDataFrame([(None, f"{one} {one} {one}"), (1, one), (2, other)], "doc_id long, text string")
    base = {g.doc_id: round(g.base_score, 5) for g in contexttree.score(pair).collect()}
    assert base[1] > base[2]
    runs = [morse(9, "x", "y")[0] * 3, morse(9, "x", "y")[1] * 3 + "z"]
    raw = spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string")
    assert {g.doc_id: g.n_removed for g in suffixes.remove_repeats(raw).collect()} == {i: sum(gone) for i, gone in enumerate(brute_repeats([t.encode() for t in runs], 200))}


def test_suffix_sort_survives_colliding_hashes(monkeypatch):
    rng = random.Random(3)
    body = bytes(rng.choice(b"ab") for _ in range(40))
    texts = [body, body, body[:20] + bytes(rng.choice(b"ab") for _ in range(20)), bytes(rng.choice(b"ab") for _ in range(40))]
    segments = [repeats.Segment(1, t, 1, 1, 5) for t in texts]
    want = [texts.count(t) > 1 for t in texts]
    assert [bool(f[0]) for f in suffixes.resolve(segments, repeats.Unit(False, 40, 8))] == want
    monkeypatch.setattr(suffixes, "BYTE_VALUE", np.zeros(256, np.uint64))  # every hash is 0
    assert [bool(f[0]) for f in suffixes.resolve(segments, repeats.Unit(False, 40, 8))] == want


def test_every_window_is_decided_by_the_resolver(spark):
    rng = random.Random(13)
    passage = " ".join("p%d" % rng.randrange(10**6) for _ in range(60))
    texts = [passage + " " + prose(rng, 20) for _ in range(6)] + [passage] * 3 + [prose(rng, 80)]
    df = repeats.identified(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    unit = repeats.Unit(True, substrings.WINDOW, substrings.GRAM)
    none = lambda segments, unit: [np.zeros(s.windows, bool) for s in segments]
    for most in (5000, 1):  # by anchors, and by whole windows
        assert repeats.repeated_runs(df, unit, none, most).count() == 0
        flagged = sum(r.windows if r.flags is None else sum(r.flags) for r in repeats.repeated_runs(df, unit, substrings.resolve, most).collect())
        assert flagged == 9 * 26 + 0


def test_quality_rows_lose_their_own_lines_only(spark):
    line, other = "one two three four five six seven eight nine ten", "uno dos tres cuatro cinco seis siete ocho nueve diez"
    mine = lambda i: " ".join(f"w{i}x{k}" for k in range(12))
    rows = [(i, f"{line}\n{mine(i)}", "a") for i in range(12)] + [(5, f"{line}\n{mine(5)}", "a")]  # a row twice
    rows += [(None, f"{other}\n{mine(100 + i)}", "a") for i in range(11)]  # documents of their own
    rows += [(50, f"{line} x{i}\n{mine(50)}", "a") for i in range(3)] + [(60, f"same {k}\n{mine(200 + k)}", "a") for k in range(3)]
    rows += [(70, f"shared by one id\n{mine(300 + k)}", "b") for k in range(20)]  # one document, however many rows
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    document = lambda k: rows[k][0] if rows[k][0] is not None else ("row", k)
    held, hosts = defaultdict(set), defaultdict(set)
    for k, (_, t, host) in enumerate(rows):
        hosts[host].add(document(k))
        for x in t.split("\n"):
            held[host, " ".join(x.lower().split())].add(document(k))
    often = {x for x, d in held.items() if len(d) > quality.MOST_DOCUMENTS and len(d) > quality.MOST_SHARE * len(hosts[x[0]])}
    want = [(i, sum(len(x.split()) for x in t.split("\n") if (host, " ".join(x.lower().split())) in often)) for i, t, host in rows]
    got = quality.judge(df).collect()
    assert multiset((g.doc_id, g.n_removed) for g in got) == multiset(want)
    assert all(g.kept for g in got if g.doc_id == 5) and {n for _, n in want} == {0, 10}


def brute_components(texts):
    """n_shingles and component (least index) of texts, from all pairs."""
    sets = []
    for t in texts:
        w = words(t, lower=True)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


def check_components(spark, texts):
    n, component = brute_components(texts)
    got = jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {g.doc_id: (g.n_shingles, g.component_id) for g in got} == {i: (n[i], component[i]) for i in range(len(texts))}


def test_jaccard(spark, docs, rows, empty):
    check_components(spark, [r[1] for r in rows])
    assert jaccard.near_duplicates(docs).count() == len(rows) and jaccard.near_duplicates(empty).count() == 0


def test_jaccard_null_ids_keep_the_links_of_others(spark):
    rng = random.Random(21)
    w = ["n%d" % rng.randrange(10_000) for _ in range(90)]
    text, near = " ".join(w), " ".join([*w[:40], "other", *w[41:]])
    lonely = prose(rng, 80)
    rows = [(None, text), (7, text), (8, text), (3, near), (None, near), (None, lonely), (None, lonely), (5, prose(rng, 80))]
    got = Counter((g.doc_id, g.component_id) for g in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(None, 3), (7, 3), (8, 3), (3, 3), (None, 3), (None, None), (None, None), (5, 5)])


def test_jaccard_near_the_threshold(spark, monkeypatch):
    rng = random.Random(11)
    texts = []
    for size in (5, 6, 7, 8, 9, 10, 12, 15, 20, 40, 90, 200):
        for _ in range(3):
            w = ["v%d" % rng.randrange(10_000) for _ in range(size)]
            texts.append(" ".join(w))
            for _ in range(6):
                x = w[:]
                for _ in range(rng.randint(0, max(1, size // 22))):
                    at = rng.randrange(len(x))
                    x[at : at + rng.randint(0, 1)] = ["n%d" % rng.randrange(10_000)]
                texts.append(" ".join(x[rng.randint(0, size // 12) :]))
    check_components(spark, texts)


def test_jaccard_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_BYTES", 8 * 8 * 90)
    rng = random.Random(4)
    w = ["k%d" % i for i in range(120)]
    check_components(spark, [" ".join(w[:p] + ["z%d" % p] + w[p + 1 :]) for p in range(60)] + [" ".join(rng.sample(w, 100)) for _ in range(5)])


def test_jaccard_in_blocks_beyond_the_hub(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_BYTES", 8 * 8 * 90)
    rng = random.Random(6)
    w, texts = ["k%d" % i for i in range(100)], []
    for i in range(45):  # drifts away from where it began, with branches
        at = rng.randrange(100)
        w = w[:at] + ["d%d" % i] + w[at + 1 :]
        texts.append(" ".join(w))
        texts.append(" ".join(w[:90] + ["e%d" % i] + w[91:]))
    check_components(spark, texts)


@pytest.mark.parametrize("group_bytes", [48 << 20, 8 * 8 * 90])
def test_jaccard_forms_long_chains_anew(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(jaccard, "CHAIN_BYTES", 0)
    monkeypatch.setattr(jaccard, "GROUP_BYTES", group_bytes)
    rng = random.Random(12)
    w, texts = ["k%d" % i for i in range(100)], []
    for i in range(30):
        at = rng.randrange(100)
        w = w[:at] + ["d%d" % i] + w[at + 1 :]
        texts += [" ".join(w), " ".join(w[:90] + ["e%d" % i] + w[91:]), " ".join(rng.sample(w, rng.randint(3, 100))), f"q{i} r s t u v"]
    check_components(spark, texts + texts[:10])


def test_jaccard_does_not_compare_all_that_passages_chain(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHAIN_BYTES", 8 * 100)
    monkeypatch.setattr(jaccard, "GROUP_BYTES", 8 * 100 * 8)
    rng = random.Random(13)
    passages = [prose(rng, 60) for _ in range(40)]
    texts = [f"{passages[i]} {prose(rng, 10)} {passages[i + 1]}" for i in range(39)]  # halves in common, so keys, but no link
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near = jaccard.key_members(docs).where("node <> hub").selectExpr("node AS a", "hub AS b")
    assert components.components(near).groupBy("label").count().agg({"count": "max"}).first()[0] > 8  # keys chain more than a task holds
    monkeypatch.setattr(jaccard, "_units", None)  # blocks of a chain would each be compared with all others
    check_components(spark, texts)


def test_bitmaps_allow_every_link():
    rng = np.random.default_rng(5)
    for size in (1, 4, 15, 63, 64, 65, 300, 3000):
        base = rng.integers(0, 2**63, size, np.uint64)
        sets = [np.unique(np.concatenate([base[rng.random(size) < p], rng.integers(0, 2**63, size // 9, np.uint64)])) for p in (1, 1, 0.95, 0.9, 0.9, 0.5)]
        sets = [s for s in sets if len(s)]
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                for sides in ([jaccard.ALL] * 2, [jaccard.LEFT, jaccard.RIGHT]):
                    found = jaccard.may_link(np.array([len(a), len(b)]), [jaccard.bitmap(a), jaccard.bitmap(b)], np.array(sides))
                    assert found or not jaccard.linked(a, b)
    for near in ((60, 64, 70), (500, 505, 560)):
        strangers = [np.unique(rng.integers(0, 2**63, n, np.uint64)) for n in near]
        assert jaccard.may_link(np.array([len(s) for s in strangers]), [jaccard.bitmap(s) for s in strangers], np.full(3, jaccard.ALL)) == []


def test_signature_tree_finds_all_connections():
    rng = np.random.default_rng(9)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**63, 60, np.uint64)
        for _ in range(8):
            keep = base[rng.random(60) < 0.95]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, rng.integers(0, 6), np.uint64)])))
    sets = [sets[i] for i in rng.permutation(len(sets))]

    def labels(pairs):
        root = list(range(len(sets)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i, j in pairs:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
        return [find(i) for i in range(len(sets))]

    assert labels(jaccard.forest(sets)) == labels([(i, j) for i in range(len(sets)) for j in range(i) if jaccard.linked(sets[i], sets[j])])


def test_context_tree_base(docs, rows, empty):
    learned = [r for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2]
    count = Counter(w for r in learned for w in [*words(r[1], True), None])
    n, v = sum(count.values()), len(count)
    want = []
    for r in rows:
        w = [*words(r[1], True), None]
        want.append((r[0], r not in learned, len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)))
    got = contexttree.score(docs).collect()
    assert multiset((g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 6)) for g in got) == multiset(want)
    assert all(g.score < 0 for g in got)
    assert contexttree.score(empty).count() == 0


def brute_ctw(training, depth):
    """log10 probability of a byte after a context, by the definition, for a tree without pruning."""
    counts = defaultdict(lambda: [0, 0])  # (context, decision) -> zeros, ones
    children = defaultdict(set)
    for text in training:
        data = bytes([255] * depth) + text.translate(LOWER) + bytes([255])
        for i in range(depth, len(data)):
            for d in range(depth + 1):
                context = data[i - d : i]
                node = 1
                for bit in range(7, -1, -1):
                    b = data[i] >> bit & 1
                    counts[context, node][b] += 1
                    node = 2 * node + b
                if d:
                    children[context[1:]].add(context)
    kt = lambda c: math.lgamma(c[0] + 0.5) + math.lgamma(c[1] + 0.5) - math.lgamma(sum(c) + 1) - math.log(math.pi)

    def log_weighted(context, node):
        own = kt(counts[context, node])
        if len(context) == depth:
            return own
        below = sum(log_weighted(c, node) for c in children[context])
        return np.logaddexp(own, below) - math.log(2)

    def chance(context_bytes, node, context=b""):
        c = counts[context, node]
        own = (c[1] + 0.5) / (sum(c) + 1) if sum(c) else 0.5
        if len(context) == depth:
            return own
        below = sum(log_weighted(x, node) for x in children[context])
        w = 1 / (1 + math.exp(min(700, below - kt(c))))
        deeper = context_bytes[len(context_bytes) - len(context) - 1 :]
        next_ = chance(context_bytes, node, deeper) if deeper in children[context] else own
        return w * own + (1 - w) * next_

    def log10(context_bytes, byte):
        node, out = 1, 0.0
        for bit in range(7, -1, -1):
            b = byte >> bit & 1
            p = chance(context_bytes, node)
            out += math.log10(p if b else 1 - p)
            node = 2 * node + b
        return out

    return log10


def test_context_tree_matches_the_definition(spark):
    training = [b"abab abba", b"abcab", b""]
    model = contexttree.learn(spark.createDataFrame([(t.decode(),) for t in training], "text string"), depth=2, least=0.0)
    log10 = brute_ctw(training, 2)
    for text in (b"abab", b"Abba c", b"", b"zz"):
        data = bytes([255] * 2) + text.translate(LOWER) + bytes([255])
        want = sum(log10(data[i - 2 : i], data[i]) for i in range(2, len(data)))
        got = contexttree.text_logs(model, np.frombuffer(text, np.uint8), np.array([0, len(text)]), 2)[0]
        assert got == pytest.approx(want, abs=2e-4)


def test_context_tree_probabilities_add_up(spark):
    rng = random.Random(1)
    model = contexttree.learn(spark.createDataFrame([(prose(rng, 200),) for _ in range(10)], "text string"))
    assert len(model.logs) > 5 and np.allclose((10.0 ** model.logs.astype(float)).sum(axis=1), 1, atol=1e-4)


def test_context_tree_beats_uniform_on_held_out_text(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, prose(rng, 100)) for i in range(60)], "doc_id long, text string")
    held = [g for g in contexttree.score(df).collect() if g.held_out]
    assert held and all(g.bits_per_byte < 6 for g in held)


def test_context_tree_keeps_contexts_of_rare_sources(spark):
    rng = random.Random(12)
    training = [(i, prose(rng, 400)) for i in range(60) if zlib.crc32(str(i).encode()) % 7 != 2] + [(None, "qzxj vkqz zxjq"), (None, None)]
    held = [(i, t) for i in range(60, 200) if zlib.crc32(str(i).encode()) % 7 == 2 for t in ("zxjq qzxj", prose(rng, 20), "日本", "", None)]
    df = spark.createDataFrame(training + held, "doc_id long, text string").repartition(3)
    model = contexttree.learn(spark.createDataFrame([(t,) for _, t in training], "text string"), least=0.0)  # every context
    want = []
    for doc_id, t in training + held:
        data = np.frombuffer((t or "").encode(), np.uint8)
        want.append((doc_id, contexttree.text_logs(model, data, np.array([0, len(data)]), contexttree.DEPTH)[0]))
    order = lambda x: (-1 if x[0] is None else x[0], x[1])
    got = sorted([(g.doc_id, g.score) for g in contexttree.score(df).collect()], key=order)
    want.sort(key=order)
    assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want], rel=1e-4)


def test_sharding(docs, rows, empty, spark):
    got = sharding.shard_documents(docs).collect()
    assert multiset((g.doc_id, g.size, g.text_crc32) for g in got) == multiset((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    by_shard = defaultdict(list)
    for g in got:
        assert g.law == "key" and (g.grown_shard == g.shard or g.grown_shard == 24)
        by_shard[g.shard].append(g.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert sharding.shard_documents(empty).count() == 0
    many = sharding.assign(spark.range(6000).withColumnRenamed("id", "doc_id"), "doc_id", [1.0, 2.0, 0.0]).groupBy("shard").count().collect()
    n = {r["shard"]: r["count"] for r in many}
    assert set(n) == {0, 1} and 0.28 < n[0] / 6000 < 0.39


def brute_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_distance():
    rng = random.Random(6)
    for _ in range(300):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 80)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 90)))
        assert decontamination.best_match(item, text)[0] == min(len(item), brute_distance(item, text))


def test_decontamination_finds_all_within_the_budget(spark):
    rng = random.Random(19)
    items = [(i, prose(rng, rng.randint(12, 30), 500)) for i in range(8)]
    texts = []
    for _ in range(60):
        text = list(decontamination.normalised(rng.choice(items)[1]).strip())
        for _ in range(rng.randint(0, len(text) // 7)):
            at = rng.randrange(len(text))
            text[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "x", "e"])
        texts.append(prose(rng, 15) + " " + "".join(text) + " " + prose(rng, 15))
    want = set()
    for i, t in enumerate(texts):
        for item_id, item in items:
            item, text = decontamination.normalised(item), decontamination.normalised(t)
            distance = decontamination.best_match(item, text)[0]
            if distance <= int(len(item) * decontamination.BUDGET):
                want.add((i, item_id, distance))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontamination.leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(g.doc_id, g.item_id, g.distance) for g in got} == want
    assert any(6 < 100 * d / len(items[j][1]) for _, j, d in want) and len(want) < 60


def test_decontamination(spark, docs, empty):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randint(15, 40), 500)) for i in range(12)] + [(50, None), (51, "!!"), (52, ""), (53, prose(rng, 20, 500))]
    benchmark = spark.createDataFrame([(*i, 9) for i in items], "item_id long, text string, doc_id int")
    rows = []
    for n in range(80):
        text = items[n % 12][1]
        if n % 3:
            x = list(text.upper() if n % 2 else text)
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(x))
                x[at : at + rng.randint(0, 1)] = [rng.choice("qxz")] if rng.random() < 0.7 else []
            text = "".join(x)
        rows.append((n, prose(rng, 30, 500) + "\n" + text + " " + prose(rng, 30, 500)))
    rows += [(100, None), (101, ""), (102, prose(rng, 300, 500))]
    got = {(r.doc_id, r.item_id): r.distance for r in decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    want = {}
    for doc_id, text in rows:
        for item_id, item in items:
            a, b = decontamination.normalised(item), decontamination.normalised(text)
            if a.strip() and b.strip() and (d := brute_distance(a, b)) <= int(len(a) * decontamination.BUDGET):
                want[doc_id, item_id] = d
    assert got == want and len(want) > 40
    assert decontamination.leaks(docs, benchmark).count() >= 0 and decontamination.leaks(empty, benchmark).count() == 0
    assert decontamination.leaks(docs, benchmark.limit(0)).count() == 0


def brute_repeats(sequences, window):
    count = Counter(tuple(s[i : i + window]) for s in sequences for i in range(len(s) - window + 1))
    out = []
    for s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - window + 1):
            if count[tuple(s[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append(gone)
    return out


@pytest.mark.parametrize("most_runs", [5000, 1])
def test_substrings(docs, rows, empty, monkeypatch, most_runs):
    monkeypatch.setattr(repeats.repeated_runs, "__defaults__", (most_runs,))
    sequences = [words(r[1]) for r in rows]
    want = []
    for r, w, gone in zip(rows, sequences, brute_repeats(sequences, 35)):
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want.append((r[0], len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    got = substrings.remove_repeats(docs, keep=["lang"]).collect()
    assert multiset((g.doc_id, g.n_words, g.n_removed, g.kept_sha256) for g in got) == multiset(want)
    assert all(hashlib.sha256(b" ".join(words(g.kept_text))).hexdigest() == g.kept_sha256 for g in got)
    assert substrings.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("most_runs", [5000, 1])
def test_suffixes(docs, rows, empty, monkeypatch, most_runs):
    monkeypatch.setattr(repeats.repeated_runs, "__defaults__", (most_runs,))
    sequences = [(r[1] or "").encode() for r in rows]
    want = []
    for r, s, gone in zip(rows, sequences, brute_repeats(sequences, 200)):
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        want.append((r[0], len(s), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(s, gone) if not g)).hexdigest()))
    got = suffixes.remove_repeats(docs).collect()
    assert multiset((g.doc_id, g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got) == multiset(want)
    assert suffixes.remove_repeats(empty).count() == 0


def test_suffix_sort_orders_suffixes():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 2, 800).astype(np.uint8)
    start = rng.permutation(700)[:300]
    classes = np.sort(rng.integers(0, 4, 300))
    order = suffixes.SuffixSort(data, 50).sort(start, classes)
    want = sorted(range(300), key=lambda i: (classes[i], data[start[i] : start[i] + 50].tobytes()))
    assert [data[start[i] : start[i] + 50].tobytes() for i in order] == [data[start[i] : start[i] + 50].tobytes() for i in want]


def test_suffix_automaton_counts_occurrences():
    rng = random.Random(3)
    automaton, texts = substrings.SuffixAutomaton(), []
    for _ in range(12):
        texts.append(([rng.choice("ab") for _ in range(rng.randint(1, 25))], rng.randint(1, 2)))
        automaton.add(*texts[-1])
    automaton.close()
    for text, _ in texts:
        for width in (1, 3, 6):
            want = [sum(n for t, n in texts for j in range(len(t) - width + 1) if t[j : j + width] == text[i : i + width]) > 1 for i in range(len(text) - width + 1)]
            assert automaton.repeated(text, width).tolist() == want
