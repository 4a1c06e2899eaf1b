"""Personal data in texts, disguised forms included, with spans of the source's characters.

Two transducers normalise a text and keep track of where each piece came from: the first
replaces single characters (homoglyphs, wide and raised forms) and drops invisible ones, the
second rewrites tokens (``(at)``, ``[dot]``, ``name at site dot org``, character references,
spelled digits).  The same detectors run on the source and on what was normalised; spans of the
latter are mapped back to source characters.

Base spans are those of the source itself, leftmost and not overlapping within a kind:
email, ip (parts up to 255), card (16 to 19 digits that pass Luhn's check) and phone (8 to 15
digits after a plus); a match that fails its check is dropped.  A span found only in the
normalised text is added if it was disguised (what it covers isn't what was detected), is no
part of a base span of its kind and, for an email, ends in a domain of letters; added
spans may overlap base ones, which all stay.  A plain ``at`` counts only with a spelled dot
behind it, and spelled digits only three in a row.

All patterns take linear time: a failed run of characters is never tried again from its
middle, and at most three blanks stand between the parts of a disguise.  Defined results: null and empty texts have no spans; every row gives one row, rows
without an id and repeated rows too; texts of any length are read whole; an empty table
gives no rows.  ``spans`` keeps the other columns that are asked for; a column called spans
among them is an error.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archlens.llm.common import slices, tidied

KINDS = ("email", "ip", "card", "phone")

# The contract's patterns.  Runs are possessive, and what may follow a run is optional, so that each run is read once.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?+")
_IP = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_AT_LEAST = re.compile(r"[0-9](?:[ -]?[0-9]){15}")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def detected(text: str) -> Iterator[Span]:
    """(kind, start, end) of a text, by kind and then start."""
    if "@" in text:
        yield from (("email", m.start(), m.end()) for m in _EMAIL.finditer(text) if m[1])
    if text.count(".") >= 3:
        for m in _IP.finditer(text):
            if m[1] and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                yield "ip", m.start(), m.end()
    if _AT_LEAST.search(text):
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield "phone", m.start(), m.end()


# --- characters -----------------------------------------------------------------------------

#: Letters of other scripts that look like Latin ones, in the order of what they look like.
_LOOKALIKES = {
    "аАαΑ": "aAaA", "ВΒ": "BB", "сСϲϹ": "cCcC", "ԁ": "d", "еЕΕ": "eEE", "ƒ": "f", "ɡ": "g", "һНΗ": "hHH", "іІιΙ": "iIiI", "јЈ": "jJ",
    "КκΚ": "KkK", "ӏ": "l", "МΜ": "MM", "ΝпＮ": "NnN", "оОοΟ": "oOoO", "рРρΡ": "pPpP", "ԛ": "q", "ѕЅ": "sS", "ТΤ": "TT", "υ": "u", "ѵν": "vv", "ѡ": "w", "хХχΧ": "xXxX", "уУΥ": "yYY", "ΖᴢΖ": "ZzZ",
    "․。。٠": "...0", "‐‑‒–—−": "------", "   　": "    ",
}
#: Wide forms stand 0xFEE0 above ASCII; raised and lowered digits.
_WIDE = {0xFEE0 + c: chr(c) for c in range(0x21, 0x7F)}
_RAISED = {ord(c): str(i) for i, c in enumerate("⁰¹²³⁴⁵⁶⁷⁸⁹")} | {0x2080 + i: str(i) for i in range(10)}
_LIKE = {ord(c): to for a, b in _LOOKALIKES.items() for c, to in zip(a, b)} | _WIDE | _RAISED | {0x0660 + i: str(i) for i in range(10)} | {0x06F0 + i: str(i) for i in range(10)}
_INVISIBLE = "­​‌‍⁠﻿"
_ODD = re.compile("[" + re.escape("".join(map(chr, _LIKE))) + "]")
_HIDDEN = re.compile(f"[{_INVISIBLE}]+")

# --- tokens -----------------------------------------------------------------------------------

#: Spelled digits in English, German, French and Spanish.
_DIGITS = (
    "zero null zéro cero", "one eins un uno", "two zwei deux dos", "three drei trois tres", "four vier quatre cuatro", "five fünf cinq cinco",
    "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve",
)
_VALUE = {word: str(i) for i, words in enumerate(_DIGITS) for word in words.split()}
_DOTS, _ATS, _DASHES, _PLUS = "dot|punkt|point|punto", "at|arobase|arroba", "dash|hyphen", "plus|más"
_D = "(?:" + "|".join(sorted(_VALUE, key=len, reverse=True)) + r")(?!\w)"
_BETWEEN = r"(?:[ \t]?[,-][ \t]?|[ \t])"
_JOIN = rf"{_BETWEEN}(?:(?:{_DOTS}|{_DASHES})(?!\w){_BETWEEN})?"
_THREE = re.compile(rf"(?<!\w){_D}(?:{_JOIN}{_D}){{2}}", re.I)
#: The same for texts in lower case, without the look behind it: a quick test that comes first.
_MAY_THREE = re.compile(rf"{_D}(?:{_JOIN}{_D}){{2}}")
_RUN = re.compile(rf"(?<!\w)(?:(?:{_PLUS})(?!\w){_BETWEEN})?(?:{_D}|[0-9]{{1,4}}(?!\w))(?:{_JOIN}(?:{_D}|[0-9]{{1,4}}(?!\w)))++", re.I)
_WORD = re.compile(r"\w+")
_OPEN, _CLOSE = r"[ \t]{0,3}[(\[{<][ \t]{0,3}", r"[ \t]{0,3}[)\]}>][ \t]{0,3}"
_LABEL = r"[A-Za-z0-9-]++"
#: A name, a plain "at", and labels of which at least one is joined by a spelled dot.
_PLAIN = re.compile(rf"(?<=[A-Za-z0-9_])[ \t]{{1,3}}(?:{_ATS})[ \t]{{1,3}}(?=(?:{_LABEL}\.)*+{_LABEL}[ \t]{{1,3}}(?:{_DOTS})[ \t]{{1,3}}[A-Za-z0-9])", re.I)
_AT_SIGN = re.compile(rf"{_OPEN}(?:{_ATS}|@){_CLOSE}|(?<=[A-Za-z0-9])[ \t]{{1,3}}@[ \t]{{0,3}}(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])@[ \t]{{1,3}}(?=[A-Za-z0-9])|&#0*64;|&#x0*40;|&commat;|%40", re.I)
_DOT_SIGN = re.compile(rf"{_OPEN}(?:{_DOTS}|\.){_CLOSE}|(?<=[A-Za-z0-9])[ \t]{{1,3}}(?:(?:{_DOTS})[ \t]{{1,3}}|\.[ \t]{{0,3}})(?=[A-Za-z0-9])|&#0*46;|&#x0*2e;|&period;", re.I)
_MAY_AT = re.compile(rf"[(\[{{<][ \t]{{0,3}}(?:{_ATS}|@)[ \t]{{0,3}}[)\]}}>]|[ \t]@|@[ \t]|&#|&commat;|%40|[ \t](?:{_DOTS})[ \t]")
_MAY_DOT = re.compile(rf"[(\[{{<][ \t]{{0,3}}(?:{_DOTS}|\.)[ \t]{{0,3}}[)\]}}>]|[ \t](?:{_DOTS})[ \t]|&#|&period;|[ \t]\.")


class Layer:
    """A rewritten text that knows the source of each of its characters, as the pieces that were replaced."""

    def __init__(self, text: str, edits: Sequence[tuple[int, int, str]]):
        out, at = [], 0
        #: Starts in the new text, and in the old one, of what was copied after each replacement; the first piece is copied whole.
        self.new, self.old, self.end = [0], [0], [0]
        length = 0
        for start, end, instead in edits:
            out += [text[at:start], instead]
            length += start - at
            self.new += [length, length + len(instead)]
            self.old += [start, end]
            self.end += [end, end]
            length += len(instead)
            at = end
        out.append(text[at:])
        self.text = "".join(out)

    def start(self, place: int) -> int:
        """Where a character of the new text begins in the old one; inside a replacement, where that begins."""
        i = bisect_right(self.new, place) - 1
        return self.old[i] if i % 2 else self.old[i] + place - self.new[i]

    def stop(self, place: int) -> int:
        """Where the character before ``place`` ends in the old text; inside a replacement, where that ends."""
        i = bisect_right(self.new, place - 1) - 1
        return self.end[i] if i % 2 else self.old[i] + place - self.new[i]


def _spelled(text: str) -> list[tuple[int, int, str]]:
    """Runs with three spelled digits in a row: digits joined, spelled dots, dashes and plus as signs, written numbers as they are."""
    edits = []
    for run in _RUN.finditer(text):
        if not _THREE.search(run[0]):
            continue
        out, spelled_before = [], False
        end = run.start()
        for word in _WORD.finditer(text, run.start(), run.end()):
            w = word[0].lower()
            spelled = not w[0].isdigit()
            if out and not (spelled and spelled_before):
                out.append(" ")
            out.append(_VALUE.get(w) or ("." if re.fullmatch(_DOTS, w) else "-" if re.fullmatch(_DASHES, w) else "+" if re.fullmatch(_PLUS, w) else word[0]))
            spelled_before = spelled
            end = word.end()
        edits.append((run.start(), end, "".join(out).replace("+ ", "+")))
    return edits


def normalised(text: str) -> tuple[str, list[Layer]]:
    """The text without disguises, and the layers that lead back to the source."""
    layers: list[Layer] = []
    if not text.isascii():
        if _ODD.search(text):
            text = text.translate(_LIKE)  # one character for one: no offset moves
        if _HIDDEN.search(text):
            layers.append(Layer(text, [(m.start(), m.end(), "") for m in _HIDDEN.finditer(text)]))
            text = layers[-1].text
    low = text.lower()
    if _MAY_THREE.search(low) and _THREE.search(text):
        layers.append(Layer(text, _spelled(text)))
        text = layers[-1].text
    low = text.lower()
    if _MAY_AT.search(low):
        edits = [(m.start(), m.end(), "@") for m in _AT_SIGN.finditer(text)]
        taken = {e[0] for e in edits}
        edits += [(m.start(), m.end(), "@") for m in _PLAIN.finditer(text) if m.start() not in taken]
        layers.append(Layer(text, _apart(edits)))
        text = layers[-1].text
    if _MAY_DOT.search(low):
        layers.append(Layer(text, [(m.start(), m.end(), ".") for m in _DOT_SIGN.finditer(text)]))
        text = layers[-1].text
    return text, layers


def _apart(edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Edits in order, without those that begin inside an earlier one."""
    out: list[tuple[int, int, str]] = []
    for e in sorted(edits):
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


_LETTERS = re.compile(r"\.[A-Za-z]{2,}$")


def found(text: str) -> list[tuple[str, int, int, bool, str]]:
    """(kind, start, end, base, value) of a text, by kind and place; value is what was detected, without its disguise."""
    base = list(detected(text))
    out = [(kind, start, end, True, text[start:end]) for kind, start, end in base]
    plain, layers = normalised(text)
    if layers or plain != text:
        inside: dict[str, list[tuple[int, int]]] = {}
        for kind, start, end in base:
            inside.setdefault(kind, []).append((start, end))
        for kind, start, end in detected(plain):
            value, lo, hi = plain[start:end], start, end
            for layer in reversed(layers):
                lo, hi = layer.start(lo), layer.stop(hi)
            if text[lo:hi] == value or (kind == "email" and not _LETTERS.search(value)):
                continue
            own = inside.get(kind, [])
            i = bisect_right(own, (lo, len(text))) - 1
            if i < 0 or own[i][1] < hi:
                out.append((kind, lo, hi, False, value))
    return sorted(out, key=lambda x: (KINDS.index(x[0]), *x[1:3]))


_SPANS = "array<struct<kind: string, start: int, end: int, base: boolean, value: string>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("value", pa.string())]))


def _task(batches: Iterator[pa.RecordBatch], keep: Sequence[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "_text"):
            rows = [[dict(zip(("kind", "start", "end", "base", "value"), s)) for s in found(t.as_py() or "")] for t in part.column("_text")]
            yield pa.record_batch([*(part.column(c) for c in keep), pa.array(rows, _ARROW)], [*keep, "spans"])


def spans(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept columns and spans, an array of (kind, start, end, base, value), of every row."""
    if "spans" in keep:
        raise ValueError("a column called spans would be lost")
    given = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("_text"))
    ddl = [f"`{c}` {given.schema[c].dataType.simpleString()}" for c in keep]
    return given.mapInArrow(tidied(partial(_task, keep=list(keep))), ", ".join([*ddl, f"spans {_SPANS}"]))


def masked(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """As ``spans``, with clean, the text whose spans are replaced by their kinds in brackets; of overlapping ones the first counts."""
    both = spans(docs, text, [*keep, text])
    # each step cuts the rest of the text at one span; spans by place
    ordered = F.array_sort("spans", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    source = F.col(f"`{text}`")
    cut = lambda acc, s: F.struct(
        F.concat(acc["out"], F.substring(source, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at"))
    done = F.aggregate(ordered, zero, lambda acc, s: F.when(s["start"] >= acc["at"], cut(acc, s)).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))))
    both = both.withColumn("_done", done)
    return both.withColumn("clean", F.concat(F.col("_done.out"), F.substring(source, F.col("_done.at") + 1, F.length(source)))).drop("_done")


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, the hash of all base spans, and all spans, from ``spans``."""
    base = F.filter("spans", lambda s: s["base"])
    place = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda a: F.array_join(F.transform(a, place), ",")
    number = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(number(k) for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))
