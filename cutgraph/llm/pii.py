"""Personal data: base patterns, and offset-preserving deobfuscation.

A chain of transducers rewrites a text into a plain form (homoglyphs and fullwidth letters to ASCII,
spelled digits to figures, ``(at)`` and ``dot`` to their signs) and keeps, for each character of the
result, the span of source characters it stands for. Identifiers found in the plain form are mapped
back through that. Texts without a trace of disguise skip the chain, as it would change nothing.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does: the last group of the match before takes its whole run.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# Letters of other scripts that look like these, in the order of PLAIN.
_LOOKALIKES = str.maketrans("аеорсухіјѕԁһкмтвнАВЕКМНОРСТХІЅЈΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανι＠．＋－", "aeopcyxijsdhkmtbhABEKMHOPCTXISJABEZHIKMNOPTYXoavi@.+-")
_LOOKALIKES |= {0xFF10 + i: chr(48 + i) for i in range(10)} | {0xFF21 + i: chr(65 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
_HAS_LOOKALIKE = re.compile("[" + "".join(map(chr, _LOOKALIKES)) + "]")
_HIDDEN = re.compile("[​-‍⁠﻿­]")
# The words for 0 to 9 in each language; "oh" is a spoken zero.
_SPOKEN = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
_DIGIT_WORDS = {w: str(d) for words in _SPOKEN.values() for d, w in enumerate(words.split())} | {"oh": "0", "fuenf": "5"}
_ONE = f"(?:{'|'.join(sorted(_DIGIT_WORDS, key=lambda w: (-len(w), w)))})"
# Runs of spelled digits and groups of figures, none of them part of a word or a local part.
_ITEM = rf"(?:{_ONE}|[0-9]++)(?![@\w])"
_SPELLED = re.compile(rf"(?<![@\w]){_ITEM}(?:(?:[ \t,-]+|\.){_ITEM})*+", re.I)
_HAS_SPELLED = re.compile(rf"\b{_ONE}(?:[ \t,-]+|\.)(?:{_ONE}|[0-9])|[0-9][ \t,-]+{_ONE}\b|\bplus[ \t]+[0-9]", re.I)
_DIGIT_OR_SEPARATOR = re.compile(rf"({_ONE})|([0-9]+)|([ \t,-]+|\.)", re.I)
# "plus" before figures or spelled digits
_PLUS = re.compile(rf"\bplus[ \t]+(?=[0-9]|{_ONE}\b)", re.I)
# Words without brackets are signs only before one of these. Fixed values.
_TOP = "(?:com|org|net|edu|gov|mil|int|info|biz|io|co|dev|app|ai|de|fr|es|it|nl|uk|eu|us|ca|ch|at)"
# Country codes and generic domains besides; not after a word like "the", as many are words themselves.
_MORE_TOPS = (
    "ac ad ae af ag al am ao aq ar as au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bv bw by bz cc cd cf cg ci ck cl cm cn cr cu cv cw cx cy cz dj dk dm do dz ec ee eg er et fi fj fk fm fo ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in iq ir is je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sj sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw "
    "name pro mobi tel travel jobs museum coop aero asia cat post xyz online site website space store shop tech cloud blog club email live news media digital agency company group network solutions software systems studio design academy university school world life page link one art inc ltd law bank finance health care"
).split()
_ARTICLE = "(?:the|a|an|this|that|these|those|each|every|some|any|its|his|her|their|our|your|my)"
_LABELS = r"(?:[A-Za-z0-9-]+[ \t]+dot[ \t]+)*+"
_TO_TOP = rf"{_LABELS}(?:{_TOP}|(?:{'|'.join(_MORE_TOPS)}))\b"
_AT = re.compile(rf"[ \t]*(?:\[at\]|\(at\)|\{{at\}}|<at>|\[@\]|\(@\))[ \t]*|(?<=[A-Za-z0-9])[ \t]+at[ \t]+(?=[A-Za-z0-9-]+(?:[ \t]+dot[ \t]+{_LABELS}{_TOP}\b|[ \t]*[\[({{<]dot[\])}}>])|(?!{_ARTICLE}\b)[A-Za-z0-9-]+[ \t]+dot[ \t]+{_TO_TOP})", re.I)
_DOT = re.compile(rf"[ \t]*(?:\[dot\]|\(dot\)|\{{dot\}}|<dot>|\[\.\]|\(\.\))[ \t]*|(?<=[A-Za-z0-9])[ \t]+dot[ \t]+(?={_TO_TOP})|(?<=[0-9])[ \t]+dot[ \t]+(?=[0-9])", re.I)
# Behind a sign "@" any label may follow, and before one the words of a local part.
_DOTS_BEHIND = re.compile(r"(?<=@)[A-Za-z0-9-]+(?:[ \t]+dot[ \t]+[A-Za-z0-9-]+)*[ \t]+dot[ \t]+[A-Za-z]{2,}\b", re.I)
_DOTS_BEFORE = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]++(?:[ \t]+dot[ \t]+[A-Za-z0-9._%+-]++)++(?=@)", re.I)
_DOT_WORD = re.compile(r"[ \t]+dot[ \t]+", re.I)
_HAS_SIGN = re.compile(r"[\[({<](?:at|dot|@|\.)[\])}>]|[ \t]dot[ \t]", re.I)


#: What every text with a disguise has, for a quick search over whole batches: a superset of the tests in plain_form().
_TRACE = "|".join([_HAS_LOOKALIKE.pattern, _HIDDEN.pattern, rf"(?i:\b{_ONE}(?:[ \t,-]+|\.)(?:{_ONE}|[0-9])|[0-9][ \t,-]+{_ONE}|\bplus[ \t]+[0-9])", r"(?i:[\[({<](?:at|dot|@|\.)[\])}>]|[ \t]dot[ \t])"])


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) << (i & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def find_spans(text: str) -> list[Span]:
    """Base spans by kind, then start. Failing matches are dropped and not retried."""
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append(("email", start, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            last = at + 1
            at = text.find("@", last)
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(q := p.lstrip("0")) < 3 or len(q) == 3 and q <= "255" for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


class Plain:
    """A rewritten text; character i stands for source[starts[i]:ends[i]]."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, list(range(len(text))), list(range(1, len(text) + 1))

    def replace(self, pattern: re.Pattern, made) -> None:
        """Each match becomes the pieces (text, from, to) of ``made(match)``."""
        text, starts, ends, done = [], [], [], 0
        for m in pattern.finditer(self.text):
            text.append(self.text[done : m.start()])
            starts += self.starts[done : m.start()]
            ends += self.ends[done : m.start()]
            for new, a, b in made(m):
                text.append(new)
                starts += [self.starts[a]] * len(new)
                ends += [self.ends[b - 1]] * len(new)
            done = m.end()
        if text:
            self.text = "".join(text) + self.text[done:]
            self.starts, self.ends = starts + self.starts[done:], ends + self.ends[done:]


def _digits(m: re.Match) -> Iterator[tuple[str, int, int]]:
    """Spelled digits of a run as figures, closed up with their neighbours; what stands between figures stays."""
    found = list(_DIGIT_OR_SEPARATOR.finditer(m[0]))
    for i, x in enumerate(found):
        a, b = m.start() + x.start(), m.start() + x.end()
        if x[1]:
            yield _DIGIT_WORDS[x[1].casefold()], a, b
        elif x[2] or x[3] == "." or not (found[i - 1][1] or found[i + 1][1]):
            yield from ((c, a + k, a + k + 1) for k, c in enumerate(x[0]))


def _dots(m: re.Match) -> Iterator[tuple[str, int, int]]:
    """A match with its words "dot" as signs."""
    done = 0
    for x in _DOT_WORD.finditer(m[0]):
        yield from ((c, m.start() + k, m.start() + k + 1) for k, c in enumerate(m[0][done : x.start()], done))
        yield ".", m.start() + x.start(), m.start() + x.end()
        done = x.end()
    yield from ((c, m.start() + k, m.start() + k + 1) for k, c in enumerate(m[0][done:], done))


def plain_form(text: str) -> Plain | None:
    """The text without disguises; None if there are none."""
    alike, hidden = _HAS_LOOKALIKE.search(text), _HIDDEN.search(text)
    if not (alike or hidden or _HAS_SIGN.search(text) or _HAS_SPELLED.search(text)):
        return None
    p = Plain(text)
    if hidden:
        p.replace(_HIDDEN, lambda m: ())
    if alike:
        p.text = p.text.translate(_LOOKALIKES)  # one character for one
    p.replace(_PLUS, lambda m: (("+", m.start(), m.end()),))
    p.replace(_SPELLED, _digits)
    p.replace(_AT, lambda m: (("@", m.start(), m.end()),))
    p.replace(_DOT, lambda m: ((".", m.start(), m.end()),))
    p.replace(_DOTS_BEHIND, _dots)
    p.replace(_DOTS_BEFORE, _dots)
    return p


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans of disguised identifiers that no base span of their kind holds, in source characters."""
    p = plain_form(text)
    if p is None or p.text == text:
        return []
    # base spans of a kind come by start and don't overlap, so only the last that begins before one can hold it
    starts, ends = ({k: [s[i] for s in base if s[0] == k] for k in KINDS} for i in (1, 2))
    out = []
    for kind, a, b in find_spans(p.text):
        start, end = p.starts[a], p.ends[b - 1]
        if text[start:end] != p.text[a:b]:
            before = bisect_right(starts[kind], start) - 1
            if before < 0 or ends[kind][before] < end:
                out.append((kind, start, end))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def traced(texts: pa.Array) -> list[bool | None]:
    """Whether each text may hold a disguise."""
    return pc.match_substring_regex(texts, _TRACE).to_pylist()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, found = batch.column(0), []
        for value, likely in zip(batch.column(1), traced(batch.column(1)), strict=True):
            text = value.as_py() or ""
            base = find_spans(text)
            every = sorted(base + (added_spans(text, base) if likely else []), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
            found.append((base, every))
        yield pa.RecordBatch.from_arrays(
            [
                ids,
                *(pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS),
                pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string()),
                pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in every] for _, every in found], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
            ],
            ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "found"],
        )


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, found) of every row.

    n_* and the digest are of the base spans; ``found`` has all spans as (kind, start, end), in code
    points of the source, by kind and start. Null and empty texts have none. Repeated rows each give a
    row; a null doc_id stays null; other columns are not read. The work grows with the text and its identifiers, however many.
    """
    return docs.select("doc_id", "text").mapInArrow(_scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, found array<struct<kind:string,start:bigint,end:bigint>>")


def redacted(text: str | None, likely: bool | None = True) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlapping spans merge, first kind named."""
    if not text:
        return text
    base = find_spans(text)
    spans = sorted(base + (added_spans(text, base) if likely else []), key=lambda s: (s[1], -s[2], KINDS.index(s[0])))
    if not spans:
        return text
    out, done = [], 0
    for kind, a, b in spans:
        if a >= done:
            out += [text[done:a], f"<{kind}>"]
        done = max(done, b)
    return "".join(out) + text[done:]


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        new = pa.array([redacted(t.as_py(), likely) for t, likely in zip(texts, traced(texts), strict=True)], pa.string())
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "text", new)


def redact_pii(docs: DataFrame) -> DataFrame:
    """The documents with personal data in ``text`` replaced; all columns and rows stay."""
    out = docs.mapInArrow(_redact, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def query_pii(docs: DataFrame) -> DataFrame:
    """find_pii with all spans as one string ``kind:start:end``, comma-joined."""
    text = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return find_pii(docs).select("*", text.alias("spans")).drop("found")
