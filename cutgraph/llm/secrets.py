"""Secret scans, in DataFrame functions only: base patterns and multipart credential linking.

Positions come from marks that one regexp_replace per kind sets around its matches: the pieces between
marks are gaps and matches in turn, and the sums of their lengths are code-point offsets.

Linking: access identifiers, secrets and endpoints too weak to report alone are joined within scopes (the
parts of a text between blank lines): one is reported only where a complementary part, weak or not, lies in
the same scope. Parts, base spans and scope ends of a text go in one list by position, over which three passes run, so
that the time grows with the text and not with its pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound

OPEN, CLOSE, OTHER = "\x01", "\x02", "\x03"
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Runs too short for a kind can't be part of a match of it, so the least length may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
WEAK_ID = r"""(?i:(?:access|client|account|user)[_-]?(?:key[_-]?)?(?:id|name))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})|A[KS]IA[A-Z0-9]{4,}"""
WEAK_SECRET = r"""(?i:password|passwd|pwd|passphrase|secret|token|api_?key|private_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{4,})"""
ENDPOINT = r"""(?i:https?|ftp|sftp|ssh|jdbc:[a-z0-9]{1,20}|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+|(?i:host|hostname|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"""
BREAK = r"\n[\x20\x09\r]*(?=\n)"
PARTS = ("secret", "id", "endpoint")
#: part of a credential that a kind is
PART = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}
#: Items that one list is folded over.
BLOCK = 256
_MATCH = "struct<start:bigint,rank:int,end:bigint,kind:string,value:string>"
_EMPTY = f"cast(array() as array<{_MATCH}>)"


def _fold(items: Column, start: Column, made: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """The items, of type ``made``, that ``step`` makes of each item and the state that those before have left.

    Every step copies the list it adds to, so the items go in blocks of BLOCK and the blocks' lists are joined at the end.
    """

    def one(acc: Column, x: Column) -> Column:
        state, item = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(item)).alias("out"))

    def folded(items: Column) -> Column:
        def block(acc: Column, number: Column) -> Column:
            inner = F.struct(acc["state"].alias("state"), F.expr(f"cast(array() as array<{made}>)").alias("out"))
            whole = lambda x: F.struct(x["state"].alias("state"), F.concat(acc["out"], F.array(x["out"])).alias("out"))
            return F.aggregate(F.slice(items, number * BLOCK + 1, F.lit(BLOCK)), inner, one, whole)

        numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")))
        blocks = F.aggregate(numbers, F.struct(start.alias("state"), F.expr(f"cast(array() as array<array<{made}>>)").alias("out")), block)
        return F.flatten(blocks["out"])

    return bound(items, folded)


def _matches(text: Column, kind: str, pattern: str, trace: str) -> Column:
    """All matches as structs (start, rank, end, kind, value), in order; ``trace`` is a cheap test for any."""
    rank = KINDS.index(kind) if kind in KINDS else -1
    pieces = F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}"), f"[{OPEN}{CLOSE}]", -1)

    def step(at: Column, piece: Column) -> tuple[Column, Column]:
        end = at + F.length(piece)
        return end, F.struct(at.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), piece.alias("value"))

    every = _fold(pieces, F.lit(0).cast("long"), _MATCH, step)
    return F.when(F.regexp_like(text, F.lit(trace)), F.filter(every, lambda _, i: i % 2 == 1)).otherwise(F.expr(_EMPTY))


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, found) of every row.

    ``base`` and ``found`` hold structs (start, rank, end, kind, value) by start, then kind, with offsets in code
    points; ``found`` has the linked weak parts too. Null and empty texts have none; control characters 1
    and 2 of a text count as one character of no kind; repeated rows each give a row; other columns are not
    read.
    """
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), OPEN + CLOSE, OTHER * 2)
    rows = docs.select("doc_id", text.alias("t"))
    t = F.col("t")
    assign = F.filter(_matches(t, "assign", ASSIGN, r"(?i:password|passwd|secret|token|api_?key)"), lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 2)) >= 12)
    weak = reduce(lambda a, b: F.concat(a, b), (_matches(t, "weak_id", WEAK_ID, r"(?i:id|name)[\"']?\x20*[:=]|A[KS]IA"), _matches(t, "weak_secret", WEAK_SECRET, r"(?i:password|passwd|pwd|passphrase|secret|token|key)[\"']?\x20*[:=]"), _matches(t, "endpoint", ENDPOINT, r"://|(?i:host|hostname|endpoint|server)[\"']?\x20*[:=]")))
    rows = rows.select("doc_id", "t", assign.alias("assign"), _matches(t, "access", ACCESS, "AKIA").alias("access"), _matches(t, "hex", HEX, HEX).alias("hex"), weak.alias("weak"))
    order = F.array_sort(F.concat("assign", "access", "hex"))
    rows = rows.select("doc_id", "t", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]), order.alias("base"), "weak")
    breaks = _matches(t, "break", BREAK, r"\n[\x20\x09\r]*\n")
    found = F.when(F.size("weak") > 0, F.array_sort(F.concat("base", _linked(F.array_sort(F.concat("base", "weak", breaks)))))).otherwise(F.col("base"))
    return rows.select("doc_id", *(f"n_{k}" for k in KINDS[:3]), "base", found.alias("found"))


def _bit(m: Column) -> Column:
    """1, 2 or 4 for a secret, an access identifier or an endpoint; 0 for a break."""
    return reduce(lambda otherwise, k: F.when(m["kind"] == k, 1 << PARTS.index(PART[k])).otherwise(otherwise), PART, F.lit(0))


def _linked(events: Column) -> Column:
    """The weak parts that a complementary part lies in one scope with, of base spans, weak parts and breaks by start.

    Three passes, each linear: the end that base spans reach before an event; from behind, the start of the next
    base span, hence whether the weak part touches none, and the parts in the rest of its scope; and the parts in the scope so far.
    """
    base, gap = (lambda m: m["rank"].between(0, 2)), (lambda m: m["kind"] == "break")
    reached = _fold(events, F.lit(-1).cast("long"), f"struct<m:{_MATCH},reached:bigint>", lambda at, m: (F.when(base(m), F.greatest(at, m["end"])).otherwise(at), F.struct(m.alias("m"), at.alias("reached"))))

    def back(state: Column, x: Column) -> tuple[Column, Column]:
        m = x["m"]
        free = base(m) | (~gap(m) & (x["reached"] <= m["start"]) & (state["next"] >= m["end"]))
        bit = F.when(free, _bit(m)).otherwise(0)
        after = F.when(gap(m), 0).otherwise(state["mask"].bitwiseOR(bit))
        return F.struct(F.when(base(m), m["start"]).otherwise(state["next"]).alias("next"), after.alias("mask")), F.struct(m.alias("m"), bit.alias("bit"), state["mask"].alias("rest"))

    behind = _fold(F.reverse(reached), F.struct(F.lit(2**62).cast("long").alias("next"), F.lit(0).alias("mask")), f"struct<m:{_MATCH},bit:int,rest:int>", back)

    def forth(mask: Column, x: Column) -> tuple[Column, Column]:
        return F.when(gap(x["m"]), 0).otherwise(mask.bitwiseOR(x["bit"])), F.struct(x["m"].alias("m"), x["bit"].alias("bit"), mask.bitwiseOR(x["rest"]).alias("scope"))

    whole = _fold(F.reverse(behind), F.lit(0), f"struct<m:{_MATCH},bit:int,scope:int>", forth)
    return F.transform(F.filter(whole, lambda x: (x["m"]["rank"] > 2) & (x["bit"] > 0) & (x["scope"].bitwiseOR(x["bit"]) != x["bit"])), lambda x: x["m"])


def query_secrets(docs: DataFrame) -> DataFrame:
    """find_secrets with the spans as strings ``kind:start:end`` and the digest of the base ones."""

    def text(name: str) -> Column:
        return F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return find_secrets(docs).select("doc_id", *(f"n_{k}" for k in KINDS[:3]), F.sha2(text("base"), 256).alias("base_sha256"), text("found").alias("spans"))
