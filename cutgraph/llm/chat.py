"""Chat formatting by quotation linking, in DataFrame functions only.

Each line's quote level is the number of ``>`` before it. Lines of one level in a row are a passage, and so is each of their
lines of under WIDTH words; white space, line breaks and case are normalised. Of a passage every window of WIDTH words is hashed (the
whole of a shorter one) and joined within the conversation to the latest earlier message whose own text has that window
(for a shorter one: has it as whole lines), so that partial and re-wrapped quotes are found too. A passage comes from the
message that most of its windows lead to, the later one of two, if these are half of them at least. A message replies to the one
that most of its passages' characters come from, those of level one before deeper ones. Following replies up gives each
message its thread; conversations are ordered by thread, then turn, which puts every message after the one it
answers, and quotes are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, bound

#: Words of a window.
WIDTH = 5

_PREFIX = r"^(?:[\x20\t]*>)+"
# Lines that introduce a quote.
_INTRO = r"(?i)^(on\b.*\bwrote|le\b.*\ba écrit|am\b.*\bschrieb.*|el\b.*\bescribió)\s*:$"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _PREFIX, 0), "[^>]", ""))


def _passage(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, _PREFIX, ""), r"\s+", " ")))


def _lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)


def unquoted(text: Column) -> Column:
    """The lines of level zero, without lines that introduce a quote; blank lines at the ends go."""
    kept = lambda lines: F.filter(lines, lambda x, i: (_level(x) == 0) & ~(F.regexp_like(F.trim(x), F.lit(_INTRO)) & (_level(F.coalesce(F.get(lines, i + 1), F.lit(""))) > 0)))
    return F.when(F.regexp_like(text, F.lit(r"(?m)^[\x20\t]*>")), F.regexp_replace(F.array_join(bound(_lines(text), kept), "\n"), r"^\s+|\s+$", "")).otherwise(text)


def _is_short(passage: Column) -> Column:
    return F.regexp_count(passage, F.lit("\x20")) < WIDTH - 1


def _windows(passage: Column) -> Column:
    """Hashes of all windows of words; none of a short passage."""
    hashes = lambda words: F.transform(F.sequence(F.lit(1), F.size(words) - WIDTH + 1), lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(WIDTH)), " ")))
    return F.when(_is_short(passage), F.expr("cast(array() as array<bigint>)")).otherwise(F.array_distinct(bound(F.split(passage, " "), hashes)))


def _quoted(text: Column) -> Column:
    """Quoted passages as structs (level, passage)."""

    def passages(lines: Column) -> Column:
        def runs(starts: Column) -> Column:
            def run(at: Column, j: Column) -> Column:
                its = F.filter(F.slice(lines, at + 1, F.coalesce(F.get(starts, j + 1), F.size(lines)) - at), lambda x: x["passage"] != "")
                return F.struct(F.get(lines, at)["level"].alias("level"), F.array_join(F.transform(its, lambda x: x["passage"]), " ").alias("passage"))

            return F.transform(starts, run)

        starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, i - 1)["level"]))
        return F.concat(bound(starts, runs), F.filter(lines, lambda x: _is_short(x["passage"])))

    lines = F.transform(_lines(text), lambda x: F.struct(_level(x).alias("level"), _passage(x).alias("passage")))
    return F.filter(bound(lines, passages), lambda x: (x["level"] > 0) & (x["passage"] != ""))


def _own_hashes(text: Column) -> Column:
    """Hashes of the windows of a message's own text, and of its runs of whole lines that are short."""

    def hashes(lines: Column) -> Column:
        runs = F.flatten(F.transform(lines, lambda _, i: F.transform(F.sequence(F.lit(1), F.lit(WIDTH - 1)), lambda n: F.array_join(F.slice(lines, i + 1, n), " "))))
        return F.concat(_windows(F.array_join(lines, " ")), F.transform(F.filter(runs, _is_short), lambda x: F.xxhash64(x)))

    own = F.filter(F.transform(F.filter(_lines(text), lambda x: _level(x) == 0), _passage), lambda x: x != "")
    return F.array_distinct(bound(own, hashes))


def reply_links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to) of each message that quotes an earlier one of its conversation."""
    known = messages.filter("conv_id is not null and turn is not null and text is not null").select("conv_id", "turn", "text")
    quoting = known.filter(F.regexp_like("text", F.lit(r"(?m)^[\x20\t]*>")))
    passages = quoting.select("conv_id", "turn", F.inline(_quoted(F.col("text"))))
    keys = F.when(_is_short(F.col("passage")), F.array(F.xxhash64("passage"))).otherwise(_windows(F.col("passage")))
    passages = passages.select("conv_id", "turn", "level", F.xxhash64("passage").alias("q"), F.length("passage").alias("chars"), keys.alias("keys"))
    passages = passages.groupBy("conv_id", "turn", "q").agg(F.min("level").alias("level"), F.first("chars").alias("chars"), F.first("keys").alias("keys"))
    quoted = passages.select("conv_id", "turn", "q", "level", "chars", F.size("keys").alias("n"), F.explode("keys").alias("h"))
    # only conversations with quotes, and of them only what is quoted
    own = known.join(quoting.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn", F.explode(_own_hashes(F.col("text"))).alias("h"))
    own = own.join(quoted.select("conv_id", "h").distinct(), ["conv_id", "h"], "left_semi").select("conv_id", "h", "turn").distinct()
    # a running maximum per window: no pair of messages is made
    both = own.withColumn("source", F.col("turn")).unionByName(quoted, allowMissingColumns=True)
    earlier = Window.partitionBy("conv_id", "h").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    linked = both.withColumn("source", F.max("source").over(earlier)).filter("q is not null and source is not null")
    hits = linked.groupBy("conv_id", "turn", "q", "level", "chars", "n", "source").agg(F.count("*").alias("hits"))
    best = hits.groupBy("conv_id", "turn", "q", "level", "chars", "n").agg(F.max(F.struct("hits", "source")).alias("best")).filter("2 * best.hits >= n")
    votes = best.groupBy("conv_id", "turn", F.col("best.source").alias("source"), (F.col("level") == 1).alias("direct")).agg(F.sum("chars").alias("chars"))
    return votes.groupBy("conv_id", "turn").agg(F.max(F.struct("direct", "chars", "source")).alias("best")).select("conv_id", "turn", F.col("best.source").alias("reply_to"))


def link_quotations(spark: SparkSession, messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, reply_to, thread, depth) of every row, ordered by conv_id, thread, turn.

    ``thread`` is the turn that the chain of replies begins with, ``depth`` its length. Messages that quote nothing known begin a thread. Rows
    of one (conv_id, turn) are one message for linking; rows without conv_id, turn or text are never linked. A null
    text stays null; other columns are not read.
    """
    scratch = Scratch(spark, "chat")
    links = scratch.save(reply_links(messages))
    # chains: each round doubles how far up a message sees
    state = links.select("conv_id", "turn", F.col("reply_to").alias("up"), F.lit(1).cast("long").alias("depth"))
    while True:
        above = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        state = scratch.save(state.join(above, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("next", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")))
        if state.filter("moved").isEmpty():
            break
        state = state.drop("moved")
    known = links.join(state.select("conv_id", "turn", F.col("up").alias("thread"), "depth"), ["conv_id", "turn"])
    rows = messages.select("conv_id", "turn", "role", unquoted(F.col("text")).alias("text")).join(known, ["conv_id", "turn"], "left")
    out = rows.select("conv_id", "turn", "role", "text", "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"))
    return out.orderBy("conv_id", "thread", "turn")
