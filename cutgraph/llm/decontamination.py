"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Texts become templates: numbers, names (capitalised words within a sentence) and units after a number are
replaced by typed placeholders, one token for one. Windows of five template tokens of the documents are
hash-joined with those of the benchmark. Matches of one document and item at one distance between their
positions form an alignment; in it, equal slot values of the item must stand for equal values of the document, and
windows with a slot that breaks this don't count. Windows of placeholders alone, and items of fewer than five tokens
(one window each), are matched by their own tokens in the same join. What stands before an item decides whether its
first token is a name or a unit, so both forms of it are matched. A document leaks an item if 0.8 of the item's windows,
or 0.8 of those with a token of their own, are matched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE

WIDTH = 5
PERCENT = 80
RAW = [f"r{i}" for i in range(WIDTH)]
NUMBER, NAME, UNIT = SLOTS = "<num>", "<name>", "<unit>"
#: Windows of the benchmark up to which its table (about 200 bytes each) is broadcast.
BROADCAST_WINDOWS = 200_000
# Units as they stand after a number.
UNITS = ("mm", "cm", "m", "km", "in", "ft", "yd", "mi", "mg", "g", "kg", "t", "oz", "lb", "lbs", "ml", "cl", "l", "s", "ms", "min", "h", "kb", "mb", "gb", "tb", "hz", "khz", "mhz", "ghz", "w", "kw", "kwh", "v", "a", "j", "kj", "cal", "kcal", "usd", "eur", "gbp", "percent", "meters", "metres", "kilometers", "miles", "inches", "feet", "grams", "kilograms", "pounds", "liters", "litres", "seconds", "minutes", "hours", "days", "weeks", "months", "years", "dollars", "euros", "cents", "degrees")


def spaced(text: Column) -> Column:
    """The text with single spaces between words; empty for null."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " "))


def _bared(text: Column) -> Column:
    """The text in lower case, without punctuation at the ends of its tokens."""
    # each alternative begins with a character class, which fails fast on letters
    return F.lower(F.regexp_replace(text, r"[.,;:!?\x22\x27()\[\]]+(?=\x20|$)|[\x22\x27(\[](?<=(?:\x20|^).)[\x22\x27(\[]*", ""))


def _marked(plain: Column) -> Column:
    """A text from spaced() with placeholders."""
    named = F.regexp_replace(plain, r"\p{Lu}(?<=[^.!?:;\x20]\x20.)[\p{Ll}\x27-]+", NAME)
    numbered = F.regexp_replace(named, r"[0-9]+(?:[.,:/][0-9]+)*", NUMBER)
    return F.when(F.contains(numbered, F.lit(NUMBER)), F.regexp_replace(numbered, rf"(?<={NUMBER}\x20)(?i:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])", UNIT)).otherwise(numbered)


def template(plain: Column) -> Column:
    """Template of a text from spaced(): as many tokens, in lower case without punctuation at their ends."""
    return _bared(_marked(plain))


def _windows(rows: DataFrame, key: str, *more: str) -> DataFrame:
    """(key, pos, c0..c4, r0..r4): a row per window of template tokens, with the raw ones."""
    plain = rows.select(F.col(key), spaced(F.col("text")).alias("plain"), *more)
    tokens = plain.select(key, F.split("plain", " ").alias("r"), F.split(template(F.col("plain")), " ").alias("c"), *more)
    shifted = F.arrays_zip(*(F.expr(f"slice({x}, {i + 1}, greatest(size({x}) - {WIDTH - 1}, 0))").alias(f"{x}{i}") for x in "cr" for i in range(WIDTH)))
    return tokens.select(key, *more, F.posexplode(shifted).alias("pos", "w")).select(key, *more, "pos", *(f"w.{x}{i}" for x in "cr" for i in range(WIDTH)))


def _short(rows: DataFrame, key: str, lengths: list[int], *more: str) -> DataFrame:
    """(key, pos, h): a row per token and length of the run from there, hashed as it is."""
    plain = rows.select(F.col(key), *more, spaced(F.col("text")).alias("plain")).filter("plain <> ''")
    tokens = plain.select(key, *more, F.split(_bared(F.col("plain")), " ").alias("e"))
    runs = F.array(*(F.expr(f"xxhash64({n}, array_join(slice(e, pos + 1, {n}), ' '))") for n in lengths))
    return tokens.select(key, *more, "e", F.posexplode("e").alias("pos", "_")).select(key, *more, "pos", F.explode(runs).alias("h"))


def _hash(first: Column | str = "c0") -> Column:
    return F.xxhash64(first, *(f"c{i}" for i in range(1, WIDTH)))


def _slots_only() -> Column:
    every = F.col("c0").isin(*SLOTS)
    for i in range(1, WIDTH):
        every = every & F.col(f"c{i}").isin(*SLOTS)
    return every


def _own() -> Column:
    """Hash of a window's own tokens, apart from those of templates."""
    return F.xxhash64(F.lit("own"), _bared(F.concat_ws(" ", *RAW)))


def _value(raw: str) -> Column:
    """A raw token without the punctuation that the template drops."""
    return F.ltrim(F.rtrim(F.col(raw), F.lit(".,;:!?\"'()[]")), F.lit("\"'(["))


def _values() -> Column:
    """What stands in a window's slots, separated by blanks."""
    return F.concat_ws(" ", *(F.when(F.col(f"c{i}").isin(*SLOTS), _value(f"r{i}")) for i in range(WIDTH)))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(h, item_id, item_text, item_pos, literal, kinds, values, n, soft) of all windows of n tokens; item_text tells the texts of an id apart."""
    items = benchmark.filter("item_id is not null and text is not null").select("item_id", F.xxhash64("text").alias("item_text"), "text").dropDuplicates(["item_id", "item_text"])
    # the first token as it is, after a word, and after a number
    after = lambda before: F.get(F.split(template(F.concat(F.lit(before), spaced(F.col("text")))), " "), F.lit(1))
    rows = _windows(items.withColumn("firsts", F.array(after("x "), after("0 "))), "item_id", "item_text", "firsts")
    forms = F.when(F.col("pos") == 0, F.array_distinct(F.concat(F.array("c0"), "firsts"))).otherwise(F.array("c0"))
    rows = rows.withColumn("_c0", F.explode(forms)).withColumn("soft", F.col("_c0") != F.col("c0")).withColumn("c0", F.col("_c0")).withColumn("literal", ~_slots_only())
    kinds = F.filter(F.array(*(F.when(F.col(f"c{i}").isin(*SLOTS), F.col(f"c{i}")) for i in range(WIDTH))), lambda k: k.isNotNull())
    long = rows.select(F.when(F.col("literal"), _hash()).otherwise(_own()).alias("h"), "item_id", "item_text", F.col("pos").alias("item_pos"), "literal", kinds.alias("kinds"), F.split(_values(), " ").alias("values"), F.lit(WIDTH).alias("n"), "soft")
    few = items.withColumn("n", F.size(F.split(spaced(F.col("text")), " "))).filter(F.col("n") < WIDTH)
    none = F.expr("cast(array() as array<string>)")
    for n in range(1, WIDTH):
        short = _short(few.filter(F.col("n") == n), "item_id", [n], "item_text").filter("pos = 0")
        long = long.unionByName(short.select("h", "item_id", "item_text", F.col("pos").alias("item_pos"), F.lit(True).alias("literal"), none.alias("kinds"), none.alias("values"), F.lit(n).alias("n"), F.lit(False).alias("soft")))
    return long


def _document_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_text, pos, c0..c4, r0..r4, h, soft): windows by template, with a capitalised first token also as a name; those of placeholders alone by their own tokens."""
    rows = _windows(docs, "doc_id", "doc_text")
    name = r"^[\x22\x27(\[]*\p{Lu}[\p{Ll}\x27-]+"
    first = F.col("r0")
    # a word that begins a sentence is a literal here and may be a name in the item
    also = (first != F.col("c0")) & ~F.contains("c0", F.lit(NAME)) & F.regexp_like(first, F.lit(name))
    own = F.when(_slots_only(), _own()).otherwise(_hash())
    either = F.when(also, F.array(own, _hash(_bared(F.regexp_replace(first, name, NAME))))).otherwise(F.array(own))
    return rows.select("*", F.posexplode(either).alias("form", "h")).withColumn("soft", F.col("form") > 0).drop("form")


def _document_values() -> Column:
    """_values() of a row of _document_windows, whose first token is a name too where it is matched as one."""
    return F.when(F.col("_soft"), F.rtrim(F.concat_ws(" ", _value("r0"), _values()))).otherwise(_values())


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, matched, windows, reparameterised) of each item that a document leaks.

    ``windows`` are all of the item's, or those with a token of their own where only of these enough are matched. Texts
    without a word, null texts and rows without an id match nothing. The texts of a doc_id or item_id that is repeated count
    each for itself; of the leaks found so the one with most matched windows is told. Other columns are not read.

    Documents are joined as (id, position, hash, slot values), about 40 bytes a word, where the benchmark is too
    large to be broadcast: its windows are counted first. Matches are judged in one sort of their slots; their number, and with it the work, is that of
    the pairs of equal windows of a document and an item, which is the product of how often each has it.
    """
    of_items = benchmark_windows(benchmark)
    counts = {r["n"]: r["count"] for r in of_items.groupBy("n").count().collect()}
    small = sum(counts.values()) <= BROADCAST_WINDOWS
    item = ["item_id", "item_text"]
    totals = of_items.groupBy(*item).agg(F.countDistinct("item_pos").alias("windows"), F.countDistinct(F.when(F.col("literal"), F.col("item_pos"))).alias("literals"))
    known = docs.filter("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("doc_text"), "text")
    zipped = F.arrays_zip(F.col("kinds").alias("kind"), F.col("values").alias("item_value"), F.split("_values", " ").alias("value"))
    slots = F.when(F.size("kinds") > 0, zipped)

    def met(of_docs: DataFrame, of_items: DataFrame, values: Column) -> DataFrame:
        of_docs = of_docs.withColumnRenamed("soft", "_soft")
        if small:
            both = of_docs.join(F.broadcast(of_items), "h").withColumn("_values", values)
        else:
            both = of_docs.select("doc_id", "doc_text", "pos", "h", "_soft", values.alias("_values")).join(of_items, "h")
        return both.select("doc_id", "doc_text", *item, "item_pos", "literal", (F.col("soft") | F.col("_soft")).alias("soft"), (F.col("pos") - F.col("item_pos")).alias("shift"), slots.alias("slots"))

    hits = met(_document_windows(known), of_items.filter(F.col("n") == WIDTH), _document_values())
    if lengths := sorted(n for n in counts if n < WIDTH):
        short = _short(known, "doc_id", lengths, "doc_text").withColumn("soft", F.lit(False))
        hits = hits.unionByName(met(short, of_items.filter(F.col("n") < WIDTH), F.lit("")))
    # one exchange, by document and item, serves all that follows. Of an alignment, each slot value of the item must stand for one value of
    # the document; a window that only another form of its first token matched (a soft one) breaks no other
    pair = ["doc_id", "doc_text", *item]
    filled = hits.withColumn("slots", F.coalesce("slots", F.array())).repartition(*pair).select("*", F.explode_outer("slots").alias("s"))
    alike = Window.partitionBy(*pair, "shift", "s.kind", "s.item_value")
    clash = lambda value: F.min(value).over(alike) != F.max(value).over(alike)
    filled = filled.withColumn("clash", F.when(F.col("soft"), clash(F.col("s.value"))).otherwise(clash(F.when(~F.col("soft"), F.col("s.value")))))
    sound = filled.groupBy(*pair, "shift", "item_pos", "literal", "soft", "slots").agg(F.bool_or(F.coalesce("clash", F.lit(False))).alias("clash")).filter("not clash")
    changed = F.coalesce(F.exists("slots", lambda s: s["item_value"] != s["value"]), F.lit(False))
    found = sound.select(*pair, "item_pos", "literal", changed.alias("changed")).groupBy(*pair, "item_pos").agg(F.min("changed").alias("changed"), F.max("literal").alias("literal"))
    found = found.groupBy("doc_id", "doc_text", *item).agg(F.count("*").alias("matched"), F.count_if("literal").alias("by_literal"), F.max("changed").alias("reparameterised")).join(totals, item)
    every, some = (100 * F.col(a) >= percent * F.col(b) for a, b in (("matched", "windows"), ("by_literal", "literals")))
    found = found.filter(every | some & (F.col("literals") > 0))
    told = F.struct(F.when(every, F.col("matched")).otherwise(F.col("by_literal")).alias("matched"), F.when(every, F.col("windows")).otherwise(F.col("literals")).alias("windows"), (~F.col("reparameterised")).alias("exact"))
    best = found.groupBy("doc_id", "item_id").agg(F.max(told).alias("best"))
    return best.select("doc_id", "item_id", "best.matched", "best.windows", (~F.col("best.exact")).alias("reparameterised"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, with all their columns; rows without an id or text stay."""
    leaks = benchmark_leaks(docs, benchmark).select("doc_id").distinct().alias("leaks")
    return docs.alias("docs").join(leaks, F.col("docs.doc_id") == F.col("leaks.doc_id"), "left_anti")
