"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed from the left into phrases,
each the longest match with some substring of the labelled text, or one symbol that it hasn't. A phrase costs the bits that tell one
of the labelled text's positions or one of all symbols, log2(positions + symbols), so that languages with samples of different
length compare; the language that needs the fewest bits a symbol wins. Parsing runs over many texts at once: transitions by
the most frequent letters of a language are a dense table of (state, letter), the others a sorted table. A missing
transition leads where the letter leads from the start, with a mark that counts a phrase.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bound of the training sample: labelled documents and code points per language.
SAMPLE_DOCS = 64
SAMPLE_CHARS = 16_384
#: Symbols: 0 ends a parse lane, 1 is any gap between words, 2 any letter that no sample has; then all letters of the samples.
GAP, UNKNOWN, FIRST = 1, 2, 3
#: Entries of the dense tables of all languages; what they can't hold is looked up in the sorted ones.
DENSE_ENTRIES = 1 << 24
MOST_DENSE = 96
#: Symbols that are parsed side by side; where the parse before a lane ends is then carried over.
LANE = 1024
_LETTER = re.compile(r"[^\W\d_]")
_BREAK = np.int32(1 << 30)


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        now = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = now
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return moves


class Automaton:
    """Transitions of one language over its own codes: dense ones below ``width``, the others as sorted keys. States are offsets into the dense table."""

    def __init__(self, codes: np.ndarray, alphabet: int, most_entries: int):
        moves = suffix_automaton(codes.tolist())
        # one more state, before a phrase: every code begins one, and those that the text hasn't lead back to it
        outside = len(moves)
        self.alphabet = alphabet
        self.width = width = max(FIRST, min(MOST_DENSE, alphabet, most_entries // (outside + 1)))
        first = np.full(alphabet, outside * width | _BREAK, np.int32)
        for c, to in moves[0].items():
            first[c] = to * width | _BREAK
        table = np.tile(first[:width], (outside + 1, 1))
        rest: list[tuple[int, int]] = []
        for state, to in enumerate(moves):
            for c, target in to.items():
                if c < width:
                    table[state, c] = target * width
                else:
                    rest.append((state * alphabet + c, target * width))
        # from the start every code begins a phrase
        table[0] = first[:width]
        rest = sorted(x for x in rest if x[0] >= alphabet)
        self.start, self.table, self.first = outside * width, table.ravel(), first
        self.keys, self.targets = np.array([k for k, _ in rest], np.int64), np.array([t for _, t in rest], np.int32)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The states after one code each, marked where it begins a phrase."""
        if self.width == self.alphabet:
            return self.table[state + code]
        dense = code < self.width
        out = self.table[state + np.where(dense, code, 0)]
        if not dense.all():
            other = ~dense
            key = state[other].astype(np.int64) // self.width * self.alphabet + code[other]
            to = self.first[code[other]]
            if len(self.keys):
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                to = np.where(self.keys[at] == key, self.targets[at], to)
            out[other] = to
        return out

    def phrases(self, grid: np.ndarray, lengths: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Phrases begun in each lane (a column, by falling length); ``before`` is the lane that a lane goes on from, or -1.

        All lanes are parsed from the start at once. Then those that go on from a lane are parsed again from its end, only until
        both parses are in the same state, which is mostly soon; a lane that ends in another state than before hands that on.
        """
        state, count = np.full(len(lengths), self.start, np.int32), np.zeros(len(lengths), np.int64)
        for row, n in zip(grid, np.searchsorted(-lengths, -np.arange(len(grid)), "left"), strict=True):
            to = self.step(state[:n], row[:n])
            count[:n] += to >> 30
            state[:n] = to & ~_BREAK
        entry = np.full(len(lengths), self.start, np.int32)
        while True:
            known = np.where(before >= 0, state[before], self.start)
            lane = np.flatnonzero(known != entry)
            if not len(lane):
                return count
            old, new = entry[lane], known[lane]
            entry[lane] = new
            for at in range(len(grid)):
                ended = lengths[lane] == at
                state[lane[ended]] = new[ended]
                on = ~ended & (old != new)
                lane, old, new = lane[on], old[on], new[on]
                if not len(lane):
                    break
                a, b = self.step(old, grid[at, lane]), self.step(new, grid[at, lane])
                count[lane] += (b >> 30) - (a >> 30)
                old, new = a & ~_BREAK, b & ~_BREAK
            else:
                state[lane] = new


class Model:
    """Languages, the symbol of each letter, and for each language its automaton and its code of each symbol, frequent ones first."""

    def __init__(self, samples: dict[str, list[str]], sample_chars: int = SAMPLE_CHARS, dense_entries: int = DENSE_ENTRIES):
        self.languages = sorted(samples)
        texts = {k: "\n".join(v).lower()[:sample_chars] for k, v in samples.items()}
        letters = sorted({c for t in texts.values() for c in t if c.isalpha()})
        self.symbol = {c: FIRST + i for i, c in enumerate(letters)}
        self._low = np.array([self._symbol(chr(c)) for c in range(0x10000)], np.int32)
        every = FIRST + len(letters)
        encoded = [self.encode(texts[k]) for k in self.languages]
        most = dense_entries // max(1, 2 * sum(map(len, encoded)))  # an automaton has under two states a symbol
        self.automata, self.codes = [], []
        for text in encoded:
            often = Counter(text[text >= FIRST].tolist())
            code = np.full(every, UNKNOWN, np.int32)
            code[:FIRST] = range(FIRST)
            for i, (symbol, _) in enumerate(sorted(often.items(), key=lambda x: (-x[1], x[0]))):
                code[symbol] = FIRST + i
            self.codes.append(code)
            self.automata.append(Automaton(code[text], FIRST + len(often), most * (2 * len(text) + 2)))
        #: bits of a phrase
        self.bits = np.log2([len(t) + every for t in encoded])

    def _symbol(self, c: str) -> int:
        c = c.lower()
        return self.symbol.get(c[:1], UNKNOWN) if c.isalpha() else GAP

    def encode(self, text: str) -> np.ndarray:
        """Symbols of a text, with gaps closed up to one."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self._low[np.minimum(points, 0xFFFF)]
        if len(beyond := np.flatnonzero(points > 0xFFFF)):
            values, at = np.unique(points[beyond], return_inverse=True)
            symbols[beyond] = np.array([self._symbol(chr(c)) for c in values], np.int32)[at]
        keep = np.ones(len(symbols), bool)
        keep[1:] = (symbols[1:] != GAP) | (symbols[:-1] != GAP)
        return symbols[keep]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(text, language): phrases that the parse of each text has."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        lanes = [(i, a, t[a : a + LANE]) for i, t in enumerate(texts) for a in range(0, len(t), LANE)]
        if not lanes:
            return out
        order = sorted(range(len(lanes)), key=lambda j: -len(lanes[j][2]))
        place = np.empty(len(lanes), np.int64)
        place[order] = np.arange(len(lanes))
        before = np.array([place[j - 1] if lanes[j][1] else -1 for j in order])
        lanes = [lanes[j] for j in order]
        owner, lengths = np.array([i for i, _, _ in lanes]), np.array([len(t) for _, _, t in lanes])
        grid = np.zeros((int(lengths[0]), len(lanes)), np.int32)
        for j, (_, _, t) in enumerate(lanes):
            grid[: len(t), j] = t
        for k, (automaton, code) in enumerate(zip(self.automata, self.codes, strict=True)):
            np.add.at(out[:, k], owner, automaton.phrases(code[grid], lengths, before))
        return out


def classify(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, score) of each text; 'und' with score 0 for null, for no letter or for no language."""
    told: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    some = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
    if not model.languages:
        return told
    bits = model.phrases([model.encode(texts[i]) for i in some]) * model.bits
    for i, row in zip(some, bits, strict=True):
        order = np.argsort(row, kind="stable")
        best = row[order[0]]
        rest = row[order[1]] if len(order) > 1 else 2 * best
        told[i] = (model.languages[order[0]], float(1.0 - best / rest))
    return told


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2. A null id is."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit the automata on a bounded sample of the labelled documents that aren't held out.

    Every language that has one is learned: the texts of the ``sample_docs`` documents with the smallest hash of their id, of
    which the first ``sample_docs`` different ones count where ids are repeated, until ``sample_chars`` code points are reached. So at most
    sample_docs texts of sample_chars code points a language reach the driver.
    """
    known = docs.filter(F.col("lang").isNotNull() & ~held_out() & (F.length("text") > 0))
    ids = known.select("lang", "doc_id", F.xxhash64(F.col("doc_id"), F.lit(17)).alias("h")).distinct()
    # the first of parts of a language, then the first of those, so that no task gets more of it than a few from each part
    for by in (["lang", F.pmod("h", F.lit(64))], ["lang"]):
        ids = ids.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h", "doc_id"))).filter(F.col("r") <= sample_docs)
    chosen = ids.select("lang", "doc_id")
    texts = known.join(F.broadcast(chosen), ["lang", "doc_id"], "left_semi").select("lang", F.substring("text", 1, sample_chars).alias("text"), F.xxhash64(F.col("doc_id"), F.lit(17)).alias("h")).distinct()
    texts = texts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("r") <= sample_docs).drop("r")
    rows = texts.collect()
    samples: dict[str, list[str]] = {}
    for lang, text, _ in sorted(rows, key=lambda r: (r.lang, r.h, r.text)):
        if sum(map(len, samples.get(lang, []))) < sample_chars:
            samples.setdefault(lang, []).append(text)
    return Model(samples, sample_chars)


def _in_parts(model: Model, texts: list[str | None], most: int = 2_000_000) -> list[tuple[str, float]]:
    """classify() over parts of about ``most`` code points, which bounds the parse's memory."""
    told, part, size = [], [], 0
    for text in texts:
        part.append(text)
        size += len(text or "")
        if size > most:
            told += classify(model, part)
            part, size = [], 0
    return told + classify(model, part)


def in_known_language(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents with a language, which becomes their ``lang``; 'und' ones go. All columns stay."""
    model = model or learn(docs)  # goes with the tasks; its size is that of the samples and of DENSE_ENTRIES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = pa.array([x for x, _ in _in_parts(model, batch.column("text").to_pylist())], pa.string())
            named = batch.set_column(batch.schema.get_field_index("lang"), "lang", told)
            yield named.filter(pa.array([x.as_py() != "und" for x in told], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify_language(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row.

    Only the text is used for a prediction. The score is 1 - bits(best) / bits(second). A null or
    letterless text is 'und' with score 0, ties go to the first language by name; repeated rows each give a
    row; other columns are not read.
    """
    model = model or learn(docs)  # goes with the tasks; its size is that of the samples and of DENSE_ENTRIES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = _in_parts(model, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in told], pa.string()), pa.array([x for _, x in told], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
