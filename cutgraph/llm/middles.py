"""Fill-in-the-middle: texts are cut at unit boundaries and put together again with sentinels.

A table over bytes drives one scan of a text. Its states are those of a search for the sentinels, of white space
and of the continuation bytes that a UTF-8 lead byte still expects; each transition emits whether its byte begins a code
point, begins a unit and completes a sentinel, and these are counted. A second pass finds the bytes of the cuts
among the boundaries emitted. Many stretches of a batch are scanned side by side: the state depends on the last
few bytes only, so a stretch starts with those before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
SEED = 42
#: Of a hundred texts, how many are transformed, and how many of those have the suffix first.
RATE, SUFFIX_FIRST = 50, 80
#: What a transition emits.
CHAR, UNIT, MARK = 1, 2, 4
#: Stretches that are scanned side by side, their least length, and bytes of texts that are scanned at once.
LANES, LEAST, PART = 8192, 256, 8 << 20
#: A byte that UTF-8 never has; it stands before each text and starts afresh.
RESET = 0xFF
_WHITE = frozenset(b"\x20\x09\x0a\x0b\x0c\x0d")


class Scanner:
    """The table for some sentinels: ``after`` and ``emitted`` by 256 * state + byte, and ``memory``, the bytes a state depends on."""

    START, WHITE, WORD, MORE = 0, 1, 2, (3, 4, 5)  # MORE[k]: k + 1 continuation bytes are expected

    def __init__(self, sentinels: tuple[str, ...] = SENTINELS):
        words = [s.encode() for s in sentinels]
        if not all(w and max(w) < 0x80 and not _WHITE & set(w) for w in words):
            raise ValueError("sentinels must be ASCII without white space")
        self.memory = max(4, *map(len, words))
        # a state for each beginning of a sentinel, WORD for the empty one
        known = {b"": self.WORD} | {p: 6 + i for i, p in enumerate(sorted({w[: k + 1] for w in words for k in range(len(w))}))}
        self.after, self.emitted = np.zeros((6 + len(known) - 1, 256), np.int64), np.zeros((6 + len(known) - 1, 256), np.uint8)
        of_state = {state: read for read, state in known.items()}
        for state in range(len(self.after)):
            for byte in range(256):
                to, out = self._step(words, known, of_state.get(state, b""), byte)
                if state in self.MORE and 0x80 <= byte < 0xC0:
                    to = self.MORE[state - self.MORE[0] - 1] if state > self.MORE[0] else self.WORD
                if byte != RESET and (state == self.START or byte in _WHITE and state != self.WHITE):
                    out |= UNIT
                self.after[state, byte], self.emitted[state, byte] = 256 * to, out
        self.after, self.emitted = self.after.ravel(), self.emitted.ravel()

    def _step(self, words: list[bytes], known: dict[bytes, int], read: bytes, byte: int) -> tuple[int, int]:
        if byte == RESET:
            return self.START, 0
        if byte in _WHITE:
            return self.WHITE, CHAR
        if byte >= 0x80:
            return (self.WORD, 0) if byte < 0xC0 else (self.MORE[0 if byte < 0xE0 else 1 if byte < 0xF0 else 2], CHAR)
        read += bytes([byte])
        held = next(read[i:] for i in range(len(read) + 1) if read[i:] in known)  # the longest end that begins a sentinel
        return known[held], CHAR | MARK * any(read.endswith(w) for w in words)

    def scan(self, data: np.ndarray) -> np.ndarray:
        """What the transition at each byte emits."""
        lanes = max(1, min(LANES, len(data) // max(LEAST, self.memory)))
        length = -(-len(data) // lanes)
        padded = np.full(lanes * length, RESET, np.uint8)
        padded[: len(data)] = data
        steps = np.ascontiguousarray(padded.reshape(lanes, length).T)
        state, at, out = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), np.empty_like(steps)
        if lanes > 1:
            for step in steps[-self.memory :]:
                state[1:] = self.after[state[1:] + step[:-1]]
        for step, row in zip(steps, out, strict=True):
            np.add(state, step, out=at)
            np.take(self.emitted, at, out=row, mode="clip")
            np.take(self.after, at, out=state, mode="clip")
        return out.T.ravel()[: len(data)]


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits for a document; a null id counts as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


Transformed = tuple[int, str, int | None, int | None, bytes]


def transform(scanner: Scanner, ids: list[int | None], texts: list[bytes], seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, sentinels: tuple[str, ...] = SENTINELS) -> list[Transformed]:
    """(units, form, code points of the prefix and of the middle, output) of each text."""
    before, between, behind = (s.encode() for s in sentinels)
    sep = bytes([RESET])
    emitted = scanner.scan(np.frombuffer(sep + sep.join(texts), np.uint8))
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts = ends - [len(t) for t in texts]
    units, marks = np.flatnonzero(emitted & UNIT), np.flatnonzero(emitted & MARK)
    first, last = np.searchsorted(units, starts), np.searchsorted(units, ends)
    marked = np.searchsorted(marks, ends) > np.searchsorted(marks, starts)
    out: list[Transformed] = []
    for i, text in enumerate(texts):
        n = int(last[i] - first[i])
        h1, h2, h3, h4 = draws(ids[i], seed)
        if not text or marked[i] or h3 % 100 >= rate:
            out.append((n, "plain", None, None, text))
            continue
        a, b = (int(units[first[i] + k]) if k < n else int(ends[i]) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
        start = int(starts[i])
        chars = [int(np.count_nonzero(emitted[x:y] & CHAR)) for x, y in ((start, a), (a, b))]
        prefix, middle, suffix = text[: a - start], text[a - start : b - start], text[b - start :]
        if h4 % 100 < suffix_first:
            out.append((n, "spm", *chars, between + suffix + before + prefix + behind + middle))
        else:
            out.append((n, "psm", *chars, before + prefix + between + suffix + behind + middle))
    return out


def _parts(texts: list[bytes]) -> Iterator[slice]:
    """Runs of texts of about PART bytes; a longer text is one by itself."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > PART:
            yield slice(start, i)
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield slice(start, len(texts))


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row.

    A unit is a word with the white space before it, or the white space that ends a text; ``n`` counts them. The seed and
    doc_id decide the cuts and the form: ``plain`` is the text as it is, ``psm`` has prefix, suffix and middle in this
    order, each behind its sentinel (given as those of prefix, suffix and middle), ``spm`` the suffix first. Null
    and empty texts are plain with an empty output, and so, unchanged, are texts that have a sentinel. A null doc_id draws as no digits;
    repeated rows each give the same row; other columns are not read. Memory: some times PART bytes, or the longest text.
    """
    if len(set(sentinels)) != 3 or any(a != b and (a in b or b in a) for a in sentinels for b in sentinels):
        raise ValueError("three sentinels are needed, none within another")
    if any(a[-k:] == b[:k] for a in sentinels for b in sentinels for k in range(1, min(len(a), len(b)))):
        raise ValueError("no sentinel may begin as one ends, or outputs could not be taken apart")
    scanner = Scanner(sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), [t or b"" for t in batch.column(1).to_pylist()]
            for part in _parts(texts):
                rows = transform(scanner, ids[part.start : part.stop].to_pylist(), texts[part], seed, rate, suffix_first, sentinels)
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                columns[4] = pa.Array.from_buffers(pa.string(), len(rows), columns[4].buffers())  # as it is: bytes that aren't UTF-8 stay
                yield pa.RecordBatch.from_arrays([ids[part.start : part.stop], *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, ...] = SENTINELS) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, "|".join(rf"\Q{s}\E" for s in sentinels), -1)
    put = lambda p, *order: F.concat(*(F.get(p, F.lit(i)) for i in order))
    return F.when(form == "plain", output).otherwise(bound(parts, lambda p: F.when(form == "psm", put(p, 1, 3, 2)).otherwise(put(p, 2, 3, 1))))


def query_middles(docs: DataFrame) -> DataFrame:
    """fill_in_middle with digests of the output and of the text restored from it."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    made = fill_in_middle(docs)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
