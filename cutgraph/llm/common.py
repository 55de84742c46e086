"""What the operators share: tables in the shared folder, words and their hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of the separators between words, and of a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a purely local session without that setting gets a folder of its own, as its
    driver and executors are one process.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if "local-cluster" in spark.sparkContext.master or not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="cutgraph-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


class Scratch:
    """Written tables in the shared folder: they cut lineage and outlive a lost executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return it as read from there; ``.at`` is its path."""
        self.n += 1
        at = f"{self.root}/{self.n}"
        df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out.at = at
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a saved table that no later plan reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df.at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once: an expression in a lambda is evaluated wherever it stands, a variable isn't."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class WordHashes(dict):
    """64-bit hashes of words, kept for the words seen last; the same in every process."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; of all words where there are fewer."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    last = len(hashes) - width + 1
    out = hashes[:last].copy()
    for j in range(1, width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + last]
    return mixed(out + np.uint64(width))
