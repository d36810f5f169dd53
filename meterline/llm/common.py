"""Helpers shared by the text operators: words, word hashes and shuffle widths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

CACHE_BYTES = 32 << 20
"""About what a Python worker keeps of words and what it knows of them before it starts over; results don't depend on it."""
ENTRY_BYTES = 150
"""What an entry of such a store takes beside the word."""


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator works on, under fixed names, so that no other column can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words between ASCII white space; ``bytes.split`` splits at exactly space and \\t to \\r."""
    return (text or "").encode("utf-8", "surrogatepass").split()


class WordHashes(dict):
    """XXH64 of words, remembered within a worker up to CACHE_BYTES."""

    held = 0

    def __missing__(self, word: bytes) -> int:
        self.held += len(word) + ENTRY_BYTES
        if self.held > CACHE_BYTES:
            self.clear()
            self.held = len(word) + ENTRY_BYTES
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of all runs of ``n`` words from prefix sums of ``hash * base**position`` modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self._grow(1 << 12)

    def _grow(self, size: int) -> None:
        self.powers = np.cumprod(np.full(size, self.base, np.uint64))
        self.inverses = np.cumprod(np.full(size, self.inverse, np.uint64))

    def runs(self, hashes: np.ndarray, n: int) -> np.ndarray:
        if len(hashes) < n:
            return np.empty(0, np.uint64)
        if len(hashes) > len(self.powers):
            self._grow(2 * len(hashes))
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self.powers[: len(hashes)], out=sums[1:])
        return mixed((sums[n:] - sums[:-n]) * self.inverses[: len(sums) - n])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)
