"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Every document is streamed once through the automaton, which tracks the longest run of words,
ending at the current word, that occurs in some item. Where that run reaches ``window`` words (or
is a whole shorter item), its words are hit. Hit spans can be cut out of the text, and documents
with too large a hit share dropped.

The automaton holds at most ``BLOCK_WORDS`` item words, so what is broadcast has a fixed bound;
a larger benchmark is taken in several blocks, each streamed against all documents; what they hit is merged
before anything is cut or dropped, so results don't depend on the blocks.

Defined cases: a null or empty text has no words and is clean; null or wordless items match
nothing; repeated items count once per item id, repeated documents are judged each; an empty
benchmark leaves every document clean; other columns of either table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import columns, ids_and_texts

WINDOW = 10
BLOCK_WORDS = 200_000
DROP_SHARE = 0.5

_SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
_TABLE = bytearray(bytes(range(256)).lower())
for _byte in (b for b in _SEPARATORS if not 0x41 <= b <= 0x5A):
    _TABLE[_byte] = 0x20
_TABLE = bytes(_TABLE)


def item_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, letters and everything beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class ItemAutomaton:
    """Suffix automaton over the word sequences of several items."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(name, words) for name, words in items if words]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for name, words in items:
            self._label(name, words)
        self._index()
        self.shortest = min((min(len(words), window) for _, words in items), default=1)

    def _state(self, nexts: dict[bytes, int], link: int, length: int) -> int:
        self.next.append(nexts)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, parent: int, word: bytes) -> int:
        """The state for parent's strings plus word, parted from longer strings if need be."""
        old = self.next[parent][word]
        if self.length[old] == self.length[parent] + 1:
            return old
        copy = self._state(dict(self.next[old]), self.link[old], self.length[parent] + 1)
        self.link[old] = copy
        while parent >= 0 and self.next[parent].get(word) == old:
            self.next[parent][word] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new, at = self._state({}, 0, self.length[last] + 1), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, word)
        return new

    def _label(self, name: str, words: list[bytes]) -> None:
        at = 0
        if len(words) < self.window:
            for word in words:
                at = self.next[at][word]
            self.short.setdefault(at, []).append((len(words), name))
            return
        for i, word in enumerate(words):
            at = self.next[at][word]
            if i + 1 >= self.window:
                while self.length[self.link[at]] >= self.window:
                    at = self.link[at]
                self.items.setdefault(at, set()).add(name)

    def _index(self) -> None:
        """For each state: the state of its last ``window`` words, and the nearest one that ends a short item."""
        order = sorted(range(len(self.next)), key=self.length.__getitem__)
        self.windowed, self.shorter = [-1] * len(order), [-1] * len(order)
        for state in order:
            up = self.link[state]
            if self.length[state] >= self.window:
                self.windowed[state] = self.windowed[up] if self.length[up] >= self.window else state
            self.shorter[state] = state if state in self.short else self.shorter[up] if up >= 0 else -1

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged hit spans (first word, word after the last) and the items that occur.

        A word of no item brings the automaton back to its start, so only runs of words of items,
        and of these only such as could hold a match, are walked.
        """
        known = np.zeros(len(words) + 2, np.int8)
        known[1:-1] = np.fromiter(map(self.next[0].__contains__, words), bool, len(words))
        turns = np.flatnonzero(np.diff(known))
        spans: list[list[int]] = []
        found: set[str] = set()
        starts, ends = turns[::2], turns[1::2]
        long = ends - starts >= self.shortest
        for start, end in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            self._walk(words, start, end, spans, found)
        return spans, found

    def _walk(self, words: list[bytes], first: int, end: int, spans: list[list[int]], found: set[str]) -> None:
        nexts, link, length, window, shorter = self.next, self.link, self.length, self.window, self.shorter
        state = matched = 0
        any_short = bool(self.short)
        for i in range(first, end):
            word = words[i]
            to = nexts[state].get(word)
            if to is None:
                while word not in nexts[state]:
                    state = link[state]
                matched, to = length[state], nexts[state][word]
            state = to
            matched += 1
            start = -1
            if matched >= window:
                start = i + 1 - window
                found |= self.items.get(self.windowed[state], frozenset())
            if any_short and shorter[state] >= 0:
                at = shorter[state]
                while at >= 0:
                    for size, name in self.short[at]:
                        if size <= matched:
                            found.add(name)
                            start = i + 1 - size if start < 0 else min(start, i + 1 - size)
                    at = shorter[link[at]] if link[at] >= 0 else -1
            if start >= 0:
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i + 1])


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and out[-1][1] >= start:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _scanner(block, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ItemAutomaton(block.value, window)
        for batch in batches:
            out = []
            for text, spans, items in columns(batch, "text", "spans", "items"):
                words = item_words(text)
                new, found = automaton.scan(words)
                if spans or items:
                    new, found = merged(new + [[s["start"], s["end"]] for s in spans]), found | set(items)
                out.append((len(words), [{"start": s, "end": e} for s, e in new], sorted(found)))
            n, spans, items = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))],
                names=["doc_id", "text", "n_words", "spans", "items"],
            )

    return run


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in blocks of at most BLOCK_WORDS words (or one longer item)."""
    block, size = [], 0
    for name, text in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        words = item_words(text)
        if name is None or not words:
            continue
        if block and size + len(words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((name, words))
        size += len(words)
    if block:
        yield block


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, text, n_words, spans of hit words, items that occur), one per document."""
    spark = docs.sparkSession
    out = ids_and_texts(docs).select(
        "doc_id", "text", F.lit(0).cast("long").alias("n_words"),
        F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"),
    )
    blocks = _blocks(benchmark)
    for block in chain([next(blocks, [])], blocks):  # an empty benchmark is one empty block
        out = out.mapInArrow(
            _scanner(spark.sparkContext.broadcast(block), window),
            "doc_id long, text string, n_words long, spans array<struct<start:int,end:int>>, items array<string>",
        )
    return out


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + (s["end"] - s["start"]))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 over the sorted item ids, contaminated."""
    hits = find_hits(docs, benchmark, window).withColumn("n_hit", hit_words(F.col("spans")))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def _cutter(block, window: int, drop_share: float, at: int, names: list[str], spans_col: str, last: bool):
    """Adds the block's hits to the spans in the last column; after the last block texts are cut and spans go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ItemAutomaton(block.value, window)
        for batch in batches:
            kept, texts, found = [], [], []
            earlier = batch.column(batch.num_columns - 1).to_pylist() if batch.num_columns > len(names) else [()] * batch.num_rows
            for i, (text, old) in enumerate(zip(batch.column(at).to_pylist(), earlier, strict=True)):
                words = item_words(text)
                spans, _ = automaton.scan(words)
                if old:
                    spans = merged(spans + [[s["start"], s["end"]] for s in old])
                if not last:
                    found.append([{"start": s, "end": e} for s, e in spans])
                    continue
                if spans and sum(e - s for s, e in spans) > drop_share * len(words):
                    continue
                kept.append(i)
                texts.append(cut(text, spans) if spans else text)
            own, fields = list(batch.columns[: len(names)]), list(batch.schema)[: len(names)]
            if not last:
                yield pa.RecordBatch.from_arrays([*own, pa.array(found, _SPANS)], schema=pa.schema([*fields, pa.field(spans_col, _SPANS)]))
                continue
            out = pa.RecordBatch.from_arrays(own, schema=pa.schema(fields)).take(pa.array(kept, pa.int64()))
            yield out.set_column(at, fields[at], pa.array(texts, fields[at].type))

    return run


def cut(text: str, spans: list[list[int]]) -> str:
    """The text without the characters from each span's first to its last word."""
    data = text.encode("utf-8", "surrogatepass")
    plain = data.translate(_TABLE)
    starts, ends, at = [], [], 0
    for word in plain.split():
        at = plain.index(word, at)
        starts.append(at)
        at += len(word)
        ends.append(at)
    out, done = [], 0
    for first, after in spans:
        out.append(data[done : starts[first]])
        done = ends[after - 1]
    return b"".join([*out, data[done:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, drop_share: float = DROP_SHARE, text_col: str = "text") -> DataFrame:
    """``docs`` with every column: hit spans are cut out of the text; a document of whose words more
    than ``drop_share`` are hit goes. Spans of all blocks are gathered on the text as it came before either."""
    out, names, spark = docs, docs.columns, docs.sparkSession
    spans = next(n for n in ("__spans" + "_" * i for i in range(len(names) + 1)) if n.lower() not in {c.lower() for c in names})
    with_spans = StructType([*docs.schema.fields, StructField(spans, ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])))])
    blocks = [spark.sparkContext.broadcast(block) for block in _blocks(benchmark)]
    for i, block in enumerate(blocks):
        last = i + 1 == len(blocks)
        out = out.mapInArrow(_cutter(block, window, drop_share, names.index(text_col), names, spans, last), docs.schema if last else with_spans)
    return out
