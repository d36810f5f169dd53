"""Removal of passages that an earlier document already has, with repeated-phrase automata.

1. Anchors. Any ``window`` consecutive words contain, among their ``GRAM``-word runs, one of least
   hash. Equal windows have equal anchors, so a window can only recur if its anchor does. About one
   run in five is an anchor; anchors go through one shuffle and those of a single document end there.
2. Confirmed windows. Documents with recurring anchors give the windows under these, named by 96 bits of
   two hashes; a second shuffle finds a document before each.
3. Automata. A document's windows with an earlier first document join up to passages. The passages
   of a shard of documents are compiled into Aho-Corasick automata of bounded size, and the shard's
   documents are streamed through them. All windows of a passage have a document before the one it is from, so it
   removes the words it covers wherever it occurs in that document or a later one.

The documents are shuffled once by their id and that shuffle is read by steps 2 and 3.

Defined cases: a null or empty text has no words; rows with equal ids do not precede one another;
a row without an id neither precedes nor follows any other, so nothing of it is removed; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, compress

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window, functions as F

from .common import Rolling, WordHashes, ids_and_texts, mixed, partitions, signed

WINDOW = 13
GRAM = 5
LOT_BYTES = 400_000
"""Text whose words are hashed as one array."""
SORTED_ROWS = 2_000_000
"""Anchors or windows that a task sorts at once to settle what it can by itself."""
AUTOMATON_CHARS = 4_000_000
"""Passage characters compiled into one automaton; a larger shard gets several, one after the other."""


class Windows:
    """Anchors and window hashes of lots of documents, one array operation for a whole lot."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram = window, gram
        self.words = WordHashes()
        self.grams, self.first, self.second = Rolling(0x9E3779B97F4A7C15), Rolling(0xD1342543DE82EF95), Rolling(0xA0761D6478BD642F)

    def lot(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word hashes of the texts one after the other, the starts of their windows, and the text of each start."""
        split = [(t or b"").split() for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        hashes = self.words.of(list(chain.from_iterable(split)))
        starts = np.flatnonzero(np.arange(len(hashes)) + self.window <= np.repeat(np.cumsum(sizes), sizes))
        return hashes, starts, np.repeat(np.arange(len(split)), np.maximum(0, sizes - self.window + 1))

    def anchors(self, hashes: np.ndarray) -> np.ndarray:
        """The least run hash of each window, by doubling."""
        if len(hashes) < self.window:
            return np.empty(0, np.uint64)
        least, width, want = self.grams.runs(hashes, self.gram), 1, self.window - self.gram + 1
        while 2 * width <= want:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        rest = want - width
        return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least

    def names(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.first.runs(hashes, self.window), self.second.runs(mixed(hashes), self.window)


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about LOT_BYTES of text (column 1, as bytes)."""
    for batch in batches:
        ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(ends):
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + LOT_BYTES)))
            yield batch.slice(start, end - start)
            start = end


def _flat(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def _spread(ids: np.ndarray) -> np.ndarray:
    return signed(mixed(ids.view(np.uint64)))


def _settled(keys: np.ndarray, ids: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows grouped by key: (order, first place of each group, the group of each place). Where rows of one key differ
    in ``more``, every row is a group of its own, as if the task had not seen the others."""
    order = np.argsort(keys)
    sorted_ = keys[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    if more is not None and len(order):
        starts = np.flatnonzero(new)
        differ = np.minimum.reduceat(more[order], starts) != np.maximum.reduceat(more[order], starts)
        new |= differ[np.cumsum(new) - 1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _anchors(window: int, gram: int):
    """Rows (k, anchor, doc_id). An anchor that a task meets in one document asks for other tasks' (k is the anchor).

    One that it meets in several documents is known to recur: one row without an id tells the other tasks, and
    each document gets its answer at once (anchor is set, k is the document's), so no anchor has more rows to
    compare than there are tasks, however many documents share it.
    """

    def rows(found: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
        anchors, docs = _flat(found), _flat(ids)
        if not len(anchors):
            return _batch(["k", "anchor", "doc_id"], [], [], [])
        order, first, group = _settled(anchors, docs)
        low, high = np.minimum.reduceat(docs[order], first), np.maximum.reduceat(docs[order], first)
        shared = np.empty(len(order), bool)
        shared[order] = (low != high)[group]
        single = np.zeros(len(order), bool)
        single[order[first[low == high]]] = True  # of repeats within a document one asks
        tell = anchors[order[first[low != high]]]
        k = np.concatenate([anchors[single], tell, _spread(docs[shared])])
        anchor = np.concatenate([np.zeros(single.sum() + len(tell), np.int64), anchors[shared]])
        doc = np.concatenate([docs[single], np.zeros(len(tell), np.int64), docs[shared]])
        told = np.zeros(len(k), bool)
        told[single.sum() : single.sum() + len(tell)] = True
        return _batch(["k", "anchor", "doc_id"], k, pa.array(anchor, mask=np.arange(len(k)) < single.sum() + len(tell)), pa.array(doc, mask=told))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, found, ids, held = Windows(window, gram), [], [], 0
        for lot in _lots(batches):
            hashes, starts, owner = made.lot(lot.column(1).to_pylist())
            own = signed(made.anchors(hashes))[starts] if len(starts) else np.empty(0, np.int64)
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (owner[1:] != owner[:-1])
            found.append(own[new])
            ids.append(lot.column(0).to_numpy()[owner[new]])
            held += int(new.sum())
            if held >= SORTED_ROWS:
                yield rows(found, ids)
                found, ids, held = [], [], 0
        yield rows(found, ids)

    return run


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names=names)


def _candidates(window: int, gram: int):
    """Rows (k, a, b, doc_id) of the windows under recurring anchors, settled within a task like anchors.

    Of a window that a task meets in several documents the earliest asks for one before it (k and b are the window's
    hashes); the others have their answer (a is the window's first hash, k is the document's).
    """

    def rows(a: list[np.ndarray], b: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
        a, b, docs = _flat(a), _flat(b), _flat(ids)
        if not len(a):
            return _batch(["k", "a", "b", "doc_id"], [], [], pa.array([], pa.int32()), [])
        order, first, group = _settled(a, docs, b)
        low = np.minimum.reduceat(docs[order], first)
        later = np.empty(len(order), bool)
        later[order] = docs[order] > low[group]
        ask = ~later
        names = ["k", "a", "b", "doc_id"]
        k = np.where(later, _spread(docs), a)
        return _batch(names, k, pa.array(a, mask=ask), pa.array((b >> 32).astype(np.int32), mask=later), docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, a, b, ids, held = Windows(window, gram), [], [], [], 0
        for lot in _lots(batches):
            hashes, starts, owner = made.lot(lot.column(1).to_pylist())
            if not len(starts):
                continue
            wanted = lot.column(2)
            places = np.repeat(np.arange(len(wanted)), pa.compute.list_value_length(wanted).to_numpy())
            known = np.sort(wanted.flatten().to_numpy() ^ _spread(places))
            anchors = signed(made.anchors(hashes))[starts] ^ _spread(owner)
            at = np.flatnonzero(known[np.minimum(np.searchsorted(known, anchors), len(known) - 1)] == anchors)
            one, two = made.names(hashes)
            one, two, docs = signed(one[starts[at]]), signed(two[starts[at]]), lot.column(0).to_numpy()[owner[at]]
            order = np.lexsort((one, owner[at]))  # windows that a document repeats count once
            once = np.ones(len(order), bool)
            once[1:] = (one[order][1:] != one[order][:-1]) | (docs[order][1:] != docs[order][:-1])
            at = order[once]
            a.append(one[at])
            b.append(two[at])
            ids.append(docs[at])
            held += len(at)
            if held >= SORTED_ROWS:
                yield rows(a, b, ids)
                a, b, ids, held = [], [], [], 0
        yield rows(a, b, ids)

    return run


def _passages(at: np.ndarray, window: int) -> Iterator[tuple[int, int]]:
    """(first word, word after the last) of each run of consecutive windows."""
    for lot in np.split(at, np.flatnonzero(np.diff(at) != 1) + 1):
        yield int(lot[0]), int(lot[-1]) + window


def covered(words: list[bytes], automaton: ahocorasick.Automaton | None, doc_id: int) -> np.ndarray | None:
    """Which of the words lie in a passage that goes from ``doc_id`` on; None if none does."""
    if automaton is None or doc_id is None:
        return None
    text = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    found = [(end - size + 1, end) for end, (size, since) in automaton.iter(text) if since <= doc_id]
    if not found:
        return None
    spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") == 32)
    found, marks = np.searchsorted(spaces, np.array(found)), np.zeros(len(words) + 1, np.int32)
    np.add.at(marks, found[:, 0], 1)
    np.add.at(marks, found[:, 1], -1)
    return np.cumsum(marks[:-1]) > 0


def _stream(window: int, gram: int, digest: bool):
    def flush(lot, passages):
        automaton = None
        if passages:
            automaton = ahocorasick.Automaton()
            for passage, since in passages.items():
                automaton.add_word(passage, (len(passage), since))
            automaton.make_automaton()
        ids, counts, removed, kept = [], [], [], []
        for doc_id, text in lot:
            words = (text or b"").split()
            gone = covered(words, automaton, doc_id)
            left = b" ".join(words if gone is None else compress(words, (~gone).tolist()))
            ids.append(doc_id)
            counts.append(len(words))
            removed.append(0 if gone is None else int(gone.sum()))
            kept.append(hashlib.sha256(left).hexdigest() if digest else left.decode("utf-8", "surrogatepass"))
        arrays = [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, lot, passages, chars, held = Windows(window, gram), [], {}, 0, 0
        for batch in batches:
            for doc_id, text, names in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if names.is_valid:
                    words = (text or b"").split()
                    own = signed(made.first.runs(made.words.of(words), window))
                    names = np.sort(names.values.to_numpy())
                    at = np.flatnonzero(names[np.minimum(np.searchsorted(names, own), len(names) - 1)] == own)
                    for start, end in _passages(at, window) if len(at) else ():
                        passage = f" {b' '.join(words[start:end]).decode('utf-8', 'surrogatepass')} "
                        chars += len(passage) * (passage not in passages)
                        passages[passage] = min(doc_id, passages.get(passage, doc_id))
                lot.append((doc_id, text))
                held += len(text or b"")
                if chars >= AUTOMATON_CHARS or held >= 8 * AUTOMATON_CHARS:
                    yield flush(lot, passages)
                    lot, passages, chars, held = [], {}, 0, 0
        if lot:
            yield flush(lot, passages)

    return run


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words left, joined by spaces, or their SHA-256 with ``digest``."""
    rows, n = ids_and_texts(docs).withColumn("text", F.col("text").cast("binary")), partitions(docs.sparkSession)
    named = rows.where("doc_id is not null")
    anchors = named.mapInArrow(_anchors(window, gram), "k long, anchor long, doc_id long").repartition(n, "k")
    met = F.count("*").over(Window.partitionBy("k", F.isnull("anchor")))  # rows of one key: one per task at most
    wanted = anchors.withColumn("met", met).where("doc_id is not null and (anchor is not null or met > 1)")
    wanted = wanted.groupBy("doc_id").agg(F.collect_list(F.coalesce("anchor", "k")).alias("anchors"))
    by_id = named.repartition(n, "doc_id")
    found = by_id.join(wanted, "doc_id").select("doc_id", "text", "anchors").mapInArrow(_candidates(window, gram), "k long, a long, b int, doc_id long").repartition(n, "k")
    least = F.min("doc_id").over(Window.partitionBy("k", "b"))
    later = found.withColumn("least", least).where("a is not null or least < doc_id").select("doc_id", F.coalesce("a", "k").alias("a"))
    lists = later.groupBy("doc_id").agg(F.collect_list("a").alias("names"))
    schema = "doc_id long, n_words long, n_removed long, kept string"
    whole = by_id.join(lists, "doc_id", "left").select("doc_id", "text", "names").mapInArrow(_stream(window, gram, digest), schema)
    none = F.lit(None).cast("array<long>").alias("names")
    return whole.unionByName(rows.where("doc_id is null").select("doc_id", "text", none).mapInArrow(_stream(window, gram, digest), schema))


def report(docs: DataFrame) -> DataFrame:
    return without_repeats(docs, digest=True).withColumnRenamed("kept", "kept_sha256")
