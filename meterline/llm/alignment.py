"""Aligns the tokens of two tokenizers over the same bytes, and counts which ids go together in a corpus.

Both tokenizers cut the same bytes. Ends that they share cut a text into groups; ``shared_groups`` finds them by
divide and conquer: near the middle of an interval it looks for a shared end by bisection, then works on both
halves; an interval without a shared end within is one group. All intervals of a level are worked on at once, so
that a very long text takes as many steps as its depth; intervals of up to ``SMALL`` tokens are tried at all their ends. Within a text every pair of tokens whose bytes overlap is a link.

The count of an id pair is taken over the corpus. Links never leave their task: a task hands on the *distinct* pairs
of a chunk of documents with their number, Spark adds these up, and each chunk gets the totals of just its own
pairs back. A chunk is closed at ``CHUNK_PAIRS`` distinct pairs, or when its documents have
``CHUNK_ENTRIES`` pairs together, which bounds what a task holds beside one text. Every text is encoded once; its pairs lie in the shared folder between the two passes.

Defined cases: null and empty texts, and texts whose tokens do not spell the text (as after normalisation), have no
tokens: zeros and an empty digest; repeated rows and ids are rows of their own; an empty table gives an
empty result; other columns are ignored. Names of special tokens within a text are plain text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path, store
from .common import ids_and_texts

CHUNK_PAIRS = 500_000
CHUNK_ENTRIES = 4_000_000
SMALL = 8
BATCH = 64
"""Texts that are aligned at once."""

_TABLE = "kind string, chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
_KINDS = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.binary(), pa.binary()]
_NAMES = ["kind", "chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_level_alphabet() -> dict[str, int]:
    """Character to byte of byte-level vocabularies: printable Latin-1 stands for itself, other bytes follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


# How byte-level BPE of this kind parts a text before it merges bytes.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_UNCOMMON = re.compile("[^\x00-\u024f]")


class ByteLevel:
    """A byte-level BPE of the tokenizers library; a text is encoded behind one space.

    Where a tokenizer is of the plain kind (parted as ``PARTS`` says, merges in the order of their ids), texts of letters
    up to U+024F are encoded from the same vocabulary by tiktoken, which takes a third of the time; beyond that the
    two libraries' character classes may differ by Unicode version. Tests hold both against each other.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        alphabet, vocabulary = byte_level_alphabet(), self.tokenizer.get_vocab(with_added_tokens=True)
        self.spelled = [b""] * (1 + max(vocabulary.values()))
        for entry, i in vocabulary.items():
            self.spelled[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        self.ranked = self._ranked(json.loads(self.tokenizer.to_str()))

    def _ranked(self, setup: dict):
        """The same vocabulary for tiktoken, None if the tokenizer is not of the plain kind."""
        import tiktoken

        model, parts = setup["model"], setup["pre_tokenizer"] or {}
        special = {x["content"] for x in setup["added_tokens"]}
        ranks = {self.spelled[i]: i for entry, i in model["vocab"].items() if entry not in special}
        joined = (x if isinstance(x, list) else x.split(" ") for x in model["merges"])
        plain = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        plain &= parts.get("type") == "ByteLevel" and parts.get("use_regex", False) and not parts.get("add_prefix_space", True)
        plain &= not setup["normalizer"] and all(x["special"] for x in setup["added_tokens"])
        if not plain or any(model["vocab"].get("".join(x)) != 256 + i for i, x in enumerate(joined)) or sorted(ranks.values()) != [*range(len(ranks))]:
            return None
        return tiktoken.Encoding("ranks", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        texts = [f" {t}" for t in texts]
        if self.ranked is None:
            return self._encode(texts)
        out = [None if _UNCOMMON.search(t) else self.ranked.encode_ordinary(t) for t in texts]
        others = iter(self._encode([t for t, ids in zip(texts, out, strict=True) if ids is None]))
        return [next(others) if ids is None else ids for ids in out]

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """A sentencepiece model, which puts a space before a text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.spelled = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))


def shared_groups(a_ends: np.ndarray, b_ends: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First token, on either side, of every group. Ends ascend over all texts; ``a_cuts`` and ``b_cuts`` are the token
    counts before each text and at the end, and no interval reaches over them."""
    spans = np.stack([a_cuts[:-1], a_cuts[1:], b_cuts[:-1], b_cuts[1:]])
    spans = spans[:, spans[1] > spans[0]]  # rows: a_lo, a_hi, b_lo, b_hi
    leaves = []
    while spans.shape[1]:
        small = (spans[1] - spans[0] <= SMALL) | (spans[3] - spans[2] == 1)
        if small.any():
            leaves.append(_small(a_ends, b_ends, spans[:, small]))
            spans = spans[:, ~small]
        a_lo, a_hi, b_lo, b_hi = spans
        cut_a, cut_b = np.full(len(a_lo), -1), np.full(len(a_lo), -1)
        # the ends of tokens a_lo .. a_hi - 2 lie within; tried from the middle outwards until one is shared
        middle, left, step = (a_lo + a_hi - 2) // 2, np.arange(len(a_lo)), 0
        while len(left):
            at = middle[left] + (step + 1) // 2 * (1 if step % 2 else -1)
            inside = (at >= a_lo[left]) & (at <= a_hi[left] - 2)
            tried, at = left[inside], at[inside]
            other = np.searchsorted(b_ends, a_ends[at])
            hit = b_ends[other] == a_ends[at]
            cut_a[tried[hit]], cut_b[tried[hit]] = at[hit] + 1, other[hit] + 1
            step += 1
            left = left[(cut_a[left] < 0) & (step // 2 <= (a_hi - a_lo)[left] // 2)]
        found = cut_a >= 0
        leaves.append((a_lo[~found], b_lo[~found]))
        a_lo, a_hi, b_lo, b_hi, cut_a, cut_b = (x[found] for x in (a_lo, a_hi, b_lo, b_hi, cut_a, cut_b))
        spans = np.concatenate([np.stack([a_lo, cut_a, b_lo, cut_b]), np.stack([cut_a, a_hi, cut_b, b_hi])], axis=1)
    if not leaves:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    firsts = np.concatenate([a for a, _ in leaves])
    order = np.argsort(firsts, kind="stable")
    return firsts[order], np.concatenate([b for _, b in leaves])[order]


def _small(a_ends: np.ndarray, b_ends: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups of intervals so short that all inner ends are looked up at once."""
    a_lo, a_hi, b_lo, _ = spans
    inner = a_hi - a_lo - 1
    at = np.repeat(a_lo - (np.cumsum(inner) - inner), inner) + np.arange(inner.sum())
    other = np.searchsorted(b_ends, a_ends[at])
    hit = b_ends[other] == a_ends[at]
    return np.concatenate([a_lo, at[hit] + 1]), np.concatenate([b_lo, other[hit] + 1])


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.cumsum([0, *map(len, ids)])
    return np.fromiter(chain.from_iterable(ids), np.int64, cuts[-1]), cuts


class Aligner:
    """Works on batches of texts; ``paths`` are those of the two tokenizers."""

    def __init__(self, paths: tuple[str, str]):
        self.a, self.b = ByteLevel(paths[0]), Pieces(paths[1])
        self.a_size, self.b_size = (np.array([len(x) for x in t.spelled]) for t in (self.a, self.b))
        # an id followed by a comma, or by what ends its side of a group
        self.printed = [b"%d%c" % (i, c) for n, end in ((len(self.a_size), b"|"), (len(self.b_size), b";")) for i in range(n) for c in (b",", end)]

    def ids(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; none where the two don't both spell the text behind a space."""
        full = [i for i, t in enumerate(texts) if t]
        some = [texts[i] for i in full]
        a, b = [[] for _ in texts], [[] for _ in texts]
        spell_a, spell_b = self.a.spelled.__getitem__, self.b.spelled.__getitem__
        for i, text, x, y in zip(full, some, self.a.encode(some), self.b.encode(some), strict=True):
            data = b" " + text.encode("utf-8", "surrogatepass")
            if b"".join(map(spell_a, x)) == data == b"".join(map(spell_b, y)):
                a[i], b[i] = x, y
        return a, b

    def align(self, texts: list[str | None]) -> tuple:
        """Per text n_a, n_b, n_groups, n_links and the digest of its groups; then (text, id pair, times) sorted by both."""
        a, b = self.ids(texts)
        (a, a_cuts), (b, b_cuts) = _flat(a), _flat(b)
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        a_first, b_first = shared_groups(a_ends, b_ends, a_cuts, b_cuts)
        groups = np.diff(np.searchsorted(a_first, a_cuts))
        # a link ends with its A token, or with its B token where that end is not shared
        b_of_a = np.searchsorted(b_ends, a_ends)
        alone = np.ones(len(b), bool)
        alone[b_of_a[b_ends[b_of_a] == a_ends]] = False
        alone = np.flatnonzero(alone)
        a_of_b = np.searchsorted(a_ends, b_ends[alone])
        pairs = np.concatenate([b[b_of_a] << 32 | a, b[alone] << 32 | a[a_of_b]])
        text = np.concatenate([np.repeat(np.arange(len(texts)), np.diff(a_cuts)), np.searchsorted(b_cuts, alone, "right") - 1])
        known, rank = np.unique(pairs, return_inverse=True)
        entry, times = np.unique(text * len(known) + rank, return_counts=True)
        links = np.bincount(text, minlength=len(texts))
        entries = (entry // max(1, len(known)), known[entry % max(1, len(known))], times)
        return np.diff(a_cuts), np.diff(b_cuts), groups, links, self._digests(a, b, a_cuts, b_cuts, a_first, b_first), entries

    def _digests(self, a, b, a_cuts, b_cuts, a_first, b_first) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3`` per text, '' without tokens."""
        a_size, b_size = np.diff(a_first, append=len(a)), np.diff(b_first, append=len(b))
        code = np.empty(len(a) + len(b), np.int64)
        last = np.zeros(len(a), np.int64)
        last[a_first + a_size - 1] = 1
        code[np.arange(len(a)) + np.repeat(b_first, a_size)] = 2 * a + last
        last = np.zeros(len(b), np.int64)
        last[b_first + b_size - 1] = 1
        code[np.arange(len(b)) + np.repeat(a_first + a_size, b_size)] = 2 * (b + len(self.a_size)) + last
        printed = [*map(self.printed.__getitem__, code.tolist())]
        cuts = (a_cuts + b_cuts).tolist()
        return [hashlib.sha256(b"".join(printed[x:y])[:-1]).hexdigest() if x < y else "" for x, y in zip(cuts, cuts[1:])]


_ALIGNERS: dict[tuple, Aligner] = {}


def aligner(paths: tuple[str, str]) -> Aligner:
    """One per worker process."""
    if paths not in _ALIGNERS:
        _ALIGNERS[paths] = Aligner(paths)
    return _ALIGNERS[paths]


class _Chunk:
    """Documents that share one table of id pairs."""

    def __init__(self, number: int):
        self.number, self.known, self.times, self.rows, self.entries = number, np.empty(0, np.int64), np.empty(0, np.int64), [], 0

    def add(self, doc_ids: list, aligned: tuple) -> None:
        text, pairs, times = aligned[-1]
        known, rank = np.unique(np.concatenate([self.known, pairs]), return_inverse=True)
        self.times = np.bincount(rank, np.concatenate([self.times, times]), len(known)).astype(np.int64)
        self.known = known
        cuts = np.searchsorted(text, np.arange(len(doc_ids) + 1))
        self.rows += [(i, *map(int, n), sha, pairs[x:y], times[x:y]) for i, *n, sha, x, y in zip(doc_ids, *aligned[:5], cuts, cuts[1:])]
        self.entries += len(pairs)

    def batch(self) -> pa.RecordBatch:
        rows = [("pairs", self.number, *[None] * 6, self.known.astype("<i8").tobytes(), self.times.astype("<i8").tobytes())]
        for *row, pairs, times in self.rows:
            rows.append(("texts", self.number, *row, np.searchsorted(self.known, pairs).astype("<u4").tobytes(), times.astype("<u4").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS, strict=True)], names=_NAMES)


def _encoder(paths: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, number = aligner(paths), TaskContext.get().partitionId() << 32
        chunk = _Chunk(number)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start in range(0, len(ids), BATCH):
                chunk.add(ids[start : start + BATCH], work.align(texts[start : start + BATCH]))
                if len(chunk.known) >= CHUNK_PAIRS or chunk.entries >= CHUNK_ENTRIES or len(chunk.rows) >= CHUNK_PAIRS:
                    yield chunk.batch()
                    number += 1
                    chunk = _Chunk(number)
        if chunk.rows:
            yield chunk.batch()

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, pairs, times in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            pairs, times = np.frombuffer(pairs, "<i8"), np.frombuffer(times, "<i8")
            for x in range(0, len(pairs), 50_000):
                part, n = pairs[x : x + 50_000], times[x : x + 50_000]
                yield pa.RecordBatch.from_arrays([np.full(len(part), chunk), part & 0xFFFFFFFF, part >> 32, n], names=["chunk", "a_id", "b_id", "n"])


def encoded(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """Encodes and aligns every text once, into a stored table: a row per text, and a row per chunk with its id pairs."""
    path = scratch_path(docs.sparkSession, "alignment")
    ids_and_texts(docs).mapInArrow(_encoder(paths or default_tokenizers()), _TABLE).write.partitionBy("kind").parquet(path)
    return docs.sparkSession.read.schema(_TABLE).parquet(path)


def chunk_pairs(table: DataFrame) -> DataFrame:
    """(chunk, a_id, b_id, n): how often a chunk's texts link two ids."""
    return table.where("kind = 'pairs'").select("chunk", "pairs", "times").mapInArrow(_unpacked, "chunk long, a_id long, b_id long, n long")


def pair_counts(table: DataFrame) -> DataFrame:
    """(a_id, b_id, count, best) over the corpus; best: no other A id goes with the B id more often."""
    totals = chunk_pairs(table).groupBy("a_id", "b_id").agg(F.sum("n").alias("count"))
    totals = store(totals, "alignment-totals")
    most = totals.groupBy("b_id").agg(F.max("count").alias("most"))
    return totals.join(most, "b_id").select("a_id", "b_id", "count", (F.col("count") == F.col("most")).alias("best"))


def _scored(key, texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """The texts of one chunk, with the corpus-wide counts of their links."""
    code = pairs["b_id"].to_numpy() << 32 | pairs["a_id"].to_numpy()
    order = np.argsort(code)
    count, best = pairs["count"].to_numpy()[order], pairs["best"].to_numpy()[order]
    n_best, count_sum = [], []
    for packed, times in zip(texts["pairs"].to_pylist(), texts["times"].to_pylist(), strict=True):
        at, n = np.frombuffer(packed, "<u4"), np.frombuffer(times, "<u4").astype(np.int64)
        n_best.append(int(n[best[at]].sum()))
        count_sum.append(int((n * count[at]).sum()))
    kept = texts.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64())).append_column("groups_sha256", texts["groups_sha256"])


def report(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    table = encoded(docs, paths)
    counts = chunk_pairs(table).join(pair_counts(table), ["a_id", "b_id"]).select("chunk", "a_id", "b_id", "count", "best")
    texts = table.where("kind = 'texts'").drop("kind")
    return texts.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(_scored, _RESULT)
