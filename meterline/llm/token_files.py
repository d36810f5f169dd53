"""Token ids as raw binary files, each with a minimal perfect hash index for access by document key.

``name.ids`` holds unsigned little-endian ids and nothing else, of 16 bits where the vocabulary allows it and
of 32 bits elsewhere. ``name.idx`` holds the keys in file order and, by hash slot, a 64-bit fingerprint, the offset and the number of ids. The hash is
hash-and-displace: keys go to buckets, buckets (largest first) take the first displacement that
puts their keys on free slots, buckets of one key name their slot. As many slots as keys, one probe
per lookup, and a fingerprint that turns away (all but one in 2**64) foreign keys.

Files are written by tasks under names of their own below a folder that all executors share; only
files named by the stored manifest count, so a repeated or speculative task does no harm.

A key is a document id and a number among rows that repeat the id. Defined cases: a null or
empty text has no ids but the end id; a null id sorts first; repeated rows each get a key; an empty table
gives no file; other columns are ignored.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import scratch_path, store
from .common import ENTRY_BYTES, ids_and_texts, mixed, partitions

END_ID = 2
FILE_IDS = 16_000_000
KNOWN_BYTES = 160 << 20
"""About what a worker keeps of words and their ids, as encoding a word again is dear."""
LOT_BYTES = 4 << 20
_MAGIC = b"IDX1"
_SPREAD = 2


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def key_hashes(keys: list[tuple[int | None, int]]) -> tuple[np.ndarray, np.ndarray]:
    data = b"".join(xxhash.xxh3_128_digest(f"{doc_id}/{turn}".encode()) for doc_id, turn in keys)
    pairs = np.frombuffer(data, ">u8").astype(np.uint64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _slot(second: np.ndarray, displacement: np.ndarray | int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(second + np.asarray(displacement).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)


class PerfectHash:
    """Slots 0..n-1 for n distinct keys; ``moves`` holds a displacement per bucket, or ~slot."""

    def __init__(self, n: int, moves: np.ndarray):
        self.n, self.moves = n, moves

    @classmethod
    def build(cls, first: np.ndarray, second: np.ndarray) -> PerfectHash:
        n = len(first)
        buckets = max(1, n // _SPREAD)
        moves, taken = np.zeros(buckets, np.int64), np.zeros(max(1, n), bool)
        home = (first % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        sizes = np.bincount(home, minlength=buckets)
        ends = np.cumsum(sizes)
        for size in range(int(sizes.max()), 1, -1):  # buckets of a size move on together; of two that want a slot, the first gets it
            open_ = np.flatnonzero(sizes == size)
            own, move = second[order[(ends[open_] - size)[:, None] + np.arange(size)]], np.zeros(len(open_), np.int64)
            while len(open_):
                slots = _slot(own, move[:, None], n).astype(np.int64)
                rows = np.sort(slots, axis=1)
                good = np.flatnonzero(~taken[slots].any(axis=1) & (rows[:, 1:] != rows[:, :-1]).all(axis=1))
                wanted, first_at = np.unique(slots[good], return_index=True)
                holder = np.zeros(max(1, n), np.int64)
                holder[wanted] = first_at // size
                good = good[(holder[slots[good]] == np.arange(len(good))[:, None]).all(axis=1)]
                moves[open_[good]] = move[good]
                taken[slots[good]] = True
                left = np.ones(len(open_), bool)
                left[good] = False
                open_, own, move = open_[left], own[left], move[left] + 1
        single = np.flatnonzero(sizes == 1)
        moves[single] = ~np.flatnonzero(~taken[:n])[: len(single)]
        return cls(n, moves)

    def slots(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        move = self.moves[(first % np.uint64(len(self.moves))).astype(np.int64)]
        return np.where(move < 0, ~move, _slot(second, np.maximum(move, 0), self.n).astype(np.int64))


def index_bytes(keys: list[tuple[int | None, int]], lengths: np.ndarray) -> bytes:
    first, second = key_hashes(keys)
    table = PerfectHash.build(first, second)
    at = table.slots(first, second)
    prints, offsets, sizes = np.zeros(len(keys), "<u8"), np.zeros(len(keys), "<u8"), np.zeros(len(keys), "<u4")
    prints[at], sizes[at] = first ^ second, lengths
    offsets[at] = np.cumsum(lengths) - lengths
    names = np.array([(k is None, k or 0, t) for k, t in keys], [("none", "?"), ("id", "<i8"), ("turn", "<i8")])
    out = io.BytesIO()
    out.write(_MAGIC + struct.pack("<QQ", len(keys), len(table.moves)))
    for part in (table.moves.astype("<i8"), prints, offsets, sizes, names):
        out.write(part.tobytes())
    return out.getvalue()


class TokenIndex:
    """Reads ``name.idx``: where a key's ids lie in ``name.ids``."""

    def __init__(self, data: bytes):
        if data[:4] != _MAGIC:
            raise ValueError("not a token index")
        n, buckets = struct.unpack_from("<QQ", data, 4)
        at = 20

        def take(kind, count):
            nonlocal at
            part = np.frombuffer(data, kind, count, at)
            at += part.nbytes
            return part

        self.table = PerfectHash(n, take("<i8", buckets))
        self.prints, self.offsets, self.sizes = take("<u8", n), take("<u8", n), take("<u4", n)
        self.keys = [(None if none else int(i), int(t)) for none, i, t in take([("none", "?"), ("id", "<i8"), ("turn", "<i8")], n).tolist()]

    def find(self, keys: list[tuple[int | None, int]]) -> list[tuple[int, int] | None]:
        """(offset, number of ids) of each key, None for keys that are not in the file."""
        if not self.table.n or not keys:
            return [None] * len(keys)
        first, second = key_hashes(keys)
        at = self.table.slots(first, second)
        known = self.prints[at] == (first ^ second)
        return [(int(o), int(s)) if k else None for k, o, s in zip(known, self.offsets[at], self.sizes[at], strict=True)]


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return (pafs.LocalFileSystem(), uri) if uri.startswith("/") else pafs.FileSystem.from_uri(uri)


def _put(folder: str, name: str, data: bytes) -> None:
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{name}") as out:
        out.write(data)


def _get(folder: str, name: str) -> bytes:
    system, path = file_system(folder)
    with system.open_input_stream(f"{path}/{name}") as source:
        return source.readall()


class Encoder:
    """Ids of texts as bytes. ``word_wise`` is for tokenizers that split at white space and drop it: words
    are encoded once per worker and texts are put together from them. Others take whole texts.
    """

    def __init__(self, tokenizer_path: str, end_id: int, word_wise: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.word_wise, self.known, self.held = Tokenizer.from_file(tokenizer_path), word_wise, {}, 0
        self.kind = "<u2" if max(end_id, self.tokenizer.get_vocab_size() - 1) < 1 << 16 else "<u4"
        self.end = np.array([end_id], self.kind).tobytes()

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array(self.kind[-1] == "2" and "H" or "I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not self.word_wise:
            return [ids + self.end for ids in self._encode(texts.to_pylist())]
        if self.held > KNOWN_BYTES:
            self.known.clear()
            self.held = 0
        split = pc.ascii_split_whitespace(texts)  # at exactly space and \t to \r; it may give empty words, which have no ids
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        own = [*map(self.known.get, words), self.end]  # ids of the lot's words, and the end id as one more word
        new = [i for i, ids in enumerate(own) if ids is None]
        for i, ids in zip(new, self._encode([words[i] for i in new]) if new else (), strict=True):
            own[i] = self.known[words[i]] = ids
            self.held += len(words[i]) + ENTRY_BYTES
        width = int(self.kind[-1])
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // width
        starts = np.cumsum(sizes) - sizes
        offsets = split.offsets.to_numpy().astype(np.int64)
        codes = np.insert(coded.indices.to_numpy(), offsets[1:] - offsets[0], len(words))
        lengths = sizes[codes]
        ends = np.cumsum(lengths)
        ids = np.frombuffer(b"".join(own), self.kind)[np.repeat(starts[codes] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        cuts = (ends[offsets[1:] - offsets[0] + np.arange(len(texts))] * width).tolist()
        return [ids[a:b] for a, b in zip([0, *cuts], cuts)]


def lots(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are encoded at once, of about LOT_BYTES."""
    ends, start = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)), 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + LOT_BYTES, "right")))
        yield start, stop
        start = stop


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(*key) -> Encoder:
    """One per worker process, so that tasks that follow one another know the words."""
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


_MANIFEST = "part int, seq int, name string, kind string, n_docs long, n_ids long"


def _writer(folder: str, tokenizer_path: str, end_id: int, word_wise: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, end_id, word_wise)
        width = int(encode.kind[-1])
        part, seq, last, turn = TaskContext.get().partitionId(), 0, object(), 0
        keys, lengths, payload, held = [], [], [], 0

        def close():
            name = f"part-{part:06d}-{seq:04d}-{uuid.uuid4().hex}"
            _put(folder, f"{name}.ids", b"".join(payload))
            _put(folder, f"{name}.idx", index_bytes(keys, np.array(lengths, np.int64)))
            rows = [[part], [seq], [name], [encode.kind], [len(keys)], [held]]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=["part", "seq", "name", "kind", "n_docs", "n_ids"])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for start, stop in lots(texts):
                for doc_id, tokens in zip(ids[start:stop], encode(texts.slice(start, stop - start)), strict=True):
                    turn = turn + 1 if doc_id == last else 0
                    last = doc_id
                    keys.append((doc_id, turn))
                    payload.append(tokens)
                    lengths.append(len(tokens) // width)
                    held += len(tokens) // width
                if held >= FILE_IDS:
                    yield close()
                    keys, lengths, payload, held, seq = [], [], [], 0, seq + 1
        if keys:
            yield close()

    return run


def write(docs: DataFrame, folder: str, tokenizer_path: str | None = None, end_id: int = END_ID, word_wise: bool = True) -> DataFrame:
    """Writes the files in ascending order of id; the manifest (part, seq, name, kind, n_docs, n_ids, start)."""
    rows = ids_and_texts(docs).withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    manifest = store(ordered.mapInArrow(_writer(folder, tokenizer_path or default_tokenizer(), end_id, word_wise), _MANIFEST), "token-manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start, kind in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                index, payload = TokenIndex(_get(folder, f"{name}.idx")), np.frombuffer(_get(folder, f"{name}.ids"), kind)
                found = index.find(index.keys)
                rows = [[k for k, _ in index.keys], [start + o for o, _ in found], [n for _, n in found], [zlib.crc32(payload[o : o + n].astype("<u4")) for o, n in found]]
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_back(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, looked up in the index and read from the files."""
    files = manifest.select("name", "start", "kind").repartition(partitions(manifest.sparkSession), "name")
    return files.mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def report(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    folder = scratch_path(docs.sparkSession, "tokens")
    return read_back(write(docs, folder, tokenizer_path), folder)
