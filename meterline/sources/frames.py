"""Lines of zstd files of many frames, read in ranges of frames, so that a large file is many tasks.

A first pass reads frame and block headers only and says where frames begin. Frames are gathered into ranges of about
``RANGE_BYTES``; each range is decoded on its own, in a stream, into complete lines, the piece before its first line end and the
piece after its last. Pieces of lines that cross ranges meet by the number of line ends before them. The number of a line is
exact, and whether the last one ended is known.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import store

RANGE_BYTES = 8 << 20
TASKS = 20_000
_MAGIC, _SKIPPED = 0xFD2FB528, 0x184D2A50
_CHUNK = 1 << 20
_PARTS = "path string, range long, kind string, i long, ends long, bad boolean, bytes binary"


def _file(path: str) -> pa.NativeFile:
    system, name = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return system.open_input_file(name)


def frames(source: pa.NativeFile) -> Iterator[tuple[int, int]]:
    """(offset, length) of each frame, from headers alone; a frame that is cut off, or anything else, reaches to the end."""
    size, at = source.size(), 0

    def number(offset: int, n: int) -> int | None:
        source.seek(offset)
        data = source.read(n)
        return int.from_bytes(data, "little") if len(data) == n else None

    while at < size:
        magic = number(at, 4)
        end = None
        if magic is not None and magic & ~0xF == _SKIPPED:
            length = number(at + 4, 4)
            end = None if length is None else at + 8 + length
        elif magic == _MAGIC and (flags := number(at + 4, 1)) is not None:
            single = flags >> 5 & 1
            end = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
            last = False
            while not last:
                block = number(end, 3)
                if block is None:
                    end = None
                    break
                last, kind, length = block & 1, block >> 1 & 3, block >> 3
                end += 3 + (1 if kind == 1 else length)
            else:
                end += 4 * (flags >> 2 & 1)
        if end is None or end > size:
            yield at, size - at
            return
        yield at, end - at
        at = end


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of frames: (path, range, offset, length)."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            spans: dict[int, list[int]] = {}
            with _file(path) as source:
                for at, length in frames(source):
                    spans.setdefault(at // RANGE_BYTES, [at, 0])[1] += length
            if spans:
                columns = [[path] * len(spans), list(spans), [s[0] for s in spans.values()], [s[1] for s in spans.values()]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["path", "range", "offset", "length"])


def _decoded(path: str, offset: int, length: int) -> Iterator[bytes | None]:
    """The bytes of the frames of a range; None at last if they can't all be decoded."""
    import zstandard

    with _file(path) as source:
        source.seek(offset)
        left, rest, work = length, b"", None
        while left or rest:
            data = rest or source.read(min(_CHUNK, left))
            left -= 0 if rest else len(data)
            work, rest = work or zstandard.ZstdDecompressor().decompressobj(), b""
            try:
                yield work.decompress(data)
            except zstandard.ZstdError:
                yield None
                return
            if work.eof:
                rest, work = work.unused_data, None


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
    names = [f.split()[0] for f in _PARTS.split(", ")]
    rows: list[tuple] = []

    def flushed() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names=names)
        rows.clear()
        return batch

    for batch in batches:
        for path, number, offset, length in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            ends, pieces, head, bad, held = 0, [], b"", False, 0
            for data in _decoded(path, offset, length):
                if data is None:
                    bad = True
                    break
                first, *others = data.split(b"\n")
                pieces.append(first)
                for piece in others:
                    line = b"".join(pieces)
                    if ends:
                        rows.append((path, number, "line", ends, None, None, line))
                        held += len(line)
                    else:
                        head = line
                    ends, pieces = ends + 1, [piece]
                if held >= 8 << 20:
                    yield flushed()
                    held = 0
            rest = b"".join(pieces)
            if ends:
                rows.append((path, number, "tail", None, None, None, rest))
            rows.append((path, number, "head", None, ends, bad, head if ends else rest))
            yield flushed()


def _joined(pieces: Column) -> Column:
    """Bytes of pieces in order, as text."""
    text = F.transform(F.array_sort(pieces), lambda p: F.decode(p["bytes"], "ISO-8859-1"))
    return F.encode(F.array_join(text, ""), "ISO-8859-1")


def scan_frames(files: DataFrame) -> DataFrame:
    """[path, line, bytes, terminated] of the zstd files ``files`` (path)."""
    paths = files.select("path")
    dealt = paths.repartition(max(1, paths.sparkSession.sparkContext.defaultParallelism))
    ranges = store(dealt.mapInArrow(_indexed, "path string, range long, offset long, length long"), "frame-ranges")
    spread = ranges.repartition(max(1, min(ranges.count(), TASKS)))  # a number, as Spark would join rows as small as these into one task
    parts = store(spread.mapInArrow(_parted, _PARTS), "frame-lines")
    by_range = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(by_range), F.lit(0))
    heads = parts.where("kind = 'head'")  # a row per range
    known = heads.select(
        "path", "range", "ends", before("ends").alias("before"), before(F.col("bad").cast("int")).alias("_bad"), before((F.col("ends") > 0).cast("int")).alias("_groups"),
    ).where("_bad = 0").drop("_bad")  # nothing counts behind what can't be decoded
    lines = parts.where("kind = 'line'").join(known, ["path", "range"]).select("path", (F.col("before") + F.col("i") + 1).alias("line"), "bytes", F.lit(True).alias("terminated"))
    pieces = parts.where("kind != 'line'").drop("ends").join(known, ["path", "range"])
    tail = F.col("kind") == "tail"
    group = F.col("_groups") + tail.cast("int")
    crossing = pieces.groupBy("path", group.alias("group")).agg(
        _joined(F.collect_list(F.struct("range", tail.alias("after"), "bytes"))).alias("bytes"),
        F.max(F.when(~tail & (F.col("ends") > 0), F.col("before") + 1)).alias("_ended"), F.max(F.when(tail, F.col("before") + F.col("ends")).otherwise(F.col("before"))).alias("_open"),
    )
    crossing = crossing.select("path", F.coalesce("_ended", F.col("_open") + 1).alias("line"), "bytes", F.col("_ended").isNotNull().alias("terminated"))
    return lines.unionByName(crossing)
