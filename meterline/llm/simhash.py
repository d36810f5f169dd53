"""SimHash near-duplicates: every pair of fingerprints within a few bits, found with vantage-point trees.

A vantage-point tree sorts points by their Hamming distance to a vantage point and passes over the
branches that the triangle inequality rules out. On whole 64-bit fingerprints those bounds rule out
little (distances to any point crowd around 32, so a border of 4 on either side takes in most
points, see README), hence the upper part of the tree is cut by masked distances. Of the six bands of bits, two at
least are equal in any pair that differs in at most four bits. For each of the 15 pairs of bands one
tree is built whose upper vantage points lie on those bands: there the pair has masked distance zero,
the triangle bound has no border, and the shard of a fingerprint is its value on the two bands.
Within a shard the tree goes on over the whole distance, with borders of ``radius``.

Fingerprints are made distinct before any search, so copies cost nothing. A shard gives a spanning
forest of its links, not all pairs; the components are those of all links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..session import store
from .common import ids_and_texts, partitions, words_of
from .components import components

RADIUS = 4
SHINGLE = 4
SEED = 42
BANDS = (11, 11, 11, 11, 10, 10)
LEAF = 64
SHARD = 4_096
BLOCK = 256


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = np.asarray(hashes[at : at + 65_536], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is set if it is set in over half the shingles' hashes; zero without words."""
    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words).lower()
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    return majority(np.array(hashes, np.uint64))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint's bits as a long. Null and wordless texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    return ids_and_texts(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, fp long")


class Tree:
    """A vantage-point tree over distinct fingerprints; ``near`` takes those within the radius out of it."""

    def __init__(self, points: np.ndarray, radius: int):
        self.points, self.radius = points, radius
        self.alive = np.ones(len(points), bool)
        self.left = len(points)
        self.root = self._grow(np.arange(len(points)))

    def _grow(self, at: np.ndarray):
        if len(at) <= LEAF:
            return at
        far = np.bitwise_count(self.points[at] ^ self.points[at[0]]).astype(np.int64)
        cut = int(np.median(far))
        inner = far <= cut
        if inner.all():
            inner = far < cut
        if not inner.any():
            return at
        return int(at[0]), cut, int(far[~inner].min()), int(far[inner].max()), self._grow(at[inner]), self._grow(at[~inner])

    def near(self, point: np.uint64) -> np.ndarray:
        """Indexes still in the tree within the radius of the point; they leave the tree."""
        found, open_ = [], [self.root]
        while open_:
            node = open_.pop()
            if isinstance(node, np.ndarray):
                at = node[self.alive[node]]
                if len(at):
                    hits = at[np.bitwise_count(self.points[at] ^ point) <= self.radius]
                    found.append(hits)
                continue
            vantage, _, least_outer, most_inner, inner, outer = node
            distance = int(self.points[vantage] ^ point).bit_count()
            if distance - self.radius <= most_inner:
                open_.append(inner)
            if distance + self.radius >= least_outer:
                open_.append(outer)
        hits = np.concatenate(found) if found else np.empty(0, np.int64)
        self.alive[hits] = False
        self.left -= len(hits)
        return hits


def crowded(points: np.ndarray, radius: int) -> np.ndarray:
    """Indexes of the points that have another one within ``radius``; a shard's points at once, BLOCK by BLOCK."""
    found = [np.count_nonzero(np.bitwise_count(points[at : at + BLOCK, None] ^ points) <= radius, axis=1) > 1 for at in range(0, len(points), BLOCK)]
    return np.flatnonzero(np.concatenate(found)) if found else np.empty(0, np.int64)


def forest(points: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (indexes) that span each component of the points within ``radius`` of each other."""
    if len(points) <= SHARD:  # most points of a shard are alone: only the others are worth a tree
        at = crowded(points, radius)
        return [(int(at[x]), int(at[y])) for x, y in _grown(points[at], radius)]
    return _grown(points, radius)


def _grown(points: np.ndarray, radius: int) -> list[tuple[int, int]]:
    tree, links = Tree(points, radius), []
    for seed in range(len(points)):
        if not tree.alive[seed]:
            continue
        tree.alive[seed] = False
        open_ = [seed]
        while open_:
            at = open_.pop()
            for hit in tree.near(points[at]).tolist():
                links.append((at, hit))
                open_.append(hit)
    return links


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The fp values of each run of equal (tree, key, ring) in sorted batches; a run may span batches."""
    last, held = None, []
    for batch in batches:
        tree, key, ring, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        if not len(fp):
            continue
        cuts = np.flatnonzero((tree[1:] != tree[:-1]) | (key[1:] != key[:-1]) | (ring[1:] != ring[:-1])) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)], strict=True):
            name = (tree[start], key[start], ring[start])
            if name != last and held:
                yield np.concatenate(held)
                held = []
            last = name
            held.append(fp[start:end])
    if held:
        yield np.concatenate(held)


def _forest_rows(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in _groups(batches):
            points = np.unique(group).view(np.uint64)
            for x, y in forest(points, radius) if len(points) > 1 else ():
                a.append(int(points[x].view(np.int64)))
                b.append(int(points[y].view(np.int64)))
            if len(a) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def links(prints: DataFrame, radius: int = RADIUS, bands: tuple[int, ...] = BANDS) -> DataFrame:
    """Links (a, b) between distinct fingerprints that join the same fingerprints as all pairs within ``radius``.
    ``bands`` cut the 64 bits into ``radius + 2`` pieces or more, so that two are equal in any such pair.

    Shards of one fingerprint end in the shuffle's first aggregate and never reach Python. A shard is
    bounded by splitting: one of more than SHARD points is parted again by distance to a vantage point
    into rings as wide as the radius, and each ring is searched with the next one, so border pairs meet.
    """
    if sum(bands) != 64 or len(bands) < radius + 2:
        raise ValueError("bands must be radius + 2 or more and hold 64 bits")
    masks, low = [], 0
    for width in bands:
        masks.append(((1 << width) - 1) << low)
        low += width
    keys = [(i, x | y) for i, (x, y) in enumerate(combinations(masks, 2))]
    as_long = lambda v: v - (1 << 64) if v >> 63 else v
    distinct = prints.select("fp").distinct()
    rows = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("tree"), F.col("fp").bitwiseAND(F.lit(as_long(m))).alias("key")) for i, m in keys))).alias("k")).select("fp", "k.tree", "k.key")
    sizes = rows.groupBy("tree", "key").agg(F.count("*").alias("n"), F.min("fp").alias("vantage")).where("n > 1")
    rows = rows.join(sizes, ["tree", "key"])
    ring = F.when(F.col("n") > SHARD, F.floor(F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage"))) / radius).cast("int")).otherwise(0)
    rows = rows.withColumn("ring", ring).withColumn("ring", F.explode(F.when(F.col("n") > SHARD, F.array("ring", F.col("ring") + 1)).otherwise(F.array("ring"))))
    shards = rows.select("tree", "key", "ring", "fp").repartition(partitions(prints.sparkSession), "tree", "key", "ring").sortWithinPartitions("tree", "key", "ring")
    return shards.mapInArrow(_forest_rows(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, root) per document; component_id is the smallest doc_id that
    links reach, root names the component by its smallest fingerprint.

    Defined cases: texts without words share fingerprint zero and link like any other; repeated rows
    each get a row; a null doc_id is never a component's id unless nothing else is in it; an empty
    table gives no rows; other columns are ignored.
    """
    prints = store(fingerprints(docs, shingle), "fingerprints")
    roots = components(links(prints, radius), "fingerprint-links")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    least = least.join(roots, least["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    named = store(least.join(least.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id", "root"), "fingerprint-classes")
    return prints.join(named, "fp")


def report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", grouped: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """``docs`` with every column and one document of each group of ``grouped``: the one with the smallest id.

    Where several texts share that id, one of them stays; of rows repeated as they are, one stays. A row
    without an id stays only if no document of its group has one. Only ids and hashes are grouped; the
    texts meet the ids to keep in one join.
    """
    groups = grouped(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("k"))
    keep = first.select(F.col("k.doc_id").alias("keep_id"), F.col("k.text_hash").alias("keep_hash"))
    key = [F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("hash")]
    rows = docs.select(F.struct(*docs.columns).alias("row"), *key)  # no column can clash
    kept = rows.join(keep, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("hash") == F.col("keep_hash")), "left_semi")
    turn = F.row_number().over(Window.partitionBy("id", "hash").orderBy("id", "hash"))
    return kept.withColumn("turn", turn).where("turn = 1").select("row.*")
