"""Shards of near-equal bytes by a k-d tree over document metadata, with DataFrame functions only.

A node of the tree that must hold several shards is split along its widest dimension (its range as
a share of the whole table's) where the wanted share of its bytes lies to the left: the
distributed weighted median. The split point is found by histograms: one job counts the bytes of all
open nodes of a level in equal-width bins, and the bin that the wanted weight falls in is cut again
until it is light. Ties on the dimension are cut in the same way by a hash of the row, so that a
value held by a third of all rows doesn't make a heavy shard.

Per level only bins and ranges (at most ``BINS`` rows) reach the driver. The tree is an expression of
literal arrays, evaluated where the documents are; documents move once, to get their slots.

Defined cases: a null text has size 8 and the checksum of no bytes; a null dimension sorts first;
repeated rows get a slot each; an empty table gives no rows; other columns stay (``assign``) or
are ignored (``report``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import store

SHARDS = 24
BINS = 65_536
LIGHT = 1 / 2_000
"""A bin of at most this share of its node's bytes is not cut further."""
CHUNK_ROWS = 8_192
_LEAST, _MOST = -(1 << 61), 1 << 61


def as_number(column: Column) -> Column:
    """A long that keeps the order of a string's first seven bytes."""
    head = F.rpad(F.hex(F.substring(F.encode(column, "UTF-8"), 1, 7)), 14, "0")
    return F.conv(head, 16, 10).cast("long")


def dimensions(docs: DataFrame) -> list[Column]:
    """What the tables of documents can be parted by: source, language, id and length."""
    known = {"source": as_number, "lang": as_number, "doc_id": lambda c: c.cast("long"), "text": lambda c: F.octet_length(c).cast("long")}
    return [make(F.col(name)) for name, make in known.items() if name in docs.columns]


def bounded(dim: Column) -> Column:
    """A dimension within 62 bits, so that differences fit a long; what lies beyond ties at the end, and is parted by hash."""
    return F.least(F.lit(_MOST), F.greatest(F.lit(_LEAST), F.coalesce(dim, F.lit(_LEAST))))


@dataclass
class Node:
    leaves: int
    dim: int = 0
    value: int = _MOST
    tie: int = 0
    left: int = 0


def _step(level: list[Node], x: Column, tie: Column) -> Callable[[Column], Column]:
    """From the node of one level (bound once by a lambda, as it is read often) to the node of the next."""

    def step(n: Column) -> Column:
        of = lambda name: _lookup([getattr(v, name) for v in level], n)
        at, value = F.element_at(x, of("dim").cast("int")), of("value")
        right = (at > value) | ((at == value) & (tie >= of("tie")))
        return (of("left") + F.when(right, 1).otherwise(0)).cast("int")

    return step


@dataclass
class Tree:
    dims: list[Column]
    tie: Column
    levels: list[list[Node]] = field(default_factory=list)

    def leaf(self, upto: int | None = None) -> Column:
        """The index of a row's node after the first levels."""
        node = F.lit(0)
        x, tie = F.array(*map(bounded, self.dims)), self.tie
        for level in self.levels[:upto]:
            node = F.element_at(F.transform(F.array(node), _step(level, x, tie)), 1)
        return node


def _lookup(values: list[int | None], node: Column | None = None) -> Column:
    """The literal at a row's node; null beyond the list."""
    return F.get(F.array(*(F.lit(v).cast("long") for v in values)), F.col("node") if node is None else node)


def _cut(rows: DataFrame, open_: dict[int, dict], key: str) -> None:
    """Narrows ``lo``/``hi`` of every open node to a light bin around its wanted weight.

    Each node has lo, hi (the keys still in question), want (bytes that must lie below the split,
    of those in question) and light. Afterwards ``split`` is the least key that goes right.
    """
    todo = dict(open_)
    while todo:
        bins = max(16, BINS // len(todo))
        for n in todo.values():
            n["step"] = -(-(n["hi"] - n["lo"] + 1) // bins)
        none = {"lo": 0, "hi": -1, "step": 1}
        of = lambda name: _lookup([todo.get(i, none)[name] for i in range(max(todo) + 1)])
        inside = rows.withColumns({"lo": of("lo"), "step": of("step")}).where(F.col(key).between(F.col("lo"), of("hi")))
        found = inside.groupBy("node", F.expr(f"({key} - lo) div step").alias("bin")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
        by_node: dict[int, list] = {}
        for row in found:
            by_node.setdefault(row["node"], []).append(row)
        for i in list(todo):
            n, below = todo[i], 0
            for row in sorted(by_node.get(i, ()), key=lambda r: r["bin"]):
                if below + row["bytes"] >= n["want"]:
                    break
                below += row["bytes"]
            else:
                n["split"] = n["hi"] + 1
                del todo[i]
                continue
            lo = n["lo"] + row["bin"] * n["step"]
            hi = min(n["hi"], lo + n["step"] - 1)
            n["want"] -= below
            if row["bytes"] <= n["light"] or row["n"] == 1 or lo == hi:
                whole = 2 * n["want"] > row["bytes"]
                n.update(split=hi + 1 if whole else lo, lo=lo, hi=hi, single=lo == hi, held=row["bytes"], rows=row["n"])
                del todo[i]
            else:
                n.update(lo=lo, hi=hi)


def build(docs: DataFrame, shards: int, size: Column, tie: Column, dims: list[Column]) -> Tree:
    names = [f"x{i}" for i in range(len(dims))]
    rows = store(docs.select(size.alias("size"), tie.alias("tie"), *(bounded(d).alias(n) for n, d in zip(names, dims, strict=True))), "shard-metadata")
    stored = Tree([F.col(n) for n in names], F.col("tie"))
    tree = Tree(dims, tie, stored.levels)
    nodes, spread = [Node(shards)], None
    while any(n.leaves > 1 for n in nodes):
        placed = rows.withColumn("node", stored.leaf())
        ranges = {
            r["node"]: r for r in placed.groupBy("node").agg(
                F.sum("size").alias("bytes"), *(F.min(n).alias(f"lo_{n}") for n in names), *(F.max(n).alias(f"hi_{n}") for n in names)).collect()
        }
        extent = lambda r: [r[f"hi_{n}"] - r[f"lo_{n}"] for n in names]
        if spread is None:
            spread = [max(1, e) for e in extent(ranges[0])] if ranges else [1] * len(names)
        open_ = {}
        for i, node in enumerate(nodes):
            if node.leaves > 1 and i in ranges:
                r = ranges[i]
                shares = [e / s for e, s in zip(extent(r), spread, strict=True)]
                node.dim = shares.index(max(shares)) + 1
                name = names[node.dim - 1]
                want = r["bytes"] * (-(-node.leaves // 2)) / node.leaves
                open_[i] = {"lo": r[f"lo_{name}"], "hi": r[f"hi_{name}"], "want": want, "light": r["bytes"] * LIGHT}
        keyed = placed.withColumn("key", F.element_at(F.array(*names), _lookup([max(1, n.dim) for n in nodes]).cast("int")))
        _cut(keyed, open_, "key")
        tied = {i: n for i, n in open_.items() if n.get("single") and n["rows"] > 1}
        for i, n in open_.items():
            nodes[i].value, nodes[i].tie = n["split"], -(1 << 63)
        if tied:
            values = {i: n["lo"] for i, n in tied.items()}
            same = keyed.where(F.col("key") == _lookup([values.get(i) for i in range(max(values) + 1)]))
            for n in tied.values():
                n.update(lo=0, hi=(1 << 62) - 1)
                n.pop("single")
            _cut(same, tied, "tie")
            for i, n in tied.items():
                nodes[i].value, nodes[i].tie = values[i], n["split"]
        following: list[Node] = []
        for node in nodes:
            node.dim, node.left = max(1, node.dim), len(following)
            following.append(Node(-(-node.leaves // 2)))
            if node.leaves > 1:
                following.append(Node(node.leaves // 2))
        stored.levels.append(nodes)
        nodes = following
    return tree


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", dims: list[Column] | None = None) -> DataFrame:
    """``docs`` with every column, and size, text_crc32, shard and slot (0, 1, ... within a shard).

    Slots are numbered within chunks of a shard, and chunks are offset by the counts of earlier
    ones, so a shard of any size is numbered by many tasks.
    """
    text = F.col(text_col).cast("string")
    own = [c for c in docs.columns if c not in ("size", "text_crc32", "shard", "slot")]
    size, crc = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8, F.coalesce(F.crc32(text.cast("binary")), F.lit(0))
    tie = F.xxhash64(F.col(id_col), crc, size).bitwiseAND(F.lit((1 << 62) - 1))
    tree = build(docs, shards, size, tie, dims if dims is not None else dimensions(docs))
    chunks = max(1, docs.count() // (shards * CHUNK_ROWS))
    placed = docs.select(F.struct(*own).alias("row"), F.col(id_col).alias("id"), size.alias("size"), crc.alias("text_crc32"), tree.leaf().alias("shard"), F.pmod(tie, F.lit(chunks)).cast("int").alias("chunk"), tie.alias("tie"))
    counts = placed.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "chunk").orderBy("tie", "id", "text_crc32", "size")
    return (
        placed.withColumn("rank", F.row_number().over(order)).join(starts, ["shard", "chunk"])
        .select("row.*", "size", "text_crc32", "shard", (F.col("start") + F.col("rank") - 1).alias("slot"))
    )


def report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Law ``bytes``: doc_id, size, text_crc32, law, shard, slot and a null grown_shard."""
    out = assign(docs.select(*(c for c in ("doc_id", "text", "lang", "source") if c in docs.columns)), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
