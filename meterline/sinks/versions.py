"""Maintained tables in hash buckets, published together as one version.

A round writes the buckets it changes into folders of its own and then publishes a manifest: for every table its
schema, its number of buckets, and the folder and bytes of each bucket. Nothing that a reader may hold is overwritten, so a reader sees all
tables as of one version, and a round that dies before its manifest leaves the tables as they were. Bucket
folders that the last ``KEPT`` manifests don't name are deleted by later rounds; there is one writer at a time.

Buckets split one by one as a table grows (linear hashing): with n buckets a hash goes to its remainder by the power of two
above n, or, where that bucket doesn't exist yet, by the power below. So growth rewrites the split buckets alone, and a
bucket has about ``BUCKET_BYTES``. A bucket is written by as many tasks as its size asks for.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

BUCKET_BYTES = 64 << 20
KEPT = 2
_BUCKET = "_bucket"


def bucket_of(hashed: Column, n: int) -> Column:
    """The bucket of a 64-bit hash among n."""
    low = 1 << (n.bit_length() - 1)
    wide = F.pmod(hashed, F.lit(2 * low))
    return F.when(wide < n, wide).otherwise(wide - low).cast("int")


def parent(bucket: int, n: int) -> int:
    """The bucket among n that holds what later goes to ``bucket``."""
    while bucket >= n:
        bucket -= 1 << (bucket.bit_length() - 1)
    return bucket


@dataclass(frozen=True)
class Table:
    schema: StructType
    buckets: int = 1
    keys: tuple[str, ...] = ()
    """Columns that the bucket is a hash of."""
    folders: dict[int, tuple[str, int]] = field(default_factory=dict)
    """Bucket to (folder below the root, bytes)."""

    @property
    def bytes(self) -> int:
        return sum(n for _, n in self.folders.values())

    def bucket(self, *columns: Column) -> Column:
        return bucket_of(F.xxhash64(*(columns or self.keys)), self.buckets)


@dataclass(frozen=True)
class Version:
    number: int = 0
    tables: dict[str, Table] = field(default_factory=dict)


class Tables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs
        self._system = self._paths.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._paths.Path(f"{self.root}/{name}")

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._system.listStatus(path)) if self._system.exists(path) else []

    def numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifest") if n.endswith(".json"))

    def version(self, number: int | None = None) -> Version:
        """A published version, by default the newest; version 0 has no tables."""
        known = self.numbers()
        number = (known[-1] if known else 0) if number is None else number
        if not number:
            return Version()
        stream = self._system.open(self._path(f"manifest/{number:010d}.json"))
        try:
            held = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        table = lambda t: Table(StructType.fromJson(t["schema"]), t["buckets"], tuple(t["keys"]), {int(b): (f, n) for b, (f, n) in t["folders"].items()})
        return Version(number, {name: table(t) for name, t in held.items()})

    def read(self, version: Version, name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table, or those of its rows that lie in ``buckets``; only their folders are listed."""
        table = version.tables[name]
        chosen = table.folders if buckets is None else {*buckets} & {*table.folders}
        paths = [f"{self.root}/{table.folders[b][0]}" for b in sorted(chosen)]
        return self.spark.read.schema(table.schema).parquet(*paths) if paths else self.spark.createDataFrame([], table.schema)

    def write(self, name: str, rows: DataFrame, keys: tuple[str, ...], base: Table | None = None, replaced: Iterable[int] = (), buckets: int = 1) -> Table:
        """Writes ``rows`` and says what the table then is: ``base`` without its ``replaced`` buckets, and these rows."""
        table = Table(rows.schema, buckets, keys)
        folder = f"{name}/{uuid.uuid4().hex}"
        if buckets == 1:
            rows.write.parquet(f"{self.root}/{folder}/{_BUCKET}=0")
        else:
            placed = rows.withColumn(_BUCKET, table.bucket())
            placed.hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.root}/{folder}")
        gone = {*replaced}
        kept = {b: f for b, f in base.folders.items() if b not in gone} if base else {}
        made = {}
        for part in self._names(folder):
            if part.startswith(f"{_BUCKET}="):
                size = self._system.getContentSummary(self._path(f"{folder}/{part}")).getLength()
                made[int(part.partition("=")[2])] = (f"{folder}/{part}", size)
        return Table(rows.schema, buckets, keys, kept | made)

    def publish(self, base: Version, changed: dict[str, Table]) -> Version:
        """Makes ``base`` with the ``changed`` tables the newest version, by one rename."""
        new = Version(base.number + 1, base.tables | changed)
        held = {n: {"schema": t.schema.jsonValue(), "buckets": t.buckets, "keys": t.keys, "folders": t.folders} for n, t in new.tables.items()}
        beside, target = self._path(f"manifest/{uuid.uuid4().hex}.tmp"), self._path(f"manifest/{new.number:010d}.json")
        stream = self._system.create(beside, False)
        try:
            stream.write(bytearray(json.dumps(held).encode()))
        finally:
            stream.close()
        if not self._system.rename(beside, target):
            raise RuntimeError(f"version {new.number} was published by another writer")
        return new

    def clean(self) -> None:
        """Deletes old manifests, what rounds that died have left, and buckets that no kept manifest names."""
        numbers = self.numbers()
        kept, old = [self.version(n) for n in numbers[-KEPT:]], numbers[:-KEPT]
        live = {f for v in kept for t in v.tables.values() for f, _ in t.folders.values()}
        dead = {f for n in old for t in self.version(n).tables.values() for f, _ in t.folders.values()} - live
        tops = {f.rpartition("/")[0] for f in live}
        dead |= {f"{name}/{top}" for name in self._names("") if name != "manifest" for top in self._names(name) if f"{name}/{top}" not in tops}
        for folder in sorted(dead) + [f"manifest/{n:010d}.json" for n in old] + [f"manifest/{n}" for n in self._names("manifest") if n.endswith(".tmp")]:
            self._system.delete(self._path(folder), True)


def grown(table: Table | None, added: int) -> tuple[int, set[int]]:
    """The number of buckets for a table and ``added`` bytes, and the present buckets that are split for it."""
    now = table.buckets if table else 1
    wanted = max(now, -(-((table.bytes if table else 0) + added) // BUCKET_BYTES))
    return wanted, {parent(b, now) for b in range(now, wanted)}
