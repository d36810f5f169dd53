"""One round of keeping tables in step with growing, changing and vanishing source files.

The round is driven by the ledger of files, not by a stream's memory of names: a file that has grown is read again.
Order of work: list, compare with the ledger, read what changed, replace those files' rows, retract vanished files, elect the
touched identities again, and publish all tables as one version (``sinks.versions``). A round that dies anywhere before
that has changed nothing, and the next one does its work.

Four tables lie below one folder. ``events`` in buckets by the path: a round reads and writes the buckets of its files.
``homes`` names the paths of each identity, ``winners`` holds the elected row of each; both in buckets by
identity. A touched identity meets its present winner and the new rows; only where its winner lay in a file that was
replaced or lost do its other rows count, and ``homes`` says in which buckets of ``events`` they are. ``ledger`` has a row
per file. So a round costs what its files touch, beside the listing and the ledger.

A file that can't be read is recorded with its reason and the time of its next try, keeps the rows it had, and
holds up no other file.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.elect import KEYS, first_by
from ..session import store
from ..sinks.versions import Table, Tables, Version, grown
from ..sources import files, ledger as L

FILES_AT_ONCE = 10_000
_LEDGER = "path string, agent string, size long, mtime long, reason string, version int, attempt long, retry_at long"
_NAMES = [f.split()[0] for f in _LEDGER.split(", ")]
_FILE = ["path", "agent"]


def escaped(path: str) -> str:
    """The path with the characters quoted that a reader would take for a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _chunks(gone: DataFrame) -> Iterator[list]:
    """The rows of ``gone``, so many at once; few files cost one job."""
    chunk = gone.take(FILES_AT_ONCE + 1)
    if len(chunk) <= FILES_AT_ONCE:
        yield chunk
        return
    chunk = []
    for row in gone.toLocalIterator():
        chunk.append(row)
        if len(chunk) == FILES_AT_ONCE:
            yield chunk
            chunk = []
    yield chunk


def _read(read: Callable[[list[str]], DataFrame], paths: list[str]) -> tuple[list[DataFrame], list[tuple[str, str]]]:
    """The stored rows of ``paths``, and (path, reason) of those that can't be read, found by halving."""
    try:
        return [store(read([escaped(p) for p in paths]), "fresh")], []
    except (PySparkException, Py4JJavaError) as error:
        if len(paths) == 1:
            return [], [(paths[0], str(error).strip().splitlines()[0][:500])]
    halves = [_read(read, part) for part in (paths[: len(paths) // 2], paths[len(paths) // 2 :])]
    return halves[0][0] + halves[1][0], halves[0][1] + halves[1][1]


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _numbers(rows: DataFrame, table: Table, *keys: str) -> set[int]:
    """The buckets of ``table`` that the keys of ``rows`` lie in: at most as many numbers as it has buckets."""
    if table.buckets == 1:
        return {0}
    return {r[0] for r in rows.select(table.bucket(*map(F.col, keys))).distinct().collect()}


def known_files(spark: SparkSession, sink: str) -> DataFrame:
    tables = Tables(spark, sink)
    at = tables.version()
    return tables.read(at, "ledger") if at.tables else spark.createDataFrame([], _LEDGER)


def refresh(
    spark: SparkSession, roots: Sequence[str] | str, glob: str, read: Callable[[list[str]], DataFrame], sink: str,
    agent: str, version: int = 1, winners: bool = True, now_ms: int | None = None,
) -> dict[str, int]:
    """Runs one round and says how many files were read, how many failed and how many vanished.

    ``read`` turns paths into rows with path and agent. With ``winners`` the rows also carry id and ts (and mtime, if
    copies of one time differ by it), and one winner per identity is kept. An empty listing is no evidence of
    deletion and retracts nothing.
    """
    now_ms = int(time.time() * 1000) if now_ms is None else now_ms
    tables = Tables(spark, sink)
    tables.clean()
    at = tables.version()
    state = _compared(spark, tables, at, roots, glob, agent, version, now_ms)
    gone = state.where("due OR vanished").select(*_FILE, "due")
    fresh, failed, done = [], [], {"read": 0, "failed": 0, "vanished": 0}
    for chunk in _chunks(gone):
        due = [r["path"] for r in chunk if r["due"]]
        rows, bad = _read(read, due) if due else ([], [])
        fresh, failed = fresh + rows, failed + bad
        done = {"read": done["read"] + len(due) - len(bad), "failed": len(failed), "vanished": done["vanished"] + len(chunk) - len(due)}
    if not any(done.values()):
        return done
    failures = spark.createDataFrame([(p, agent, r) for p, r in failed], "path string, agent string, failure string")
    new = {}
    if fresh or done["vanished"]:
        replaced = gone.select(*_FILE) if not failed else gone.join(failures, _FILE, "left_anti").select(*_FILE)
        new |= _replaced(tables, at, replaced, _union(fresh) if fresh else None, winners)
    new["ledger"] = _ledger(tables, state, failures if failed else None, version, now_ms)
    tables.publish(at, new)
    return done


def _compared(spark: SparkSession, tables: Tables, at: Version, roots: Sequence[str] | str, glob: str, agent: str, version: int, now_ms: int) -> DataFrame:
    """Every file of the ledger and of the listing, with what is to be done, by the rules of ``sources.ledger`` in one join:
    ``due`` to be read, ``vanished``, or neither."""
    known = tables.read(at, "ledger") if at.tables else spark.createDataFrame([], _LEDGER)
    known = known.select(*_FILE, *(F.col(c).alias(f"k_{c}") for c in _NAMES[2:]), F.lit(True).alias("known"))
    listing = store(files.list_files(spark, roots, glob).select("path", F.lit(agent).alias("agent"), "size", F.col("mtime_ms").alias("mtime"), F.lit(True).alias("listed")), "listing")
    trusted = not listing.isEmpty()  # an empty listing is no evidence of deletion
    listed, seen = F.coalesce("listed", F.lit(False)), F.coalesce("known", F.lit(False))
    same = F.col("size").eqNullSafe(F.col("k_size")) & F.col("mtime").eqNullSafe(F.col("k_mtime"))
    fine = seen & same & F.col("k_reason").isNull() & F.col("k_version").eqNullSafe(F.lit(version))
    waits = seen & same & F.col("k_reason").isNotNull() & (F.coalesce("k_retry_at", F.lit(0)) > now_ms)
    vanished = ~listed & (F.col("agent") == agent) & F.lit(trusted)
    return store(listing.join(known, _FILE, "full").withColumns({"due": listed & ~fine & ~waits, "vanished": vanished}), "compared")


def _ledger(tables: Tables, state: DataFrame, failures: DataFrame | None, version: int, now_ms: int) -> Table:
    """Files that were read, files that failed with the time of their next try, and all others as they were."""
    none = {"reason": F.lit(None).cast("string"), "version": F.lit(version), "attempt": F.lit(None).cast("long"), "retry_at": F.lit(None).cast("long")}
    read = state.where("due") if failures is None else state.where("due").join(failures, _FILE, "left_anti")
    rows = [state.where("NOT due AND NOT vanished").select(*_FILE, *(F.col(f"k_{c}").alias(c) for c in _NAMES[2:])), read.withColumns(none).select(*_NAMES)]
    if failures is not None:
        again = F.col("k_reason").isNotNull() & (F.col("k_size") == F.col("size")) & (F.col("k_mtime") == F.col("mtime"))
        attempt = F.when(again, F.col("k_attempt") + 1).otherwise(F.lit(1).cast("long"))
        bad = state.where("due").join(failures, _FILE).withColumn("attempt", attempt)
        rows.append(bad.withColumns({"reason": F.col("failure"), "version": F.lit(version), "retry_at": L.retry_at(F.col("attempt"), now_ms)}).select(*_NAMES))
    return tables.write("ledger", _union(rows), ("path",))


def _replaced(tables: Tables, at: Version, gone: DataFrame, fresh: DataFrame | None, winners: bool) -> dict[str, Table]:
    """The tables after the files of ``gone`` have given way to ``fresh``; nothing is published yet."""
    base = at.tables.get("events")
    if base is None and fresh is None:
        return {}
    added = 0 if fresh is None else sum(_size(tables, p) for p in fresh.inputFiles())
    old = None
    buckets, again = grown(base, added)
    if base is not None:
        again |= _numbers(gone, base, "path")
        old = tables.read(at, "events", again)
    parts = [p for p in (None if old is None else old.join(gone, _FILE, "left_anti"), fresh) if p is not None]
    new = {"events": tables.write("events", _union(parts).select(*(base.schema.names if base else fresh.columns)), ("path",), base, again, buckets)}
    return new | _elected(tables, at, gone, old, fresh) if winners else new


def _size(tables: Tables, uri: str) -> int:
    return tables._system.getFileStatus(tables._paths.Path(uri)).getLen()


def _elected(tables: Tables, at: Version, gone: DataFrame, old: DataFrame | None, fresh: DataFrame | None) -> dict[str, Table]:
    """``homes`` and ``winners`` after the round; ``old`` holds the rows that gave way, among others."""
    keys, homes, base = list(KEYS), at.tables.get("homes"), at.tables.get("winners")
    order = [F.col("ts").desc(), *([F.coalesce("mtime", F.lit(0)).desc()] if "mtime" in (fresh if fresh is not None else old).columns else []), F.col("path")]
    added = None if fresh is None else fresh.select(*keys, "path").distinct()
    if base is None:
        if fresh is None:
            return {}
        sizes = sum(_size(tables, p) for p in fresh.inputFiles())
        n = grown(None, sizes)[0]
        return {"homes": tables.write("homes", added, KEYS, buckets=n), "winners": tables.write("winners", first_by(fresh, keys, order), KEYS, buckets=n)}
    lost = old.join(gone, _FILE, "left_semi").select(*keys)
    touched = store((lost if fresh is None else lost.unionByName(added.select(*keys))).distinct(), "touched")
    more = 0 if fresh is None else sum(_size(tables, p) for p in fresh.inputFiles())
    n_homes, split_homes = grown(homes, more)
    n_base, split_base = grown(base, more)
    homes_again = _numbers(touched, homes, *keys)
    base_again = homes_again if homes.buckets == base.buckets else _numbers(touched, base, *keys)
    paths, seats = tables.read(at, "homes", homes_again | split_homes), tables.read(at, "winners", base_again | split_base)
    left = paths.join(gone, _FILE, "left_anti").select(*keys, "path")

    seat = seats.join(touched, keys, "left_semi")
    stays = seat.join(gone, _FILE, "left_anti")
    open_ = touched.join(stays, keys, "left_anti")  # identities whose winner is gone
    elsewhere, events = left.join(open_, keys, "left_semi"), at.tables["events"]
    if events.buckets > 1:
        elsewhere = store(elsewhere, "elsewhere")
    others = tables.read(at, "events", _numbers(elsewhere, events, "path")).join(elsewhere, [*keys, "path"], "left_semi")
    candidates = [x for x in (fresh, stays, others.select(*seats.columns)) if x is not None]
    elected = first_by(_union([c.select(*seats.columns) for c in candidates]), keys, order)
    return {
        "homes": tables.write("homes", (left if added is None else left.unionByName(added)).select(*homes.schema.names), KEYS, homes, homes_again | split_homes, n_homes),
        "winners": tables.write("winners", seats.join(touched, keys, "left_anti").unionByName(elected).select(*base.schema.names), KEYS, base, base_again | split_base, n_base),
    }


def current_rows(spark: SparkSession, sink: str, table: str = "events") -> DataFrame:
    """A table as of the newest version."""
    tables = Tables(spark, sink)
    return tables.read(tables.version(), table)
