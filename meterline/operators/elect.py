"""One winner per identity among copies, and keeping winners right as files come and go."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

KEYS = ("agent", "id")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in ``order``.

    Filtering ``row_number() = 1`` lets Spark cut every map task down to one row per key
    before the shuffle, so a key with very many copies costs one row per task.
    """
    spot = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(spot)).where("_rank = 1").drop("_rank")


def with_mtime(raw: DataFrame, files: DataFrame) -> DataFrame:
    """Modification time of each row's source file; 0 when the ledger has none."""
    times = files.select("path", "agent", F.col("mtime").alias("_mtime"))
    joined = raw.drop("mtime").join(times, ["path", "agent"], "left")
    return joined.withColumn(
        "mtime", F.coalesce("_mtime", F.lit(0).cast("bigint"))
    ).drop("_mtime")


def elect(raw: DataFrame, files: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Latest observation wins, then the most recently changed file, then the smallest path."""
    order = [F.col("ts").desc(), F.col("mtime").desc(), F.col("path").asc()]
    return first_by(with_mtime(raw, files), keys, order).drop("mtime").select(raw.columns)


def elect_first(df: DataFrame, keys: Sequence[str] = ("agent", "request_id")) -> DataFrame:
    """Earliest observation wins, then the smallest path. Apply before any range filter."""
    return first_by(df, keys, [F.col("ts").asc(), F.col("path").asc()])


def distinct_observations(
    quota: DataFrame, columns: Sequence[str] = ("agent", "session", "ts", "payload")
) -> DataFrame:
    """Archive copies of one observation count once; another payload is another observation."""
    return quota.select(*columns).dropDuplicates()


def replace_by_file(current: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """All rows of the re-read files give way to what was read now."""
    gone = changed.select("path", "agent").dropDuplicates()
    return current.join(gone, ["path", "agent"], "left_anti").unionByName(new)


def touched_keys(*frames: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    out = frames[0].select(*keys)
    for frame in frames[1:]:
        out = out.unionByName(frame.select(*keys))
    return out.dropDuplicates()


def reelect(
    current: DataFrame, raw: DataFrame, files: DataFrame, touched: DataFrame,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Winners recomputed for the touched identities only; all others are kept as they are."""
    fresh = elect(raw.join(touched, list(keys), "left_semi"), files, keys)
    kept = current.join(touched, list(keys), "left_anti")
    return kept.unionByName(fresh.select(current.columns))


def forget_files(
    tables: dict[str, DataFrame], stale: DataFrame, snapshot_agent: str | None = None
) -> dict[str, DataFrame]:
    """Retracts vanished files from every table that carries (path, agent).

    With ``snapshot_agent``, sessions of that agent that have no event left also leave the
    ``snapshots`` table, which has no path of its own.
    """
    gone = stale.select("path", "agent").dropDuplicates()
    out = {
        name: table.join(gone, ["path", "agent"], "left_anti")
        for name, table in tables.items()
        if name != "snapshots"
    }
    if "snapshots" in tables:
        snapshots = tables["snapshots"]
        if snapshot_agent is not None:
            alive = out["events"].where(F.col("agent") == snapshot_agent).select("session")
            snapshots = snapshots.join(alive.dropDuplicates(), ["session"], "left_semi")
        out["snapshots"] = snapshots
    return out


def ledger_audit(current: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows on which kept and recomputed winners disagree; empty when the ledger is sound."""
    columns = current.columns
    other = recomputed.select(*columns)
    return (
        current.exceptAll(other).withColumn("side", F.lit("kept"))
        .unionByName(other.exceptAll(current).withColumn("side", F.lit("recomputed")))
    )
