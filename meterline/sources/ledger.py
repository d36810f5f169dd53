"""The ledger of source files: what to read again, what to give up on, what has vanished."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import variants as V

# Retry curve and status words.
FREE_ATTEMPTS = 3
BACKOFF_MS, BACKOFF_MAX_MS, BACKOFF_STEPS = 60_000, 1_800_000, 20
UNKNOWN_AGENT, UNREADABLE_STATE = "unknown", "unreadable"
_FILE = ["path", "agent"]


def changed_files(
    listing: DataFrame, ledger: DataFrame, health: DataFrame, version: int
) -> DataFrame:
    """Files to read: new, different in size or time, failed before, without a health row, or
    last read by another version of the normaliser."""
    known = ledger.select(
        *_FILE, F.col("size").alias("_size"), F.col("mtime").alias("_mtime"),
        F.col("reason").alias("_reason"), F.col("version").alias("_version"),
    ).withColumn("_known", F.lit(True))
    healthy = health.select(*_FILE).withColumn("_healthy", F.lit(True))
    joined = listing.join(known, _FILE, "left").join(healthy, _FILE, "left")
    stale = (
        F.col("_known").isNull() | F.col("_healthy").isNull() | F.col("_reason").isNotNull()
        | ~F.col("_size").eqNullSafe(F.col("size")) | ~F.col("_mtime").eqNullSafe(F.col("mtime"))
        | ~F.col("_version").eqNullSafe(F.lit(version))
    )
    return joined.where(stale).select(*_FILE)


def retry_at(attempt: Column, now_ms: int) -> Column:
    """Free retries first, then a wait that doubles up to half an hour."""
    step = F.least(attempt - FREE_ATTEMPTS, F.lit(BACKOFF_STEPS)).cast("int")
    wait = F.least(
        F.lit(BACKOFF_MS).cast("bigint") * F.pow(F.lit(2.0), step).cast("bigint"),
        F.lit(BACKOFF_MAX_MS).cast("bigint"),
    )
    now = F.lit(now_ms).cast("bigint")
    return F.when(attempt < FREE_ATTEMPTS, now).otherwise(now + wait)


def next_failures(previous: DataFrame, failures: DataFrame, now_ms: int) -> DataFrame:
    """Failure rows after this round. The count starts over when the file has changed."""
    before = previous.where("reason IS NOT NULL").select(
        *_FILE, F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col("attempt").alias("_attempt")
    )
    same = (F.col("_size") == F.col("size")) & (F.col("_mtime") == F.col("mtime"))
    attempt = F.when(same, F.col("_attempt") + 1).otherwise(F.lit(1).cast("bigint"))
    rows = failures.join(before, _FILE, "left").withColumn("attempt", attempt)
    return rows.withColumn("retry_at", retry_at(F.col("attempt"), now_ms)).select(
        *_FILE, "size", "mtime", "reason", "attempt", "retry_at"
    )


def gated(listing: DataFrame, ledger: DataFrame, now_ms: int) -> DataFrame:
    """Unchanged files that failed and may not be tried again yet."""
    waiting = ledger.where((F.col("reason").isNotNull()) & (F.col("retry_at") > now_ms))
    return listing.join(
        waiting.select(*_FILE, "size", "mtime", "attempt", "retry_at"), [*_FILE, "size", "mtime"]
    )


def stale_files(ledger: DataFrame, listing: DataFrame, agent_ok: DataFrame) -> DataFrame:
    """Ledger files the listing no longer has, for agents whose root exists and whose scan
    saw no error: an incomplete listing is no evidence of deletion."""
    trusted = agent_ok.where("ok").select("agent")
    return (
        ledger.select(*_FILE).join(listing.select(*_FILE), _FILE, "left_anti")
        .join(trusted, ["agent"], "left_semi").select(*_FILE)
    )


def union_sources(first: DataFrame, *others: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), others, first)


def scan_status(
    results: DataFrame, agents: DataFrame, disabled: list[str] | None = None, stopped: bool = False
) -> DataFrame:
    """One row per agent. ``results``: agent, path, outcome (parsed, reused or failed),
    malformed_lines, error, retry_at. Error texts are kept in their own rows by
    :func:`scan_errors`; here only their number appears, so no row grows with the failures."""
    sums = results.groupBy("agent").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("outcome") == "parsed").alias("parsed"),
        F.count_if(F.col("outcome") == "reused").alias("reused"),
        F.count_if(F.col("outcome") == "failed").alias("failed_files"),
        F.sum("malformed_lines").alias("malformed_lines"),
        F.min("retry_at").alias("next_retry_at"),
        F.count("error").alias("errors"),
    )
    counts = ("files", "parsed", "reused", "failed_files", "malformed_lines", "errors")
    filled = agents.join(sums, ["agent"], "left").withColumns(
        {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in counts}
    )
    trouble = (F.col("errors") > 0) | (F.col("failed_files") > 0)
    state = (
        F.when(F.col("agent").isin(disabled or []), "disabled")
        .when(F.lit(stopped), "stopped")
        .when((F.col("parsed") + F.col("reused") == 0) & trouble, "error")
        .when(trouble, "degraded").when(F.col("malformed_lines") > 0, "warning")
        .when(F.col("files") == 0, "missing").otherwise("ready")
    )
    return filled.withColumn("state", state)


def scan_errors(results: DataFrame) -> DataFrame:
    return results.where("error IS NOT NULL").select("agent", "path", "error")


def read_status(rows: DataFrame, column: str) -> DataFrame:
    """Status rows as other writers left them: bad fields become NULL and set ``partial``."""
    v = F.col("_v")

    def count(path: str) -> Column:
        n = V.number_at(v, path)
        return F.when(n >= 0, n.cast("bigint"))

    def text(path: str) -> Column:
        return F.when(F.btrim(V.text_at(v, path)) != "", V.text_at(v, path))

    entries = V.array_at(v, "errors")
    good = F.filter(
        F.transform(entries, lambda e: F.when(F.schema_of_variant(e) == "STRING", F.try_variant_get(e, "$", "string"))),
        lambda e: e.isNotNull() & (F.btrim(e) != ""),
    )
    absent = V.is_null(v, "errors")
    unreadable = (
        F.when(entries.isNotNull(), F.size(entries) - F.size(good))
        .when(absent, F.lit(0)).otherwise(F.lit(1)).cast("bigint")
    )
    numbers = {"files": "files", "reused": "reused", "malformed_lines": "malformedLines", "updated_at": "updatedAt"}
    parsed = rows.withColumn("_v", V.parse(column)).withColumns(
        {
            "agent": F.coalesce(text("agent"), F.lit(UNKNOWN_AGENT)),
            "state": F.coalesce(text("state"), F.lit(UNREADABLE_STATE)),
            **{name: count(path) for name, path in numbers.items()},
            "failed_files": count("failedFiles"), "next_retry_at": count("nextRetryAt"),
            "errors": F.coalesce(good, F.array().cast("array<string>")),
            "unreadable_errors": unreadable,
            "_gap": V.is_null(v, "agent") | V.is_null(v, "state") | ~V.is_object(v, ""),
        }
    )
    short = F.col("_gap") | (F.col("unreadable_errors") > 0)
    for name in numbers:
        short = short | F.col(name).isNull()
    return parsed.withColumn("partial", F.coalesce(short, F.lit(True))).drop("_v", "_gap", column)
