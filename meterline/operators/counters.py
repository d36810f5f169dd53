"""Running totals back to per-request amounts, and ledgers of session snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S
from .ordered import DAY_MS, with_previous

COUNTERS = ("c_input", "c_cached", "c_cache_write", "c_output", "c_reasoning")


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def counter_reset(prev: str = "prev") -> Column:
    """A total that fell means the counter started over."""
    return (F.col("c_input") < F.col(f"{prev}.c_input")) | (
        F.col("c_output") < F.col(f"{prev}.c_output")
    )


def spelling_changed(column: str = "spelling", prev: str = "prev") -> Column:
    """Two different concrete field names in neighbouring samples break the series."""
    now, before = F.col(column), F.col(f"{prev}.{column}")
    return now.between(1, 3) & before.between(1, 3) & (now != before)


def delta_columns(prev: str = "prev") -> dict[str, Column]:
    """Differences to the preceding totals. ``c_input`` counts cached input too."""

    def step(name: str) -> Column:
        return F.greatest(F.col(name) - F.col(f"{prev}.{name}"), _zero())

    whole = step("c_input")
    cached = F.least(step("c_cached"), whole)
    return {
        "input": whole - cached,
        "cached": cached,
        "cache_write": step("c_cache_write"),
        "output": step("c_output"),
        "reasoning": step("c_reasoning"),
    }


def with_previous_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], extra: Sequence[str] = (),
    width: int = DAY_MS,
) -> DataFrame:
    return with_previous(df, keys, order, [*COUNTERS, *extra], "prev", width)


def skip_repeats(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], extra: Sequence[str] = (),
    width: int = DAY_MS,
) -> DataFrame:
    """Drops a sample identical to the one before it. Keeps ``prev`` for the next step:
    a dropped repeat equals its predecessor, so ``prev`` is the last kept sample as well."""
    seen = with_previous_totals(df, keys, order, extra, width)
    same = F.col("prev").isNotNull()
    for name in (*COUNTERS, *extra):
        same = same & F.col(f"prev.{name}").eqNullSafe(F.col(name))
    return seen.where(~same)


def cumulative_delta(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], spelling: str | None = None,
    width: int = DAY_MS,
) -> DataFrame:
    """Running totals to per-request usage.

    The first sample, a reset and a change of field spelling cannot be differenced: they take
    the sample's own ``last_*`` usage, or yield NULL when it has none. ``last_*`` columns are
    ``last_input`` (new input), ``last_cached``, ``last_cache_write``, ``last_output`` and
    ``last_reasoning``.
    """
    extra = [spelling] if spelling else []
    rows = skip_repeats(df, keys, order, extra, width)
    fresh = F.col("prev").isNull() | counter_reset()
    if spelling:
        fresh = fresh | spelling_changed(spelling)
    rows = rows.withColumn("use_last", F.coalesce(fresh, F.lit(False)))
    steps = delta_columns()
    return rows.withColumns(
        {
            name: F.when(F.col("use_last"), F.col(f"last_{name}")).otherwise(step)
            for name, step in steps.items()
        }
    ).drop("prev")


def same_local_day(a: Column, b: Column, zone: str) -> Column:
    """Both the UTC date and the date in ``zone`` agree."""
    utc = S.local_day(a, "UTC") == S.local_day(b, "UTC")
    return utc & (S.local_day(a, zone) == S.local_day(b, zone)) if zone != "UTC" else utc


def snapshot_ledger(snapshots: DataFrame, zone: str = "UTC", width: int = DAY_MS) -> DataFrame:
    """Session snapshots (running totals seen at ``ts``) to dated usage.

    Copies of one (session, ts) count once. A difference is booked only inside one day; the
    first snapshot counts only when the session was created that same day, else it is just a
    baseline. A late older snapshot needs no special case: the union is recomputed.
    """
    once = snapshots.groupBy("session", "ts").agg(
        F.max(
            F.struct(
                "path", *COUNTERS, "created_at", "model", "project",
            )
        ).alias("_snap")
    ).select("session", "ts", "_snap.*")
    rows = with_previous(once, ["session"], ["ts"], [*COUNTERS, "ts"], "prev", width)
    fell = (
        (F.col("c_input") < F.col("prev.c_input"))
        | (F.col("c_output") < F.col("prev.c_output"))
        | (F.col("c_cache_write") < F.col("prev.c_cache_write"))
    )
    first = F.col("prev").isNull()
    opened_today = F.coalesce(same_local_day(F.col("created_at"), F.col("ts"), zone), F.lit(False))
    booked = F.when(first, opened_today).otherwise(
        ~fell & same_local_day(F.col("prev.ts"), F.col("ts"), zone)
    )
    own = {
        "input": F.col("c_input") - F.col("c_cached"),
        "cached": F.col("c_cached"),
        "cache_write": F.col("c_cache_write"),
        "output": F.col("c_output"),
        "reasoning": F.col("c_reasoning"),
    }
    steps = delta_columns()
    usage = rows.withColumn("_booked", F.coalesce(booked, F.lit(False))).withColumns(
        {
            name: F.when(~F.col("_booked"), _zero()).when(first, own[name]).otherwise(step)
            for name, step in steps.items()
        }
    )
    return usage.select(
        F.concat_ws("|", "session", F.col("ts").cast("string")).alias("id"),
        F.lit(S.CREDIT_AGENT).alias("agent"), "session", "project", "model", "ts",
        *steps, "path", F.lit(0).cast("bigint").alias("line"),
    ).where(S.total_tokens() > 0)
