"""Ordered operators (previous row, carry forward, running sum) that survive a hot key.

A plain window puts one key's whole history into one task. Here the order axis is cut into
slices of fixed width, every (key, slice) is scanned on its own, and each slice receives what
the earlier slices of its key left behind, as a row before its first. That carry is computed from one small
summary row per (key, slice), pre-aggregated on the map side, so no task ever sees more than a slice.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

DAY_MS = 86_400_000
LINES_PER_SLICE = 100_000
_SLICE, _OWN = "_slice", "_own"


def _order(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def _sliced(df: DataFrame, order: Sequence[str], width: int) -> DataFrame:
    at = order[0]
    return df.withColumn(_SLICE, F.expr(f"({at} - pmod({at}, {width})) div {width}"))


def _within(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys, _SLICE).orderBy(_OWN, *order)


def _opened(rows: DataFrame, carry: DataFrame) -> DataFrame:
    """The rows, and before the first of a slice a row with what earlier slices left behind.

    So a slice's scan begins with its carry, and rows are shuffled and sorted once, without a join. A null key is a key like
    any other. :func:`_closed` takes the extra rows out.
    """
    return rows.withColumn(_OWN, F.lit(True)).unionByName(carry.withColumn(_OWN, F.lit(False)), allowMissingColumns=True)


def _closed(rows: DataFrame) -> DataFrame:
    return rows.where(_OWN).drop(_OWN, _SLICE)


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str],
    out: str = "prev", width: int = DAY_MS,
) -> DataFrame:
    """Adds ``out``: a struct of ``columns`` from the preceding row of the key, NULL on the first."""
    rows = _sliced(df, order, width)
    packed = F.struct(*columns)
    last = rows.groupBy(*keys, _SLICE).agg(F.max_by(packed, _order(order)).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy(_SLICE)
    carry = last.select(*keys, _SLICE, F.lag("_last").over(earlier).alias("_packed")).where("_packed IS NOT NULL")
    seen = _opened(rows.withColumn("_packed", packed), carry)
    return _closed(seen.withColumn(out, F.lag("_packed").over(_within(keys, order))).drop("_packed"))


def with_carried(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, Column],
    width: int = DAY_MS,
) -> DataFrame:
    """Adds one column per entry: the latest non-null value up to and including the row."""
    names = list(columns)
    rows = _sliced(df.withColumns({f"_v_{n}": e for n, e in columns.items()}), order, width)
    at = _order(order)
    last = rows.groupBy(*keys, _SLICE).agg(
        *[
            F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), at)).alias(f"_l_{n}")
            for n in names
        ]
    )
    earlier = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(
        *keys, _SLICE, *[F.last(f"_l_{n}", ignorenulls=True).over(earlier).alias(f"_v_{n}") for n in names]
    ).where(reduce(lambda a, b: a | b, [F.col(f"_v_{n}").isNotNull() for n in names]))
    so_far = _within(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    found = _opened(rows, carry).withColumns({f"_w_{n}": F.last(f"_v_{n}", ignorenulls=True).over(so_far) for n in names})
    return _closed(found).drop(*[f"_v_{n}" for n in names]).withColumns({n: F.col(f"_w_{n}") for n in names}).drop(*[f"_w_{n}" for n in names])


def with_running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, Column],
    width: int = DAY_MS,
) -> DataFrame:
    """Adds one inclusive running sum per entry."""
    names = list(columns)
    rows = _sliced(df.withColumns({f"_v_{n}": e for n, e in columns.items()}), order, width)
    sums = rows.groupBy(*keys, _SLICE).agg(*[F.sum(f"_v_{n}").alias(f"_l_{n}") for n in names])
    earlier = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(
        *keys, _SLICE, *[F.sum(f"_l_{n}").over(earlier).alias(f"_v_{n}") for n in names]
    ).where(reduce(lambda a, b: a | b, [F.col(f"_v_{n}").isNotNull() for n in names]))
    so_far = _within(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    found = _opened(rows, carry).withColumns({f"_w_{n}": F.sum(f"_v_{n}").over(so_far) for n in names})
    return _closed(found).drop(*[f"_v_{n}" for n in names]).withColumns({n: F.col(f"_w_{n}") for n in names}).drop(*[f"_w_{n}" for n in names])


def change_points(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, width: int = DAY_MS
) -> DataFrame:
    """Rows whose ``column`` differs from the preceding row of the key; the first row stays."""
    seen = with_previous(df, keys, order, [column], "_prev", width)
    same = F.col("_prev").isNotNull() & F.col(f"_prev.{column}").eqNullSafe(F.col(column))
    return seen.where(~same).drop("_prev")


def with_run_id(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, out: str = "run",
    width: int = DAY_MS,
) -> DataFrame:
    """Numbers runs of equal neighbours (gaps and islands), from 1 per key."""
    seen = with_previous(df, keys, order, [column], "_prev", width)
    starts = F.col("_prev").isNull() | ~F.col(f"_prev.{column}").eqNullSafe(F.col(column))
    return with_running_sum(seen, keys, order, {out: starts.cast("bigint")}, width).drop("_prev")
