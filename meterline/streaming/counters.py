"""Running totals as a keyed stateful operator: Spark's state store holds the last sample of every path."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.counters import COUNTERS

TOKENS = ("input", "cached", "cache_write", "output", "reasoning")


NUMBERS, USAGE = "a sample's numbers", "a sample's usage"
"""Columns of text that hold comma-separated numbers (none for null): totals, spelling and own usage; and the usage found.
Every value that crosses to Python and back as a column of its own costs more than the differences do."""


def usage_of(samples: Iterable[tuple[Row, list]], last: tuple | None, spelling: bool = False) -> Iterator[tuple[Row, tuple, tuple]]:
    """(sample, its usage, what to keep of it) for one path's samples (row, numbers) in order, by the batch operator's rules: repeats go;
    the first sample, a reset and a change of spelling take the sample's own usage, all others the clamped difference.
    ``last`` is what was kept of the sample before."""
    width = len(COUNTERS) + spelling
    whole, made = COUNTERS.index("c_input"), COUNTERS.index("c_output")
    fell = lambda now, then: now is not None and then is not None and now < then
    step = lambda now, then: max(now - then, 0) if now is not None and then is not None else 0
    last = None if last is None else tuple(last)
    for row, numbers in samples:
        now = tuple(numbers[:width])
        if last is not None and now == last:
            continue
        own = last is None or fell(now[whole], last[whole]) or fell(now[made], last[made])
        if spelling and not own:
            a, b = now[-1], last[-1]
            own = a is not None and b is not None and 1 <= a <= 3 and 1 <= b <= 3 and a != b
        if own:
            usage = tuple(numbers[width:])
        else:
            total, cached, written, output, reasoning = (step(x, y) for x, y in zip(now, last[: len(COUNTERS)]))
            cached = min(cached, total)
            usage = (total - cached, cached, written, output, reasoning)
        last = now
        yield row, usage, now


def _numbers(text: str) -> list:
    return [int(x) if x else None for x in text.split(",")]


class Differences(StatefulProcessor):
    """Usage per sample. A path's rows of one micro-batch are put in order of their line, which the trigger's size bounds;
    state is one row a path, kept by the state store with its change log, so a batch costs what its rows cost."""

    def __init__(self, others: list[str], state: str, spelling: bool):
        self.others, self.state, self.spelling = others, state, spelling

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.state)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        made, kept = Row(*self.others, NUMBERS, USAGE), None
        ordered = sorted(rows, key=lambda r: r["line"])
        for row, usage, kept in usage_of(((r, _numbers(r[NUMBERS])) for r in ordered), self.last.get(), self.spelling):
            if usage[0] is not None:
                yield made(*(row[n] for n in self.others), row[NUMBERS], ",".join("" if n is None else str(n) for n in usage))
        if kept is not None:
            self.last.update(kept)

    def close(self) -> None:
        pass
