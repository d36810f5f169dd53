"""Quality rules whose cutoffs come with a bound on false rejection.

Fixed base rules reject short and self-repeating texts. Beyond them a document is rejected if any
of its signals exceeds the cutoff of its stratum (its language). Cutoffs come from labelled documents,
halved by a hash of the text, so that copies stay on one side:

1. On the first half, level ``t`` proposes as cutoffs the 1 - t quantiles of each signal over the
   documents labelled good.
2. On the second half, for each stratum and level, an exact binomial test takes or leaves the claim that
   more than ``RISK`` of good documents are rejected: p = P(Bin(n, RISK) <= rejected). With
   Bonferroni's correction over all strata and levels, with probability 1 - ``DOUBT`` no certified cutoff
   rejects more than RISK of any stratum's good documents.
3. Of the certified levels a stratum takes the one that, on the first half, rejects the most bad
   documents, each good one counted ten times against it.

A stratum with no certified level (too few labels) rejects by the base rules only.

Defined cases: a null or empty text has no words and fails the base; the null language is a stratum;
null labels don't count and of several labels of a document the lowest does; repeated rows are judged each;
without labels only the base rules reject; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import store
from .common import Rolling, WordHashes

RISK, DOUBT = 0.02, 0.05
LEVELS = (0.0, 0.0005, 0.001, 0.002, 0.004, 0.008, 0.015)
AGAINST = 10
MIN_WORDS = 50
SIGNALS = ("repeats", "symbols", "long_words", "short_words", "same_lines", "capitals", "few_words")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SPACE, _MARKS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"


class Measure:
    """Counts and signals of a text."""

    def __init__(self):
        self.words, self.triples = WordHashes(), Rolling(0x9E3779B97F4A7C15)

    def __call__(self, text: str | None) -> tuple[list[int], list[float]]:
        text = text or ""
        data = text.encode("utf-8", "surrogatepass")
        hashes = self.words.of(data.split())
        n = len(hashes)
        chars = len(text) - (len(data) - len(data.translate(None, _SPACE)))
        symbols = len(data) - len(data.translate(None, _MARKS))
        lines = [x for x in data.split(b"\n") if x.strip(_SPACE)]
        same = len(lines) - len(set(lines))
        _, place, times = np.unique(self.triples.runs(hashes, 3), return_inverse=True, return_counts=True)
        twice = np.flatnonzero(times[place] > 1)
        repeats = len(np.unique(np.concatenate([twice, twice + 1, twice + 2]))) if len(twice) else 0
        letters = sum(map(str.isupper, text))
        some = max(1, n)
        signals = [repeats / some, symbols / max(1, chars), chars / some, -chars / some, same / max(1, len(lines)), letters / max(1, chars), -len(np.unique(hashes)) / some]
        return [n, chars, symbols, same, repeats], signals


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > 50 * n_words)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(doc_id, stratum, half, the counts, signals) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure()
        for batch in batches:
            found = [measure(t) for t in batch.column(3).to_pylist()]
            counts = np.array([c for c, _ in found], np.int64).reshape(-1, len(COUNTS))
            signals = pa.array([s for _, s in found], pa.list_(pa.float64()))
            arrays = [batch.column(0), batch.column(1), batch.column(2), *(pa.array(counts[:, i]) for i in range(len(COUNTS))), signals]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "stratum", "half", *COUNTS, "signals"])

    stratum = F.col(stratum_col).cast("string") if stratum_col in docs.columns else F.lit(None).cast("string")
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(stratum, F.lit("\0")).alias("stratum"), F.pmod(F.xxhash64(text), F.lit(2)).cast("int").alias("half"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, stratum string, half int, " + ", ".join(f"{c} long" for c in COUNTS) + ", signals array<double>")


def p_value(n: int, rejected: int, risk: float) -> float:
    """P(Bin(n, risk) <= rejected), summed from the smallest term."""
    term = n * math.log1p(-risk)
    logs = [term]
    for i in range(1, rejected + 1):
        term += math.log(n - i + 1) - math.log(i) + math.log(risk) - math.log1p(-risk)
        logs.append(term)
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in sorted(logs)))


def _p_values(risk: float):
    @F.pandas_udf("double")
    def run(n: pd.Series, rejected: pd.Series) -> pd.Series:
        return pd.Series([p_value(int(a), int(b), risk) for a, b in zip(n, rejected, strict=True)], dtype=float)

    return run


def exceeds(signals: Column, cutoffs: Column) -> Column:
    return F.exists(F.arrays_zip(signals.alias("x"), cutoffs.alias("c")), lambda z: z["x"] > z["c"])


def certified(measures: DataFrame, labels: DataFrame, risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """(stratum, cutoffs) of each stratum that has a certified level."""
    marks = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") > 0).alias("good"))
    known = measures.where(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).join(marks, "doc_id").select("stratum", "half", "signals", "good")
    probabilities = [1 - t for t in LEVELS]
    signals = [F.percentile_approx(F.col("signals")[i], probabilities, 10_000).alias(f"q{i}") for i in range(len(SIGNALS))]
    quantiles = known.where("half = 0 and good").groupBy("stratum").agg(*signals)
    levels = F.array(*(F.struct(F.lit(k).alias("level"), F.array(*(F.col(f"q{i}")[k] for i in range(len(SIGNALS)))).alias("cutoffs")) for k in range(len(LEVELS))))
    proposed = store(quantiles.select("stratum", F.explode(levels).alias("p")).select("stratum", "p.level", "p.cutoffs"), "quality-cutoffs")
    tests = proposed.count()
    lists = proposed.groupBy("stratum").agg(F.array_sort(F.collect_list(F.struct("level", "cutoffs"))).alias("all"))
    judged = known.join(lists, "stratum").select("stratum", "half", "good", F.explode("all").alias("p"), "signals")
    judged = judged.select("stratum", "p.level", "half", "good", exceeds(F.col("signals"), F.col("p.cutoffs")).alias("out"))
    count = lambda c: F.count(F.when(c, 1))
    out, good, first = F.col("out"), F.col("good"), F.col("half") == 0
    sums = judged.groupBy("stratum", "level").agg(
        count(~first & good).alias("n"), count(~first & good & out).alias("rejected"),
        (count(first & ~good & out) - AGAINST * count(first & good & out)).alias("gain"))
    safe = sums.withColumn("p", _p_values(risk)("n", "rejected")).where(F.col("p") <= doubt / max(1, tests)).where("gain > 0")
    best = F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("gain"), "level"))
    chosen = safe.withColumn("rank", best).where("rank = 1").select("stratum", "level")
    return store(chosen.join(proposed, ["stratum", "level"]).select("stratum", "cutoffs"), "quality-certified")


def judged(measures: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """The measures with base_failed and kept."""
    out = measures.join(cutoffs, "stratum", "left").withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    rejected = F.coalesce(exceeds(F.col("signals"), F.col("cutoffs")), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~rejected)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    measures = store(measured(docs), "quality-measures")
    return judged(measures, certified(measures, labels)).select("doc_id", *COUNTS, "base_failed", "kept")


def filtered(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The documents that are kept, with every column. They are measured a second time where they are read, so no text is shuffled."""
    measures = store(measured(docs, id_col, text_col, stratum_col), "quality-measures")
    cutoffs = certified(measures, labels).select(F.col("stratum").alias("own"), "cutoffs")
    stratum = F.col(stratum_col).cast("string") if stratum_col in docs.columns else F.lit(None).cast("string")
    docs_columns = docs.columns
    at, width = docs_columns.index(text_col), len(docs_columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure()
        for batch in batches:
            keep = []
            for text, cut in zip(batch.column(at).to_pylist(), batch.column(width).to_pylist(), strict=True):
                (n, *_, repeats), signals = measure(text)
                keep.append(n >= MIN_WORDS and 100 * repeats <= 50 * n and not (cut and any(s > c for s, c in zip(signals, cut, strict=True))))
            yield batch.select(range(width)).rename_columns(docs_columns).filter(pa.array(keep, pa.bool_()))

    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(stratum, F.lit("\0")).alias("own"))  # no column can clash
    names = [f"c{i}" for i in range(width)]
    joined = rows.join(cutoffs, "own", "left").select(*(F.col("row")[c].alias(n) for c, n in zip(docs.columns, names, strict=True)), "cutoffs")
    return joined.mapInArrow(run, docs.schema)
