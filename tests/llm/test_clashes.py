"""Stages on tables whose columns bear the names that operators use inside, on ids over all 64 bits, and slots in numbers."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meterline.llm import kd_shards, mixing

CLASHING = ("s", "row", "id", "hash", "own", "text_hash", "cutoffs", "__tie", "__chunk", "__taken", "__turn", "__stratum", "__keep_id", "__size", "tie", "chunk", "rank", "turn")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(55, 90))), "en", rng.choice(["a", "b", None]), 5) for i in range(200)]
    frame = spark.createDataFrame([*rows, (900, rows[3][1], "en", "a", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    return frame.select("*", *(F.concat(F.lit(f"{c}-"), "doc_id").alias(c) for c in CLASHING))


def test_every_stage_keeps_clashing_columns(spark, docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "none of these words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        assert set(docs.columns) <= set(at.columns), name
        got = at.select("doc_id", *CLASHING).distinct().collect()
        assert got and all(r[c] == f"{c}-{r['doc_id']}" for r in got for c in CLASHING), name
    assert 900 not in {r["doc_id"] for r in got}


def test_ids_over_all_64_bits(spark):
    rng = random.Random(6)
    ids = [-(2**63), 2**63 - 1, *(rng.randrange(-(2**63), 2**63) for _ in range(3_000))]
    docs = spark.createDataFrame([(i, "text") for i in ids], "doc_id long, text string")
    got = kd_shards.report(docs, 8).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(ids)
    assert all(abs(n - len(ids) / 8) < 0.1 * len(ids) for n in Counter(r["shard"] for r in got).values())


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_slots_come_from_numbers_not_arrays(spark):
    big = spark.createDataFrame([("a", 0, 10**11, 5.0, 1.5e11, 781_250_000), ("b", 1, 10**9, 2.0, 2e9, 7_812_500)], "source string, s int, source_size long, weight double, target double, blocks long")
    small = big.withColumns({"source_size": F.col("source_size") / 10**6, "target": F.col("target") / 10**6}).withColumn("blocks", F.expr("(cast(source_size as long) + 127) div 128")).withColumn("source_size", F.col("source_size").cast("long"))
    assert "sequence(lo" not in plan_of(mixing.slots(small))
    got = mixing.slots(small).collect()
    by_source = {s: sorted(r["slot"] for r in got if r["s"] == s) for s in (0, 1)}
    assert all(v == list(range(len(v))) for v in by_source.values())
    assert Counter(r["s"] for r in got) == {0: 1_173, 1: 16}
    times = Counter((r["s"], r["block"]) for r in got)
    assert max(times.values()) - min(times[0, b] for b in range(782)) <= 1


def test_a_task_takes_a_bounded_number_of_slots(spark):
    assert mixing.numbers(spark, 10**9).rdd.getNumPartitions() == 250
