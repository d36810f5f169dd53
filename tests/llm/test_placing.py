"""K-d shards and source mixing: balance, whole results and reruns."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from meterline.llm import kd_shards, mixing

SCHEMA = "doc_id long, text string, source string, lang string, size string, shard string, n_chars int"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choices(["aa", "bbb", "c"], k=rng.randrange(1, 60))), rng.choice(["src0", "src0", "src1", "src2", "é"]), "en", "", "", 1) for i in range(1_500)]
    rows += [(9_000, "long " * 600, "src1", None, "", "", 1), (9_001, None, "src1", "de", "", "", 1), (9_002, "", None, "de", "", "", 1), (9_003, " \t ", "src2", "de", "", "", 1)]
    rows += [(None, "no id here", None, "fr", "", "", 1)] * 3 + [(77, "again and again", "src0", "en", "", "", 1)] * 40
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def size(text):
    return len((text or "").encode()) + 8


def test_shards_hold_near_equal_bytes(docs):
    rows, got = docs.collect(), kd_shards.report(docs, 24).collect()
    assert Counter((str(r["doc_id"]), r["size"]) for r in got) == Counter((str(r["doc_id"]), size(r["text"])) for r in rows)
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r["shard"]].append(r)
    assert sorted(by_shard) == list(range(24))
    mean = sum(r["size"] for r in got) / 24
    light = [sum(r["size"] for r in part) for part in by_shard.values()]
    assert all(abs(b - mean) < 0.4 * mean for b in light)  # one text is more than half a shard
    for part in by_shard.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    again = kd_shards.report(docs.repartition(3), 24).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_a_value_held_by_all_rows_is_split_by_hash(spark):
    docs = spark.range(4_000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    got = kd_shards.assign(docs, 8, dims=[F.lit(3).cast("long"), F.lit(None).cast("long")]).groupBy("shard").count().collect()
    assert len(got) == 8 and all(abs(r["count"] - 500) < 25 for r in got)


def test_sharding_keeps_columns_and_takes_empty_tables(docs):
    out = kd_shards.assign(docs, 3)
    assert {"doc_id", "text", "n_chars", "shard", "slot", "size"} <= set(out.columns) and out.count() == docs.count()
    assert kd_shards.report(docs.limit(0)).count() == 0


def fill(sizes, share=1.5, cap=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > cap * sizes[s]}
        if not over:
            return target | {s: unit * weight[s] for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix_meets_its_targets(docs):
    rows, got = docs.collect(), mixing.report(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len((r["text"] or "").split())
    target = fill(sizes)
    want = Counter((str(r["doc_id"]), len((r["text"] or "").split()), sizes[r["source"]], round(target[r["source"]], 3)) for r in rows)
    assert Counter((str(r["doc_id"]), r["size"], r["source_size"], round(r["target"], 3)) for r in got) == want
    taken, kind = Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source_size"]] += r["taken"]
        kind[r["source_size"]] = r["target"]
    for s, n in taken.items():
        assert abs(n - kind[s]) <= max(mixing.BLOCK, 0.02 * kind[s])
    assert Counter(map(tuple, mixing.report(docs.repartition(3)).collect())) == Counter(map(tuple, got))


def test_mixed_documents_hold_the_words_taken(docs):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        assert r["n_chars"] == len(r["text"])
        words[str(r["doc_id"])] += len(r["text"].split())
    taken = Counter()
    for r in mixing.report(docs).collect():
        taken[str(r["doc_id"])] += r["taken"]
    assert words == +taken


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1_001])
def test_permutation_is_a_bijection(spark, n):
    got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("p")).collect()
    assert sorted(r["p"] for r in got) == list(range(n))


def test_mixing_nothing(docs):
    assert mixing.report(docs.limit(0)).count() == 0
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert mixing.report(docs.where("doc_id in (9001, 9002)")).where("taken > 0 or target > 0").count() == 0


def test_water_level_by_hand(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10_000), ("c", 5_000), (None, 1_000)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    want = fill({"a": 100, "b": 10_000, "c": 5_000, None: 1_000})
    assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in want.items()}
