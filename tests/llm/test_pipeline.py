"""The pipeline's stages one after the other on a small corpus, each held against a plain version."""

import random
from collections import Counter

import corpus_pipeline
from meterline.llm import mixing

from test_near_copies import brute_components, brute_hits, brute_print
from test_placing import fill
from test_quality import brute as brute_quality


def corpus(tmp_path, spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(3, 8)))
    items = [(i, " ".join(word() for _ in range(rng.choice([4, 12, 25])))) for i in range(5)]
    rows = []
    for i in range(220):
        words = [word() for _ in range(rng.randrange(30, 260))]
        if i % 9 == 0:
            at = rng.randrange(len(words))
            words[at:at] = items[i % 5][1].split()
        rows.append((i, " ".join(words), rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src1", None]), 0, "clash"))
    rows += [(300 + i, rows[i * 7][1], "en", "src1", 0, "clash") for i in range(12)] + [rows[40], (400, None, "en", "src0", 0, ""), (401, "", None, None, 0, ""), (None, rows[3][1], "en", "src0", 0, "")]
    folder = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, size string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, items


def test_stages_in_order(spark, tmp_path):
    folder, items = corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "simhash", "decontaminate", "mixing", "sharding"]
    kept = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], folder).write.parquet(f"{tmp_path}/out{i}")
        kept.append(spark.read.parquet(f"{tmp_path}/out{i}"))
    assert all(k.columns == docs.columns for k in kept[:-1])
    whole, good, alone, clean, mixed, placed = [k.collect() for k in kept]
    key = lambda r: (str(r["doc_id"]), r["text"])
    assert Counter(map(key, good)) == Counter(key(r) for r in whole if not brute_quality(r["text"])[-1])
    roots = brute_components([(r["doc_id"], brute_print(r["text"])) for r in good])
    assert sorted(r["doc_id"] for r in alone) == sorted(set(roots))
    texts = {r["doc_id"]: r["text"] for r in alone}
    for r in clean:
        n, hit, _ = brute_hits(texts[r["doc_id"]], items, 10)
        assert len(r["text"].split()) == n - len(hit)
    assert len(clean) == sum(2 * len(brute_hits(t, items, 10)[1]) <= brute_hits(t, items, 10)[0] for t in texts.values())
    sizes, taken = Counter(), Counter()
    for r in clean:
        sizes[r["source"]] += len(r["text"].split())
    for r in mixed:
        taken[r["source"]] += len(r["text"].split())
    for source, target in fill(sizes).items():
        assert abs(taken[source] - target) <= max(mixing.BLOCK, 0.05 * target)
    assert Counter(map(key, placed)) == Counter(map(key, mixed)) and {"shard", "slot", "text_crc32"} <= set(kept[-1].columns)
    assert {r["shard"] for r in placed} <= set(range(24))


def test_run_gives_the_last_stage(spark, tmp_path):
    folder, _ = corpus(tmp_path, spark)
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 100 and out.select("shard", "slot").distinct().count() == out.count()
