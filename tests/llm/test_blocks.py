"""Decontamination gives the same texts however the benchmark is cut into blocks."""

import random

from meterline.llm import decontaminate

from test_near_copies import brute_hits, plain_words


def test_cuts_and_drops_do_not_depend_on_blocks(spark, monkeypatch):
    words = [f"u{i}" for i in range(100)]
    items = [(0, " ".join(words[:9])), (1, " ".join(words[9:14])), (2, " ".join(words[30:36])), (3, " ".join(words[33:39])), (4, "u50 u53 u54 u55 u56"), (5, " ".join(words[51:57]))]
    rng = random.Random(6)
    items += [(10 + i, " ".join(rng.choices(["x", "y", "z"], k=5))) for i in range(12)]
    docs = [
        (1, " ".join(words[:20]), "s"),  # 9 of 20 words in one block and 5 in the next
        (2, " ".join(words[20:60]), "s"),  # windows of two blocks overlap
        (3, "u50 " + " ".join(words[30:36]) + " u53 u54 u55 u56 " + " ".join(words[60:90]), "s"),  # a cut joins an item that was not there
        (4, None, "s"), (5, "", "s"), (None, "a b c", "s"),
        *((100 + i, " ".join(rng.choices(["x", "y", "z", "a"], k=40)), "s") for i in range(30)),
    ]
    table, bench = spark.createDataFrame(docs, "doc_id long, text string, __spans string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (8, 15, 1_000_000):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", size)
        out = decontaminate.decontaminate(table, bench, window=4, drop_share=0.5)
        assert out.schema == table.schema
        kept = {r["doc_id"]: r["text"] for r in out.collect()}
        for doc_id, text, _ in docs:
            n, hit, _ = brute_hits(text, items, 4)
            assert (doc_id in kept) == (2 * len(hit) <= n), (size, doc_id)
            if doc_id in kept:
                assert plain_words(kept[doc_id]) == [w for i, w in enumerate(plain_words(text)) if i not in hit], (size, doc_id)
                assert hit or kept[doc_id] == text
    assert 1 not in kept and 2 in kept and 3 in kept
