"""Decontamination and SimHash against brute force on small texts, odd rows included."""

import random

import pytest
import xxhash

from meterline.llm import decontaminate, simhash

DOCS = "doc_id long, text string, n_words string, fp string, spans string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    made = [" ".join(rng.choices(words, k=rng.choice([0, 1, 3, 9, 10, 30, 80]))) for _ in range(120)]
    made += [made[5] + " x", made[7], "", None, "Ä ö 12 B-c", " \t\n "]
    return [(i, t, "a", "b", "c") for i, t in enumerate(made)] + [(None, "w1 w2 w3", "a", "b", "c"), (3, made[3], "a", "b", "c")]


def plain_words(text):
    out, word = [], ""
    for ch in (text or "") + " ":
        ch = chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch
        if ord(ch) >= 128 or "0" <= ch <= "9" or "a" <= ch <= "z":
            word += ch
        elif word:
            out.append(word)
            word = ""
    return out


def brute_hits(text, items, window):
    words, hit, names = plain_words(text), set(), set()
    for name, item in items:
        own = plain_words(item)
        size = min(len(own), window)
        grams = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1 if own else 0):
            if tuple(words[i : i + size]) in grams:
                hit |= set(range(i, i + size))
                names.add(name)
    return len(words), hit, names


def test_decontamination_against_brute_force(spark, texts):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choices([f"w{j}" for j in range(12)], k=k))) for i, k in enumerate([2, 3, 4, 4, 5, 7, 9, 12, 20])] + [(50, None), (51, "--"), (52, "W1 w2-W3"), (52, "W1 w2-W3")]
    items += [(60, texts[5][1]), (61, texts[5][1][3:])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(spark.createDataFrame(texts, DOCS), bench, window=4).collect()
    assert len(got) == len(texts)
    by_id = {}
    for row in got:
        by_id.setdefault(row["doc_id"], row)
    import hashlib

    for doc_id, text, *_ in texts:
        n, hit, names = brute_hits(text, [(str(i), t) for i, t in items], 4)
        row = by_id[doc_id]
        assert (row["n_words"], row["n_hit"], row["n_items"], row["contaminated"]) == (n, len(hit), len(names), bool(hit))
        assert row["items_sha256"] == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def test_decontamination_in_blocks_and_cuts(spark, texts, monkeypatch):
    rng = random.Random(2)
    items = [(i, " ".join(rng.choices([f"w{j}" for j in range(12)], k=5))) for i in range(30)]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(texts, DOCS)
    key = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    whole = key(decontaminate.report(docs, bench, window=4).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 23)
    assert key(decontaminate.report(docs, bench, window=4).collect()) == whole
    monkeypatch.undo()
    out = decontaminate.decontaminate(docs, bench, window=4, drop_share=0.5)
    assert out.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in out.collect()}
    for doc_id, text, *_ in texts:
        words, (_, hit, _) = plain_words(text), brute_hits(text, items, 4)
        assert (doc_id in kept) == (2 * len(hit) <= len(words) or not hit)
        if doc_id in kept:
            assert plain_words(kept[doc_id]) == [w for i, w in enumerate(words) if i not in hit]
            assert hit or kept[doc_id] == text


def test_empty_tables(spark, texts):
    docs, none = spark.createDataFrame(texts, DOCS), spark.createDataFrame([], "item_id long, text string")
    assert not decontaminate.report(docs, none).where("contaminated").count()
    assert decontaminate.report(docs.limit(0), none).count() == 0
    assert decontaminate.decontaminate(docs, none).count() == len(texts)
    assert simhash.report(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs.limit(0)).count() == 0


def brute_print(text):
    words = (text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]).lower() for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=4):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(prints):
        for j, (_, b) in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(prints):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [least.get(find(i)) for i in range(len(prints))]


def test_simhash_against_brute_force(spark, texts):
    base = " ".join(f"t{i % 97}x{i}" for i in range(400))
    more = [(1000 + i, base.replace(f"x{i} ", f"y{i} "), "", "", "") for i in range(20)] + [(2000 + i, base, "", "", "") for i in range(5)]
    rows = texts + more
    got = simhash.report(spark.createDataFrame(rows, DOCS)).collect()
    prints = [(r[0], brute_print(r[1])) for r in rows]
    want = sorted((str(i), f"{p:016x}", str(c)) for (i, p), c in zip(prints, brute_components(prints), strict=True))
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == want
    docs = spark.createDataFrame(rows, DOCS)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted({w[2] for w in want})


def test_forest_finds_every_component_in_tight_and_loose_sets():
    import numpy as np

    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 400).astype(np.uint64)
    flips = [np.uint64(0), *(np.uint64(1) << np.uint64(b) for b in (0, 7, 63)), np.uint64(0x1F << 20), np.uint64(0xF << 40)]
    points = np.unique(np.concatenate([seeds ^ f for f in flips]))
    root = list(range(len(points)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in simhash.forest(points, 4):
        assert int(points[a] ^ points[b]).bit_count() <= 4
        root[find(a)] = find(b)
    prints = [(i, int(p)) for i, p in enumerate(points)]
    want = brute_components(prints)
    groups = {}
    for i, c in enumerate(want):
        groups.setdefault(c, set()).add(find(i))
    assert all(len(g) == 1 for g in groups.values()) and len({find(i) for i in range(len(points))}) == len(groups)


def test_long_chains_are_one_component(spark):
    from meterline.llm.components import components

    links = [(i, i + 1) for i in range(70)] + [(1000, 1001), (7000, 7000)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(71)}, 1000: 1000, 1001: 1000}
