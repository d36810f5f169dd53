"""Spelling variants against brute force, with leaves small enough for deep trees and split anagrams."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from meterline.llm import spelling

SCHEMA = "doc_id long, text string, word string, n string, length string, node string"


def edits(a, b):
    """Whether exactly one code point is put in, taken out or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def plain(words):
    rows = {}
    for w, n in words.items():
        near = [x for x in words if abs(len(x) - len(w)) < 2 and edits(w, x)]
        form = min(near, key=lambda x: (-words[x], x), default=None)
        form = form if form and words[form] >= 5 * n else None
        rows[w] = (form, n, len(near), words.get(form))
    out = []
    for w, (form, n, near, form_n) in rows.items():
        root = w
        while rows[root][0]:
            root = rows[root][0]
        out.append((w, form, root, n, near, form_n))
    return sorted(out, key=repr)


def odd_rows(rng):
    letters = "abcéÿ×ß"
    stems = ["".join(rng.choices(letters, k=rng.randrange(6, 10))) for _ in range(25)]
    stems += ["".join(p) for p in itertools.islice(itertools.permutations("abcdef"), 90)] + ["abcdeg", "abcde", "abcdeff"]
    rows = []
    for k in range(400):
        words = []
        for stem in rng.choices(stems, k=30):
            if rng.random() < 0.3:
                at = rng.randrange(len(stem))
                stem = stem[:at] + rng.choice(["", rng.choice(letters), stem[at] + rng.choice(letters)]) + stem[at + 1 :]
            words.append(rng.choice([stem, stem.upper(), stem.capitalize()]))
        rows.append((rng.randrange(10**9) - 1000, rng.choice([" ", ", ", "中", "1"]).join(words)))
    long = "z" * 3_000
    rows.append((8, "éé×ßcc " * 6 + "éé×ßcd " * 40 + "éé×ßdd " * 300))
    return rows + [(None, None), (None, "abcdef " * 7), (1, ""), (2, "Éabcdef \U0001f600abcdef"), (2, "Éabcdef \U0001f600abcdef")] + [(i, f"{long} {long}y") for i in range(9)]


@pytest.mark.parametrize("leaf, few", [(None, 64), (40, 64), (5, 1)])
def test_report_against_brute_force(spark, monkeypatch, leaf, few):
    monkeypatch.setattr(spelling, "FEW", few)
    monkeypatch.setattr(spelling, "BUCKET", 3)
    monkeypatch.setattr(spelling, "BATCH", 50)
    monkeypatch.setattr(spelling, "VOCABULARY", 20)
    rows = odd_rows(random.Random(12))
    want = plain(plain_words(rows))
    assert any(r[1] != r[2] and r[1] for r in want) and any(r[4] > 1 for r in want)
    got = spelling.report(spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA), leaf)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_trees_have_small_leaves_and_split_anagrams(spark):
    words = ["".join(p) for p in itertools.islice(itertools.permutations("abcdefg"), 300)] + ["".join(p) for p in itertools.product("xyz", repeat=7)]
    frame = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    cuts, parts = spelling.grow(frame, 100)
    tree = spelling._trees(cuts)[7]
    ((_, rows, vectors),) = spelling._by_length(words)
    sizes = {node: len(found) for node, found in spelling.reached(tree, vectors, False, False)}
    assert sum(sizes.values()) == len(words) and all(n <= 100 * parts.get((7, node), 1) for node, n in sizes.items())
    assert 3 in parts.values()


def test_every_vector_within_reach_is_reached():
    rng = np.random.default_rng(1)
    words = sorted({bytes(w) for w in rng.choice(list(b"abcd"), (400, 7)).astype(np.uint8)})
    leaf = spelling.Leaf(words, [1] * len(words))
    for other in (6, 7, 8):
        queries = [bytes(w) for w in rng.choice(list(b"abcde"), (60, other)).astype(np.uint8)]
        q, w = leaf.near(queries)
        got = sorted(zip(q.tolist(), w.tolist()))
        assert got == [(i, j) for i, a in enumerate(queries) for j, b in enumerate(leaf.words) if edits(a.decode(), b.decode())]


def test_roots_of_a_long_chain(spark):
    forms = spark.createDataFrame([(f"w{i:03}", f"w{i + 1:03}") for i in range(100)], "word string, form string")
    assert {tuple(r) for r in spelling.roots(forms).collect()} == {(f"w{i:03}", "w100") for i in range(100)}


def test_no_documents(spark):
    assert spelling.report(spark.createDataFrame([], SCHEMA)).count() == 0
