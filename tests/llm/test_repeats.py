"""Removal of repeated windows against brute force."""

import hashlib
import random

from meterline.llm import repeats

SCHEMA = "doc_id long, text string, anchor string, a string, kept string, names string"


def brute(rows, window):
    words = [((t or "").encode().split()) for _, t in rows]
    first = {}
    for (doc_id, _), w in zip(rows, words):
        for i in range(len(w) - window + 1):
            if doc_id is not None:
                key = tuple(w[i : i + window])
                first[key] = min(doc_id, first.get(key, doc_id))
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if doc_id is not None and first[tuple(w[i : i + window])] < doc_id:
                gone |= set(range(i, i + window))
        left = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(doc_id), len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out)


def made(seed, docs, vocabulary):
    rng = random.Random(seed)
    passages = [[f"p{rng.randrange(vocabulary)}é" for _ in range(rng.choice([6, 12, 13, 14, 40, 90]))] for _ in range(8)]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(rng.randrange(6)):
            part = rng.choice(passages)
            cut = rng.randrange(len(part))
            words += rng.choice([part, part[cut:], part[:cut], [f"w{rng.randrange(vocabulary)}" for _ in range(9)]])
        rows.append((i * 3 % 101, rng.choice([" ", "\n", " \t"]).join(words)))
    return rows


def check(spark, rows, window, gram):
    docs = spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in rows], SCHEMA)
    got = repeats.without_repeats(docs, window, gram, digest=True).collect()
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in got) == brute(rows, window)
    kept = {(str(r[0]), hashlib.sha256(r[3].encode()).hexdigest()) for r in repeats.without_repeats(docs, window, gram).collect()}
    assert kept == {(r[0], r[3]) for r in brute(rows, window)}


def test_windows_of_thirteen_with_odd_rows(spark):
    rows = made(1, 90, 400) + [(None, "p1é " * 30), (200, None), (201, ""), (202, " \n "), (0, made(1, 1, 400)[0][1]), (203, "same " * 50), (204, "same " * 20), (205, "u v " * 15), (206, "u v " * 15)]
    check(spark, rows, 13, 5)


def test_short_windows_over_few_words(spark):
    check(spark, made(4, 60, 6), 4, 2)


def test_one_automaton_per_document_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(repeats, "AUTOMATON_CHARS", 1)
    check(spark, made(7, 50, 30), 13, 5)


def test_no_documents(spark):
    assert repeats.report(spark.createDataFrame([], SCHEMA)).count() == 0
