"""Quality rules: counts against brute force, the binomial test, and the bound on held-out documents."""

import random
from math import comb

from meterline.llm import quality

SCHEMA = "doc_id long, text string, lang string, kept string, signals string, stratum string"


def brute(text):
    text = text or ""
    words = text.encode().split()
    decoded = [w.decode() for w in words]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    grams = {}
    for i in range(len(words) - 2):
        grams.setdefault(tuple(words[i : i + 3]), []).append(i)
    marks = {j for at in grams.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    n = len(words)
    return n, sum(map(len, decoded)), sum(c in "#*$%&|<>" for c in text), dup, len(marks), n < 50 or 100 * len(marks) > 50 * n


def made(n, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(["en", "en", "de", None])
        words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 8))) for _ in range(rng.randrange(60, 120))]
        bad = rng.random() < 0.2
        if bad:
            words = [w + rng.choice(["###", "|", "$$"]) for w in words]
        rows.append((i, " ".join(words) + rng.choice(["", "\nsame\nsame", "\n \n"]), lang, "", "", ""))
        if rng.random() < 0.8:
            labels.append((i, 0 if bad else 1))
    return rows, labels


ODD = [(90_000, None, "en"), (90_001, "", None), (90_002, "x " * 80, "en"), (90_003, "Ä b " * 60, "xx"), (90_004, " \n\n \t", "de"), (None, "a b c " * 30 + "#", "en"), (3, "repeat " * 70, "en")]


def test_counts_and_bound(spark):
    rows, labels = made(6_000)
    rows += [(*r, "", "", "") for r in ODD]
    labels += [(90_002, None), (90_003, 1), (90_003, 0)]
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {}
    for r in quality.report(docs, marks).collect():
        got.setdefault((r["doc_id"], r["n_words"], r["word_chars"]), r)
    good = bad = lost = caught = 0
    for doc_id, text, lang, *_ in rows:
        n, chars, symbols, dup, rep, failed = brute(text)
        r = got[doc_id, n, chars]
        assert (r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (symbols, dup, rep, failed)
        assert not (r["kept"] and failed)
        if not failed and doc_id is not None and doc_id < 6_000 and lang == "en":
            bad, caught, good, lost = bad + (symbols > 20), caught + (symbols > 20 and not r["kept"]), good + (symbols <= 20), lost + (symbols <= 20 and not r["kept"])
    assert caught > 0.95 * bad and lost <= quality.RISK * good
    out = quality.filtered(docs, marks)
    assert out.columns == docs.columns
    assert out.count() == sum(quality.report(docs, marks).select(quality.F.col("kept").cast("int")).toPandas()["kept"])


def test_few_labels_certify_nothing(spark):
    rows, labels = made(100)
    docs = spark.createDataFrame(rows, SCHEMA)
    for some in (labels[:20], []):
        marks = spark.createDataFrame(some, "doc_id long, quality int")
        assert all(r["kept"] != r["base_failed"] for r in quality.report(docs, marks).collect())
    assert quality.report(docs.limit(0), marks).count() == 0


def test_binomial_tail_is_exact():
    for n, k, p in ((10, 0, 0.3), (50, 3, 0.1), (400, 2, 0.02), (5, 5, 0.5)):
        want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(quality.p_value(n, k, p) - want) < 1e-12
    assert quality.p_value(0, 0, 0.02) == 1.0
