"""Token groups and link counts of two tokenizers, against a plain version."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from meterline.llm import alignment

pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, chunk string, pairs string, kind string, n_a string"


def plain(rows):
    """The contract, token by token."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    paths = alignment.default_tokenizers()
    a_model, b_model = Tokenizer.from_file(paths[0]), SentencePieceProcessor(model_file=paths[1])
    a_model.encode_special_tokens = True
    spell_a, spell_b = alignment.ByteLevel(paths[0]).spelled, alignment.Pieces(paths[1]).spelled
    parts, counts = [], Counter()
    for doc_id, text in rows:
        a = a_model.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        data = f" {text}".encode()
        if b"".join(spell_a[i] for i in a) != data or b"".join(spell_b[i] for i in b) != data:
            a = b = []
        spans = []
        for ids, spell in ((a, spell_a), (b, spell_b)):
            at, side = 0, []
            for i in ids:
                side.append((at, at + len(spell[i]), i))
                at += len(spell[i])
            spans.append(side)
        links = [(x, y) for s, e, x in spans[0] for t, f, y in spans[1] if max(s, t) < min(e, f)] if len(a) < 400 else list(merged(*spans))
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = [",".join(str(i) for s, e, i in spans[0] if lo < e <= hi) + "|" + ",".join(str(i) for s, e, i in spans[1] if lo < e <= hi) for lo, hi in zip([0, *cuts], cuts)] if len(a) < 400 else None
        counts.update(links)
        parts.append((doc_id, len(a), len(b), len(cuts), links, groups))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    for doc_id, n_a, n_b, n_groups, links, groups in parts:
        sha = None if groups is None else hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else ""
        yield doc_id, n_a, n_b, n_groups, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), sha


def merged(a, b):
    i = j = 0
    while i < len(a) and j < len(b):
        yield a[i][2], b[j][2]
        end = min(a[i][1], b[j][1])
        i, j = i + (a[i][1] == end), j + (b[j][1] == end)


def odd_rows():
    rng = random.Random(8)
    pieces = ["hello", " world", "the ", "Straße", "  ", "\n\n", "\t", "12345", "中文", "😀", "<|endoftext|>", "</s>", "<0x41>", "▁", "é", "é", "x" * 30, "'ll", "ﬁ", "\x00", "​"]
    rows = [(rng.randrange(10**9), "".join(rng.choices(pieces, k=rng.randrange(25)))) for _ in range(150)]
    return rows + [(None, None), (1, ""), (2, " "), (3, "a"), (3, "a"), (None, "a b"), (4, "lorem ipsum " * 3_000), (5, "y" * 9_000)]


@pytest.mark.parametrize("entries, pairs", [(4_000_000, 500_000), (100, 500_000), (4_000_000, 40)])
def test_report_against_plain_version(spark, monkeypatch, entries, pairs):
    monkeypatch.setattr(alignment, "BATCH", 7)
    monkeypatch.setattr(alignment, "CHUNK_ENTRIES", entries)
    monkeypatch.setattr(alignment, "CHUNK_PAIRS", pairs)
    rows = odd_rows()
    got = [tuple(r) for r in alignment.report(spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)).collect()]
    want = [*plain(rows)]
    shas = {(w[0], w[1]) for w in want if w[7] is None}
    got = [(*g[:7], None if (g[0], g[1]) in shas and g[1] >= 400 else g[7]) for g in got]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_pair_counts(spark):
    rows = [(i, t) for i, t in enumerate(["the cat sat", "the cat", "a the\nthe"] * 5)]
    table = alignment.encoded(spark.createDataFrame(rows, "doc_id long, text string"))
    got = alignment.pair_counts(table).collect()
    assert sum(r["count"] for r in got) == sum(w[4] for w in plain(rows))
    most = defaultdict(int)
    for r in got:
        most[r["b_id"]] = max(most[r["b_id"]], r["count"])
    assert all(r["best"] == (r["count"] == most[r["b_id"]]) for r in got)


def test_groups_by_halving_are_the_shared_ends():
    rng = np.random.default_rng(4)
    for trial in range(300):
        sizes = rng.integers(0, 60, rng.integers(1, 5))
        a_ends, b_ends, a_cuts, b_cuts, at = [], [], [0], [0], 0
        for n in sizes:
            for ends, cuts in ((a_ends, a_cuts), (b_ends, b_cuts)):
                inner = rng.choice(n, rng.integers(0, n), replace=False) + 1 if n > 1 else np.empty(0, int)
                ends += sorted({*(at + inner).tolist(), *([at + int(n)] if n else [])})
                cuts.append(len(ends))
            at += int(n)
        a, b = alignment.shared_groups(*(np.array(x, np.int64) for x in (a_ends, b_ends, a_cuts, b_cuts)))
        shared = sorted({*a_ends} & {*b_ends})
        assert len(a) == len(shared)
        ends = ([*a[1:], len(a_ends)], [*b[1:], len(b_ends)]) if shared else ([], [])
        assert [a_ends[i - 1] for i in ends[0]] == [b_ends[i - 1] for i in ends[1]] == shared


def test_common_letters_encode_as_by_the_tokenizer():
    model, rng = alignment.ByteLevel(alignment.default_tokenizers()[0]), random.Random(3)
    assert model.ranked is not None
    every = [chr(c) for c in range(0x250)]
    pieces = [*every, *"aeiou  \n\t'", "'ll", "'S", "  \n ", "\u00a0", "\x85", "\x1c", "²", "ª", "the", " and", "<|endoftext|>"] + ["e"] * 300 + [" "] * 200
    texts = ["".join(rng.choices(pieces, k=rng.randrange(60))) for _ in range(5_000)] + [f"a{c}b {c}{c} 1{c}'s" for c in every]
    assert not any(map(alignment._UNCOMMON.search, texts))
    assert model.encode(texts) == model._encode([f" {t}" for t in texts])
    assert model.encode(["中文 a", "a", "\u0250"]) == model._encode([" 中文 a", " a", " \u0250"])


def test_no_documents(spark):
    assert alignment.report(spark.createDataFrame([], SCHEMA)).count() == 0
