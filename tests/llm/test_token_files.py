"""Token files: round trip, the perfect hash and foreign keys."""

import random
import zlib

import numpy as np
import pytest

from meterline.llm import token_files

pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, start string, n_tokens string, part string"


def test_round_trip_against_direct_encoding(spark, monkeypatch, tmp_path):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "FILE_IDS", 200)
    rng = random.Random(3)
    rows = [(rng.randrange(10**12), " ".join(rng.choices(["Alpha", "béta", "12", "x<|endoftext|>y", "中"], k=rng.randrange(30)))) for _ in range(150)]
    rows += [(5, None), (6, ""), (7, "long " * 3_000), (8, "twice"), (8, "twice"), (None, "none")]
    docs = spark.createDataFrame([(i, t, "x", "x", "x") for i, t in rows], SCHEMA)
    got = sorted(token_files.report(docs).collect(), key=lambda r: r["start"])
    tokenizer = Tokenizer.from_file(token_files.default_tokenizer())
    at = 0
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    for row, (_, text) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1_000, 20_000])
def test_perfect_hash_is_minimal_and_turns_foreign_keys_away(n):
    keys = [(i * 7, 0) for i in range(n)]
    lengths = np.arange(n, dtype=np.int64) % 5
    index = token_files.TokenIndex(token_files.index_bytes(keys, lengths))
    first, second = token_files.key_hashes(keys)
    assert sorted(index.table.slots(first, second).tolist()) == list(range(n)) if n else True
    offsets = np.cumsum(lengths) - lengths
    assert index.find(keys) == [(int(o), int(s)) for o, s in zip(offsets, lengths)]
    assert index.keys == keys
    assert index.find([(i * 7 + 1, 0) for i in range(100)]) == [None] * 100


def test_words_encode_like_whole_texts():
    path, rng = token_files.default_tokenizer(), random.Random(2)
    letters = "aAbZ 'sS\t\n\x0b\r\x1c\x85\u2003\u0301İΣςÉé中ㄱ😀12<|>endoftext"
    texts = ["".join(rng.choices(letters, k=rng.randrange(20))) + rng.choice(["", "<|endoftext|>", " <|startoftext|>x"]) for _ in range(4_000)] + [None, ""]
    assert token_files.Encoder(path, 2, True)(texts) == token_files.Encoder(path, 2, False)(texts)
    assert token_files.Encoder(path, 70_000, True).kind == "<u4"


def test_lots_are_bounded_and_encode_like_single_texts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_files, "LOT_BYTES", 50)
    texts = ["one two", None, "", " three\tthree ", "long " * 40, "é x", *["two one"] * 30]
    lots = list(token_files.lots(pa.array(texts, pa.string())))
    assert [i for a, b in lots for i in range(a, b)] == list(range(len(texts)))
    assert all(b == a + 1 or sum(len((t or "").encode()) for t in texts[a:b]) <= 50 for a, b in lots)
    encode, plain = token_files.Encoder(token_files.default_tokenizer(), 2, True), token_files.Encoder(token_files.default_tokenizer(), 2, False)
    assert [ids for a, b in lots for ids in encode(pa.array(texts, pa.string()).slice(a, b - a))] == plain(texts)
    assert list(token_files.lots(pa.array([], pa.string()))) == []


def test_no_documents(spark):
    assert token_files.report(spark.createDataFrame([], SCHEMA)).count() == 0
