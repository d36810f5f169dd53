"""Personal data: patterns against plain regular expressions, and what the field adds."""

import hashlib
import random
import re

import numpy as np

from meterline.llm import pii

SCHEMA = "doc_id long, text string, spans string, n_email string, h string"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, match):
    digits = re.sub(r"[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    spans = [(m.start(), i, m.end()) for i, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if valid(kind, m.group())]
    return sorted(spans)


def card(rng):
    body = "".join(rng.choices("0123456789", k=15))
    return next(body + d for d in "0123456789" if valid("card", body + d))


def made(n):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        words = [rng.choice(["lorem", "ípsum", "a1", "9.", "2.0.", "7", "x@", "@y", "1.2.3.4.5", "a@b.c_d@e.f", "300.1.1.1"]) for _ in range(rng.randrange(25))]
        for _ in range(rng.randrange(4)):
            words.insert(rng.randrange(len(words) + 1), rng.choice([
                f"u{rng.randrange(99)}@mail.example.com", ".".join(str(rng.randrange(256)) for _ in range(4)), card(rng), f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"]))
        rows.append((i, rng.choice([" ", "\n"]).join(words)))
    return rows


def test_patterns_equal_plain_expressions():
    rng = random.Random(1)
    texts = [t for _, t in made(300)] + ["".join(rng.choices("0123456789.@+-() a_", k=60)) for _ in range(3_000)]
    for text in texts:
        assert pii.pattern_spans(text) == brute(text)
        assert pii.tokens(text) == [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text) if re.search("[0-9@]", m.group())]


def test_report_and_added_spans(spark):
    rng = random.Random(5)
    two = f"{card(rng)} {card(rng)}"
    rows = made(400) + [(1_000, None), (1_001, ""), (1_002, f"call +1 (826) 555-4081 190.137.223.204 or {two} now"), (1_003, "no data 2.0. here"), (3, made(4)[3][1]), (None, "1.2.3.4")]
    docs = spark.createDataFrame([(i, t, "", "", "") for i, t in rows], SCHEMA)
    got = {}
    for r in pii.report(docs).collect():
        got.setdefault(r["doc_id"], r)
    for doc_id, text in rows:
        spans, row = brute(text), got[doc_id]
        joined = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans]
        assert row["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == i for s in spans) for i in range(4)]
        every = row["spans"].split(",") if row["spans"] else []
        assert set(joined) <= set(every) and every == sorted(every, key=lambda s: (int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0])))
        for kind, start, end in (s.split(":") for s in set(every) - set(joined)):
            assert valid(kind, text[int(start) : int(end)])
    text = rows[402][1]
    assert {f"phone:5:22", f"card:{text.index(two)}:{text.index(two) + 16}", f"card:{text.index(two) + 17}:{text.index(two) + 33}"} <= set(got[1_002]["spans"].split(","))
    assert got[1_003]["spans"] == "" and len(pii.report(docs.limit(0)).collect()) == 0


def test_skips_pass_labels_to_repeats():
    weights = {"unary": np.zeros((pii.FEATURES, pii.LABELS)), "chain": np.zeros((pii.LABELS,) * 2), "skip": 3 * np.eye(pii.LABELS)}
    graph = pii.Graph("one +12345 far away from 12345 and 777")
    clear = set(graph.unary[0]) - set(graph.unary[1]) - set(graph.unary[2])
    weights["unary"][list(clear), 5] = 9.0
    assert graph.skips == [(0, 1)] and not graph.chain
    assert pii.beliefs(graph, weights).argmax(axis=1)[:2].tolist() == [5, 5]
    assert pii.beliefs(graph, weights)[2].max() < 0.2


def test_belief_propagation_is_exact_on_a_chain():
    rng = np.random.default_rng(1)
    weights = {"unary": rng.normal(size=(pii.FEATURES, pii.LABELS)), "chain": rng.normal(size=(pii.LABELS,) * 2), "skip": np.zeros((pii.LABELS,) * 2)}
    graph = pii.Graph("+1 (234) 567-890")
    local = weights["unary"][np.array(graph.unary)].sum(axis=1)
    joint = np.exp(local[0][:, None, None] + local[1][None, :, None] + local[2][None, None, :] + weights["chain"][:, :, None] + weights["chain"][None, :, :])
    joint /= joint.sum()
    want = np.array([joint.sum(axis=(1, 2)), joint.sum(axis=(0, 2)), joint.sum(axis=(0, 1))])
    assert np.allclose(pii.beliefs(graph, weights), want, atol=1e-3)


def test_long_tokens_take_linear_time():
    for text in ("a" * 200_000 + " x@y.z", "1" * 200_000, "@" * 50_000, "a@" * 50_000, "1." * 50_000):
        pii.pattern_spans(text)
        pii.Graph(text)
