"""Personal data: fixed patterns, and a skip-chain conditional random field that adds to them.

The field's nodes are a document's tokens that can belong to an entity, those with a digit or
an ``@``; all others are outside by definition. Neighbouring nodes are linked (the chain), and so are
nodes that repeat the same digits or the same letters anywhere in the document (the skips, each to the last
occurrence before it, so their number is linear). Both kinds of link carry potentials, and loopy
belief propagation passes messages along both, which lets a clear mention decide for an unclear repeat.
It finds what the patterns lose: entities that run into one another, or into further digits.

Training: the patterns label the tokens of at most ``SAMPLE`` documents, the ones of least hash among those
with a digit or an ``@``. The weights (of features, chain and skips) maximise the pseudo-likelihood, in one
task on that bounded sample. An added span must be well-formed for its kind and clear of pattern spans.

Defined cases: null and empty texts have no spans; repeated rows each get theirs; no documents, or none to
learn from, leave the patterns alone; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import ids_and_texts

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 4_000
FEATURES = 1_024
LABELS = 1 + 2 * len(KINDS)
ROUNDS, DAMPING = 12, 0.3
SURE = 0.6
STEPS, RATE, SHRINK = 300, 0.1, 1e-3

_LOCAL, _DOMAIN = re.compile(r"[A-Za-z0-9._%+-]"), re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a digit run that fails at its start fails everywhere
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[+(]?[0-9][\x20().0-9-]*[0-9]")
_CAPABLE, _END, _DIGITS = re.compile(r"[0-9@]"), re.compile(r"[\x20\x09-\x0D]"), re.compile(r"[0-9]")
_SPACE = frozenset(" \t\n\x0b\x0c\r")


def emails(text: str, start: int = 0, end: int | None = None) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their @ signs in linear time."""
    end = len(text) if end is None else end
    low, at = start, text.find("@", start, end)
    while at >= 0:
        first = at
        while first > low and _LOCAL.match(text, first - 1):
            first -= 1
        domain = _DOMAIN.match(text, at + 1, end) if first < at else None
        if domain:
            yield first, domain.end()
        low = domain.end() if domain else at + 1
        at = text.find("@", low, end)


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * int(d) - 9 * (d > "4") for d in even)) % 10 == 0


def well_formed(kind: str, match: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))
    digits = "".join(_DIGITS.findall(match))
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 10 <= len(digits) <= 15


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of what the patterns find, in that order."""
    out = [(start, 0, end) for start, end in emails(text)]
    for number, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        out += [(m.start(), number, m.end()) for m in pattern.finditer(text) if well_formed(KINDS[number], m.group())]
    return sorted(out)


def tokens(text: str) -> list[tuple[int, int]]:
    """Runs without white space that hold a digit or an @."""
    out, at = [], 0
    while found := _CAPABLE.search(text, at):
        start = found.start()
        while start > at and text[start - 1] not in _SPACE:
            start -= 1
        end = _END.search(text, found.end())
        at = end.start() if end else len(text)
        out.append((start, at))
    return out


def features(token: str) -> list[int]:
    digits = _DIGITS.findall(token)
    core = token.strip(".,;:!?\"'*#&%$|<>")
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]{5,}", "9+", re.sub(r"[0-9]{1,4}(?![0-9])", lambda m: "9" * len(m.group()), core)))
    names = [
        "bias", f"shape {shape[:24]}", f"head {shape[:2]}", f"digits {min(len(digits), 20)}", f"dots {min(core.count('.'), 4)}",
        f"signs {'@' in core}{core.startswith('+')}{core.startswith('(')}{'-' in core}", f"letters {any(map(str.isalpha, core))}",
        f"card {14 <= len(digits) <= 19 and luhn(''.join(digits))}{core.isdigit()}", f"mail {next(emails(core), None) is not None}",
        f"octets {(m := _IP.fullmatch(core)) is not None and well_formed('ip', m.group())}",
    ]
    return [xxhash.xxh32_intdigest(n) % FEATURES for n in names]


class Graph:
    """Nodes of a document with features, chain links and skip links."""

    def __init__(self, text: str):
        self.at = tokens(text)
        parts = [text[s:e] for s, e in self.at]
        self.unary = [features(p) for p in parts]
        self.chain = [(i, i + 1) for i in range(len(parts) - 1) if not text[self.at[i][1] : self.at[i + 1][0]].strip(" \t\n\x0b\x0c\r")]
        self.skips, last = [], {}
        for i, part in enumerate(parts):
            digits = "".join(_DIGITS.findall(part))
            for key in {digits if len(digits) > 4 else None, part.strip(".,;:!?\"'").lower() if len(part) > 4 else None} - {None}:
                if key in last and (last[key], i) not in self.skips[-2:]:
                    self.skips.append((last[key], i))
                last[key] = i

    def __len__(self) -> int:
        return len(self.at)

    def silver(self, spans: list[tuple[int, int, int]]) -> list[int]:
        """Labels from pattern spans: 0 outside, 1 + 2 * kind where one begins, one more inside."""
        labels, low = [0] * len(self), 0
        for start, kind, end in sorted(spans, key=lambda s: (s[0], -s[1])):
            while low < len(self.at) and self.at[low][1] <= start:
                low += 1
            for i in range(low, len(self.at)):
                s, e = self.at[i]
                if s >= end:
                    break
                labels[i] = 1 + 2 * kind + (s > start)
        return labels


def train(samples: list[tuple[Graph, list[int]]]) -> dict[str, np.ndarray]:
    """Weights by maximum pseudo-likelihood: each node's label given its features and its neighbours' labels."""
    params = {"unary": np.zeros((FEATURES, LABELS)), "chain": np.zeros((LABELS, LABELS)), "skip": np.zeros((LABELS, LABELS))}
    rows = [(f, y) for graph, labels in samples for f, y in zip(graph.unary, labels, strict=True)]
    if not rows:
        params["unary"][:, 0] = 1.0
        return params
    x, y = np.array([f for f, _ in rows]), np.array([label for _, label in rows])
    chains, skips, base = [], [], 0
    for graph, _ in samples:
        chains += [(a + base, b + base) for a, b in graph.chain]
        skips += [(a + base, b + base) for a, b in graph.skips]
        base += len(graph)
    chains, skips = np.array(chains, np.int64).reshape(-1, 2), np.array(skips, np.int64).reshape(-1, 2)
    truth = np.eye(LABELS)[y]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    for step in range(1, STEPS + 1):
        scores = params["unary"][x].sum(axis=1)
        np.add.at(scores, chains[:, 1], params["chain"][y[chains[:, 0]]])
        np.add.at(scores, chains[:, 0], params["chain"].T[y[chains[:, 1]]])
        np.add.at(scores, skips[:, 1], params["skip"][y[skips[:, 0]]])
        np.add.at(scores, skips[:, 0], params["skip"].T[y[skips[:, 1]]])
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        off = (scores / scores.sum(axis=1, keepdims=True) - truth) / len(y)
        slopes = {k: SHRINK / len(y) * v for k, v in params.items()}
        np.add.at(slopes["unary"], x.ravel(), np.repeat(off, x.shape[1], axis=0))
        for name, links in (("chain", chains), ("skip", skips)):
            np.add.at(slopes[name], y[links[:, 0]], off[links[:, 1]])
            np.add.at(slopes[name].T, y[links[:, 1]], off[links[:, 0]])
        for k, slope in slopes.items():
            mean, square = moments[k]
            mean += 0.1 * (slope - mean)
            square += 0.001 * (slope * slope - square)
            params[k] -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return params


def beliefs(graph: Graph, weights: dict[str, np.ndarray]) -> np.ndarray:
    """Label probabilities of every node by damped loopy belief propagation over chain and skip links."""
    local = weights["unary"][np.array(graph.unary)].sum(axis=1)
    links = np.array(graph.chain + graph.skips, np.int64).reshape(-1, 2)
    if not len(links):
        out = np.exp(local - local.max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)
    pairs = np.concatenate([np.broadcast_to(weights["chain"], (len(graph.chain), LABELS, LABELS)), np.broadcast_to(weights["skip"], (len(graph.skips), LABELS, LABELS))])
    source, target = np.concatenate([links[:, 0], links[:, 1]]), np.concatenate([links[:, 1], links[:, 0]])
    pairs, back = np.concatenate([pairs, pairs.transpose(0, 2, 1)]), np.concatenate([np.arange(len(links)) + len(links), np.arange(len(links))])
    sent = np.zeros((len(source), LABELS))
    for _ in range(ROUNDS):
        total = local.copy()
        np.add.at(total, target, sent)
        inner = (total[source] - sent[back])[:, :, None] + pairs
        top = inner.max(axis=1, keepdims=True)
        new = np.log(np.exp(inner - top).sum(axis=1)) + top[:, 0]
        sent = DAMPING * sent + (1 - DAMPING) * (new - new.max(axis=1, keepdims=True))
    total = local.copy()
    np.add.at(total, target, sent)
    out = np.exp(total - total.max(axis=1, keepdims=True))
    return out / out.sum(axis=1, keepdims=True)


def _trimmed(kind: str, text: str, start: int, end: int) -> tuple[int, int] | None:
    """The well-formed entity within a run of tokens, without marks around it."""
    if kind == "email":
        return next(emails(text, start, end), None)
    found = {"ip": _IP, "card": _CARD, "phone": _NUMBER}[kind].search(text, start, end)
    return found.span() if found and well_formed(kind, found.group()) else None


def field_spans(text: str, graph: Graph, weights: dict[str, np.ndarray], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that the field adds: runs of sure labels, well-formed and clear of the pattern spans."""
    shares = beliefs(graph, weights)
    labels = np.where(shares.max(axis=1) >= SURE, shares.argmax(axis=1), 0).tolist()
    joined, runs = set(graph.chain), []
    for i, label in enumerate(labels):
        kind, inside = (label - 1) // 2, label % 2 == 0
        if not label:
            continue
        if inside and runs and runs[-1][0] == kind and runs[-1][2] == i - 1 and (i - 1, i) in joined:
            runs[-1][2] = i
        else:
            runs.append([kind, i, i])
    out, ends = [], sorted(base)
    for kind, first, last in runs:
        span = _trimmed(KINDS[kind], text, graph.at[first][0], graph.at[last][1])
        if span and not any(s < span[1] and span[0] < e for s, _, e in ends):
            out.append((span[0], kind, span[1]))
    return out


def _sample_trainer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    samples = []
    for batch in batches:
        for text in batch.column(0).to_pylist():
            graph = Graph(text)
            samples.append((graph, graph.silver(pattern_spans(text))))
    weights = train(samples)
    names = sorted(weights)
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([weights[n].ravel().tolist() for n in names], pa.list_(pa.float64()))], names=["name", "weights"])


def trained(docs: DataFrame) -> dict[str, np.ndarray]:
    """Weights from the SAMPLE documents of least hash; only hashes are sorted, only these texts are sent."""
    hashed = ids_and_texts(docs).where(F.col("text").rlike("[0-9@]")).select("text", F.xxhash64("text").alias("h"))
    least = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(SAMPLE).collect()]
    if not least:
        return train([])
    sample = hashed.where(F.col("h") <= least[-1]).dropDuplicates(["h"]).orderBy("h").limit(SAMPLE).select("text")
    rows = sample.coalesce(1).mapInArrow(_sample_trainer, "name string, weights array<double>").collect()
    shapes = {"unary": (FEATURES, LABELS), "chain": (LABELS, LABELS), "skip": (LABELS, LABELS)}
    return {r["name"]: np.array(r["weights"]).reshape(shapes[r["name"]]) for r in rows}


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("added", pa.bool_())]))


def find(docs: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """(doc_id, spans: kind, start, end in code points, added by the field or not), by start, then kind."""
    weights = trained(docs) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                spans = []
                if text and _CAPABLE.search(text):
                    base = pattern_spans(text)
                    graph = Graph(text)
                    spans = sorted([(*s, False) for s in base] + [(*s, True) for s in field_spans(text, graph, weights, base)])
                out.append([{"kind": KINDS[k], "start": s, "end": e, "added": a} for s, k, e, a in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _SPAN)], names=["doc_id", "spans"])

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int,added:boolean>>")


def report(docs: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: ~s["added"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.expr(f"cast(size(filter(spans, s -> not s.added and s.kind = '{kind}')) as long)").alias(f"n_{kind}") for kind in KINDS]
    return find(docs).select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
