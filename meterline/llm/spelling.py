"""Groups spelling variants: words one edit apart, each led to its most frequent neighbour.

One edit adds a letter, takes one away, or both. So the letter counts of two near words of equal length differ by one
up and one down, and those of words whose lengths differ by one by a single step: an L1 distance of at most two. Words of
one length are the points of a k-d tree over letter counts; every word is looked up in the trees of its own length and of the lengths
next to it, with one step up, one step down, or both to spend. A branch that needs more is pruned, as its box is too far away.
Vectors that are left are compared, and the order of letters decides at last.

The upper part of each tree is cut on Spark, level by level, from histograms over all words, at the most even
cut of any letter. Its cuts, at most ``CUTS`` (a leaf holds ``LEAF`` words, or more if they are so many that this bound would break),
are all that is sent to the tasks. A word goes to one leaf as a point, and as a query to the leaves that it can reach. Within a leaf the
tree goes on in memory. Pairs never leave a leaf: it gives the number of near words and the best one per query, so that nothing
grows with the square of a group. Anagrams cannot be parted by letter counts: leaves of too many are split by hash, and queries
meet every part.

Defined cases: null and empty texts have no words; a null doc_id counts as the text ``null``; repeated rows count again; ties for the best
neighbour go to the word that is first in code-point order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import store
from .common import columns, ids_and_texts, partitions

RARE = 199
"""One in so many words of a document loses a letter."""
LEAST_LENGTH, LEAST_COUNT, FACTOR = 6, 5, 5
LEAF, CUTS = 20_000, 30_000
BUCKET = 16
FEW = 64
"""Up to so many anagrams are compared with a query letter by letter; of more, those that an edit can give are looked up."""
DEPTH = 55
VOCABULARY = 500_000
"""Words that a task counts before it hands them on."""
BATCH = 8_192

LETTERS = bytes([*range(0x61, 0x7B), *range(0xC0, 0x100)])
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in LETTERS else 0x20 for b in range(256))
_COLUMN = np.full(256, len(LETTERS))
_COLUMN[list(LETTERS)] = np.arange(len(LETTERS))
_UNSPENT, _NONE = -1, -2


def runs(text: str | None, least: int) -> Counter:
    """How often each run of at least ``least`` letters occurs, A-Z lower-cased, as Latin-1 bytes."""
    return Counter(w for w in (text or "").encode("latin-1", "replace").translate(_FOLD).split() if len(w) >= least)


def _counted(rare: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total]), pa.array(total.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in columns(batch, "doc_id", "text"):
                start = zlib.crc32(b"null:" if doc_id is None else b"%d:" % doc_id)
                for word, n in runs(text, least).items():
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                    if h % rare == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    total[word] += n
                if len(total) >= VOCABULARY:
                    yield rows()
                    total.clear()
        if total:
            yield rows()

    return run


def vocabulary(docs: DataFrame, rare: int = RARE, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all words that are long and frequent enough."""
    counted = ids_and_texts(docs).mapInArrow(_counted(rare, least_length), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where((F.length("word") >= least_length) & (F.col("n") >= least_count))


def _letters(words: list[bytes]) -> np.ndarray:
    """A matrix of the letters of words of one length."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def _vectors(letters: np.ndarray, column: np.ndarray, width: int) -> np.ndarray:
    at = np.arange(len(letters))[:, None] * width + column[letters]
    return np.bincount(at.ravel(), minlength=len(letters) * width).reshape(-1, width).astype(np.int32)


def reached(tree: tuple, vectors: np.ndarray, up: bool, down: bool) -> Iterator[tuple]:
    """(leaf, rows of ``vectors``) for all leaves within ``up`` and ``down``. A tree is (letter, value, below, from value on) or
    (leaf,). Whoever crosses a cut has that letter spent, and counts it from there on."""
    n = len(vectors)
    stack = [(tree, np.arange(n), np.full(n, _UNSPENT if up else _NONE, np.int16), np.full(n, _UNSPENT if down else _NONE, np.int16))]
    while stack:
        node, rows, plus, minus = stack.pop()
        if not len(rows):
            continue
        if len(node) == 1:
            yield node[0], rows
            continue
        letter, value, below, above = node
        have = vectors[rows, letter] + (plus == letter) - (minus == letter)
        right = have >= value
        more, less = (have == value - 1) & (plus == _UNSPENT), (have == value) & (minus == _UNSPENT)
        for child, stay, cross, spend_plus in ((above, right, more, True), (below, ~right, less, False)):
            spent = np.full(np.count_nonzero(cross), letter, np.int16)
            stack.append((
                child, np.concatenate([rows[stay], rows[cross]]),
                np.concatenate([plus[stay], spent if spend_plus else plus[cross]]),
                np.concatenate([minus[stay], minus[cross] if spend_plus else spent]),
            ))


class Leaf:
    """Words of one length, in code-point order, with a k-d tree over their distinct letter counts."""

    def __init__(self, words: list[bytes], counts: list[int]):
        order = sorted(range(len(words)), key=words.__getitem__)
        self.words, self.counts = [words[i] for i in order], np.array(counts, np.int64)[order]
        self.letters = _letters(self.words)
        used = np.unique(self.letters)
        self.column = np.full(256, len(used))  # the last column: letters that no word has
        self.column[used] = np.arange(len(used))
        self.width = len(used) + 1
        self.vectors, of = np.unique(_vectors(self.letters, self.column, self.width), axis=0, return_inverse=True)
        of = of.ravel()
        self.members, self.cuts = np.argsort(of, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(self.vectors)))])
        self.place = None
        self.tree = self._grown(np.arange(len(self.vectors)))

    def _grown(self, rows: np.ndarray) -> tuple:
        if len(rows) <= BUCKET:
            return (rows,)
        own = self.vectors[rows]
        letter = int(own.var(axis=0).argmax())
        have = own[:, letter]
        values, sizes = np.unique(have, return_counts=True)
        value = int(values[1:][np.abs(2 * np.cumsum(sizes)[:-1] - len(rows)).argmin()])
        return letter, value, self._grown(rows[have < value]), self._grown(rows[have >= value])

    def near(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word of this leaf) one edit apart; all queries are of one length."""
        letters, more = _letters(words), self.letters.shape[1] - len(words[0])
        vectors = _vectors(letters, self.column, self.width)
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for bucket, rows in reached(self.tree, vectors, more >= 0, more <= 0):
            step = max(1, 4_000_000 // (len(bucket) * self.width))
            for x in range(0, len(rows), step):
                apart = self.vectors[bucket][None] - vectors[rows[x : x + step]][:, None]
                q, v = np.nonzero(np.abs(apart, out=apart).sum(axis=2) == (1 if more else 2))
                if len(q):
                    found += self._ordered(words, letters, rows[x : x + step][q], bucket[v])
        return np.concatenate([q for q, _ in found]), np.concatenate([w for _, w in found])

    def _ordered(self, words: list[bytes], letters: np.ndarray, q: np.ndarray, v: np.ndarray) -> list[tuple]:
        """Of queries and vectors within reach, the words whose letters are in order."""
        sizes = self.cuts[v + 1] - self.cuts[v]
        out = [self._looked_up(words[i], i, j) for i, j in zip(q[sizes > FEW].tolist(), v[sizes > FEW].tolist())]
        q, v, sizes = q[sizes <= FEW], v[sizes <= FEW], sizes[sizes <= FEW]
        at = np.repeat(self.cuts[v] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        q, w = np.repeat(q, sizes), self.members[at]
        long, short = letters[q], self.letters[w]
        if long.shape[1] == short.shape[1]:
            good = (long != short).sum(axis=1) == 1
        else:
            if long.shape[1] < short.shape[1]:
                long, short = short, long
            ahead = np.cumprod(long[:, :-1] == short, axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
            behind = np.cumprod(long[:, :0:-1] == short[:, ::-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
            good = ahead + behind >= short.shape[1]
        return [*out, (q[good], w[good])]

    def _looked_up(self, word: bytes, q: int, v: int) -> tuple[np.ndarray, np.ndarray]:
        if self.place is None:
            self.place = {w: i for i, w in enumerate(self.words)}
        wanted = self.words[self.members[self.cuts[v]]]
        gained, lost = (b"".join(bytes([b]) for b in (x - y).elements()) for x, y in ((Counter(wanted), Counter(word)), (Counter(word), Counter(wanted))))
        if not lost:
            tries = {word[:i] + gained + word[i:] for i in range(len(word) + 1)}
        else:
            tries = {word[:i] + gained + word[i + 1 :] for i, b in enumerate(word) if b == lost[0]}
        hits = [self.place[t] for t in tries if t in self.place]
        return np.full(len(hits), q), np.array(hits, np.int64)


def _trees(cuts: dict) -> dict[int, tuple]:
    """Nested trees by length, from {(length, node): (letter, value)}; a node's children are 2 * node and 2 * node + 1."""

    def grown(length: int, node: int) -> tuple:
        cut = cuts.get((length, node))
        return (node,) if cut is None else (*cut, grown(length, 2 * node), grown(length, 2 * node + 1))

    return {length: grown(length, 1) for length in {length for length, _ in cuts}}


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, letter counts) for the words of a batch."""
    data = [w.encode("latin-1") for w in words]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    for length in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == length)
        yield length, rows, _vectors(_letters([data[i] for i in rows]), _COLUMN, len(LETTERS) + 1)


def _histogram(shared):
    """Per leaf, letter and count of it, how many words; letter -1 for all words of the leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _trees(shared.value)
        for batch in batches:
            for length, _, vectors in _by_length(batch.column(0).to_pylist()):
                for node, rows in reached(trees.get(length, (1,)), vectors, False, False):
                    row, letter = np.nonzero(vectors[rows])
                    keys, n = np.unique(np.stack([letter, vectors[rows][row, letter]]), axis=1, return_counts=True)
                    letter, value, n = np.append(keys[0], -1), np.append(keys[1], 0), np.append(n, len(rows))
                    same = np.ones(len(n), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (same * length, same * node, letter, value, n)], names=["length", "node", "letter", "value", "n"])

    return run


def grow(words: DataFrame, leaf: int | None = None) -> tuple[dict, dict]:
    """The cuts of the upper trees, and into how many parts each leaf goes that no cut can part."""
    spark = words.sparkSession
    leaf = leaf or max(LEAF, -(-words.count() * 2 // CUTS))
    cuts: dict = {}
    while True:
        shared = spark.sparkContext.broadcast(cuts)
        seen = words.select("word").mapInArrow(_histogram(shared), "length long, node long, letter long, value long, n long")
        seen = store(seen.groupBy("length", "node", "letter", "value").agg(F.sum("n").alias("n")), "spelling-cuts")
        large = seen.where((F.col("letter") == -1) & (F.col("n") > leaf)).select("length", "node", F.col("n").alias("total"))
        sides = seen.alias("x").join(seen.alias("y"), ["length", "node", "letter"]).where("letter >= 0 AND y.value >= x.value")  # few values a letter
        sides = sides.groupBy("length", "node", "letter", F.col("x.value").alias("value")).agg(F.sum("y.n").alias("above")).join(large, ["length", "node"])
        even = F.struct(F.abs(2 * F.col("above") - F.col("total")).alias("gap"), "letter", "value")
        new = sides.where((F.col("above") < F.col("total")) & (F.col("node") < 1 << DEPTH)).groupBy("length", "node").agg(F.min(even).alias("cut")).collect()  # at most CUTS in all
        if not new:
            return cuts, {(r["length"], r["node"]): -(-r["total"] // leaf) for r in large.collect()}
        cuts = cuts | {(r["length"], r["node"]): (r["cut"]["letter"], r["cut"]["value"]) for r in new}


_ROUTED = "length long, node long, part long, query boolean, word string, n long"


def _router(shared):
    """Every word as a point of its own leaf, and as a query to all leaves that an edit can lead to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, parts = shared.value
        trees = _trees(cuts)
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            names = np.array(words, object)
            for length, own, vectors in _by_length(words):
                for more in (-1, 0, 1, None):  # None: as points
                    near, query = length + (more or 0), more is not None
                    for node, rows in reached(trees.get(near, (1,)), vectors, query and more >= 0, query and more <= 0):
                        n, rows = parts.get((near, node), 1), own[rows]
                        if query:
                            part, rows = np.tile(np.arange(n), len(rows)), np.repeat(rows, n)
                        else:
                            part = np.array([zlib.crc32(w.encode()) % n for w in names[rows]])
                        same = np.ones(len(rows), np.int64)
                        arrays = [pa.array(c, pa.int64()) for c in (same * near, same * node, part)]
                        arrays += [pa.array([query] * len(rows)), pa.array(names[rows].tolist(), pa.string()), pa.array(counts[rows], pa.int64())]
                        yield pa.RecordBatch.from_arrays(arrays, names=["length", "node", "part", "query", "word", "n"])

    return run


def _found(leaf: Leaf, words: list[bytes]) -> pa.RecordBatch:
    """Per query with a near word in this leaf: how many, and the best of them."""
    sizes = [len(w) for w in words]
    pairs = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for length in {*sizes}:
        rows = np.flatnonzero(np.array(sizes) == length)
        q, w = leaf.near([words[i] for i in rows])
        pairs.append((rows[q], w))
    q, w = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
    order = np.lexsort((w, -leaf.counts[w], q))
    q, w = q[order], w[order]
    q, first, n_near = np.unique(q, return_index=True, return_counts=True)
    best = w[first]
    text = lambda rows, of: pa.array([of[i].decode("latin-1") for i in rows.tolist()], pa.string())
    arrays = [text(q, words), pa.array(n_near, pa.int64()), pa.array(leaf.counts[best], pa.int64()), text(best, leaf.words)]
    return pa.RecordBatch.from_arrays(arrays, names=["word", "n_near", "form_n", "form"])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaf by leaf, its points before its queries."""
    key, points, leaf, queries = None, ([], []), None, []
    for batch in batches:
        for *own, query, word, n in columns(batch, "length", "node", "part", "query", "word", "n"):
            if own != key:
                if leaf and queries:
                    yield _found(leaf, queries)
                key, points, leaf, queries = own, ([], []), None, []
            if not query:
                points[0].append(word.encode("latin-1"))
                points[1].append(n)
            elif points[0]:
                leaf = leaf or Leaf(*points)
                queries.append(word.encode("latin-1"))
                if len(queries) == BATCH:
                    yield _found(leaf, queries)
                    queries = []
    if leaf and queries:
        yield _found(leaf, queries)


def near_words(words: DataFrame, leaf: int | None = None) -> DataFrame:
    """(word, n_near, form_n, form) for every word of ``words`` (word, n) with a near one; form is the most frequent."""
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast(grow(words, leaf))
    routed = words.select("word", "n").mapInArrow(_router(shared), _ROUTED)
    leaves = routed.repartition(partitions(spark), "length", "node", "part").sortWithinPartitions("length", "node", "part", "query")
    found = leaves.mapInArrow(_searched, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("rank"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.rank")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form): the last form that forms lead to. Steps double, so few rounds do."""
    known = store(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = store(known.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        known = after.select("word", "root")
        if after.where("moved").isEmpty():
            return known


def report(docs: DataFrame, leaf: int | None = None) -> DataFrame:
    words = store(vocabulary(docs), "spelling-words")
    leads = F.col("form_n") >= FACTOR * F.col("n")
    joined = words.join(near_words(words, leaf), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(leads, F.col("form")).alias("form"), F.when(leads, F.col("form_n")).alias("form_n")
    )
    joined = store(joined, "spelling-forms")
    return joined.join(roots(joined.where("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
