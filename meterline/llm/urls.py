"""URL filter: longest matching rule, else gradient-boosted trees on lexical features, with DataFrame functions only.

The trees (MLlib, on DataFrames) learn from labelled URLs: length, depth, digit ratio, entropy of the host, parameter counts and the
like, and how often URLs of the same host suffix were labelled bad. A URL meets the statistics of the *other*
folds while it is learnt from, so its label can't be read off them. A fifth of the labelled URLs is held out, and of these
the ones that no rule decides choose the cutoff: the lowest score from which at least ``PRECISION`` of at least ``LEAST_HELD`` held-out
URLs are bad. If there is none, the labels don't follow from URLs, and the trees block nothing.

The trees are fitted on about ``SAMPLE`` distinct labelled URLs, those of least hash, so the fit costs the same at any
size; suffix statistics and the cutoff are counted over all labelled URLs, and every URL is judged.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and is judged on its
features; repeated rows are judged each; a URL labelled both ways is bad; without labels of both kinds
nothing is blocked but by rules; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..session import store

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
SAMPLE = 20_000
FOLDS = 5
PRECISION, LEAST_HELD = 0.8, 20
TREES, TREE_DEPTH = 12, 3
SMOOTH = 20
FEATURES = ("chars", "host_chars", "depth", "digits", "entropy", "params", "query_chars", "labels", "hyphens", "fragment", "suffix_bad", "suffix_seen")


def _rest(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")


def parts(urls: DataFrame) -> DataFrame:
    """``urls`` (with url) and host (A-Z lower-cased) and path."""
    rest = _rest(F.col("url"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host, path = F.regexp_extract(rest, r"^[^/?#]*", 0), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return urls.withColumns({"host": F.translate(host, upper, upper.lower()), "path": path})


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does."""
    fits = []
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, rest = rule.partition("/")
        own = (host == name) | host.endswith(f".{name}")
        fits.append(F.when(own & path.startswith(f"/{rest}"), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits)


def suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def lexical(urls: DataFrame) -> DataFrame:
    """``urls`` (url, host, path) and the features that a URL alone tells."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    count = lambda text, char: F.length(text) - F.length(F.replace(text, F.lit(char)))
    n = F.length(host).cast("double")
    share = lambda c: (n - F.length(F.replace(host, c))) / n
    entropy = F.aggregate(F.array_distinct(F.split(host, "")), F.lit(0.0), lambda total, c: F.when(c == "", total).otherwise(total - share(c) * F.log2(share(c))))
    found = {
        "chars": F.length(url), "host_chars": n, "depth": count(path, "/"), "digits": F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(F.lit(1), F.length(url)),
        "entropy": F.when(n > 0, entropy).otherwise(0.0), "params": F.when(query == "", 0).otherwise(1 + count(query, "&")), "query_chars": F.length(query),
        "labels": count(host, "."), "hyphens": count(host, "-"), "fragment": F.when(url.contains("#"), 1).otherwise(0),
    }
    return urls.withColumns({name: value.cast("double") for name, value in found.items()})


def with_suffix_statistics(rows: DataFrame, statistics: DataFrame, rate: float) -> DataFrame:
    """Smoothed share of bad URLs of the host's suffix and the logarithm of its count, from (suffix, bad, seen)."""
    joined = rows.withColumn("suffix", suffix(F.col("host"))).join(statistics, "suffix", "left")
    bad, seen = F.coalesce("bad", F.lit(0)), F.coalesce("seen", F.lit(0))
    return joined.withColumns({"suffix_bad": (bad + SMOOTH * rate) / (seen + SMOOTH), "suffix_seen": F.log1p(seen)}).drop("bad", "seen", "suffix")


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep")


class UrlModel:
    """Suffix statistics, trees and what they are worth on held-out URLs; ``trees`` is None where labels are all alike or
    missing, ``cutoff`` is None where no score is reliable enough to block by."""

    def __init__(self, statistics: DataFrame, rate: float, trees: GBTClassificationModel | None):
        self.statistics, self.rate, self.trees = statistics, rate, trees
        self.cutoff: float | None = None
        self.auc: float | None = None

    @classmethod
    def fit(cls, labelled: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> UrlModel:
        """``labelled``: (url, bad 0 or 1)."""
        distinct = labelled.where("url is not null and bad is not null").groupBy("url").agg(F.max("bad").cast("int").alias("label"))
        ruled = fitting_rule(F.col("host"), F.col("path"), rules).isNotNull()
        fold = lambda seed: F.pmod(F.xxhash64("url", F.lit(seed)), F.lit(FOLDS)).cast("int")
        distinct = store(parts(distinct).withColumns({"suffix": suffix(F.col("host")), "fold": fold(1), "held": fold(2) == 0, "ruled": ruled}), "url-labels")
        train = distinct.where("NOT held")
        seen, bad = train.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
        rate = (bad / seen) if seen else 0.0
        by_fold = store(train.groupBy("suffix", "fold").agg(F.sum("label").alias("bad"), F.count("*").alias("seen")), "url-folds")
        statistics = store(by_fold.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("seen").alias("seen")), "url-suffixes")
        model = cls(statistics, rate, None)
        if bad in (0, seen):
            return model
        sample = train.where(F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE / seen)) + 1)
        own = by_fold.select("suffix", "fold", F.col("bad").alias("own_bad"), F.col("seen").alias("own_seen"))
        rows = lexical(sample).join(own, ["suffix", "fold"]).join(statistics, "suffix")
        others = F.col("seen") - F.col("own_seen")
        rows = rows.withColumns({"suffix_bad": (F.col("bad") - F.col("own_bad") + SMOOTH * rate) / (others + SMOOTH), "suffix_seen": F.log1p(others)})
        table = store(rows.select("url", "label", *FEATURES), "url-features")
        if table.select("label").distinct().count() < 2:
            return model
        ordered = _assembler().transform(table).select("label", "features")
        model.trees = GBTClassifier(maxIter=TREES, maxDepth=TREE_DEPTH, stepSize=0.2, seed=7, minInstancesPerNode=20).fit(ordered)
        model._weigh(distinct.where("held AND NOT ruled"))
        return model

    def _weigh(self, held: DataFrame) -> None:
        """Area under the curve and cutoff from held-out URLs, by a table of at most 1,001 scores."""
        counts = self.score(held.select("url", "host", "path", "label")).groupBy(F.floor(F.col("score") * 1_000).cast("int").alias("bin")).agg(
            F.sum("label").alias("bad"), F.count("*").alias("n")).orderBy(F.desc("bin")).collect()
        bad = all_ = won = 0
        total_bad, total = sum(r["bad"] for r in counts), sum(r["n"] for r in counts)
        for r in counts:
            won += r["bad"] * (total - total_bad - (all_ - bad) - (r["n"] - r["bad"]) / 2)
            bad, all_ = bad + r["bad"], all_ + r["n"]
            if all_ >= LEAST_HELD and bad >= PRECISION * all_:
                self.cutoff = r["bin"] / 1_000
        if 0 < total_bad < total:
            self.auc = won / (total_bad * (total - total_bad))

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` (url, host, path) with score, the probability of a bad URL."""
        if self.trees is None:
            return rows.withColumn("score", F.lit(0.0))
        names = rows.columns
        table = _assembler().transform(with_suffix_statistics(lexical(rows), self.statistics, self.rate))
        return self.trees.transform(table).select(*names, vector_to_array("probability")[1].alias("score"))


def judge(pages: DataFrame, model: UrlModel, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """``pages`` (id and url) with host, path, rule, verdict and score."""
    rows = model.score(parts(pages)).withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    blocks = F.col("score") >= model.cutoff if model.cutoff is not None else F.lit(False)
    verdict = F.coalesce(F.col("fit.verdict"), F.when(blocks, "block").otherwise("allow"))
    return rows.select(*pages.columns, "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "score")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad): a page's URL carries the id of its document; bad if that is labelled low or toxic."""
    document = F.regexp_extract("url", r"/(\d{1,18})(?:[/.?#]|$)", 1)
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    return pages.select("url", F.nullif(document, F.lit("")).cast("long").alias("doc_id")).join(marks, "doc_id").select("url", "bad")


def ruled_pages(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(url, bad) of the URLs that a rule decides."""
    fit = parts(pages.select("url")).select("url", fitting_rule(F.col("host"), F.col("path"), rules).alias("fit")).where("fit is not null")
    return fit.select("url", F.when(F.col("fit.verdict") == "block", 1).otherwise(0).alias("bad"))


def report(pages: DataFrame, labels: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``labelled`` (url, bad) adds labelled URLs to those of labelled documents and of rules."""
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"))
    known = labelled_pages(pages, labels).unionByName(ruled_pages(pages))
    model = UrlModel.fit(known if labelled is None else known.unionByName(labelled.select("url", "bad")))
    return judge(pages, model).select("page_id", "host", "path", "rule", "verdict", "score")
