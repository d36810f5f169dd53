"""Dated, multi-currency price lists: loading, checking, and the as-of join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import (
    ArrayType, DoubleType, LongType, MapType, StringType, StructField, StructType,
)

from ..functions import scalars as S, variants as V

PARTS = ("cost_input", "cost_cached", "cost_cache_write", "cost_output")
# Currencies a price list may use.
CURRENCIES = ("USD", "CNY")

_RATE = StructType([
    StructField("currency", StringType()), StructField("effectiveFrom", StringType()),
    StructField("input", DoubleType()), StructField("cached", DoubleType()),
    StructField("cacheWrite", DoubleType()), StructField("output", DoubleType()),
])
_PRICE_FILE = StructType([
    StructField("version", LongType()), StructField("currency", StringType()),
    StructField("displayCurrency", StringType()), StructField("usdCny", DoubleType()),
    StructField("description", StringType()),
    StructField("aliases", MapType(StringType(), StringType())),
    StructField("models", MapType(StringType(), ArrayType(_RATE))),
])


class PriceListError(ValueError):
    """The price list cannot be used as written."""


def price_problems(head: DataFrame, rates: DataFrame, aliases: DataFrame) -> DataFrame:
    """Every reason to reject a price list, as rows (problem, subject)."""

    def found(df: DataFrame, condition: Column, problem: str, subject: Column) -> DataFrame:
        return df.where(F.coalesce(condition, F.lit(False))).select(
            F.lit(problem).alias("problem"), subject.cast("string").alias("subject")
        )

    def known(c: str) -> Column:
        return F.coalesce(F.col(c).isin(*CURRENCIES), F.lit(False))

    prices = ("input", "cached", "cache_write", "output")
    unusable = F.lit(False)
    for p in prices:
        finite = F.col(p).isNotNull() & ~F.isnan(p) & (F.col(p) < float("inf")) & (F.col(p) >= 0)
        unusable = unusable | ~finite
    named = rates.select("raw_model", "model").dropDuplicates()
    twice = named.groupBy("model").count().where("count > 1")
    nicks = aliases.select("raw_alias", "alias").dropDuplicates()
    nick_twice = nicks.groupBy("alias").count().where("count > 1")
    same_time = (
        rates.where("input IS NOT NULL").groupBy("raw_model", "model", "effective_from_ms")
        .count().where("count > 1")
    )
    priced = rates.select(F.col("model").alias("priced")).dropDuplicates()
    to_model = aliases.join(priced, aliases["model"] == priced["priced"], "left")
    shadow = aliases.where("alias != model").join(priced, aliases["alias"] == priced["priced"])
    no_fx = F.col("usd_cny").isNull()
    wants_fx = (F.col("currency") == "CNY") | (F.col("display_currency") == "CNY")
    checks = [
        found(head, ~F.coalesce(F.col("version") == 1, F.lit(False)), "version must be 1", F.col("version")),
        found(head, ~known("currency") | ~known("display_currency"), "currency must be USD or CNY", F.col("currency")),
        found(head, F.isnan("usd_cny") | (F.col("usd_cny") <= 0) | (F.col("usd_cny") == float("inf")), "exchange rate must be positive", F.col("usd_cny")),
        found(rates, F.trim("raw_model") == "", "model name is empty", F.col("raw_model")),
        found(rates, F.col("empty"), "model has no rates", F.col("model")),
        found(rates, ~F.col("empty") & ~known("currency"), "currency must be USD or CNY", F.col("model")),
        found(rates, ~F.col("empty") & unusable, "prices must be finite and not negative", F.col("model")),
        found(rates, ~F.col("empty") & F.col("effective_text").isNotNull() & F.col("effective_from_ms").isNull(), "effective time needs a zone", F.col("effective_text")),
        found(twice, F.lit(True), "model appears twice after normalising", F.col("model")),
        found(nick_twice, F.lit(True), "alias appears twice after normalising", F.col("alias")),
        found(same_time, F.lit(True), "effective time appears twice", F.col("model")),
        found(aliases, F.trim("raw_alias") == "", "alias is empty", F.col("raw_alias")),
        found(to_model, F.col("priced").isNull(), "alias must name a priced model", F.col("alias")),
        found(shadow, F.lit(True), "alias hides a priced model", F.col("alias")),
        found(head, wants_fx & no_fx, "exchange rate is missing", F.col("currency")),
        found(rates, (F.col("currency") == "CNY") & no_fx, "exchange rate is missing", F.col("model")),
    ]
    out = checks[0]
    for check in checks[1:]:
        out = out.unionByName(check)
    return out


def parse_prices(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(head, rates, aliases) of a one-row price document, names and currencies normalised."""
    head = raw.select(
        "version", F.upper("currency").alias("currency"),
        F.upper(F.coalesce("displayCurrency", F.lit("USD"))).alias("display_currency"),
        F.col("usdCny").alias("usd_cny"),
    )
    listed = raw.select(
        F.upper("currency").alias("list_currency"), "usdCny", F.explode("models").alias("raw_model", "entries")
    )
    entry = F.col("entry")
    text = entry["effectiveFrom"]
    rates = listed.withColumn("empty", F.size("entries") < 1).select(
        "list_currency", "usdCny", "raw_model", "empty", F.explode_outer("entries").alias("entry")
    ).select(
        "raw_model", S.normalize_model("raw_model").alias("model"), "empty",
        F.col("usdCny").alias("usd_cny"),
        text.alias("effective_text"),
        F.when(text.isNull(), F.lit(0).cast("bigint")).otherwise(V.rfc3339_ms(text)).alias("effective_from_ms"),
        F.upper(F.coalesce(entry["currency"], F.col("list_currency"))).alias("currency"),
        entry["input"].alias("input"), entry["cached"].alias("cached"),
        entry["cacheWrite"].alias("cache_write"), entry["output"].alias("output"),
    )
    aliases = raw.select(F.explode("aliases").alias("raw_alias", "raw_target")).select(
        "raw_alias", S.normalize_model("raw_alias").alias("alias"),
        S.normalize_model("raw_target").alias("model"),
    )
    return head, rates, aliases


def load_prices(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, float | None]:
    """Reads and checks a price file: (rates, aliases, usd_cny). Raises on any problem."""
    raw = spark.read.schema(_PRICE_FILE).option("mode", "FAILFAST").json(path, multiLine=True)
    head, rates, aliases = parse_prices(raw)
    problem = price_problems(head, rates, aliases).orderBy("problem", "subject").first()
    if problem is not None:
        raise PriceListError(f"{problem.problem}: {problem.subject}")
    first = head.first()
    if first is None:
        raise PriceListError(f"empty price file: {path}")
    fx = first.usd_cny
    columns = ("model", "effective_from_ms", "currency", "input", "cached", "cache_write", "output")
    return rates.select(*columns), aliases.select("alias", "model"), fx


def rate_intervals(rates: DataFrame, key: str = "model") -> DataFrame:
    """Each rate with the half-open interval [from_ms, to_ms) in which it holds."""
    start = F.coalesce("effective_from_ms", F.lit(0).cast("bigint"))
    later = Window.partitionBy(key).orderBy("from_ms")
    return rates.withColumn("from_ms", start).withColumn(
        "to_ms", F.coalesce(F.lead("from_ms").over(later), F.lit(S.MAX_LONG))
    ).drop("effective_from_ms")


def resolve_alias(events: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds ``billing_model``: the alias target when there is one, else the model itself."""
    targets = aliases.select(F.col("alias").alias("_alias"), F.col("model").alias("_target"))
    named = events.withColumn("_name", S.normalize_model("model"))
    return (
        named.join(targets, F.col("_name") == F.col("_alias"), "left")
        .withColumn("billing_model", F.coalesce("_target", "_name"))
        .drop("_name", "_alias", "_target")
    )


def effective_rates(rates: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rate intervals under every ``name`` an event may carry, aliases already followed, so
    pricing needs a single join."""
    nicknames = aliases.select(F.col("alias").alias("name"), F.col("model").alias("target"))
    own = rates.withColumnRenamed("model", "name").join(nicknames.select("name"), ["name"], "left_anti")
    routed = nicknames.join(rates, F.col("target") == F.col("model")).drop("target", "model")
    return rate_intervals(own.unionByName(routed), "name")


def price(
    events: DataFrame, rates: DataFrame, aliases: DataFrame, usd_cny: float | None
) -> DataFrame:
    """Adds the four cost parts in USD and ``cost``; all NULL where no rate applies.

    The price list is joined on (name, time inside interval). No hint is given: Spark
    broadcasts the list while its estimated size is under the broadcast threshold and falls
    back to a sort-merge join (with adaptive skew splitting) beyond it.
    """
    names = ("input", "cached", "cache_write", "output")
    spans = effective_rates(rates, aliases).select(
        F.col("name").alias("_n"), "from_ms", "to_ms", F.col("currency").alias("_cur"),
        *[F.col(n).cast("double").alias(f"_r_{n}") for n in names],
    )
    match = (
        (F.col("_name") == F.col("_n")) & (F.col("ts") >= F.col("from_ms")) & (F.col("ts") < F.col("to_ms"))
    )
    fx = F.lit(None).cast("double") if usd_cny is None else F.lit(float(usd_cny))
    divisor = F.when(F.col("_cur") == "CNY", fx).when(F.col("_cur").isNotNull(), F.lit(1.0))
    priced = events.withColumn("_name", S.normalize_model("model")).join(spans, match, "left")
    parts = {
        f"cost_{n}": F.col(n).cast("double") * F.col(f"_r_{n}") / F.lit(1_000_000.0) / divisor
        for n in names
    }
    return (
        priced.withColumns(parts)
        .withColumn("cost", F.col(PARTS[0]) + F.col(PARTS[1]) + F.col(PARTS[2]) + F.col(PARTS[3]))
        .drop("_name", "_n", "_cur", "from_ms", "to_ms", *[f"_r_{n}" for n in names])
    )


def price_catalog(rates: DataFrame, aliases: DataFrame, at_ms: int) -> DataFrame:
    """Every listed model with its rate at an instant (NULL if none yet) and its aliases."""
    now = rate_intervals(rates).where((F.col("from_ms") <= at_ms) & (F.col("to_ms") > at_ms))
    nicknames = aliases.groupBy("model").agg(
        F.array_join(F.array_sort(F.collect_set("alias")), ",").alias("aliases")
    )
    listed = rates.select("model").dropDuplicates()
    return listed.join(now, ["model"], "left").join(nicknames, ["model"], "left").select(
        "model", "currency", "input", "cached", "cache_write", "output", "from_ms",
        F.coalesce("aliases", F.lit("")).alias("aliases"),
    )
