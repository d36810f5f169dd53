"""Mixing sources to target weights, with DataFrame functions only.

The words of each source form a stream (documents in a pseudorandom but fixed order) that is cut
into blocks of ``block`` words. Every output shard draws the source of each of its slots from a
multinomial; the drawn counts are scaled by cumulative rounding so that each source comes
out at its number of slots. Slot ``q`` of a source takes the block at ``q`` modulo the source's blocks
in a pseudorandom permutation of its block numbers (a swap-or-not shuffle, a bijection for any number
of blocks), so blocks repeat only after all of them were taken once. Documents meet their blocks in a
join by block number.

Targets are shares of ``share`` times all words by weight, none above ``cap`` times its source; what is
beyond that is shared again by weight among the others (a water level over cap / weight).

Defined cases: null and empty texts have size 0 and take nothing; the null source is a source
and comes last; repeated rows have their own place in the stream; an empty table gives no rows; a
single source, or one with a third of all rows, is numbered in chunks by many tasks; other columns are ignored
by ``report`` and kept by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import store
from .common import partitions

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2
BLOCK = 128
OUT_SHARDS = 64
ROUNDS = 24
SEED = 42
CHUNK_ROWS = 8_192
TASK_SLOTS = 4_000_000


def words_in(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1)
    n = F.size(parts)
    edges = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0) + F.when((n > 1) & (F.get(parts, n - 1) == ""), 1).otherwise(0)
    return (n - edges).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, s, source_size, weight, target) from (source, source_size), one row per source; s numbers them by code point."""
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    named = sizes.withColumn("s", order).withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.pmod("s", F.lit(len(weights))).cast("int")).cast("double"))
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), "s")
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    budget = share * F.sum("source_size").over(everything)
    level = (budget - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    free = named.withColumn("level", level).withColumn("level", F.when(cap * F.col("source_size") >= F.col("level") * F.col("weight"), F.col("level")))
    first = F.first("level", ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    filled = free.withColumn("water", first)
    target = F.least(cap * F.col("source_size").cast("double"), F.col("water") * F.col("weight"))
    return filled.select("source", "s", "source_size", "weight", F.coalesce(target, cap * F.col("source_size").cast("double")).alias("target"))


def permuted(x: Column, n: Column, s: Column, rounds: int = ROUNDS) -> Column:
    """Where x (0 <= x < n) goes in the pseudorandom permutation of source s."""

    def swap(at: Column, r: Column) -> Column:
        mate = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), s, r), n) - at, n)
        return F.when(F.xxhash64(F.lit(SEED + 1), s, r, F.greatest(at, mate)).bitwiseAND(F.lit(1)) == 1, mate).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("long"), swap)


def placed(docs: DataFrame, source_col: str, id_col: str, size: Column, keep: list[Column]) -> tuple[DataFrame, DataFrame]:
    """The documents with s, __size and __start in their source's stream; and the sources."""
    rows = docs.select(*keep, F.col(source_col).cast("string").alias("__source"), F.col(id_col).cast("long").alias("__id"), size.alias("__size"))
    rows = rows.withColumn("__h", F.xxhash64(F.lit(SEED), "__id", "__size"))
    chunks = max(1, docs.count() // CHUNK_ROWS)
    rows = rows.withColumn("__chunk", F.pmod("__h", F.lit(chunks)).cast("int"))
    sums = store(rows.groupBy("__source", "__chunk").agg(F.sum("__size").alias("__sum")), "mix-sizes")
    sources = targets(sums.groupBy(F.col("__source").alias("source")).agg(F.sum("__sum").alias("source_size")))
    sources = store(sources.withColumn("blocks", F.expr(f"(source_size + {BLOCK - 1}) div {BLOCK}")), "mix-sources")
    before = Window.partitionBy("__source").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("__base", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    within = Window.partitionBy("__source", "__chunk").orderBy("__h", "__id", "__size")
    rows = rows.withColumn("__run", F.sum("__size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size"))
    rows = rows.join(starts.select(F.col("__source").alias("__source2"), F.col("__chunk").alias("__chunk2"), "__base"), F.col("__source").eqNullSafe(F.col("__source2")) & (F.col("__chunk") == F.col("__chunk2")))
    rows = rows.join(sources.select(F.col("source").alias("__source3"), "s"), F.col("__source").eqNullSafe(F.col("__source3")))
    return rows.select(*(["row"] if keep else []), "s", "__id", "__size", (F.col("__base") + F.col("__run")).alias("__start")), sources


def numbers(spark: SparkSession, total: int) -> DataFrame:
    """0 .. total - 1, in tasks of a bounded count."""
    return spark.range(0, total, 1, max(partitions(spark), total // TASK_SLOTS))


def slots(sources: DataFrame, shards: int = OUT_SHARDS) -> DataFrame:
    """(shard, s, slot, block): which block of which source each slot of each output shard takes."""
    spark = sources.sparkSession
    wanted = sources.withColumn("n", F.least(CAP * F.col("blocks"), F.expr("cast(round(target * blocks / nullif(source_size, 0)) as long)"))).where("n > 0").select("s", "n", "blocks")
    total, kinds = wanted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    cell = max(1, total // (4 * kinds + 1_024))
    up_to = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    spans = wanted.withColumn("high", F.sum("n").over(up_to)).withColumn("low", F.col("high") - F.col("n"))
    cells = spans.select("s", "low", "high", F.explode(F.expr(f"sequence(low div {cell}, (high - 1) div {cell})")).alias("cell"))
    draws = numbers(spark, total).select(F.pmod("id", F.lit(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64(F.lit(SEED + 2), "id"), F.lit(max(1, total))).alias("u"))
    drawn = draws.withColumn("cell", F.expr(f"u div {cell}")).join(cells, "cell").where("low <= u and u < high").groupBy("shard", "s").agg(F.count("*").alias("c"))
    missed = wanted.join(drawn.select("s").distinct(), "s", "left_anti").select(F.pmod(F.xxhash64("s"), F.lit(shards)).cast("int").alias("shard"), "s", F.lit(1).cast("long").alias("c"))
    drawn = drawn.unionByName(missed).join(wanted, "s")
    by_shard = Window.partitionBy("s").orderBy("shard")
    run, all_ = F.sum("c").over(by_shard.rowsBetween(Window.unboundedPreceding, 0)), F.sum("c").over(Window.partitionBy("s"))
    scaled = drawn.withColumns({"run": run, "all": all_}).select(
        "shard", "s", "blocks", F.expr("cast(round(cast(run - c as double) * n / all) as long)").alias("lo"), F.expr("cast(round(cast(run as double) * n / all) as long)").alias("hi"))
    shares = scaled.where("hi > lo").join(spans.select("s", F.col("low").alias("base")), "s").select("shard", "s", "blocks", "base", (F.col("base") + F.col("lo")).alias("low"), (F.col("base") + F.col("hi")).alias("high"))
    cell = max(1, total // (4 * kinds * shards + 1_024))
    cells = shares.select("*", F.explode(F.expr(f"sequence(low div {cell}, (high - 1) div {cell})")).alias("cell"))
    cells = store(cells, "mix-cells")  # a few rows per source and shard; stored, so that Spark knows their size
    each = numbers(spark, total).withColumn("cell", F.expr(f"id div {cell}")).join(cells, "cell").where("low <= id and id < high").select("shard", "s", "blocks", (F.col("id") - F.col("base")).alias("slot"))
    return each.select("shard", "s", "slot", permuted(F.expr("slot % blocks"), F.col("blocks"), F.col("s")).alias("block"))


def _times(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(s, __start, block, words, times) of every block that every document lies in."""
    # Spark takes the slots for as few as the sources they are exploded from, and would broadcast them
    times = slots(sources).groupBy("s", "block").agg(F.count("*").alias("times")).hint("merge")
    pieces = rows.where("__size > 0").select("s", "__start", "__size", F.explode(F.expr(f"sequence(__start div {BLOCK}, (__start + __size - 1) div {BLOCK})")).alias("block"))
    words = F.least(F.col("__start") + F.col("__size"), (F.col("block") + 1) * BLOCK) - F.greatest(F.col("__start"), F.col("block") * BLOCK)
    return pieces.select("s", "__start", "block", words.alias("words")).join(times, ["s", "block"])


def report(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes, repeats counted) of every document."""
    rows, sources = placed(docs, source_col, id_col, words_in(F.col(text_col)), [])
    rows = store(rows, "mix-streams")
    taken = _times(rows, sources).groupBy("s", "__start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    out = rows.join(taken.hint("merge"), ["s", "__start"], "left").join(sources.select("s", "source_size", "target"), "s")
    return out.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), "source_size", "target", F.when(F.col("__size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken"))


def _drawn(text: Column) -> Column:
    """The text, or the words of those of its blocks that are taken as often as ``__turn``.

    Lambdas bind the words and the blocks, so that a text is split once and cut block by block.
    """
    start, size = F.col("__start"), F.col("__size")

    def cut(words: Column, block: Column) -> Column:
        low, high = F.greatest(F.lit(0), block * BLOCK - start), F.least(size, (block + 1) * BLOCK - start)
        return F.slice(words, (low + 1).cast("int"), (high - low).cast("int"))

    on = F.filter("__taken", lambda b: b["times"] >= F.col("__turn"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    some = F.get(F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform(on, lambda b: cut(w, b["block"]))), " ")), F.lit(0))
    blocks = F.expr(f"(__start + __size - 1) div {BLOCK} - __start div {BLOCK} + 1")
    return F.when(F.size(on) == blocks, text).otherwise(some)


def mixed(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix as documents, with every column of ``docs``: for each time that blocks of a document are
    taken, a row with the words of these blocks (the text as it is if that is all of them). A length
    column ``n_chars`` is counted anew.
    """
    rows, sources = placed(docs, source_col, id_col, words_in(F.col(text_col)), [F.struct(*docs.columns).alias("row")])
    taken = _times(rows.select("s", "__start", "__size"), sources)
    lists = taken.groupBy("s", "__start").agg(F.array_sort(F.collect_list(F.struct("block", "times"))).alias("__taken"), F.max("times").alias("__turns"))
    rows = rows.where("__size > 0").join(lists.hint("merge"), ["s", "__start"])
    rows = rows.withColumn("__turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__turns"))))
    out = rows.withColumn("text", _drawn(F.col("row")[text_col].cast("string")))
    new = {text_col: F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
