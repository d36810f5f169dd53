"""Totals, groupings, calendar groups and time series over priced events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import scalars as S
from ..schema import TOKENS
from .prices import PARTS
from .query import Query, with_titles

# Fixed value: label of a group whose project was never recorded.
NO_PROJECT = "未记录项目"
METRICS = (
    *TOKENS, "total_tokens", "events", "last_ts", "known_cost",
    *[f"known_{p}" for p in PARTS], "unpriced_events", "unpriced_tokens", "cost",
)
LAST = ("last_agent", "last_session", "last_path")
_MONEY = ("known_cost", *[f"known_{p}" for p in PARTS], "cost")
MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000
# Fixed value: most points a long series may have.
MAX_POINTS = 2_000


def _last_seen() -> Column:
    return F.struct("ts", "id", "agent", "session", "path")


def metric_aggs(last: bool = True) -> list[Column]:
    """Aggregates of one Summary. ``cost`` is NULL as soon as one event has no price.

    All but the ``last`` pointer have fixed-width buffers and run in the hash aggregate;
    ``last`` carries text and moves the aggregation to the sorted form.
    """
    total = S.total_tokens()
    unpriced = F.col("cost").isNull()
    zero = F.lit(0.0)
    known = F.coalesce(F.sum("cost"), zero)
    aggs = [S.saturating_sum(t, has_nulls=False).alias(t) for t in TOKENS]
    aggs += [
        S.saturating_sum(total, has_nulls=False).alias("total_tokens"),
        F.count(F.lit(1)).alias("events"),
        F.coalesce(F.max("ts"), F.lit(0).cast("bigint")).alias("last_ts"),
        known.alias("known_cost"),
        *[F.coalesce(F.sum(p), zero).alias(f"known_{p}") for p in PARTS],
        F.count_if(unpriced).alias("unpriced_events"),
        S.saturating_sum(F.when(unpriced, total).otherwise(F.lit(0).cast("bigint")), has_nulls=False).alias("unpriced_tokens"),
        F.when(F.count_if(unpriced) == 0, known).alias("cost"),
    ]
    if last:
        aggs.append(F.max(_last_seen()).alias("_last"))
    return aggs


def _unpack(df: DataFrame, last: bool) -> DataFrame:
    if not last:
        return df
    return df.withColumns(
        {f"last_{n}": F.col(f"_last.{n}") for n in ("agent", "session", "path")}
    ).drop("_last")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Costs as doubles rounded at the edge; everything else untouched."""
    return df.withColumns({c: S.money(c, digits) for c in _MONEY if c in df.columns})


def totals(priced: DataFrame, last: bool = False) -> DataFrame:
    """One row; an empty window gives zeros and cost 0."""
    return rounded(_unpack(priced.agg(*metric_aggs(last)), last))


def by(priced: DataFrame, keys: Sequence[str], last: bool = True) -> DataFrame:
    return rounded(_unpack(priced.groupBy(*keys).agg(*metric_aggs(last)), last))


def by_model(priced: DataFrame, last: bool = True) -> DataFrame:
    keyed = priced.withColumn("key", S.model_key())
    return by(keyed, ["key"], last).withColumn("label", F.col("key"))


def by_agent(priced: DataFrame, last: bool = True) -> DataFrame:
    keyed = priced.withColumn("key", F.col("agent"))
    return by(keyed, ["key"], last).withColumn("label", F.col("key"))


def _with_first_label(keyed: DataFrame, label: Column, last: bool) -> DataFrame:
    first = F.min(F.struct("ts", "id", label.alias("label")))["label"].alias("label")
    grouped = keyed.groupBy("key").agg(*metric_aggs(last), first)
    return rounded(_unpack(grouped, last))


def project_label() -> Column:
    return F.when(F.col("project") == "", F.lit(NO_PROJECT)).otherwise(F.col("project"))


def by_project(priced: DataFrame, last: bool = True) -> DataFrame:
    """Spellings of one project fold together; the label is the first spelling seen."""
    return _with_first_label(priced.withColumn("key", S.project_key("project")), project_label(), last)


def session_label() -> Column:
    return F.coalesce("title", "session")


def by_session(priced: DataFrame, files: DataFrame, last: bool = True) -> DataFrame:
    """Key ``agent:session``; the label is the title of the first event's file."""
    titled = with_titles(priced, files).withColumn("key", F.concat_ws(":", "agent", "session"))
    return _with_first_label(titled, session_label(), last)


def by_day(priced: DataFrame, q: Query, last: bool = True) -> DataFrame:
    keyed = priced.withColumn("key", S.local_day("ts", q.time_zone, q.offset_minutes))
    start, end = S.day_bounds("key", q.time_zone, q.offset_minutes)
    return by(keyed, ["key"], last).withColumns(
        {"label": F.col("key"), "range_start": start, "range_end": end}
    )


def by_month(priced: DataFrame, q: Query, last: bool = True) -> DataFrame:
    keyed = priced.withColumn("key", S.local_month("ts", q.time_zone, q.offset_minutes))
    start, end = S.month_bounds("key", q.time_zone, q.offset_minutes)
    return by(keyed, ["key"], last).withColumns(
        {"label": F.col("key"), "range_start": start, "range_end": end}
    )


def bucket_width(q: Query) -> int:
    """The caller's width; else minutes up to a day, hours up to 31 days, then whole days with a bounded count."""
    if q.bucket_ms is not None:
        return q.bucket_ms
    span = q.end - q.start
    if span <= DAY:
        return MINUTE
    if span <= 31 * DAY:
        return HOUR
    return max(-(-span // (MAX_POINTS * DAY)), 1) * DAY


def series_spine(spark: SparkSession, q: Query) -> DataFrame:
    """Every bucket start of the range; at most about two thousand rows unless the caller sets a width."""
    width, shift = bucket_width(q), q.offset_minutes * MINUTE
    first = (q.start + shift) // width * width - shift
    return spark.range(first, q.end, width, 1).withColumnRenamed("id", "bucket")


def series(priced: DataFrame, q: Query) -> DataFrame:
    """Zero-filled buckets, aligned to the fixed offset (not to the IANA zone)."""
    width, shift = bucket_width(q), q.offset_minutes * MINUTE
    sums = priced.withColumn("bucket", S.bucket_floor("ts", width, shift)).groupBy("bucket").agg(
        *metric_aggs(last=False)
    )
    filled = series_spine(priced.sparkSession, q).join(sums, ["bucket"], "left")
    whole = [*TOKENS, "total_tokens", "events", "last_ts", "unpriced_events", "unpriced_tokens"]
    parts = ["known_cost", *[f"known_{p}" for p in PARTS]]
    fills = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in whole}
    fills |= {c: F.coalesce(c, F.lit(0.0)) for c in parts}
    empty = F.col("events").isNull()
    fills["cost"] = F.when(empty, F.lit(0.0)).otherwise(F.col("cost"))
    return rounded(filled.withColumns(fills))


# --- the whole dashboard from one pass ------------------------------------------------------

FOLDS = {
    ("agent", "session"): {"session": ("agent", "session"), "agent": ("agent",), "total": ()},
    ("day", "bucket"): {"series": ("bucket",), "day": ("day",), "month": ("month",)},
    ("model_key", "project_key"): {"model": ("model_key",), "project": ("project_key",)},
}
DIMENSIONS = tuple(name for groups in FOLDS.values() for name in groups)


def keyed_events(priced: DataFrame, files: DataFrame, q: Query) -> DataFrame:
    """Events with the columns that dashboard groups are keyed by."""
    shift = q.offset_minutes * MINUTE
    return with_titles(priced, files).withColumns(
        {
            "model_key": S.model_key(),
            "project_key": S.project_key("project"),
            "day": S.local_day("ts", q.time_zone, q.offset_minutes),
            "bucket": S.bucket_floor("ts", bucket_width(q), shift),
        }
    )


def _refold() -> list[Column]:
    """Summaries of summaries."""
    zero = F.lit(0.0)
    known = F.coalesce(F.sum("known_cost"), zero)
    return [
        *[S.saturating_sum(t, has_nulls=False).alias(t) for t in (*TOKENS, "total_tokens")],
        F.coalesce(F.sum("events"), F.lit(0).cast("bigint")).alias("events"),
        F.coalesce(F.max("last_ts"), F.lit(0).cast("bigint")).alias("last_ts"),
        known.alias("known_cost"),
        *[F.coalesce(F.sum(f"known_{p}"), zero).alias(f"known_{p}") for p in PARTS],
        F.coalesce(F.sum("unpriced_events"), F.lit(0).cast("bigint")).alias("unpriced_events"),
        S.saturating_sum("unpriced_tokens", has_nulls=False).alias("unpriced_tokens"),
        F.when(F.coalesce(F.sum("unpriced_events"), F.lit(0)) == 0, known).alias("cost"),
        F.max("_last").alias("_last"),
        F.min("_first").alias("_first"),
    ]


def dashboard_all(priced: DataFrame, files: DataFrame, q: Query) -> DataFrame:
    """All groupings of one window in long form: dimension, key, label, metrics.

    One aggregation folds the events by three pairs of columns with GROUPING SETS (``grouping`` tells a
    grouped-away column from a NULL key). The eight groupings are summaries of these folds, which
    are as small as the answer, so events and their texts are expanded threefold and not eightfold.
    """
    base = keyed_events(priced, files, q)
    first = F.min(
        F.struct("ts", "id", project_label().alias("project_label"), session_label().alias("session_label"))
    ).alias("_first")
    names = [n for cols in FOLDS for n in cols]
    folded = base.groupingSets([[F.col(c) for c in cols] for cols in FOLDS], *[F.col(n) for n in names]).agg(
        *metric_aggs(last=True), first, *[F.grouping(cols[0]).alias(f"_g_{cols[0]}") for cols in FOLDS]
    ).withColumn("month", F.substring("day", 1, 7))

    def entry(name: str, cols: tuple[str, ...]) -> Column:
        value = F.concat_ws(":", *[F.col(c).cast("string") for c in cols]) if cols else F.lit("")
        known = F.concat(*[F.col(c).isNull().cast("string") for c in cols]) if cols else F.lit("")
        return F.struct(F.lit(name).alias("dimension"), value.alias("key"), known.alias("nulls"))

    targets = None
    for cols, groups in FOLDS.items():
        entries = F.array(*[entry(name, by) for name, by in groups.items()])
        test = F.col(f"_g_{cols[0]}") == 0
        targets = F.when(test, entries) if targets is None else targets.when(test, entries)
    keys = ["dimension", "key", "nulls"]
    out = folded.withColumn("_t", F.explode(targets)).withColumns({k: F.col(f"_t.{k}") for k in keys}).groupBy(*keys).agg(*_refold())
    shown = {"project": F.col("_first.project_label"), "session": F.col("_first.session_label")}
    label = F.coalesce(*[F.when(F.col("dimension") == n, v) for n, v in shown.items()], F.col("key"))
    out = out.withColumn("label", label)
    return rounded(_unpack(out, True)).select("dimension", "key", "label", *METRICS, *LAST)


def dashboard(long_form: DataFrame, q: Query) -> dict[str, DataFrame]:
    """Splits one materialised :func:`dashboard_all` into its tables, so every table of an
    answer comes from the same snapshot. Calendar rows get bounds, the series is filled."""
    out = {
        name: long_form.where(F.col("dimension") == name).drop("dimension") for name in DIMENSIONS
    }
    for name, bounds in (("day", S.day_bounds), ("month", S.month_bounds)):
        start, end = bounds("key", q.time_zone, q.offset_minutes)
        out[name] = out[name].withColumns({"range_start": start, "range_end": end})
    spine = series_spine(long_form.sparkSession, q).select(F.col("bucket").cast("string").alias("key"))
    whole = {c: 0 for c in (*TOKENS, "total_tokens", "events", "last_ts", "unpriced_events", "unpriced_tokens")}
    filled = spine.join(out["series"].withColumn("_seen", F.lit(True)), ["key"], "left")
    filled = filled.withColumn("cost", F.when(F.col("_seen").isNull(), F.lit(0.0)).otherwise(F.col("cost")))
    out["series"] = filled.na.fill(
        whole | {"known_cost": 0.0} | {f"known_{p}": 0.0 for p in PARTS}
    ).withColumn("label", F.col("key")).drop("_seen")
    return out


# --- presentation of summaries ---------------------------------------------------------------


def with_shares(rows: DataFrame) -> DataFrame:
    """Share of usage and of cost; cost shares only exist when every cost is known.

    The grand totals are scalar subqueries over one aggregate row, not a join or a window over one partition.
    """
    grand = rows.agg(
        F.sum(F.col("total_tokens").cast("double")).alias("_tokens"),
        F.when(F.count_if(F.col("cost").isNull()) == 0, F.sum("cost")).alias("_cost"),
    )
    joined = rows.withColumns({"_tokens": grand.select("_tokens").scalar(), "_cost": grand.select("_cost").scalar()})
    usage = F.when(F.col("_tokens") > 0, F.col("total_tokens") / F.col("_tokens"))
    cost = F.when((F.col("_cost") > 0) & F.col("cost").isNotNull(), F.col("cost") / F.col("_cost"))
    return joined.withColumns({"usage_share": usage, "cost_share": cost}).drop("_tokens", "_cost")


DIGITS = 40
"""Numbers in labels compare by value up to so many digits."""


def label_order(label: str = "label") -> Column:
    """A label as people read it: by the Chinese collation, with runs of digits by value, so m2 comes before m10."""
    runs = F.regexp_extract_all(label, F.lit(r"(\d+|\D+)"), 1)
    value = lambda x: F.when(x.rlike(r"^\d"), F.lpad(F.regexp_replace(x, r"^0+(?=\d)", ""), DIGITS, "0")).otherwise(x)
    return F.collate(F.array_join(F.transform(runs, value), ""), "zh")


def sort_summaries(rows: DataFrame, column: str, descending: bool) -> DataFrame:
    """Unknown values stay last in both directions; equal values order by key. Labels order by :func:`label_order`."""
    computed = {
        "cache_hit_rate": S.cache_hit_rate(), "effective_price": S.effective_price(), "label": label_order(),
    }
    value = computed.get(column, F.col(column))
    order = value.desc_nulls_last() if descending else value.asc_nulls_last()
    return rows.orderBy(order, F.col("key").asc())


# --- per-file roll-ups ------------------------------------------------------------------------


def session_daily_rollup(raw_priced: DataFrame) -> DataFrame:
    """Usage per file and UTC day, in all and per model and project, in long form.

    Counts the rows of that file as read, not the elected winners. Input includes cache.
    """
    whole_input = S.total_tokens("input", "cached", "cache_write", F.lit(0).cast("bigint"))
    keyed = raw_priced.withColumn("day", S.local_day("ts", "UTC")).withColumn("_in", whole_input)
    aggs = [
        S.saturating_sum("_in").alias("input"), S.saturating_sum("cached").alias("cached"),
        S.saturating_sum("output").alias("output"), S.saturating_sum("reasoning").alias("reasoning"),
        S.saturating_sum(S.total_tokens()).alias("total_tokens"),
        S.money(F.coalesce(F.sum("cost"), F.lit(0.0))).alias("cost"),
        F.count_if(F.col("cost").isNull()).alias("unpriced_events"),
    ]
    cols = [F.col(c) for c in ("path", "day", "model", "project")]
    path, day, model, project = cols
    grouped = keyed.groupingSets([[path, day], [path, day, model], [path, day, project]], *cols).agg(
        *aggs, F.grouping("model").alias("_gm"), F.grouping("project").alias("_gp")
    )
    return grouped.select(
        "path", "day",
        F.when(F.col("_gm") == 0, "model").when(F.col("_gp") == 0, "project").otherwise("day").alias("dim"),
        F.when(F.col("_gm") == 0, F.col("model")).when(F.col("_gp") == 0, F.col("project")).otherwise(F.lit("")).alias("key"),
        "input", "cached", "output", "reasoning", "total_tokens", "cost", "unpriced_events",
    )


def nest_rollup(rollup: DataFrame) -> DataFrame:
    """The roll-up as one row per file and day with a map per dimension, for sinks."""
    packed = F.struct("input", "cached", "output", "reasoning", "total_tokens")

    def as_map(dim: str) -> Column:
        pairs = F.collect_list(F.when(F.col("dim") == dim, F.struct(F.col("key"), packed.alias("usage"))))
        return F.map_from_entries(pairs)

    day = F.max(F.when(F.col("dim") == "day", F.struct("input", "cached", "output", "reasoning", "total_tokens", "cost", "unpriced_events")))
    return rollup.groupBy("path", "day").agg(
        day.alias("usage"), as_map("model").alias("models"), as_map("project").alias("projects")
    )


def session_cost(raw_priced: DataFrame) -> DataFrame:
    """Cost of each file's own events; events without a price are left out."""
    return raw_priced.groupBy("path").agg(S.money(F.coalesce(F.sum("cost"), F.lit(0.0))).alias("cost"))


def session_hierarchy_totals(files: DataFrame, raw: DataFrame) -> DataFrame:
    """Tokens per listed file, zero when it has no event. Input includes both kinds of cache."""
    sums = raw.groupBy("path", "agent").agg(
        S.saturating_sum(S.total_tokens("input", "cached", "cache_write", F.lit(0).cast("bigint"))).alias("input"),
        S.saturating_sum("cached").alias("cached"), S.saturating_sum("output").alias("output"),
    )
    joined = files.select("path", "agent", "title").join(sums, ["path", "agent"], "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "path", "title", *[F.coalesce(c, zero).alias(c) for c in ("input", "cached", "output")]
    )


def tool_counts(activities: DataFrame) -> DataFrame:
    return activities.groupBy("name").agg(F.count(F.lit(1)).alias("calls"))
