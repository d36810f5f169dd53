"""Quota observations and credit requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S, variants as V
from .elect import distinct_observations, elect_first
from .ordered import LINES_PER_SLICE, change_points
from .query import Query, predicate, range_predicate

# Board sizes and window names.
BOARD_SIZE, HISTORY_SIZE = 100, 500
WINDOWS = ("primary", "secondary", "monthly")


def quota_change_only(obs: DataFrame) -> DataFrame:
    """Keeps an observation only when it differs from the one before it in file and session."""
    return change_points(obs, ["path", "session"], ["line"], "payload", LINES_PER_SLICE)


def latest_quotas(quota: DataFrame, q: Query, size: int = BOARD_SIZE) -> DataFrame:
    """Newest distinct observations before the end of the range; its start is ignored.

    Copies share their time, so no row older than the ``size`` newest distinct times can be among them: only
    times are compared first, and payloads only travel from there on.
    """
    seen = quota.where((F.col("agent") != S.CREDIT_AGENT) & (F.col("ts") < q.end))
    if q.agent is not None:
        seen = seen.where(F.col("agent") == q.agent)
    oldest = seen.select("ts").distinct().orderBy(F.col("ts").desc()).limit(size).agg(F.min("ts")).scalar()
    return distinct_observations(seen.where(F.col("ts") >= oldest)).orderBy(F.col("ts").desc(), "agent", "session", "payload").limit(size)


def quota_selection(quota: DataFrame, q: Query) -> DataFrame:
    seen = quota.where((F.col("agent") != S.CREDIT_AGENT) & range_predicate(q))
    if q.agent is not None:
        seen = seen.where(F.col("agent") == q.agent)
    if q.session is not None:
        seen = seen.where(F.col("session") == q.session)
    return distinct_observations(seen)


def quota_history(quota: DataFrame, q: Query, size: int = HISTORY_SIZE) -> tuple[DataFrame, DataFrame]:
    """(one-row total, newest observations of the range)."""
    chosen = quota_selection(quota, q)
    newest = chosen.orderBy(F.col("ts").desc(), "session", "agent", "payload").limit(size)
    return chosen.agg(F.count(F.lit(1)).alias("total")), newest


def quota_windows(obs: DataFrame) -> DataFrame:
    """One row per window an observation reports."""
    v = F.col("_v")

    def window(key: str) -> Column:
        minutes, used = V.number_at(v, f"{key}.window_minutes"), V.number_at(v, f"{key}.used_percent")
        number = V.number_at(v, f"{key}.resets_at")
        reset = F.coalesce(
            F.when(number < 1e11, number * 1000.0).otherwise(number),
            V.rfc3339_ms(V.text_at(v, f"{key}.resets_at")).cast("double"),
        )
        present = V.is_object(v, key)
        return F.when(
            present,
            F.struct(
                F.lit(key).alias("window"),
                F.when(minutes > 0, minutes).alias("minutes"),
                used.alias("used"),
                F.when(used.isNotNull(), F.least(F.greatest(100.0 - used, F.lit(0.0)), F.lit(100.0))).alias("remaining"),
                F.when(reset > 0, reset.cast("bigint")).alias("reset_ms"),
            ),
        )

    rows = obs.withColumn("_v", V.parse("payload"))
    found = F.array_compact(F.array(*[window(k) for k in WINDOWS]))
    return rows.withColumn("_w", F.explode(found)).select(*obs.columns, "_w.*")


def quota_history_rows(obs: DataFrame, key: str = "all") -> DataFrame:
    """Window readings of the observations; an unknown key gives no rows."""
    rows = quota_windows(obs)
    return rows if key == "all" else rows.where(F.col("window") == key)


def latest_per_agent(obs: DataFrame) -> DataFrame:
    """The newest observation of each agent that reports at least one window."""
    v = F.col("_v")
    any_window = V.is_object(v, WINDOWS[0]) | V.is_object(v, WINDOWS[1]) | V.is_object(v, WINDOWS[2])
    reporting = obs.withColumn("_v", V.parse("payload")).where(any_window)
    newest = F.max(F.struct("ts", "session", "payload")).alias("_n")
    return reporting.groupBy("agent").agg(newest).select("agent", "_n.*")


# --- credits ---------------------------------------------------------------------------------


def credit_requests(credits: DataFrame, q: Query) -> DataFrame:
    """One row per request: elected over all copies first, filtered by the query after."""
    out = elect_first(credits.where("request_id IS NOT NULL")).where(predicate(q))
    if q.search:
        hay = F.lower(F.concat_ws(" ", "model", "project", "session"))
        out = out.where(F.contains(hay, F.lower(F.lit(q.search))))
    return out


def _strict_sum(c: str) -> Column:
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def _model_maps(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Requests and credits per model as maps; per-model sums come first, so the collected
    list is as long as the number of models of the session."""
    named = F.coalesce(F.nullif("model", F.lit("")), F.lit(S.UNKNOWN_MODEL))
    per = requests.withColumn("_m", named).groupBy(*keys, "_m").agg(
        F.sum(F.when(F.col("model") != "", F.col("requests"))).alias("n"),
        F.sum(F.when(F.col("credits") >= 0, F.col("credits"))).alias("c"),
    )
    return per.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("_m", "n"))))).alias("models"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("_m", "c"))))).alias("model_credits"),
    )


def credit_by_session(requests: DataFrame) -> DataFrame:
    """Strict sums: a total is NULL as soon as one request did not report the number."""
    newest = F.max(F.struct("ts", "request_id", "project", "model"))
    sums = requests.groupBy("session").agg(
        _strict_sum("requests").alias("requests"), _strict_sum("credits").alias("credits"),
        _strict_sum("original_credits").alias("original_credits"),
        _strict_sum("billable_requests").alias("billable_requests"),
        F.when(F.count("context_usage_ratio") == F.count(F.lit(1)), F.max("context_usage_ratio")).alias("context_usage_ratio"),
        F.max("ts").alias("last_ts"), newest["project"].alias("project"),
    )
    return sums.join(_model_maps(requests, ["session"]), ["session"], "left")


def credit_windows(requests: DataFrame) -> DataFrame:
    """Lenient sums: unknown numbers are skipped, NULL only when none is known."""
    known = requests.where("(credits IS NOT NULL OR requests IS NOT NULL) AND session != ''")
    first_project = F.min_by("project", F.when(F.col("project") != "", F.struct(-F.col("ts"), "request_id")))
    return known.groupBy("agent", "session").agg(
        F.max("ts").alias("ts"), first_project.alias("project"),
        F.sum("requests").alias("requests"), F.sum("credits").alias("credits"),
        F.sum("original_credits").alias("original_credits"),
        F.sum("billable_requests").alias("billable_requests"),
        F.max("context_usage_ratio").alias("context_usage_ratio"),
    )


def credit_window_order(windows: DataFrame) -> DataFrame:
    return windows.orderBy(F.col("ts").desc(), "agent", "session")


def credit_by_model(requests: DataFrame) -> DataFrame:
    """Requests and credits per agent and model; credits are NULL when none was reported."""
    named = F.coalesce(F.nullif("model", F.lit("")), F.lit(S.UNKNOWN_MODEL))
    return requests.withColumn("_m", named).groupBy("agent", F.col("_m").alias("model")).agg(
        F.coalesce(F.sum(F.when(F.col("model") != "", F.col("requests"))), F.lit(0).cast("bigint")).alias("requests"),
        F.sum(F.when(F.col("credits") >= 0, F.col("credits"))).alias("credits"),
    )


def quota_board(latest: DataFrame, credit_sessions: DataFrame) -> DataFrame:
    """Quota observations of ordinary agents beside the credit summary of the credit agent."""
    payload = F.to_json(F.struct("requests", "credits", "original_credits"))
    credit_rows = credit_sessions.select(
        F.lit(S.CREDIT_AGENT).alias("agent"), "session", F.col("last_ts").alias("ts"), payload.alias("payload")
    )
    return latest.select("agent", "session", "ts", "payload").unionByName(credit_rows)
