"""Report queries: filters, joins, groupings, pages, quotas and credits."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import (
    elect as E, pages, prices as P, query as Q, quotas as K, summaries as R,
)
from .inputs import END, LAST_SQL, METRIC_SQL, START, USD_CNY, WINDOW, r6
from .registry import query

CENTS = "cost_input, cost_cached, cost_cache_write, cost_output"
_ROW = "id, agent, session, project, model, ts, input, cached, cache_write, output, reasoning"
_PAGE_SQL = f"SELECT {_ROW}, path FROM {{usage_events}}"


def _money(df, *names):
    return df.withColumns({n: S.money(n) for n in names})


# --- filters -----------------------------------------------------------------------------------

_MID = replace(WINDOW, start=1704844800000, end=1705276800000)


def _filtered(t, q):
    return Q.select_events(t.usage_events, q, t.source_files).select(*_ROW.split(", "), "path")


@query("filter_range", _PAGE_SQL + " WHERE ts >= 1704844800000 AND ts < 1705276800000")
def filter_range(t):
    return _filtered(t, _MID)


@query("filter_agent", _PAGE_SQL + f" WHERE ts >= {START} AND ts < {END} AND agent = 'opencode'")
def filter_agent(t):
    return _filtered(t, replace(WINDOW, agent="opencode"))


@query("filter_session", _PAGE_SQL + f" WHERE ts >= {START} AND ts < {END} AND session = 's8-2024-01-01'")
def filter_session(t):
    return _filtered(t, replace(WINDOW, session="s8-2024-01-01"))


@query("filter_model", _PAGE_SQL + f" WHERE ts >= {START} AND ts < {END} AND agent = 'qoder' AND model = 'unknown'")
def filter_model(t):
    return _filtered(t, replace(WINDOW, model=S.UNATTRIBUTED_MODEL))


@query("filter_model_unknown", _PAGE_SQL + f" WHERE ts >= {START} AND ts < {END} AND agent <> 'qoder' AND model = 'unknown'")
def filter_model_unknown(t):
    return _filtered(t, replace(WINDOW, model="unknown"))


@query("filter_project", _PAGE_SQL + f" WHERE ts >= {START} AND ts < {END} AND project IN ('C:\\Work\\App', 'c:/work/app/')")
def filter_project(t):
    return _filtered(t, replace(WINDOW, project="C:/WORK/app"))


@query("filter_search", f"""
SELECT {", ".join("e." + c for c in _ROW.split(", "))}, e.path FROM {{usage_events}} e
LEFT JOIN {{source_files}} f ON f.path = e.path AND f.agent = e.agent
WHERE e.ts >= {START} AND e.ts < {END}
 AND contains(lower(e.model || ' ' || e.project || ' ' || e.session || ' ' || coalesce(f.title, '')), 'title s1')""")
def filter_search(t):
    return _filtered(t, replace(WINDOW, search="Title S1"))


@query("disable_agents", _PAGE_SQL + " WHERE agent NOT IN ('qoder', 'codex')")
def disable_agents(t):
    return Q.disable_agents(t.usage_events, ["qoder", "codex"]).select(*_ROW.split(", "), "path")


@query("event_projection", f"SELECT {_ROW}, input + cached + cache_write + output AS total_tokens, path, {r6('cost')} AS cost FROM {{priced}}")
def event_projection(t):
    return _money(Q.event_rows(t.priced), "cost")


# --- pricing joins ----------------------------------------------------------------------------


@query("asof_price_join", f"SELECT id, agent, model, ts, {', '.join(r6(p) + ' AS ' + p for p in P.PARTS)}, {r6('cost')} AS cost FROM {{priced}}")
def asof_price_join(t):
    return _money(t.priced.select("id", "agent", "model", "ts", *P.PARTS, "cost"), *P.PARTS, "cost")


@query("alias_join", "SELECT e.id, e.agent, e.model, coalesce(a.model, e.model) AS billing_model FROM {usage_events} e LEFT JOIN {aliases} a ON a.alias = e.model")
def alias_join(t):
    return P.resolve_alias(t.usage_events, t.aliases).select("id", "agent", "model", "billing_model")


@query("title_join", "SELECT e.id, e.agent, e.path, f.title FROM {usage_events} e LEFT JOIN {source_files} f ON f.path = e.path AND f.agent = e.agent")
def title_join(t):
    return Q.with_titles(t.usage_events, t.source_files).select("id", "agent", "path", "title")


@query("mtime_join", "SELECT c.id, c.agent, c.path, c.ts, coalesce(f.mtime, 0) AS mtime FROM {usage_copies} c LEFT JOIN {source_files} f ON f.path = c.path AND f.agent = c.agent")
def mtime_join(t):
    return E.with_mtime(t.raw_events, t.source_files).select("id", "agent", "path", "ts", "mtime")


@query("rate_intervals", "SELECT model, currency, from_ms, to_ms FROM {spans} WHERE model IN (SELECT model FROM {usage_events} UNION SELECT a.model FROM {aliases} a)")
def rate_intervals(t):
    used = t.usage_events.select("model").unionByName(t.aliases.select("model")).dropDuplicates()
    return P.rate_intervals(t.rates).join(used, ["model"], "left_semi").select("model", "currency", "from_ms", "to_ms")


@query("price_catalog", """
SELECT m.model, s.currency, s.ri AS input, s.rc AS cached, s.rw AS cache_write, s.ro AS output, s.from_ms,
 coalesce(a.alias, '') AS aliases FROM (SELECT DISTINCT model FROM {rates}) m
LEFT JOIN {spans} s ON s.model = m.model AND s.from_ms <= (SELECT min(ts) FROM {usage_raw}) AND s.to_ms > (SELECT min(ts) FROM {usage_raw})
LEFT JOIN {aliases} a ON a.model = m.model""")
def price_catalog(t):
    first = t.usage_raw.agg(F.min("ts").alias("t")).first()["t"]
    return P.price_catalog(t.rates, t.aliases, first)


# --- groupings -----------------------------------------------------------------------------------


def _group_sql(key: str, label: str, more: str = "", group: str | None = None) -> str:
    return f"SELECT {key} AS key, {label} AS label, {METRIC_SQL}, {LAST_SQL}{more} FROM {{keyed}} GROUP BY {group or key}"


_FIRST = "min(struct_pack(ts := ts, id := id, v := {c})).v"
_DAY_MS = "epoch_ms(CAST({d} AS TIMESTAMP)) - 28800000"


@query("totals", f"SELECT {METRIC_SQL} FROM {{priced}}")
def totals(t):
    return R.totals(t.priced)


@query("totals_empty", f"SELECT {METRIC_SQL} FROM {{priced_all}} WHERE ts < 0")
def totals_empty(t):
    return R.totals(t.price(t.usage_events.where("ts < 0")))


@query("by_model", _group_sql("model_key", "model_key"))
def by_model(t):
    return R.by_model(t.priced)


@query("by_project", _group_sql("project_key", _FIRST.format(c="project_label")))
def by_project(t):
    return R.by_project(t.priced)


@query("by_agent", _group_sql("agent", "agent"))
def by_agent(t):
    return R.by_agent(t.priced)


@query("by_session", _group_sql("agent || ':' || session", _FIRST.format(c="session_label")))
def by_session(t):
    return R.by_session(t.priced, t.source_files)


@query("by_day", _group_sql("day", "day", f", {_DAY_MS.format(d='day')} AS range_start, {_DAY_MS.format(d='day')} + 86400000 AS range_end"))
def by_day(t):
    return R.by_day(t.priced, WINDOW)


@query("by_month", _group_sql("month", "month", ", epoch_ms(CAST(month || '-01' AS TIMESTAMP)) - 28800000 AS range_start, epoch_ms(CAST(month || '-01' AS TIMESTAMP) + INTERVAL 1 MONTH) - 28800000 AS range_end"))
def by_month(t):
    return R.by_month(t.priced, WINDOW)


_SERIES_ZERO = ", ".join(
    f"coalesce(s.{c}, 0) AS {c}" for c in R.METRICS if c != "cost"
)


@query("series", f"""
SELECT g.bucket, {_SERIES_ZERO}, CASE WHEN s.bucket IS NULL THEN CAST(0 AS DOUBLE) ELSE s.cost END AS cost
FROM (SELECT unnest(generate_series({START}, {END} - 1, 3600000)) AS bucket) g
LEFT JOIN (SELECT bucket, {METRIC_SQL} FROM {{keyed}} GROUP BY bucket) s ON s.bucket = g.bucket""")
def series(t):
    return R.series(t.priced, WINDOW)


def _dash_sql(dimension: str, key: str, label: str, group: str) -> str:
    return f"SELECT '{dimension}' AS dimension, {key} AS key, {label} AS label, {METRIC_SQL}, {LAST_SQL} FROM {{keyed}}{group}"


@query("dashboard_all", " UNION ALL ".join([
    _dash_sql("total", "''", "''", ""),
    _dash_sql("model", "model_key", "model_key", " GROUP BY model_key"),
    _dash_sql("project", "project_key", _FIRST.format(c="project_label"), " GROUP BY project_key"),
    _dash_sql("agent", "agent", "agent", " GROUP BY agent"),
    _dash_sql("session", "agent || ':' || session", _FIRST.format(c="session_label"), " GROUP BY agent, session"),
    _dash_sql("day", "day", "day", " GROUP BY day"),
    _dash_sql("month", "month", "month", " GROUP BY month"),
    _dash_sql("series", "CAST(bucket AS VARCHAR)", "CAST(bucket AS VARCHAR)", " GROUP BY bucket"),
]))
def dashboard_all(t):
    return R.dashboard_all(t.priced, t.source_files, WINDOW)


@query("cost_nullable", f"SELECT model_key AS key, CASE WHEN count(*) FILTER (cost IS NULL) = 0 THEN {r6('sum(cost)')} END AS cost FROM {{keyed}} GROUP BY model_key")
def cost_nullable(t):
    return R.by_model(t.priced, last=False).select("key", "cost")


@query("known_cost", f"SELECT agent AS key, {r6('coalesce(sum(cost), 0)')} AS known_cost FROM {{priced}} GROUP BY agent")
def known_cost(t):
    return R.by_agent(t.priced, last=False).select("key", "known_cost")


@query("cost_components", f"SELECT model_key AS key, {', '.join(r6(f'coalesce(sum({p}), 0)') + ' AS known_' + p for p in P.PARTS)} FROM {{keyed}} GROUP BY model_key")
def cost_components(t):
    return R.by_model(t.priced, last=False).select("key", *[f"known_{p}" for p in P.PARTS])


@query("unpriced_counts", "SELECT project_key AS key, count(*) FILTER (cost IS NULL) AS unpriced_events, CAST(coalesce(sum(input + cached + cache_write + output) FILTER (cost IS NULL), 0) AS BIGINT) AS unpriced_tokens FROM {keyed} GROUP BY project_key")
def unpriced_counts(t):
    keyed = t.priced.withColumn("key", S.project_key("project"))
    return R.by(keyed, ["key"], last=False).select("key", "unpriced_events", "unpriced_tokens")


@query("saturating_sum", """
SELECT agent, CAST(least(sum(CAST(big AS HUGEINT)), 9223372036854775807) AS BIGINT) AS saturated,
 CAST(least(sum(CAST(input AS HUGEINT)), 9223372036854775807) AS BIGINT) AS plain
FROM (SELECT *, CASE WHEN agent = 'codex' THEN 9223372036854775807 - input ELSE input END AS big FROM {usage_raw}) x GROUP BY agent""")
def saturating_sum(t):
    big = F.when(F.col("agent") == "codex", F.lit(S.MAX_LONG) - F.col("input")).otherwise(F.col("input"))
    return t.usage_raw.withColumn("big", big).groupBy("agent").agg(
        S.saturating_sum("big").alias("saturated"), S.saturating_sum("input").alias("plain")
    )


# --- activities -----------------------------------------------------------------------------------

_BY_MODEL = replace(WINDOW, model="m-cny")
_SEMI_SQL = f"""SELECT a.id, a.agent, a.session, a.ts, a.name FROM {{activities}} a WHERE a.ts >= {START} AND a.ts < {END}
 AND EXISTS (SELECT 1 FROM {{usage_events}} e WHERE e.agent = a.agent AND e.session = a.session
   AND e.ts >= {START} AND e.ts < {END} AND e.model = 'm-cny')"""


@query("activity_semi", _SEMI_SQL)
def activity_semi(t):
    return Q.select_activities(t.activities, t.usage_events, _BY_MODEL)


@query("tool_counts", f"SELECT name, count(*) AS calls FROM ({_SEMI_SQL}) x GROUP BY name")
def tool_counts(t):
    return R.tool_counts(Q.select_activities(t.activities, t.usage_events, _BY_MODEL))


# --- pages and order --------------------------------------------------------------------------------


@query("event_page", f"{_PAGE_SQL} WHERE ts >= {START} AND ts < {END} ORDER BY ts DESC, agent, id LIMIT 100 OFFSET 200")
def event_page(t):
    events = Q.select_events(t.usage_events, WINDOW).select(*_ROW.split(", "), "path")
    return pages.event_page(events, 200, 100)[1]


@query("event_page_total", f"SELECT count(*) AS total FROM {{usage_events}} WHERE ts >= {START} AND ts < {END}")
def event_page_total(t):
    return pages.event_page(Q.select_events(t.usage_events, WINDOW))[0]


_TIED = "ts - ts % 3600000 AS ts"
_TIED_ROW = _ROW.replace("ts", _TIED)


@query("event_page_after", f"""WITH e AS (SELECT {_TIED_ROW}, path FROM {{usage_events}} WHERE ts >= {START} AND ts < {END}),
n AS (SELECT *, row_number() OVER (ORDER BY ts DESC, agent, id) AS r, count(*) OVER (PARTITION BY ts) AS c FROM e),
c AS (SELECT min(r) AS r FROM n WHERE r > 40 AND c > 4)
SELECT {_ROW}, path FROM n WHERE r > (SELECT r FROM c) ORDER BY r LIMIT 100""")
def event_page_after(t):
    """Pages by whole hours, so that the cursor, the first crowded row behind the newest 40, stands among rows of its own time."""
    rows = Q.select_events(t.usage_events, WINDOW).withColumn("ts", F.expr("ts - ts % 3600000"))
    rows = rows.select(*_ROW.split(", "), "path")
    crowded = rows.groupBy("ts").agg(F.count("*").alias("c")).where("c > 4")
    key = lambda found: (found[-1]["ts"], found[-1]["agent"], found[-1]["id"]) if found else None
    newest = pages.newest_first(rows).limit(40).collect()
    first = pages.page_after(rows.join(crowded, "ts", "left_semi"), key(newest), 1).collect()
    return pages.page_after(rows, key(first), 100) if first else rows.limit(0)


@query("event_page_deep", f"""SELECT {_ROW} FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, agent, id) AS r, count(*) OVER () AS n FROM {{usage_events}} WHERE ts >= {START} AND ts < {END}) x
 WHERE r BETWEEN 201 AND 300 OR r BETWEEN n // 2 + 1 AND n // 2 + 100 OR r > n - 100""")
def event_page_deep(t):
    """Three pages of a table kept in page order: an early one, one in the middle, the last."""
    kept = pages.in_order(Q.select_events(t.usage_events, WINDOW).select(*_ROW.split(", ")), rows_per_range=5_000)
    offsets = (200, kept.total // 2, max(0, kept.total - 100))
    return reduce(lambda a, b: a.unionByName(b), [pages.page_at(t.spark, kept, o, 100) for o in offsets]).distinct()


@query("activity_page", f"{_SEMI_SQL} ORDER BY a.ts DESC, a.agent, a.id LIMIT 50 OFFSET 10")
def activity_page(t):
    return pages.activity_page(Q.select_activities(t.activities, t.usage_events, _BY_MODEL), 10, 50)[1]


@query("export_order", f"SELECT id, ts FROM {{usage_events}} WHERE ts >= {START} AND ts < {END} ORDER BY ts, id")
def export_order(t):
    return pages.export_rows(Q.select_events(t.usage_events, WINDOW)).select("id", "ts")


@query("sort_summaries", f"""SELECT key, cost FROM (SELECT model_key AS key, CASE WHEN count(*) FILTER (cost IS NULL) = 0 THEN {r6('sum(cost)')} END AS cost
 FROM {{keyed}} GROUP BY model_key) s ORDER BY cost DESC NULLS LAST, key""")
def sort_summaries(t):
    return R.sort_summaries(R.by_model(t.priced, last=False), "cost", descending=True).select("key", "cost")


# --- shares and rates --------------------------------------------------------------------------------

_MODEL_SUMS = f"SELECT model_key AS key, {METRIC_SQL} FROM {{keyed}} GROUP BY model_key"


@query("cache_hit_rate", f"SELECT key, {r6('CAST(cached AS DOUBLE) / nullif(input + cached + cache_write, 0)')} AS cache_hit_rate FROM ({_MODEL_SUMS}) s")
def cache_hit_rate(t):
    return R.by_model(t.priced, last=False).select("key", S.money(S.cache_hit_rate()).alias("cache_hit_rate"))


@query("effective_price", f"SELECT key, {r6('cost / nullif(CAST(total_tokens AS DOUBLE), 0) * 1e6')} AS effective_price FROM ({_MODEL_SUMS}) s")
def effective_price(t):
    return R.by_model(t.priced, last=False).select("key", S.money(S.effective_price()).alias("effective_price"))


@query("component_prices", "SELECT key, " + ", ".join(
    r6(f"CASE WHEN cost IS NOT NULL THEN known_cost_{c} / nullif(CAST({c} AS DOUBLE), 0) * 1e6 END") + f" AS price_{c}"
    for c in ("input", "cached", "cache_write", "output")) + f" FROM ({_MODEL_SUMS}) s")
def component_prices(t):
    rows = R.by_model(t.priced, last=False)
    return rows.select("key", *[
        S.money(S.component_price("cost", f"known_cost_{c}", c)).alias(f"price_{c}")
        for c in ("input", "cached", "cache_write", "output")
    ])


@query("usage_share", f"SELECT key, {r6('total_tokens / CAST(nullif((SELECT sum(total_tokens) FROM m), 0) AS DOUBLE)')} AS usage_share FROM m".join(
    [f"WITH m AS ({_MODEL_SUMS}) ", ""]))
def usage_share(t):
    rows = R.with_shares(R.by_model(t.priced, last=False))
    return rows.select("key", S.money("usage_share").alias("usage_share"))


_ALL_AGENTS = f"SELECT agent AS key, {METRIC_SQL} FROM {{priced}} GROUP BY agent"


@query("cost_share", f"WITH m AS ({_ALL_AGENTS}) SELECT key, {r6('CASE WHEN (SELECT count(*) FROM m WHERE cost IS NULL) = 0 THEN cost / (SELECT sum(cost) FROM m) END')} AS cost_share FROM m")
def cost_share(t):
    """Events without a price leave every share unknown."""
    rows = R.with_shares(R.by_agent(t.priced, last=False))
    return rows.select("key", S.money("cost_share").alias("cost_share"))


_PRICED_AGENTS = f"SELECT agent AS key, {METRIC_SQL} FROM {{priced}} WHERE cost IS NOT NULL GROUP BY agent"


@query("cost_share_priced", f"WITH m AS ({_PRICED_AGENTS}) SELECT key, {r6('cost / (SELECT sum(cost) FROM m)')} AS cost_share FROM m")
def cost_share_priced(t):
    rows = R.with_shares(R.by_agent(t.priced.where("cost IS NOT NULL"), last=False))
    return rows.select("key", S.money("cost_share").alias("cost_share"))


# --- per-file roll-ups ---------------------------------------------------------------------------------

_ROLL = f"""CAST(sum(input + cached + cache_write) AS BIGINT) AS input, CAST(sum(cached) AS BIGINT) AS cached,
 CAST(sum(output) AS BIGINT) AS output, CAST(sum(reasoning) AS BIGINT) AS reasoning,
 CAST(sum(input + cached + cache_write + output) AS BIGINT) AS total_tokens, {r6('coalesce(sum(cost), 0)')} AS cost,
 count(*) FILTER (cost IS NULL) AS unpriced_events FROM d"""


@query("session_daily_rollup", f"""
WITH d AS (SELECT *, strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS day FROM {{raw_priced}})
SELECT path, day, 'day' AS dim, '' AS key, {_ROLL} GROUP BY path, day
UNION ALL SELECT path, day, 'model', model, {_ROLL} GROUP BY path, day, model
UNION ALL SELECT path, day, 'project', project, {_ROLL} GROUP BY path, day, project""")
def session_daily_rollup(t):
    return R.session_daily_rollup(t.raw_priced)


@query("session_cost", f"SELECT path, {r6('coalesce(sum(cost), 0)')} AS cost FROM {{raw_priced}} GROUP BY path")
def session_cost(t):
    return R.session_cost(t.raw_priced)


_HIER = """SELECT f.path, f.title, CAST(coalesce(sum(r.input + r.cached + r.cache_write), 0) AS BIGINT) AS input,
 CAST(coalesce(sum(r.cached), 0) AS BIGINT) AS cached, CAST(coalesce(sum(r.output), 0) AS BIGINT) AS output
FROM {source_files} f LEFT JOIN {raw_events} r ON r.path = f.path AND r.agent = f.agent
GROUP BY f.path, f.title"""


@query("session_hierarchy_totals", _HIER)
def session_hierarchy_totals(t):
    return R.session_hierarchy_totals(t.source_files, t.raw_events)


@query("files_events_agg_join", f"SELECT path, input + output AS tokens FROM ({_HIER}) h")
def files_events_agg_join(t):
    rows = R.session_hierarchy_totals(t.source_files, t.raw_events)
    return rows.select("path", (F.col("input") + F.col("output")).alias("tokens"))


# --- quotas ----------------------------------------------------------------------------------------------

_OBS = "agent, session, ts, payload"


@query("distinct_observations", f"SELECT DISTINCT {_OBS} FROM {{quota}}")
def distinct_observations(t):
    return E.distinct_observations(t.quota)


@query("snapshot_distinct_count", f"SELECT count(*) AS total FROM (SELECT DISTINCT {_OBS} FROM {{quota}} WHERE ts >= {START} AND ts < {END})")
def snapshot_distinct_count(t):
    return K.quota_history(t.quota, WINDOW)[0]


_LATEST = f"SELECT * FROM (SELECT DISTINCT {_OBS} FROM {{quota}} WHERE ts < 1706000000000) x ORDER BY ts DESC, agent, session, payload LIMIT 100"


@query("latest_quotas", _LATEST)
def latest_quotas(t):
    return K.latest_quotas(t.quota, replace(WINDOW, end=1706000000000))


@query("latest_per_agent", "SELECT agent, s.ts, s.session, s.payload FROM (SELECT agent, max(struct_pack(ts := ts, session := session, payload := payload)) AS s FROM {quota} GROUP BY agent) x")
def latest_per_agent(t):
    return K.latest_per_agent(E.distinct_observations(t.quota))


@query("quota_history", f"SELECT * FROM (SELECT DISTINCT {_OBS} FROM {{quota}} WHERE ts >= {START} AND ts < {END} AND agent = 'codex') x ORDER BY ts DESC, session, agent, payload LIMIT 500")
def quota_history(t):
    return K.quota_history(t.quota, replace(WINDOW, agent="codex"))[1]


def _window_sql(key: str, minutes: int) -> str:
    field = lambda f: f"CAST(json_extract_string(payload, '$.{key}.{f}') AS DOUBLE)"
    return f"""SELECT agent, session, ts, '{key}' AS "window", CAST({minutes} AS DOUBLE) AS minutes, {field('used_percent')} AS used,
 100 - {field('used_percent')} AS remaining, CAST({field('resets_at')} * 1000 AS BIGINT) AS reset_ms FROM (SELECT DISTINCT {_OBS} FROM {{quota}}) x"""


@query("quota_windows", _window_sql("primary", 300) + " UNION ALL " + _window_sql("secondary", 10080))
def quota_windows(t):
    return K.quota_windows(E.distinct_observations(t.quota)).drop("payload")


@query("quota_history_rows", _window_sql("secondary", 10080))
def quota_history_rows(t):
    return K.quota_history_rows(E.distinct_observations(t.quota), "secondary").drop("payload")


@query("minutes_to_reset", f"""SELECT agent, session, ts, CASE WHEN reset_ms <= ts + 7200000 THEN 0 ELSE CAST(ceil((reset_ms - ts - 7200000) / 60000.0) AS BIGINT) END AS minutes_left
 FROM ({_window_sql("primary", 300)}) w""")
def minutes_to_reset(t):
    rows = K.quota_history_rows(E.distinct_observations(t.quota), "primary")
    return rows.select("agent", "session", "ts", S.minutes_to_reset(F.col("ts") + 7200000, "reset_ms").alias("minutes_left"))


# --- credits -------------------------------------------------------------------------------------------------

_FIRST_REQ = "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY agent, request_id ORDER BY ts, path) AS rn FROM {credits}) WHERE rn = 1"
_REQ = f"SELECT * FROM ({_FIRST_REQ}) f WHERE ts >= {START} AND ts < {END} AND agent = 'qoder'"
_CREDIT = replace(WINDOW, agent=S.CREDIT_AGENT)


@query("elect_earliest_request", _FIRST_REQ)
def elect_earliest_request(t):
    return E.elect_first(t.credits)


@query("rank_earliest", "SELECT agent, request_id, min(ts) AS ts FROM {credits} GROUP BY agent, request_id")
def rank_earliest(t):
    return E.elect_first(t.credits).select("agent", "request_id", "ts")


def _strict(c: str) -> str:
    return f"CASE WHEN count({c}) = count(*) THEN sum({c}) END"


_BY_SESSION = f"""SELECT session, CAST({_strict('requests')} AS BIGINT) AS requests, {_strict('credits')} AS credits,
 {_strict('original_credits')} AS original_credits, CAST({_strict('billable_requests')} AS BIGINT) AS billable_requests,
 CASE WHEN count(context_usage_ratio) = count(*) THEN max(context_usage_ratio) END AS context_usage_ratio,
 max(ts) AS last_ts, max(struct_pack(ts := ts, r := request_id, p := project)).p AS project FROM ({_REQ}) q GROUP BY session"""


@query("credit_by_session", f"""SELECT s.*, m.models FROM ({_BY_SESSION}) s JOIN (SELECT session, string_agg(model || '=' || n, ',' ORDER BY model) AS models
 FROM (SELECT session, model, count(*) AS n FROM ({_REQ}) q GROUP BY session, model) x GROUP BY session) m ON m.session = s.session""")
def credit_by_session(t):
    rows = K.credit_by_session(K.credit_requests(t.credits, _CREDIT))
    text = F.transform(F.map_entries("models"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return rows.withColumn("models", F.array_join(text, ",")).drop("model_credits")


@query("credit_windows", f"""SELECT agent, session, max(ts) AS ts, min(struct_pack(t := -ts, r := request_id, p := project)) FILTER (project <> '').p AS project,
 CAST(sum(requests) AS BIGINT) AS requests, sum(credits) AS credits, sum(original_credits) AS original_credits,
 CAST(sum(billable_requests) AS BIGINT) AS billable_requests, max(context_usage_ratio) AS context_usage_ratio FROM ({_REQ}) q GROUP BY agent, session""".replace(
    "min(struct_pack(t := -ts, r := request_id, p := project)) FILTER (project <> '').p", "(min(struct_pack(t := -ts, r := request_id, p := project)) FILTER (project <> '')).p"))
def credit_windows(t):
    return K.credit_windows(K.credit_requests(t.credits, _CREDIT))


@query("credit_by_model", f"SELECT agent, model, CAST(sum(requests) AS BIGINT) AS requests, sum(credits) AS credits FROM ({_REQ}) q GROUP BY agent, model")
def credit_by_model(t):
    return K.credit_by_model(K.credit_requests(t.credits, _CREDIT))


@query("union_boards", f"SELECT agent, session, ts FROM ({_LATEST}) l UNION ALL SELECT 'qoder', session, last_ts FROM ({_BY_SESSION}) s")
def union_boards(t):
    latest = K.latest_quotas(t.quota, replace(WINDOW, end=1706000000000))
    sessions = K.credit_by_session(K.credit_requests(t.credits, _CREDIT))
    return K.quota_board(latest, sessions).drop("payload")
