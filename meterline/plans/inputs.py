"""Engine tables derived from the test tables, in one SQL text for Spark and for the oracle.

``{X}`` marks the few spots where the two dialects differ. Each view only names tables or
views before it. Sessions, copies, quotas and credits all grow with the events table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars as S
from ..operators import elect as E, prices as P, summaries as R
from ..operators.query import Query, select_events
from ..session import ensure_session

USD_CNY = 6.7521
START, END = 1704067200000, 1706659200000
WINDOW = Query(START, END, offset_minutes=480, time_zone="Asia/Shanghai")

_SPARK = {
    "S": "STRING", "LB": "{{", "RB": "}}", "BS": "\\\\", "DIV": "div",
    "MS": "unix_millis(CAST(ts AS TIMESTAMP))", "K": "get_json_object(props, '$.k')",
}
_DUCK = {
    "S": "VARCHAR", "LB": "{", "RB": "}", "BS": "\\", "DIV": "//",
    "MS": "(epoch_us(ts) // 1000)", "K": "json_extract_string(props, '$.k')",
}

VIEWS: dict[str, str] = {
    "usage_raw": """
SELECT 'e' || CAST(event_id AS {S}) AS id,
 CASE user_id % 4 WHEN 0 THEN 'codex' WHEN 1 THEN 'claude-code' WHEN 2 THEN 'opencode' ELSE 'qoder' END AS agent,
 's' || CAST(user_id AS {S}) || '-' || CAST(CAST(ts AS DATE) AS {S}) AS session,
 CASE user_id % 5 WHEN 0 THEN 'C:{BS}Work{BS}App' WHEN 1 THEN 'c:/work/app/' WHEN 2 THEN '/home/x/App'
                  WHEN 3 THEN '/home/x/app' ELSE '' END AS project,
 CASE k % 6 WHEN 0 THEN 'GLM-5.3-Flash' WHEN 1 THEN ' glm-5.3-flash ' WHEN 2 THEN 'alias-a'
            WHEN 3 THEN 'm-cny' WHEN 4 THEN '' ELSE 'm-unpriced' END AS model_raw,
 {MS} AS ts, k * 100 AS input, k * 37 AS cached, (k % 7) * 10 AS cache_write,
 CAST(floor(value * 10) AS BIGINT) AS output, CAST(floor(value * 5) AS BIGINT) AS reasoning,
 event_type, user_id, event_id, k
FROM (SELECT *, CAST({K} AS BIGINT) AS k FROM {events}) x""",
    "usage_copies": """
SELECT 'live/' || session AS path, * FROM {usage_raw}
UNION ALL SELECT 'archive/' || session AS path, id, agent, session, project, model_raw,
 CASE WHEN k % 20 = 0 THEN ts - 1000 ELSE ts END AS ts, input, cached, cache_write, output + 1 AS output, reasoning,
 event_type, user_id, event_id, k
FROM {usage_raw} WHERE k % 10 = 0""",
    "source_files": """
SELECT path, agent,
 CASE WHEN path LIKE 'live/%' THEN 100 + user_id % 50 ELSE 100 + (user_id * 7) % 90 END AS mtime,
 CASE WHEN user_id % 3 = 0 THEN 'Title ' || session END AS title
FROM (SELECT DISTINCT path, agent, user_id, session FROM {usage_copies}) f""",
    "activities": """
SELECT 'a' || CAST(event_id AS {S}) AS id, agent, session, ts, event_type AS name
FROM {usage_raw} WHERE event_type IN ('click', 'error')""",
    "activity_copies": """
SELECT 'live/' || session AS path, id, agent, session, ts, name FROM {activities}
UNION ALL SELECT 'archive/' || session AS path, id, agent, session, ts, name || '-old' AS name
FROM {activities} WHERE ts % 3 = 0""",
    "quota": """
SELECT u.path, u.agent, u.session, u.ts,
 '{LB}"primary":{LB}"used_percent":' || CAST(k AS {S}) || ',"window_minutes":300,"resets_at":' || CAST(ts {DIV} 1000 + 18000 AS {S})
 || '{RB},"secondary":{LB}"used_percent":' || CAST((k*3) % 100 AS {S}) || ',"window_minutes":10080{RB}{RB}' AS payload
FROM (SELECT 'live' AS path, * FROM {usage_raw} UNION ALL SELECT 'archive' AS path, * FROM {usage_raw}) u
WHERE event_type = 'signup' AND agent <> 'qoder'""",
    "credits": """
SELECT 'live/' || session AS path, agent, 'r' || CAST(event_id - event_id % 3 AS {S}) AS request_id, session, project,
 CASE WHEN k % 2 = 0 THEN 'qf' ELSE 'qm' END AS model, ts, CAST(1 AS BIGINT) AS requests, CAST(k AS DOUBLE) / 4 AS credits,
 CASE WHEN k % 5 = 0 THEN NULL ELSE CAST(k AS DOUBLE) / 2 END AS original_credits,
 CASE WHEN k % 3 = 0 THEN CAST(1 AS BIGINT) END AS billable_requests, CAST(k AS DOUBLE) / 128 AS context_usage_ratio
FROM {usage_raw}""",
    "counters": """
SELECT session, id, agent, ts, epoch, k,
 CAST(SUM(input + cached) OVER w AS BIGINT) AS c_input, CAST(SUM(cached) OVER w AS BIGINT) AS c_cached,
 CAST(SUM(cache_write) OVER w AS BIGINT) AS c_cache_write, CAST(SUM(output) OVER w AS BIGINT) AS c_output,
 CAST(SUM(reasoning) OVER w AS BIGINT) AS c_reasoning,
 input AS last_input, cached AS last_cached, cache_write AS last_cache_write, output AS last_output, reasoning AS last_reasoning
FROM (SELECT *, SUM(CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END) OVER
        (PARTITION BY session ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS epoch FROM {usage_raw}) e
WINDOW w AS (PARTITION BY session, epoch ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "snapshot_rows": """
SELECT 'u' || CAST(user_id AS {S}) AS session, ts, 'm-cny' AS model, project, k,
 MIN(ts) OVER (PARTITION BY user_id) - CASE WHEN user_id % 2 = 0 THEN 0 ELSE 172800000 END AS created_at,
 CAST(SUM(input + cached) OVER w AS BIGINT) AS c_input, CAST(SUM(cached) OVER w AS BIGINT) AS c_cached,
 CAST(SUM(cache_write) OVER w AS BIGINT) AS c_cache_write, CAST(SUM(output) OVER w AS BIGINT) AS c_output,
 CAST(SUM(reasoning) OVER w AS BIGINT) AS c_reasoning
 FROM (SELECT *, SUM(CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END) OVER
        (PARTITION BY user_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS epoch FROM {usage_raw}) e
 WINDOW w AS (PARTITION BY user_id, epoch ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "snapshots": """
SELECT 'live/' || session AS path, session, ts, created_at, model, project, c_input, c_cached, c_cache_write, c_output, c_reasoning FROM {snapshot_rows}
UNION ALL SELECT 'archive/' || session AS path, session, ts, created_at, model, project, c_input, c_cached, c_cache_write, c_output, c_reasoning
FROM {snapshot_rows} WHERE k % 4 = 0""",
    "rates": """
SELECT * FROM (VALUES
 ('glm-5.3-flash', CAST(NULL AS BIGINT), 'CNY', CAST(1.0 AS DOUBLE), CAST(0.2 AS DOUBLE), CAST(1.0 AS DOUBLE), CAST(4.0 AS DOUBLE)),
 ('glm-5.3-flash', CAST(1705276800000 AS BIGINT), 'CNY', CAST(2.0 AS DOUBLE), CAST(0.4 AS DOUBLE), CAST(2.0 AS DOUBLE), CAST(8.0 AS DOUBLE)),
 ('m-cny', CAST(1704844800000 AS BIGINT), 'CNY', CAST(3.0 AS DOUBLE), CAST(0.3 AS DOUBLE), CAST(3.75 AS DOUBLE), CAST(15.0 AS DOUBLE)),
 ('unknown', CAST(NULL AS BIGINT), 'USD', CAST(0.5 AS DOUBLE), CAST(0.05 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(2.0 AS DOUBLE)))
 AS t(model, effective_from_ms, currency, input, cached, cache_write, output)""",
    "aliases": "SELECT * FROM (VALUES ('alias-a', 'm-cny')) AS t(alias, model)",
}
EVENT_COLUMNS = (
    "path", "id", "agent", "session", "project", "model", "ts", "input", "cached",
    "cache_write", "output", "reasoning",
)

# Oracle-only views: the same results in plain SQL.
_EVENTS_SQL = """SELECT path, id, agent, session, project,
 coalesce(nullif(lower(trim(model_raw)), ''), 'unknown') AS model, ts, input, cached, cache_write, output, reasoning
FROM {src}"""
ORACLE_VIEWS: dict[str, str] = {
    "raw_events": _EVENTS_SQL.format(src="{usage_copies}"),
    "elected": """
SELECT * EXCLUDE (rn) FROM (SELECT c.*, row_number() OVER (PARTITION BY c.agent, c.id
   ORDER BY c.ts DESC, coalesce(f.mtime, 0) DESC, c.path) AS rn
 FROM {usage_copies} c LEFT JOIN {source_files} f ON f.path = c.path AND f.agent = c.agent) WHERE rn = 1""",
    "usage_events": _EVENTS_SQL.format(src="{elected}"),
    "spans": """
SELECT model, coalesce(effective_from_ms, 0) AS from_ms,
 coalesce(lead(coalesce(effective_from_ms, 0)) OVER (PARTITION BY model ORDER BY coalesce(effective_from_ms, 0)), 9223372036854775807) AS to_ms,
 currency, input AS ri, cached AS rc, cache_write AS rw, output AS ro FROM {rates}""",
    "named_spans": """
SELECT model AS name, from_ms, to_ms, currency, ri, rc, rw, ro FROM {spans} WHERE model NOT IN (SELECT alias FROM {aliases})
UNION ALL SELECT a.alias, s.from_ms, s.to_ms, s.currency, s.ri, s.rc, s.rw, s.ro FROM {aliases} a JOIN {spans} s ON s.model = a.model""",
    "priced_all": """
SELECT p.*, cost_input + cost_cached + cost_cache_write + cost_output AS cost FROM (
 SELECT e.*, e.input * ri / 1e6 / fx AS cost_input, e.cached * rc / 1e6 / fx AS cost_cached,
  e.cache_write * rw / 1e6 / fx AS cost_cache_write, e.output * ro / 1e6 / fx AS cost_output
 FROM {usage_events} e LEFT JOIN (SELECT *, CASE currency WHEN 'CNY' THEN CAST(6.7521 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS fx FROM {named_spans}) s
   ON s.name = e.model AND e.ts >= s.from_ms AND e.ts < s.to_ms) p""",
    "priced": f"SELECT * FROM {{priced_all}} WHERE ts >= {START} AND ts < {END}",
    "raw_priced": """
SELECT p.*, cost_input + cost_cached + cost_cache_write + cost_output AS cost FROM (
 SELECT e.*, e.input * ri / 1e6 / fx AS cost_input, e.cached * rc / 1e6 / fx AS cost_cached,
  e.cache_write * rw / 1e6 / fx AS cost_cache_write, e.output * ro / 1e6 / fx AS cost_output
 FROM {raw_events} e LEFT JOIN (SELECT *, CASE currency WHEN 'CNY' THEN CAST(6.7521 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS fx FROM {named_spans}) s
   ON s.name = e.model AND e.ts >= s.from_ms AND e.ts < s.to_ms) p""",
    "keyed": """
SELECT p.*, CASE WHEN agent = 'qoder' AND model = 'unknown' THEN 'qoder:unattributed' ELSE model END AS model_key,
 CASE WHEN project = '' THEN '未记录项目' ELSE project END AS project_label,
 CASE WHEN regexp_matches(project, '^[A-Za-z]:[/\\\\]') THEN rtrim(lower(replace(project, '\\', '/')), '/') ELSE project END AS project_key,
 strftime(make_timestamp((ts + 28800000) * 1000), '%Y-%m-%d') AS day, strftime(make_timestamp((ts + 28800000) * 1000), '%Y-%m') AS month,
 ts - ts % 3600000 AS bucket, coalesce(f.title, session) AS session_label
FROM {priced} p LEFT JOIN {source_files} f USING (path, agent)""",
}


class _Names(dict):
    def __missing__(self, key: str) -> str:
        return key


def oracle(sql: str) -> str:
    """The oracle text: named views become common table expressions, in dependency order."""
    texts = {**VIEWS, **ORACLE_VIEWS}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in texts:
            if "{" + name + "}" in text and name not in needed:
                visit(texts[name])
                needed.append(name)

    visit(sql)
    names = _Names(_DUCK)
    parts = [f"{n} AS ({texts[n].format_map(names).strip()})" for n in needed]
    body = sql.format_map(names).strip()
    if not parts:
        return body
    for opening in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(opening):
            return opening + ",\n".join(parts) + ",\n" + body[len(opening):]
    return "WITH " + ",\n".join(parts) + "\n" + body


class Inputs:
    """The derived tables as DataFrames; nothing runs until a query's result is read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = ensure_session(spark)
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        used = {n: getattr(self, n) for n in ("events", *VIEWS) if "{" + n + "}" in text}
        names = {**_SPARK, **{n: "{" + n + "}" for n in used}}
        return self.spark.sql(text.format_map(names), **used) if used else self.spark.sql(
            text.format_map(names)
        )

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        df = self.view(name)
        self.__dict__[name] = df
        return df

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def conversations(self) -> DataFrame:
        return self.table("conversations")

    @cached_property
    def raw_events(self) -> DataFrame:
        """Every copy as read from its file, in the event layout."""
        return self.usage_copies.withColumn("model", S.normalize_model("model_raw")).select(*EVENT_COLUMNS)

    @cached_property
    def usage_events(self) -> DataFrame:
        """The elected rows: the table every report reads."""
        return E.elect(self.raw_events, self.source_files)

    def price(self, events: DataFrame) -> DataFrame:
        return P.price(events, self.rates, self.aliases, USD_CNY)

    @cached_property
    def priced(self) -> DataFrame:
        return self.price(select_events(self.usage_events, WINDOW))

    @cached_property
    def raw_priced(self) -> DataFrame:
        return self.price(self.raw_events)


def r6(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,10)), 6) AS DOUBLE)"


def _sat(x: str, name: str) -> str:
    return f"CAST(least(coalesce(sum({x}), 0), 9223372036854775807) AS BIGINT) AS {name}"


_TOTAL = "input + cached + cache_write + output"
_METRIC_SQL = ", ".join(
    [
        *[_sat(t, t) for t in ("input", "cached", "cache_write", "output", "reasoning")],
        _sat(_TOTAL, "total_tokens"), "count(*) AS events", "coalesce(max(ts), 0) AS last_ts",
        r6("coalesce(sum(cost), 0)") + " AS known_cost",
        *[r6(f"coalesce(sum({p}), 0)") + f" AS known_{p}" for p in P.PARTS],
        "count(*) FILTER (cost IS NULL) AS unpriced_events",
        _sat(f"CASE WHEN cost IS NULL THEN {_TOTAL} ELSE 0 END", "unpriced_tokens"),
        f"CASE WHEN count(*) FILTER (cost IS NULL) = 0 THEN {r6('coalesce(sum(cost), 0)')} END AS cost",
    ]
)
_LAST_SQL = ", ".join(
    f"max(struct_pack(ts := ts, id := id, v := {c})).v AS last_{c}" for c in ("agent", "session", "path")
)
METRIC_SQL, LAST_SQL = _METRIC_SQL, _LAST_SQL
