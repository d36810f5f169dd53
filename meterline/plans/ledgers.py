"""Queries about running totals, elections and keeping maintained tables right."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S, variants as V
from ..operators import counters as C, elect as E, ordered as O, quotas as K
from ..sources import ledger as L
from .inputs import EVENT_COLUMNS
from .registry import query

_COUNTERS = "c_input, c_cached, c_cache_write, c_output, c_reasoning"
_LAGS = ", ".join(f"lag({c}) OVER w AS p_{c[2:]}" for c in _COUNTERS.split(", "))
_SAMPLES = f"SELECT *, row_number() OVER w AS n, {_LAGS} FROM {{counters}} WINDOW w AS (PARTITION BY session ORDER BY ts, id)"
_REPEAT = "(n > 1 AND c_input = p_input AND c_cached = p_cached AND c_cache_write = p_cache_write AND c_output = p_output AND c_reasoning = p_reasoning)"
_FELL = "(n > 1 AND (c_input < p_input OR c_output < p_output))"
_DELTA = f"""
WITH s AS ({_SAMPLES}),
u AS (SELECT *, n = 1 OR {_FELL} AS use_last FROM s WHERE NOT {_REPEAT}),
d AS (SELECT *, greatest(c_input - p_input, 0) AS whole FROM u)
SELECT id, session, ts, use_last,
 CASE WHEN use_last THEN last_input ELSE whole - least(greatest(c_cached - p_cached, 0), whole) END AS input,
 CASE WHEN use_last THEN last_cached ELSE least(greatest(c_cached - p_cached, 0), whole) END AS cached,
 CASE WHEN use_last THEN last_cache_write ELSE greatest(c_cache_write - p_cache_write, 0) END AS cache_write,
 CASE WHEN use_last THEN last_output ELSE greatest(c_output - p_output, 0) END AS output,
 CASE WHEN use_last THEN last_reasoning ELSE greatest(c_reasoning - p_reasoning, 0) END AS reasoning FROM d"""
_KEY, _ORDER = ["session"], ["ts", "id"]


@query("cumulative_delta", _DELTA)
def cumulative_delta(t):
    rows = C.cumulative_delta(t.counters, _KEY, _ORDER)
    return rows.select("id", "session", "ts", "use_last", "input", "cached", "cache_write", "output", "reasoning")


@query("counter_reset_flag", f"SELECT id, {_FELL} AS fell FROM ({_SAMPLES}) s")
def counter_reset_flag(t):
    rows = C.with_previous_totals(t.counters, _KEY, _ORDER)
    return rows.select("id", F.coalesce(C.counter_reset(), F.lit(False)).alias("fell"))


@query("skip_repeat_totals", f"SELECT id, session FROM ({_SAMPLES}) s WHERE NOT {_REPEAT}")
def skip_repeat_totals(t):
    return C.skip_repeats(t.counters, _KEY, _ORDER).select("id", "session")


@query("lag_delta", f"SELECT id, c_output - p_output AS step FROM ({_SAMPLES}) s")
def lag_delta(t):
    rows = O.with_previous(t.counters, _KEY, _ORDER, ["c_output"])
    return rows.select("id", (F.col("c_output") - F.col("prev.c_output")).alias("step"))


@query("ffill", "SELECT id, last_value(nullif(model_raw, '') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM {usage_raw}")
def ffill(t):
    filled = {"carried": F.nullif("model_raw", F.lit(""))}
    return O.with_carried(t.usage_raw, ["user_id"], ["ts", "id"], filled).select("id", "carried")


@query("change_points", "SELECT id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, id) AS p FROM {usage_raw}) x WHERE p IS DISTINCT FROM event_type")
def change_points(t):
    return O.change_points(t.usage_raw, ["user_id"], ["ts", "id"], "event_type").select("id", "event_type")


_OBS_LINES = "SELECT 'p' || user_id % 7 AS path, agent AS session, event_id AS line, ts, CAST(k % 3 AS VARCHAR) AS payload FROM {usage_raw}"


@query("quota_change_only", f"SELECT path, session, line, ts, payload FROM (SELECT *, lag(payload) OVER (PARTITION BY path, session ORDER BY line) AS p FROM ({_OBS_LINES}) o) x WHERE p IS DISTINCT FROM payload")
def quota_change_only(t):
    obs = t.usage_raw.select(
        F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string")).alias("path"),
        F.col("agent").alias("session"), F.col("event_id").alias("line"), "ts",
        (F.col("k") % 3).cast("string").alias("payload"),
    )
    return K.quota_change_only(obs)


_SPELLED = """CASE k % 5 WHEN 0 THEN '{"cache_creation_input_tokens":' || k || '}' WHEN 1 THEN '{"cache_write_input_tokens":"' || k || '"}'
 WHEN 2 THEN '{"cache_creation_input_tokens":' || k || ',"cache_write_input_tokens":' || k || '}'
 WHEN 3 THEN '{"cache_creation_input_tokens":' || k || ',"cache_write_input_tokens":' || (k + 1) || '}' ELSE '{}' END"""
_SPELLING = """SELECT id, user_id, ts, CASE WHEN k % 5 < 3 THEN k ELSE 0 END AS value,
 CASE k % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 0 END AS spelling FROM {usage_raw}"""


@query("cache_write_of", f"SELECT id, value, spelling FROM ({_SPELLING}) s")
def cache_write_of(t):
    rows = t.usage_raw.withColumn("v", V.parse(F.expr(_SPELLED)))
    return rows.withColumn("w", S.cache_write_of("v", "")).select("id", "w.value", "w.spelling")


@query("spelling_change_flag", f"""SELECT id, coalesce(spelling BETWEEN 1 AND 3 AND p BETWEEN 1 AND 3 AND spelling <> p, false) AS broken
 FROM (SELECT *, lag(spelling) OVER (PARTITION BY user_id ORDER BY ts, id) AS p FROM ({_SPELLING}) s) x""")
def spelling_change_flag(t):
    rows = t.usage_raw.withColumn("spelling", S.cache_write_of(V.parse(F.expr(_SPELLED)), "")["spelling"])
    seen = O.with_previous(rows, ["user_id"], ["ts", "id"], ["spelling"])
    return seen.select("id", F.coalesce(C.spelling_changed(), F.lit(False)).alias("broken"))


# --- session snapshots -----------------------------------------------------------------------------

_SNAP_DELTA = f"""
WITH o AS (SELECT session, ts, max(struct_pack(path := path, {', '.join(f'{c} := {c}' for c in _COUNTERS.split(', '))},
   created_at := created_at, model := model, project := project)) AS s FROM {{snapshots}} GROUP BY session, ts),
r AS (SELECT session, ts, unnest(s) FROM o),
l AS (SELECT *, row_number() OVER w AS n, lag(ts) OVER w AS p_ts, {_LAGS} FROM r WINDOW w AS (PARTITION BY session ORDER BY ts)),
b AS (SELECT *, CASE WHEN n = 1 THEN created_at // 86400000 = ts // 86400000
   ELSE NOT (c_input < p_input OR c_output < p_output OR c_cache_write < p_cache_write) AND p_ts // 86400000 = ts // 86400000 END AS booked,
   CASE WHEN n = 1 THEN c_input ELSE greatest(c_input - p_input, 0) END AS whole FROM l),
d AS (SELECT *, CASE WHEN n = 1 THEN c_cached ELSE least(greatest(c_cached - p_cached, 0), whole) END AS cached FROM b WHERE booked)
SELECT session || '|' || ts AS id, session, ts, model, whole - cached AS input, cached,
 CASE WHEN n = 1 THEN c_cache_write ELSE greatest(c_cache_write - p_cache_write, 0) END AS cache_write,
 CASE WHEN n = 1 THEN c_output ELSE greatest(c_output - p_output, 0) END AS output,
 CASE WHEN n = 1 THEN c_reasoning ELSE greatest(c_reasoning - p_reasoning, 0) END AS reasoning FROM d
WHERE whole + CASE WHEN n = 1 THEN c_cache_write + c_output ELSE greatest(c_cache_write - p_cache_write, 0) + greatest(c_output - p_output, 0) END > 0"""
_SNAP_COLUMNS = ("id", "session", "ts", "model", "input", "cached", "cache_write", "output", "reasoning")


@query("snapshot_ledger", _SNAP_DELTA)
def snapshot_ledger(t):
    return C.snapshot_ledger(t.snapshots).select(*_SNAP_COLUMNS)


_EARLY_DELTA = _SNAP_DELTA.replace("FROM {snapshots} GROUP BY", "FROM {snapshots} WHERE ts % 5 <> 0 GROUP BY")
_BOOKED = "SELECT session, CAST(sum(input + cached + cache_write + output) AS BIGINT) AS booked FROM ({}) x GROUP BY session"


@query("late_snapshot_rebase", f"""SELECT coalesce(a.session, b.session) AS session, a.booked AS before_late, b.booked AS booked
 FROM ({_BOOKED.format(_EARLY_DELTA)}) a FULL JOIN ({_BOOKED.format(_SNAP_DELTA)}) b ON a.session = b.session""")
def late_snapshot_rebase(t):
    """What the early snapshots book, and what all book once the late, older ones have come: they split baselines."""
    early, late = t.snapshots.where("ts % 5 != 0"), t.snapshots.where("ts % 5 = 0")
    booked = lambda rows, name: C.snapshot_ledger(rows).groupBy("session").agg(S.saturating_sum(S.total_tokens()).alias(name))
    return booked(early, "before_late").join(booked(early.unionByName(late), "booked"), "session", "full")


# --- election ----------------------------------------------------------------------------------------

_COLS = ", ".join(EVENT_COLUMNS)
_ELECTED = f"SELECT {_COLS} FROM {{usage_events}}"
_ELECT_FROM = f"""SELECT {_COLS} FROM (SELECT r.*, row_number() OVER (PARTITION BY r.agent, r.id ORDER BY r.ts DESC, coalesce(f.mtime, 0) DESC, r.path) AS rn
 FROM {{rows}} r LEFT JOIN {{{{source_files}}}} f ON f.path = r.path AND f.agent = r.agent) x WHERE rn = 1"""


@query("elect_events", _ELECTED)
def elect_events(t):
    return E.elect(t.raw_events, t.source_files)


@query("rank_latest", "SELECT agent, id, max(ts) AS ts FROM {raw_events} GROUP BY agent, id")
def rank_latest(t):
    return E.elect(t.raw_events, t.source_files).select("agent", "id", "ts")


@query("elect_activities", """SELECT path, id, agent, session, ts, name FROM (SELECT a.*, row_number() OVER (PARTITION BY a.agent, a.id
 ORDER BY a.ts DESC, coalesce(f.mtime, 0) DESC, a.path) AS rn FROM {activity_copies} a LEFT JOIN {source_files} f ON f.path = a.path AND f.agent = a.agent) x WHERE rn = 1""")
def elect_activities(t):
    return E.elect(t.activity_copies, t.source_files)


_CHANGED = "(SELECT path, agent FROM {source_files} WHERE path LIKE 'archive/%' AND mtime % 2 = 0)"


@query("replace_by_file", f"""SELECT {_COLS} FROM {{raw_events}} WHERE (path, agent) NOT IN {_CHANGED}
UNION ALL SELECT {_COLS.replace('output', 'output + 100 AS output')} FROM {{raw_events}} WHERE (path, agent) IN {_CHANGED}""")
def replace_by_file(t):
    changed = t.source_files.where("path LIKE 'archive/%' AND mtime % 2 = 0")
    new = t.raw_events.join(changed.select("path", "agent"), ["path", "agent"], "left_semi")
    new = new.select(*EVENT_COLUMNS).withColumn("output", F.col("output") + 100)
    return E.replace_by_file(t.raw_events, new, changed).select(*EVENT_COLUMNS)


_REMAINING = f"(SELECT * FROM {{raw_events}} WHERE (path, agent) NOT IN (SELECT path, agent FROM {{source_files}} WHERE path LIKE 'live/%' AND mtime % 3 = 0))"


@query("forget_files", _ELECT_FROM.format(rows=_REMAINING).replace("{{", "{").replace("}}", "}"))
def forget_files(t):
    stale = t.source_files.where("path LIKE 'live/%' AND mtime % 3 = 0")
    left = E.forget_files({"events": t.raw_events, "files": t.source_files}, stale)
    return E.elect(left["events"], left["files"]).select(*EVENT_COLUMNS)


@query("reelect_touched", _ELECTED)
def reelect_touched(t):
    live = t.raw_events.where("path LIKE 'live/%'")
    archived = t.raw_events.where("path LIKE 'archive/%'")
    kept = E.elect(live, t.source_files)
    return E.reelect(kept, t.raw_events, t.source_files, E.touched_keys(archived)).select(*EVENT_COLUMNS)


@query("touched_in", "SELECT agent, id, count(*) AS copies FROM {raw_events} WHERE (agent, id) IN (SELECT agent, id FROM {raw_events} WHERE path LIKE 'archive/%') GROUP BY agent, id")
def touched_in(t):
    touched = E.touched_keys(t.raw_events.where("path LIKE 'archive/%'"))
    rows = t.raw_events.join(touched, ["agent", "id"], "left_semi")
    return rows.groupBy("agent", "id").agg(F.count(F.lit(1)).alias("copies"))


_LIVE = "(SELECT * FROM {raw_events} WHERE path LIKE 'live/%')"
_AUDIT = f"""WITH c AS (SELECT {_COLS} FROM {_LIVE} l), e AS ({_ELECTED})
SELECT *, 'kept' AS side FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM e) x
UNION ALL SELECT *, 'recomputed' AS side FROM (SELECT * FROM e EXCEPT ALL SELECT * FROM c) y"""


@query("ledger_audit", _AUDIT)
def ledger_audit(t):
    kept = E.elect(t.raw_events.where("path LIKE 'live/%'"), t.source_files)
    return E.ledger_audit(kept.select(*EVENT_COLUMNS), E.elect(t.raw_events, t.source_files))


@query("except", f"SELECT agent, id, output FROM (SELECT {_COLS} FROM {_LIVE} l EXCEPT ALL {_ELECTED}) x")
def except_audit(t):
    kept = E.elect(t.raw_events.where("path LIKE 'live/%'"), t.source_files).select(*EVENT_COLUMNS)
    return kept.exceptAll(E.elect(t.raw_events, t.source_files)).select("agent", "id", "output")


@query("union_sources", f"SELECT {_COLS} FROM {{raw_events}} UNION ALL SELECT path, id, agent, session, project, model, ts, input, cached, cache_write, output, reasoning FROM (SELECT 'snap/' || session AS path, 'qoder' AS agent, project, * EXCLUDE (path, project) FROM (SELECT x.*, '' AS path, '' AS project FROM ({_SNAP_DELTA}) x)) y")
def union_sources(t):
    snaps = C.snapshot_ledger(t.snapshots).withColumns(
        {"path": F.concat(F.lit("snap/"), "session"), "project": F.lit("")}
    )
    return L.union_sources(t.raw_events, snaps.select(*EVENT_COLUMNS))


# --- file ledgers ---------------------------------------------------------------------------------------

_LISTING = "SELECT path, agent, CAST(1000 + user_id AS BIGINT) AS size, CAST(100 + user_id % 50 AS BIGINT) AS mtime FROM (SELECT DISTINCT path, agent, user_id FROM {usage_copies}) f WHERE user_id % 11 <> 0"
_LEDGER = """SELECT path, agent, CAST(1000 + user_id + CASE WHEN user_id % 6 = 0 THEN 1 ELSE 0 END AS BIGINT) AS size, CAST(100 + user_id % 50 AS BIGINT) AS mtime,
 CASE WHEN user_id % 5 = 0 THEN 'unreadable' END AS reason, CASE WHEN user_id % 5 = 0 THEN CAST(1 + user_id % 9 AS BIGINT) END AS attempt,
 CASE WHEN user_id % 5 = 0 THEN CAST(1000000 + (user_id % 4) * 60000 AS BIGINT) END AS retry_at, CAST(CASE WHEN user_id % 8 = 0 THEN 1 ELSE 2 END AS BIGINT) AS version
FROM (SELECT DISTINCT path, agent, user_id FROM {usage_copies}) f WHERE user_id % 7 <> 0"""
_HEALTH = "SELECT path, agent, CAST(user_id % 3 AS BIGINT) AS malformed_lines FROM (SELECT DISTINCT path, agent, user_id FROM {usage_copies}) f WHERE user_id % 13 <> 0"


def _files(t):
    return t.usage_copies.select("path", "agent", "user_id").dropDuplicates()


def _listing(t):
    return _files(t).where("user_id % 11 != 0").selectExpr("path", "agent", "1000 + user_id AS size", "100 + user_id % 50 AS mtime")


def _ledger(t):
    bad = "user_id % 5 = 0"
    return _files(t).where("user_id % 7 != 0").selectExpr(
        "path", "agent", "1000 + user_id + IF(user_id % 6 = 0, 1, 0) AS size", "100 + user_id % 50 AS mtime",
        f"IF({bad}, 'unreadable', NULL) AS reason", f"IF({bad}, 1 + user_id % 9, NULL) AS attempt",
        f"IF({bad}, 1000000 + (user_id % 4) * 60000, NULL) AS retry_at", "IF(user_id % 8 = 0, 1, 2) AS version",
    )


@query("changed_files", f"""SELECT i.path, i.agent FROM ({_LISTING}) i LEFT JOIN ({_LEDGER}) l ON l.path = i.path AND l.agent = i.agent
LEFT JOIN ({_HEALTH}) h ON h.path = i.path AND h.agent = i.agent
WHERE l.path IS NULL OR l.size <> i.size OR l.mtime <> i.mtime OR l.reason IS NOT NULL OR h.path IS NULL OR l.version <> 2""")
def changed_files(t):
    health = _files(t).where("user_id % 13 != 0").selectExpr("path", "agent", "user_id % 3 AS malformed_lines")
    return L.changed_files(_listing(t), _ledger(t), health, version=2)


@query("retry_ledger", f"""SELECT f.path, f.agent, f.size, f.mtime, n.attempt, CASE WHEN n.attempt < 3 THEN 5000000
   ELSE 5000000 + least(60000 * (1 << CAST(least(n.attempt - 3, 20) AS INTEGER)), 1800000) END AS retry_at
FROM ({_LISTING}) f JOIN (SELECT i.path, i.agent, CASE WHEN l.size = i.size AND l.mtime = i.mtime AND l.reason IS NOT NULL THEN l.attempt + 1 ELSE 1 END AS attempt
  FROM ({_LISTING}) i LEFT JOIN ({_LEDGER}) l ON l.path = i.path AND l.agent = i.agent) n ON n.path = f.path AND n.agent = f.agent""")
def retry_ledger(t):
    failures = _listing(t).withColumn("reason", F.lit("unreadable"))
    return L.next_failures(_ledger(t), failures, now_ms=5_000_000).drop("reason")


@query("retry_gate", f"SELECT i.path, i.agent, l.retry_at FROM ({_LISTING}) i JOIN ({_LEDGER}) l ON l.path = i.path AND l.agent = i.agent AND l.size = i.size AND l.mtime = i.mtime WHERE l.retry_at > 1060000")
def retry_gate(t):
    return L.gated(_listing(t), _ledger(t), now_ms=1_060_000).select("path", "agent", "retry_at")


_STALE = f"SELECT l.path, l.agent FROM ({_LEDGER}) l WHERE l.agent IN ('codex', 'opencode') AND NOT EXISTS (SELECT 1 FROM ({_LISTING}) i WHERE i.path = l.path AND i.agent = l.agent)"


def _agent_ok(t):
    return t.usage_raw.select("agent").dropDuplicates().withColumn("ok", F.col("agent").isin("codex", "opencode"))


@query("stale_files", _STALE)
def stale_files(t):
    return L.stale_files(_ledger(t), _listing(t), _agent_ok(t))


@query("stale_anti", f"SELECT agent, count(*) AS files FROM ({_STALE}) s GROUP BY agent")
def stale_anti(t):
    return L.stale_files(_ledger(t), _listing(t), _agent_ok(t)).groupBy("agent").agg(F.count(F.lit(1)).alias("files"))


_RESULTS = "SELECT DISTINCT path, agent, user_id FROM {usage_copies}"


@query("scan_status", f"""SELECT agent, CASE WHEN agent = 'opencode' THEN 'disabled' WHEN parsed + reused = 0 AND failed > 0 THEN 'error' WHEN failed > 0 THEN 'degraded'
  WHEN malformed > 0 THEN 'warning' WHEN files = 0 THEN 'missing' ELSE 'ready' END AS state,
 CASE WHEN agent = 'opencode' THEN 0 ELSE files END AS files, CASE WHEN agent = 'opencode' THEN 0 ELSE failed END AS failed_files,
 CASE WHEN agent = 'opencode' THEN 0 ELSE CAST(malformed AS BIGINT) END AS malformed_lines
FROM (SELECT agent, count(*) AS files, count(*) FILTER (o = 'parsed') AS parsed, count(*) FILTER (o = 'reused') AS reused, count(*) FILTER (o = 'failed') AS failed, sum(m) AS malformed
  FROM (SELECT agent, CASE WHEN agent = 'codex' AND user_id % 3 = 0 THEN 'failed' WHEN user_id % 2 = 0 THEN 'parsed' ELSE 'reused' END AS o,
    CASE WHEN agent = 'qoder' THEN user_id % 2 ELSE 0 END AS m FROM ({_RESULTS}) f) r GROUP BY agent) s
UNION ALL SELECT 'absent', 'missing', 0, 0, 0 WHERE EXISTS (SELECT 1 FROM {{events}})""")
def scan_status(t):
    results = _files(t).where("agent != 'opencode'").selectExpr(
        "agent", "path",
        "CASE WHEN agent = 'codex' AND user_id % 3 = 0 THEN 'failed' WHEN user_id % 2 = 0 THEN 'parsed' ELSE 'reused' END AS outcome",
        "IF(agent = 'qoder', user_id % 2, 0) AS malformed_lines", "CAST(NULL AS STRING) AS error", "CAST(NULL AS BIGINT) AS retry_at",
    )
    agents = t.usage_raw.select("agent").dropDuplicates().unionByName(
        t.usage_raw.agg(F.lit("absent").alias("agent"))
    )
    rows = L.scan_status(results, agents, disabled=["opencode"])
    return rows.select("agent", "state", "files", "failed_files", "malformed_lines")


@query("status_quality", """SELECT id, CASE WHEN k % 4 = 1 THEN 'unknown' ELSE 'codex' END AS agent, CASE WHEN k % 4 = 3 THEN 'unreadable' ELSE 'ready' END AS state,
 CASE WHEN k % 4 = 2 THEN NULL ELSE k END AS files, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS unreadable_errors,
 k % 4 <> 0 OR k % 3 = 0 AS partial FROM {usage_raw}""")
def status_quality(t):
    text = F.expr("""concat('{"reused":1,"malformedLines":0,"updatedAt":5,"errors":', IF(k % 3 = 0, '["x",7]', '[]'),
      IF(k % 4 = 1, '', ',"agent":"codex"'), IF(k % 4 = 2, ',"files":-1', concat(',"files":', k)), IF(k % 4 = 3, '', ',"state":"ready"'), '}')""")
    rows = L.read_status(t.usage_raw.select("id", text.alias("status")), "status")
    return rows.select("id", "agent", "state", "files", "unreadable_errors", "partial")
