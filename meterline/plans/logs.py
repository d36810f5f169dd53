"""Queries that turn log lines and landed source tables, derived from events, into rows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import scalars as S
from ..session import scratch_path
from ..sources import files as X, normalize as N, tables as B
from .registry import query

_EVENT = "id, agent, session, project, model, ts, input, cached, cache_write, output, reasoning"
_OUT = _EVENT.split(", ")
_NAME = "coalesce(nullif(lower(trim(model_raw)), ''), 'unknown')"
_PROJECT = "CASE user_id % 5 WHEN 0 THEN 'App' WHEN 1 THEN 'app' WHEN 2 THEN 'App' WHEN 3 THEN 'app' ELSE '' END"
_CACHED = "least(cached, input)"


def _json(**fields) -> Column:
    """A JSON record; nested dicts become objects."""

    def build(d: dict) -> Column:
        return F.struct(*[(build(v) if isinstance(v, dict) else _value(v)).alias(k) for k, v in d.items()])

    return F.to_json(build(fields))


def _value(v) -> Column:
    if isinstance(v, Column):
        return v
    return F.expr(v[1:]) if v.startswith("=") else F.lit(v)


def _lines(rows, path: str, value: Column, line: str = "event_id"):
    return rows.select(F.expr(path).alias("path"), F.expr(line).cast("bigint").alias("line"), value.alias("value"))


_PATH = "concat('logs/p', user_id % 7, '/f.jsonl')"


# --- files --------------------------------------------------------------------------------------

_ID_JSON = dict(id="=id", session="=session", ts="=ts")


def _written(t, name: str, **options) -> str:
    """The events as text files of JSON lines in the shared folder."""
    path = scratch_path(t.spark, name)
    t.usage_raw.select(_json(**_ID_JSON).alias("value")).write.options(**options).text(path)
    return path


def _read_back(lines):
    v = N.parsed(lines.where("line > 0"))
    return v.select(
        F.expr("try_variant_get(v, '$.id', 'string')").alias("id"),
        F.expr("try_variant_get(v, '$.session', 'string')").alias("session"),
        F.expr("try_variant_get(v, '$.ts', 'bigint')").alias("ts"),
    )


@query("scan_jsonl", "SELECT id, session, ts FROM {usage_raw}")
def scan_jsonl(t):
    return _read_back(X.scan_jsonl(t.spark, _written(t, "jsonl"), "*.txt").where("terminated"))


def _zst_writer(folder: str):
    """Task-side writer: each partition becomes one file, each batch one frame of it."""

    def write(batches):
        import zstandard
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        system, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        system.create_dir(base, recursive=True)
        name = f"{base}/part-{task.partitionId():05d}"
        with system.open_output_stream(f"{name}.{task.taskAttemptId()}") as out:
            for batch in batches:
                text = "".join(v + "\n" for v in batch["value"])
                out.write(zstandard.ZstdCompressor().compress(text.encode()))
        system.move(f"{name}.{task.taskAttemptId()}", f"{name}.jsonl.zst")
        yield from ()  # no rows, and a partition may have no batch either

    return write


@query("scan_jsonl_zst", "SELECT id, session, ts FROM {usage_raw}")
def scan_jsonl_zst(t):
    folder = scratch_path(t.spark, "zst")
    t.usage_raw.select(_json(**_ID_JSON).alias("value")).mapInPandas(_zst_writer(folder), "value string").count()
    return _read_back(X.scan_jsonl_zst(t.spark, folder))


@query("file_fingerprint", "SELECT 'user=' || user_id % 7 AS folder, CAST(sum(length(id) + 1) AS BIGINT) AS size, true AS dated FROM {usage_raw} GROUP BY 1")
def file_fingerprint(t):
    """Files of known bytes, one folder per user group; the text is ASCII and every line ends."""
    folder = scratch_path(t.spark, "bytes")
    t.usage_raw.selectExpr("id", "user_id % 7 AS user").write.partitionBy("user").text(folder)
    found = X.list_files(t.spark, folder, "part-*").withColumn("folder", F.element_at(F.split("path", "/"), -2))
    return found.groupBy("folder").agg(F.sum("size").alias("size"), (F.min("mtime_ms") > 0).alias("dated"))


@query("raw_lines_page", "SELECT event_id AS line, id AS value FROM {usage_raw} WHERE event_id > 20 AND event_id <= 120")
def raw_lines_page(t):
    lines = t.usage_raw.select(F.lit("f").alias("path"), F.col("event_id").alias("line"), F.col("id").alias("value"))
    ledger = t.usage_raw.groupBy(F.lit("f").alias("path")).agg(F.lit(10).alias("size"))
    return X.raw_lines_page(lines, ledger, "f", 20, 100, 10)


@query("malformed_count", """SELECT 'logs/p' || user_id % 7 || '/f.jsonl' AS path,
 count(*) FILTER ((k % 6 = 1 AND k % 4 <> 0) OR k % 6 = 2) AS malformed FROM {usage_raw} GROUP BY 1""")
def malformed_count(t):
    good = _json(timestamp="=ts", type="x")
    timeless = _json(type="assistant", message={"usage": {"input_tokens": "=k"}})
    plain = _json(type="session_meta", payload={"id": "=session"})
    value = F.expr("k % 6")
    text = F.when(value == 1, F.lit('{"cut":')).when(value == 2, timeless).when(value == 3, plain).otherwise(good)
    lines = _lines(t.usage_raw, _PATH, text).join(
        t.usage_raw.select(F.col("event_id").alias("line"), F.expr("k % 4 != 0").alias("terminated")), ["line"]
    )
    return N.malformed_count(lines)


# --- context -------------------------------------------------------------------------------------

_CONTEXT = """SELECT event_id AS line, 's' || user_id % 7 AS path,
 coalesce(last_value(CASE WHEN k % 5 = 0 THEN session END IGNORE NULLS) OVER w, 's' || user_id % 7) AS session,
 coalesce(last_value(CASE WHEN k % 5 IN (0, 1) THEN nullif(p, '') END IGNORE NULLS) OVER w, '') AS project,
 coalesce(last_value(CASE WHEN k % 5 = 1 THEN nullif(model_raw, '') END IGNORE NULLS) OVER w, 'unknown') AS model
FROM (SELECT *, CASE user_id % 5 WHEN 0 THEN 'App' WHEN 1 THEN 'app' WHEN 2 THEN 'App' WHEN 3 THEN 'app' ELSE '' END AS p FROM {usage_raw}) u
WINDOW w AS (PARTITION BY user_id % 7 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def _context_lines(t):
    meta = _json(type="session_meta", payload={"id": "=session", "cwd": "=project"})
    turn = _json(type="turn_context", payload={"model": "=model_raw", "cwd": "=project"})
    other = _json(type="other", payload={"id": "=id"})
    text = F.when(F.expr("k % 5 = 0"), meta).when(F.expr("k % 5 = 1"), turn).otherwise(other)
    return _lines(t.usage_raw, "concat('s', user_id % 7, '.jsonl')", text)


@query("carry_context", _CONTEXT)
def carry_context(t):
    rows = N.carry_context(N.parsed(_context_lines(t)))
    return rows.select("line", S.file_stem("path").alias("path"), "session", "project", "model")


@query("session_title", "SELECT 's' || user_id % 7 || '.jsonl' AS path, arg_min(repeat(id || ' ', 60), event_id) AS title, left(arg_min(repeat(id || ' ', 60), event_id), 180) AS label FROM {usage_raw} WHERE k % 3 = 0 GROUP BY 1")
def session_title(t):
    text = _json(type=F.expr("IF(k % 3 = 0, 'user', 'assistant')"), message={"content": "=repeat(concat(id, ' '), 60)"})
    return N.session_title(N.parsed(_lines(t.usage_raw, "concat('s', user_id % 7, '.jsonl')", text)))


# --- cumulative log ----------------------------------------------------------------------------------


def _cumulative_lines(t):
    """Per session a head, a model, then running totals and tool calls in file order."""
    heads = t.usage_raw.select("session", "project").dropDuplicates()
    path = "concat('rollouts/', session, '.jsonl')"
    meta = _lines(heads, path, _json(type="session_meta", payload={"id": "=session", "cwd": "=project"}), "1")
    turn = _lines(heads, path, _json(type="turn_context", payload={"model": "GLM-5.3-Flash"}), "2")
    used = {
        "input_tokens": "=c_input", "cached_input_tokens": "=c_cached", "cache_write_input_tokens": "=c_cache_write",
        "output_tokens": "=c_output", "reasoning_output_tokens": "=c_reasoning",
    }
    last = {
        "input_tokens": "=last_input + last_cached", "cached_input_tokens": "=last_cached",
        "cache_write_input_tokens": "=last_cache_write", "output_tokens": "=last_output",
        "reasoning_output_tokens": "=last_reasoning",
    }
    info = {"total_token_usage": used, "last_token_usage": last}
    limits = {"primary": {"used_percent": "=k % 3"}}
    counts = _json(timestamp="=ts", type="event_msg", payload={"type": "token_count", "rate_limits": limits, "info": info})
    totals = _lines(t.counters, path, counts, "2 * CAST(substring(id, 2) AS BIGINT) + 10")
    calls = _json(timestamp="=ts", type="response_item", payload={"type": "function_call", "name": "exec_command", "call_id": "=id"})
    tools = _lines(t.usage_raw.where("event_type = 'click'"), path, calls, "2 * event_id + 11")
    return meta.unionByName(turn).unionByName(totals).unionByName(tools)


_C = ("c_input", "c_cached", "c_cache_write", "c_output", "c_reasoning")
_CUM = f"""WITH s AS (SELECT c.*, u.user_id, row_number() OVER w AS n, {', '.join(f'lag({c}) OVER w AS p{c[1:]}' for c in _C)} FROM {{counters}} c JOIN {{usage_raw}} u ON u.id = c.id
  WINDOW w AS (PARTITION BY c.session ORDER BY u.event_id)),
u AS (SELECT *, n = 1 OR c_input < p_input OR c_output < p_output AS own, greatest(c_input - p_input, 0) AS whole FROM s
  WHERE NOT (n > 1 AND {' AND '.join(f'{c} = p{c[1:]}' for c in _C)})),
d AS (SELECT *, CASE WHEN own THEN last_cached ELSE least(greatest(c_cached - p_cached, 0), whole) END AS cached FROM u)
SELECT session || ':' || ts || ':' || (c_input + c_cache_write + c_output) || ':' || c_cached || ':' || c_reasoning AS id, 'codex' AS agent, session,
 {_PROJECT} AS project, 'glm-5.3-flash' AS model, ts, CASE WHEN own THEN last_input ELSE whole - cached END AS input, cached,
 CASE WHEN own THEN last_cache_write ELSE greatest(c_cache_write - p_cache_write, 0) END AS cache_write,
 CASE WHEN own THEN last_output ELSE greatest(c_output - p_output, 0) END AS output,
 CASE WHEN own THEN last_reasoning ELSE greatest(c_reasoning - p_reasoning, 0) END AS reasoning FROM d"""


@query("norm_cumulative_log", f"SELECT * FROM ({_CUM.replace('WITH s AS', 'WITH s AS')}) x WHERE input + cached + cache_write + output > 0")
def norm_cumulative_log(t):
    return N.norm_cumulative_log(_cumulative_lines(t), "codex")["events"].select(*_OUT)


@query("norm_cumulative_tools", "SELECT session || ':' || id AS id, session, ts, 'exec_command' AS name FROM {usage_raw} WHERE event_type = 'click'")
def norm_cumulative_tools(t):
    return N.norm_cumulative_log(_cumulative_lines(t), "codex")["activities"].select("id", "session", "ts", "name")


@query("norm_cumulative_quota", """SELECT session, ts, used FROM (SELECT session, ts, k % 3 AS used, lag(k % 3) OVER (PARTITION BY session ORDER BY event_id) AS p FROM {usage_raw}) x
 WHERE p IS DISTINCT FROM used""")
def norm_cumulative_quota(t):
    rows = N.norm_cumulative_log(_cumulative_lines(t), "codex")["quota"]
    used = F.get_json_object("payload", "$.primary.used_percent").cast("bigint")
    return rows.select("session", "ts", used.alias("used"))


# --- message layouts ------------------------------------------------------------------------------------


def _message_lines(t):
    usage = {
        "input_tokens": "=input", "cache_read_input_tokens": "=cached", "cache_creation_input_tokens": "=cache_write",
        "output_tokens": "=output", "output_tokens_details": {"thinking_tokens": "=reasoning"},
    }
    content = F.expr("array(named_struct('type', 'tool_use', 'id', id, 'name', 'Read'), named_struct('type', 'tool_use', 'id', CAST(NULL AS STRING), 'name', 'Bash'))")
    model = "=IF(k % 9 = 0, '<synthetic>', model_raw)"
    text = _json(
        timestamp="=ts", type=F.expr("IF(k % 8 = 0, 'user', 'assistant')"), sessionId="=session", cwd="=project",
        requestId="=concat('q', k)", message={"id": "=id", "model": model, "usage": usage, "content": content},
    )
    return _lines(t.usage_raw, _PATH, text)


_MESSAGE = "k % 8 <> 0 AND k % 9 <> 0 AND model_raw <> ''"


@query("norm_message_log", f"SELECT id || 'q' || k AS id, 'claude-code' AS agent, session, p AS project, {_NAME} AS model, ts, input, cached, cache_write, output, reasoning FROM (SELECT *, last_value(nullif({_PROJECT}, '') IGNORE NULLS) OVER (PARTITION BY user_id % 7 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p0 FROM {{usage_raw}}) x, LATERAL (SELECT coalesce(p0, '') AS p) WHERE {_MESSAGE} AND input + cached + cache_write + output > 0")
def norm_message_log(t):
    return N.norm_message_log(_message_lines(t), "claude-code")["events"].select(*_OUT)


@query("norm_message_tools", f"SELECT session || ':' || id AS id, 'Read' AS name, ts FROM {{usage_raw}} WHERE {_MESSAGE} UNION ALL SELECT session || ':' || id || ':1', 'Bash', ts FROM {{usage_raw}} WHERE {_MESSAGE}")
def norm_message_tools(t):
    return N.norm_message_log(_message_lines(t), "claude-code")["activities"].select("id", "name", "ts")


@query("norm_callid_log", f"SELECT id, 'workbuddy' AS agent, session, 'u' || user_id AS project, {_NAME} AS model, ts, input - {_CACHED} AS input, {_CACHED} AS cached, 0 AS cache_write, output, 0 AS reasoning FROM {{usage_raw}} WHERE k % 4 <> 0 AND input + output > 0")
def norm_callid_log(t):
    usage = {"input_tokens": "=input", "cache_read_input_tokens": "=cached", "output_tokens": "=output"}
    text = _json(timestamp="=ts", id="=IF(k % 4 = 0, '', id)", sessionId="=session", providerData={"model": "=model_raw"}, message={"usage": usage})
    lines = _lines(t.usage_raw, "concat('logs/x-WorkBuddy-u', user_id, '/f.jsonl')", text)
    return N.norm_callid_log(lines, "workbuddy")["events"].select(*_OUT)


@query("norm_role_log", f"SELECT session || ':' || id AS id, 'pi' AS agent, session, {_PROJECT} AS project, {_NAME} AS model, ts, input, cached, cache_write, output, reasoning FROM {{usage_raw}} WHERE k % 6 <> 5 AND input + cached + cache_write + output > 0")
def norm_role_log(t):
    heads = t.usage_raw.select("session", "project").dropDuplicates()
    path = "concat('pi/', session, '.jsonl')"
    head = _lines(heads, path, _json(type="session", id="=session", cwd="=project"), "1")
    usage = {"input": "=input", "cacheRead": "=cached", "cacheWrite": "=cache_write", "output": "=output", "reasoning": "=reasoning"}
    role = "=IF(k % 6 = 5, 'user', 'assistant')"
    text = _json(timestamp="=ts", type="message", id="=id", message={"role": role, "model": "=model_raw", "usage": usage})
    body = _lines(t.usage_raw, path, text, "event_id + 2")
    return N.norm_role_log(head.unionByName(body), "pi")["events"].select(*_OUT)


@query("norm_chunk_log", "SELECT 'd' || user_id % 7 || ':f.jsonl:' || event_id || CASE WHEN k % 2 = 1 THEN ':' || k || ':a' ELSE '' END AS id, 'dsh' AS agent, 'm' || k AS model, ts, input, cached, cache_write, output, reasoning FROM {usage_raw} WHERE input + cached + cache_write + output > 0")
def norm_chunk_log(t):
    usage = {"inputTokens": "=input", "cacheReadTokens": "=cached", "cacheWriteTokens": "=cache_write", "outputTokens": "=output", "reasoningTokens": "=reasoning"}
    message = {"source": {"model": "=concat('M', k)"}}
    new = _json(type="assistant/message", seq="=event_id", time="=ts", data={"message": message, "usage": usage})
    old = _json(type="assistant/chunk", seq="=event_id", time="=ts", data={"turn": "=k", "step": "a", "message": message, "chunk": {"type": "usage", "usage": usage}})
    lines = _lines(t.usage_raw, "concat('dsh/d', user_id % 7, '/f.jsonl')", F.when(F.expr("k % 2 = 1"), old).otherwise(new))
    return N.norm_chunk_log(lines, "dsh")["events"].select("id", "agent", "model", "ts", "input", "cached", "cache_write", "output", "reasoning")


@query("norm_turn_log", f"""SELECT session || ':' || id || ':' || m AS id, 'grok' AS agent, session, 'w' AS project, lower(m) AS model, ts, input - {_CACHED} AS input, {_CACHED} AS cached, cache_write, output, reasoning
FROM (SELECT *, unnest(CASE WHEN k % 3 = 0 THEN ['grok'] ELSE ['A', 'B'] END) AS m FROM {{usage_raw}}) u WHERE input + cache_write + output > 0""")
def norm_turn_log(t):
    one = {"inputTokens": "=input", "cachedReadTokens": "=cached", "cacheCreationTokens": "=cache_write", "outputTokens": "=output", "reasoningTokens": "=reasoning"}
    split = {"sessionUpdate": "turn_completed", "prompt_id": "=id", "usage": {"modelUsage": {"A": one, "B": one}}}
    whole = {"sessionUpdate": "turn_completed", "prompt_id": "=id", "usage": {**one, "modelUsage": F.expr("CAST(map() AS MAP<STRING, STRING>)")}}
    text = F.when(F.expr("k % 3 = 0"), _json(timestamp="=ts div 1", params={"sessionId": "=session", "update": whole})).otherwise(
        _json(timestamp="=ts", params={"sessionId": "=session", "update": split})
    )
    lines = _lines(t.usage_raw, "concat('grok/%2Fhome%2Fw/', session, '/updates.jsonl')", text)
    return N.norm_turn_log(lines, "grok")["events"].select(*_OUT)


def _credit_lines(t):
    usage = {
        "credits": "=k / 4.0D", "original_credits": "=IF(k % 5 = 0, NULL, k / 2.0D)", "billable": "=k % 2 = 0",
        "request_id": "=IF(k % 7 = 0, '', id)", "context_usage_ratio": "=k / 128.0D",
    }
    text = _json(timestamp="=ts", type="assistant", sessionId="=session", cwd="=project", message={"model": "=IF(k % 2 = 0, 'qf', 'qm')", "usage": usage})
    return _lines(t.usage_raw, "concat('q/', session, '.jsonl')", text)


@query("norm_credit_log", f"""SELECT id AS request_id, session, {_PROJECT} AS project, CASE WHEN k % 2 = 0 THEN 'qf' ELSE 'qm' END AS model, ts, CAST(k AS DOUBLE) / 4 AS credits,
 CASE WHEN k % 5 = 0 THEN NULL ELSE CAST(k AS DOUBLE) / 2 END AS original_credits, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS billable_requests FROM {{usage_raw}} WHERE k % 7 <> 0""")
def norm_credit_log(t):
    rows = N.norm_credit_log(_credit_lines(t))["credits"]
    return rows.select("request_id", "session", "project", "model", "ts", "credits", "original_credits", "billable_requests")


@query("norm_credit_malformed", "SELECT 'q/' || session || '.jsonl' AS path, count(*) AS malformed FROM {usage_raw} WHERE k % 7 = 0 GROUP BY 1")
def norm_credit_malformed(t):
    return N.norm_credit_log(_credit_lines(t))["malformed"]


@query("norm_state_snapshot", f"""SELECT session, ts, ts - 5000 AS created_at, {_NAME} AS model, {_PROJECT} AS project, input + cached AS c_input, cached AS c_cached, cache_write AS c_cache_write, output AS c_output
FROM (SELECT *, trim(model_raw) AS m0 FROM {{usage_raw}}) u WHERE k % 6 <> 1""".replace(_NAME, "coalesce(nullif(model_raw, ''), 'unknown')"))
def norm_state_snapshot(t):
    good = {"input_tokens": "=input + cached", "cache_read_input_tokens": "=cached", "cache_creation_input_tokens": "=cache_write", "output_tokens": "=output"}
    bad = {"input_tokens": "=-1", "output_tokens": "=output"}
    base = dict(sessionId="=session", createdAt="=ts - 5000", updatedAt="=ts", model="=model_raw", cwd="=project")
    text = (
        F.when(F.expr("k % 6 = 0"), _json(**base, total=bad, usage=good))
        .when(F.expr("k % 6 = 1"), _json(**base, total=bad)).when(F.expr("k % 6 = 2"), _json(**base, data={"total": good}))
        .otherwise(_json(**base, total=good))
    )
    rows = N.norm_state_snapshot(t.usage_raw.select(F.col("id").alias("path"), text.alias("value")))
    return rows.select("session", "ts", "created_at", "model", "project", "c_input", "c_cached", "c_cache_write", "c_output")


# --- landed tables ------------------------------------------------------------------------------------------


def _sessions(t):
    return t.usage_raw.select(F.col("session").alias("id"), F.col("project").alias("directory")).dropDuplicates().where("hash(id) IS NOT NULL")


def _model_usage(t):
    return t.usage_raw.selectExpr(
        "id", "session AS session_id", "model_raw AS model_id", "ts AS started_at", "IF(k % 10 = 0, NULL, input) AS input_tokens",
        "IF(k % 9 = 0, -5, output) AS output_tokens", "reasoning AS reasoning_tokens", "cache_write AS cache_creation_input_tokens",
        "cached AS cache_read_input_tokens",
    )


_USAGE_IN = "CASE WHEN k % 10 = 0 THEN 0 ELSE input END"
_USAGE_OUT = "CASE WHEN k % 9 = 0 THEN 0 ELSE output END"


@query("scan_usage_tables", f"""SELECT id, 'zcode' AS agent, session, {_PROJECT} AS project, {_NAME} AS model, ts, i - least(cached, i) AS input, least(cached, i) AS cached, cache_write, o AS output, reasoning
FROM (SELECT *, {_USAGE_IN} AS i, {_USAGE_OUT} AS o FROM {{usage_raw}}) u WHERE i + cache_write + o > 0""")
def scan_usage_tables(t):
    return B.normalize_model_usage(_model_usage(t), _sessions(t), "zcode", "db/usage")[0].select(*_OUT)


def _tool_usage(t):
    return t.usage_raw.selectExpr("event_id AS rowid", "IF(k % 7 = 0, NULL, session) AS session_id", "CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE event_type END AS tool_name", "ts AS started_at")


@query("scan_tool_usage", "SELECT session || ':' || event_id AS id, 'zcode' AS agent, session, ts, event_type AS name FROM {usage_raw} WHERE k % 7 <> 0 AND k % 5 > 1")
def scan_tool_usage(t):
    return B.normalize_tool_usage(_tool_usage(t), "zcode", "db/usage")[0].select("id", "agent", "session", "ts", "name")


@query("scan_tool_malformed", "SELECT count(*) FILTER (k % 7 = 0 OR k % 5 = 1) AS malformed FROM {usage_raw}")
def scan_tool_malformed(t):
    return B.normalize_tool_usage(_tool_usage(t), "zcode", "db/usage")[1]


@query("session_dir_join", f"SELECT id, {_PROJECT} AS project FROM {{usage_raw}}")
def session_dir_join(t):
    return B.with_directory(_model_usage(t), _sessions(t)).select("id", "project")


def _messages(t):
    tokens = {
        "input": "=IF(k % 11 = 0, -1, input)", "output": "=output", "reasoning": "=reasoning", "cache": {"read": "=cached", "write": "=cache_write"},
        "total": "=IF(k % 13 = 0, 1, input + cached + cache_write + output + reasoning)",
    }
    role = "=IF(k % 3 = 0, 'user', 'assistant')"
    data = _json(role=role, modelID="=model_raw", time={"created": "=ts + 1"}, tokens=tokens)
    return t.usage_raw.select("id", F.col("session").alias("session_id"), F.col("ts").alias("time_created"), data.alias("data"))


@query("scan_message_tables", f"""SELECT id, 'xiaomi-mimo' AS agent, session, {_PROJECT} AS project, {_NAME} AS model, ts + 1 AS ts, input, cached, cache_write, output + reasoning AS output, reasoning
FROM {{usage_raw}} WHERE k % 3 <> 0 AND k % 11 <> 0 AND k % 13 <> 0""")
def scan_message_tables(t):
    return B.normalize_message_table(_messages(t), _sessions(t), "xiaomi-mimo", "db/m", True)[0].select(*_OUT)


@query("scan_message_malformed", "SELECT count(*) AS malformed FROM {usage_raw} WHERE k % 3 <> 0 AND (k % 11 = 0 OR k % 13 = 0)")
def scan_message_malformed(t):
    return B.normalize_message_table(_messages(t), _sessions(t), "xiaomi-mimo", "db/m", True)[1]


@query("scan_part_tools", "SELECT session || ':' || CASE WHEN k % 4 = 0 THEN id ELSE 'c' || k END AS id, session, CASE WHEN k % 2 = 0 THEN ts - 50 ELSE ts END AS ts, event_type AS name FROM {usage_raw} WHERE k % 3 <> 0")
def scan_part_tools(t):
    data = _json(
        type="=IF(k % 3 = 0, 'text', 'tool')", tool="=event_type", callID="=IF(k % 4 = 0, NULL, concat('c', k))",
        state={"time": {"start": "=IF(k % 2 = 0, ts - 50, NULL)"}},
    )
    part = t.usage_raw.select("id", F.col("session").alias("session_id"), F.col("ts").alias("time_created"), data.alias("data"))
    return B.normalize_parts(part, "opencode", "db/m").select("id", "session", "ts", "name")


def _generations(t):
    return t.usage_raw.selectExpr(
        "session", "event_id AS idx", "concat('db/', session) AS path", "model_raw AS model", "input AS f2", "IF(k % 2 = 0, output, 0) AS f3", "cache_write AS f4", "cached AS f5",
        "reasoning AS f9", "IF(k % 3 = 0, NULL, output) AS f10", "IF(k % 5 = 0, 0, ts div 1000) AS done_s", "IF(k % 5 = 0, 0, 7000000L) AS done_ns",
    )


def _steps(t):
    return t.usage_raw.where("k % 10 != 0").selectExpr("session", "event_id AS idx", "ts div 1000 AS sec", "9000000L AS nanos")


_GEN_TS = "CASE WHEN k % 5 <> 0 THEN ts - ts % 1000 + 7 WHEN k % 10 <> 0 THEN ts - ts % 1000 + 9 ELSE 0 END"
_GEN_OUT = "CASE WHEN k % 2 = 0 AND output > 0 THEN output WHEN k % 3 <> 0 THEN output + reasoning ELSE reasoning END"


def _summaries(t):
    rows = t.usage_raw.select("session", "user_id").dropDuplicates()
    return rows.selectExpr("session AS conversation_id", """concat('["file:///w/p', user_id % 5, '"]') AS workspace_uris""")


@query("scan_generation_tables", f"""SELECT session || ':' || event_id AS id, 'antigravity' AS agent, session, 'p' || user_id % 5 AS project, {_NAME} AS model, t AS ts, input, cached, cache_write, o AS output, reasoning
FROM (SELECT *, {_GEN_TS} AS t, {_GEN_OUT} AS o FROM {{usage_raw}}) u WHERE t > 0 AND (input > 0 OR o > 0 OR cached > 0)""")
def scan_generation_tables(t):
    return B.normalize_generations(_generations(t), _steps(t), _summaries(t), "antigravity")[0].select(*_OUT)


@query("step_time_join", f"SELECT event_id AS idx, {_GEN_TS} AS ts FROM {{usage_raw}}")
def step_time_join(t):
    return B.with_step_time(_generations(t), _steps(t)).select("idx", "ts")


@query("project_index_join", "SELECT event_id AS idx, 'p' || user_id % 5 AS project FROM {usage_raw}")
def project_index_join(t):
    return B.with_project(_generations(t), _summaries(t)).select("idx", "project")
