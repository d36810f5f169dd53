"""Queries that apply one column builder to text or numbers derived from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as D, scalars as S, text as T, variants as V
from .inputs import r6
from .registry import query


def _raw(t, **columns: str):
    return t.usage_raw.withColumns({n: F.expr(e) for n, e in columns.items()})


def _parsed(t, text: str):
    return t.usage_raw.withColumn("v", V.parse(F.expr(text)))


# --- numbers and times at the edge -----------------------------------------------------------

_TS_TEXT = """CASE k % 6 WHEN 0 THEN '{"t":' || (ts div 1000) || '}' WHEN 1 THEN '{"t":' || ts || '}'
 WHEN 2 THEN '{"t":"' || date_format(timestamp_millis(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS") || 'Z"}'
 WHEN 3 THEN '{"t":"' || date_format(timestamp_millis(ts + 28800000), "yyyy-MM-dd'T'HH:mm:ss") || '+08:00"}'
 WHEN 4 THEN '{"t":"' || date_format(timestamp_millis(ts), "yyyy-MM-dd'T'HH:mm:ss") || '"}' ELSE '{"t":-5}' END"""


@query("ts_ms", "SELECT id, CASE k % 6 WHEN 0 THEN ts - ts % 1000 WHEN 1 THEN ts WHEN 2 THEN ts WHEN 3 THEN ts - ts % 1000 END AS ms FROM {usage_raw}")
def ts_ms(t):
    return _parsed(t, _TS_TEXT).select("id", V.ts_ms("v", "t").alias("ms"))


@query("sec_nanos_ms", """SELECT id, CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 ELSE ts - ts % 1000 + k END AS ms FROM {usage_raw}""")
def sec_nanos_ms(t):
    rows = _raw(
        t, sec="CASE k % 4 WHEN 0 THEN 9223372036854775807 WHEN 1 THEN -1 ELSE ts div 1000 END", nanos="k * 1000000"
    )
    return rows.select("id", S.sec_nanos_ms("sec", "nanos").alias("ms"))


_COUNT_TEXT = """CASE k % 8 WHEN 0 THEN '{"n":' || k || '}' WHEN 1 THEN '{"n":" ' || k || ' "}' WHEN 2 THEN '{"n":"' || k || 'a"}'
 WHEN 3 THEN '{"n":-' || (k + 1) || '}' WHEN 4 THEN '{"n":true}' WHEN 5 THEN '{"n":' || k || '.7}' WHEN 6 THEN '{"n":"1e3"}' ELSE '{}' END"""


@query("count_of", "SELECT id, CASE k % 8 WHEN 0 THEN k WHEN 1 THEN k WHEN 5 THEN k WHEN 6 THEN 1000 ELSE 0 END AS n FROM {usage_raw}")
def count_of(t):
    return _parsed(t, _COUNT_TEXT).select("id", V.count_of("v", "n").alias("n"))


_OPENAI = """'{"input_tokens":' || input || ',"cached_input_tokens":"' || cached || '","cache_read_input_tokens":' || (k * 120)
 || ',"cache_write_input_tokens":' || cache_write || ',"output_tokens":' || output || ',"reasoning_output_tokens":' || reasoning || '}'"""


@query("openai_tokens", "SELECT id, input - least(greatest(cached, k * 120), input) AS input, least(greatest(cached, k * 120), input) AS cached, cache_write, output, reasoning FROM {usage_raw}")
def openai_tokens(t):
    rows = _parsed(t, _OPENAI).select("id", S.openai_tokens("v", "").alias("tok"))
    new = F.col("tok.whole") - F.col("tok.cached")
    return rows.select("id", new.alias("input"), "tok.cached", "tok.cache_write", "tok.output", "tok.reasoning")


@query("total_tokens", "SELECT id, CASE WHEN k % 10 = 0 THEN 9223372036854775807 ELSE input + cached + cache_write + output END AS total FROM {usage_raw}")
def total_tokens(t):
    rows = _raw(t, big="IF(k % 10 = 0, 9223372036854775807, input)")
    return rows.select("id", S.total_tokens("big").alias("total"))


@query("drop_zero_usage", "SELECT id FROM {usage_raw} WHERE input + cached + cache_write + output > 0")
def drop_zero_usage(t):
    return t.usage_raw.where(S.total_tokens() > 0).select("id")


# --- identities --------------------------------------------------------------------------------


@query("normalize_model", "SELECT id, coalesce(nullif(lower(trim(model_raw)), ''), 'unknown') AS model FROM {usage_raw}")
def normalize_model(t):
    return t.usage_raw.select("id", S.normalize_model("model_raw").alias("model"))


@query("project_key", "SELECT id, CASE WHEN user_id % 5 IN (0, 1) THEN 'c:/work/app' ELSE project END AS project_key FROM {usage_raw}")
def project_key(t):
    return t.usage_raw.select("id", S.project_key("project").alias("project_key"))


@query("project_name", "SELECT id, CASE user_id % 5 WHEN 0 THEN 'App' WHEN 1 THEN 'app' WHEN 2 THEN 'App' WHEN 3 THEN 'app' ELSE '' END AS project_name FROM {usage_raw}")
def project_name(t):
    return t.usage_raw.select("id", S.project_name("project").alias("project_name"))


@query("display_path", "SELECT id, CASE k % 3 WHEN 0 THEN '\\\\nas\\' || session WHEN 1 THEN 'Q:\\' || session ELSE '/tmp/' || session END AS path FROM {usage_raw}")
def display_path(t):
    lead = F.when(F.col("k") % 3 == 0, "\\\\?\\UNC\\nas\\").when(F.col("k") % 3 == 1, "\\\\?\\Q:\\").otherwise("/tmp/")
    return t.usage_raw.select("id", S.display_path(F.concat(lead, "session")).alias("path"))


@query("uri_project", "SELECT id, CASE k % 4 WHEN 0 THEN 'My App+' || user_id WHEN 1 THEN 'p' || user_id WHEN 2 THEN '' ELSE '' END AS project FROM {usage_raw}")
def uri_project(t):
    text = """CASE k % 4 WHEN 0 THEN '["untitled:x","file:///D:/w/My%20App+' || user_id || '"]' WHEN 1 THEN '["file:///etc/p' || user_id || '/"]'
      WHEN 2 THEN '["http://h/x"]' ELSE 'not json' END"""
    return _raw(t, u=text).select("id", S.uri_project("u").alias("project"))


@query("dir_project", "SELECT id, CASE k % 2 WHEN 0 THEN 'u' || user_id ELSE 'plain' || user_id END AS marked, 'My App' AS decoded FROM {usage_raw}")
def dir_project(t):
    path = "'/r/C%3A%5Cw%5CMy%20App/' || IF(k % 2 = 0, 'x-WorkBuddy-u', 'plain') || user_id || '/f.jsonl'"
    return _raw(t, p=path).select("id", S.marker_project("p").alias("marked"), S.encoded_dir_project("p").alias("decoded"))


@query("tool_activity_id", "SELECT session || ':' || CASE WHEN k % 2 = 0 THEN 'c' || k ELSE 'line:' || event_id END AS id, event_type AS name FROM {usage_raw} WHERE k % 5 <> 0")
def tool_activity_id(t):
    from ..sources.normalize import activity_rows

    rows = _raw(t, call_id="IF(k % 2 = 0, 'c' || k, '')", name="IF(k % 5 = 0, '', event_type)", line="event_id", path="session")
    return activity_rows(rows).select("id", "name")


# --- calendar and buckets ------------------------------------------------------------------------


@query("bucket_floor", "SELECT id, ts + 19800000 - (ts + 19800000) % 86400000 - 19800000 AS bucket FROM {usage_raw}")
def bucket_floor(t):
    return t.usage_raw.select("id", S.bucket_floor("ts", 86_400_000, 19_800_000).alias("bucket"))


@query("local_day", "SELECT id, strftime(make_timestamp((ts - 18000000) * 1000), '%Y-%m-%d') AS day, strftime(make_timestamp((ts - 18000000) * 1000), '%Y-%m') AS month FROM {usage_raw}")
def local_day(t):
    zone = "America/New_York"
    return t.usage_raw.select("id", S.local_day("ts", zone).alias("day"), S.local_month("ts", zone).alias("month"))


@query("local_month", "SELECT id, strftime(make_timestamp((ts + 20700000) * 1000), '%Y-%m') AS month FROM {usage_raw}")
def local_month(t):
    return t.usage_raw.select("id", S.local_month("ts", "Asia/Kathmandu").alias("month"))


@query("day_bounds", "SELECT DISTINCT day, epoch_ms(CAST(day AS TIMESTAMP)) - 28800000 AS range_start, epoch_ms(CAST(day AS TIMESTAMP)) + 57600000 AS range_end FROM (SELECT strftime(make_timestamp((ts + 28800000) * 1000), '%Y-%m-%d') AS day FROM {usage_raw}) d")
def day_bounds(t):
    days = t.usage_raw.select(S.local_day("ts", "Asia/Shanghai").alias("day")).dropDuplicates()
    start, end = S.day_bounds("day", "Asia/Shanghai")
    return days.withColumns({"range_start": start, "range_end": end})


@query("duration_ms", "SELECT id, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN 0 ELSE k * 10 END AS ms FROM {usage_raw}")
def duration_ms(t):
    iso = lambda e: f"""date_format(timestamp_millis({e}), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")"""
    rows = _raw(t, a=iso("ts"), b=f"CASE k % 4 WHEN 0 THEN 'never' WHEN 1 THEN {iso('ts - 5')} ELSE {iso('ts + k * 10')} END")
    return rows.select("id", S.duration_ms("a", "b").alias("ms"))


# --- money text -------------------------------------------------------------------------------------


@query("display_cost", f"SELECT id, CASE WHEN cost IS NULL THEN NULL ELSE {r6('round(CAST(cost * 6.7521 AS DECIMAL(38,12)), 8)')} END AS shown, cost IS NULL AS unpriced FROM {{priced}}")
def display_cost(t):
    shown = S.display_cost("cost", "CNY", 6.7521)
    return t.priced.select(
        "id", S.money(F.when(shown != "unpriced", shown.try_cast("double"))).alias("shown"), (shown == "unpriced").alias("unpriced")
    )


@query("cost_parts", "SELECT id, " + ", ".join(r6(f"cost_{p}") + f" AS cost_{p}" for p in ("input", "cached", "cache_write", "output")) + " FROM {priced}")
def cost_parts(t):
    return t.priced.select("id", *[S.money(f"cost_{p}").alias(f"cost_{p}") for p in ("input", "cached", "cache_write", "output")])


@query("csv_safe", "SELECT id, CASE k % 4 WHEN 0 THEN '''=' || k WHEN 1 THEN '''-' || k WHEN 2 THEN 'a=' || k ELSE '''@' || k END AS cell FROM {usage_raw}")
def csv_safe(t):
    return _raw(t, c="CASE k % 4 WHEN 0 THEN '=' || k WHEN 1 THEN '-' || k WHEN 2 THEN 'a=' || k ELSE '@' || k END").select(
        "id", S.csv_safe("c").alias("cell")
    )


# --- process text --------------------------------------------------------------------------------------

_OUTPUT = """concat('Wall time ', k / 4, ' seconds\\n', CASE k % 14 WHEN 0 THEN 'Process exited with code 0\\nexit code: 3\\n' WHEN 1 THEN concat('Exit code: ', k, '\\n')
 WHEN 2 THEN 'Process stopped with signal SIGTERM\\n' WHEN 3 THEN '{"exit_code":7,"output":"x"}\\n' WHEN 4 THEN '{"meta":{"exit_code":7,"signal":"SIGHUP"}}\\n'
 WHEN 5 THEN '{"exit_code":7,"signal":"SIGINT" broken\\n' WHEN 6 THEN '{"value":{"exit_code":4}}\\n' WHEN 7 THEN '{"status":"fulfilled","value":{"exit_code":4},"exit_code":9}\\n'
 WHEN 8 THEN '{"value":{"signal":"SIGHUP"}}\\n{"signal":"SIGKILL"}\\n' WHEN 9 THEN '{"exit_code":1.5}\\n{"exit_code":"2"}\\n' WHEN 10 THEN '  Command failed with exit code -3...  \\r\\n'
 WHEN 11 THEN '{"status":"fulfilled","exit_code":5}\\n' WHEN 12 THEN ' Process stopped with signal SIGINT\\nProcess stopped with signal SIGTERM now\\n' ELSE 'no exit code: 5 here\\n' END)"""


@query("exit_code_of", "SELECT id, CASE k % 14 WHEN 0 THEN 3 WHEN 1 THEN k WHEN 3 THEN 7 WHEN 7 THEN 4 WHEN 10 THEN -3 WHEN 11 THEN 5 END AS code FROM {usage_raw}")
def exit_code_of(t):
    return _raw(t, o=_OUTPUT).select("id", T.exit_code_of("o").alias("code"))


@query("signal_of", "SELECT id, CASE k % 14 WHEN 2 THEN 'SIGTERM' WHEN 8 THEN 'SIGKILL' END AS signal FROM {usage_raw}")
def signal_of(t):
    return _raw(t, o=_OUTPUT).select("id", T.signal_of("o").alias("signal"))


@query("wall_ms_of", "SELECT id, k * 250 AS ms FROM {usage_raw}")
def wall_ms_of(t):
    return _raw(t, o=_OUTPUT).select("id", T.wall_ms_of("o").alias("ms"))


@query("clean_text", "SELECT id, 'a' || k || chr(10) || 'b' || chr(10) || 'c' AS clean FROM {usage_raw}")
def clean_text(t):
    dirty = F.concat(F.lit("\x1b[31ma"), F.col("k").cast("string"), F.lit("\x1b[0m\r\nb\x07\rc\x00"))
    return t.usage_raw.select("id", T.clean_text(dirty).alias("clean"))


_COMMAND = """CASE k % 8 WHEN 0 THEN 'cat a' || k || '.txt' WHEN 1 THEN 'rg -n foo src' WHEN 2 THEN 'ls -la dir' WHEN 3 THEN 'sed -n 1,20p x.py'
 WHEN 4 THEN 'cat a > b' WHEN 5 THEN 'rm -rf x' WHEN 6 THEN 'rg --files' ELSE 'grep foo $(ls)' END"""


@query("command_label", "SELECT id, CASE k % 8 WHEN 0 THEN 'Read' WHEN 1 THEN 'Search' WHEN 2 THEN 'List' WHEN 3 THEN 'Read' WHEN 6 THEN 'List' END AS label FROM {usage_raw}")
def command_label(t):
    return _raw(t, c=_COMMAND).select("id", T.command_label("c").alias("label"))


# --- transcript records ---------------------------------------------------------------------------------

_TEXTS = """CASE k % 7 WHEN 0 THEN '{"message":" hi ' || k || ' "}' WHEN 1 THEN '{"message":{"content":"c' || k || '"}}' WHEN 2 THEN '{"content":[{"text":"a"},{"type":"image","image_url":"data:x"},{"type":"file"}]}'
 WHEN 3 THEN '{"item":{"text":"i"}}' WHEN 4 THEN '{"summary":[{"text":"s1"},{"text":"s2"}]}' WHEN 5 THEN '{"content":{"a":1}}' ELSE '{"message":5}' END"""


@query("text_of", """SELECT id, CASE k % 7 WHEN 0 THEN 'hi ' || k WHEN 1 THEN 'c' || k WHEN 2 THEN 'a' || chr(10) || '[image: embedded data]' || chr(10) || '[file]'
 WHEN 3 THEN 'i' WHEN 4 THEN 's1' || chr(10) || 's2' WHEN 5 THEN '{"a":1}' END AS text FROM {usage_raw}""".replace('{"a":1}', "{LB}\"a\":1{RB}"))
def text_of(t):
    return _parsed(t, _TEXTS).select("id", D.text_of("v").alias("text"))


_KINDS = """CASE k % 10 WHEN 0 THEN 'user_message' WHEN 1 THEN 'message' WHEN 2 THEN 'function_call' WHEN 3 THEN 'mcp_tool_call_output' WHEN 4 THEN 'patch_apply_end'
 WHEN 5 THEN 'error_cleared' WHEN 6 THEN 'context_compacted' WHEN 7 THEN 'token_count' WHEN 8 THEN 'agent_reasoning' ELSE 'session_summary' END"""
_ROLES = """CASE WHEN k % 3 = 0 THEN '{"role":"assistant"}' WHEN k % 3 = 1 THEN '{"role":"developer"}' ELSE '{"status":"failed"}' END"""


@query("event_kind", """SELECT id, CASE k % 10 WHEN 0 THEN 'user' WHEN 1 THEN CASE k % 3 WHEN 0 THEN 'assistant' WHEN 1 THEN 'system' ELSE 'error' END
 WHEN 2 THEN 'tool_call' WHEN 3 THEN CASE WHEN true THEN 'tool_output' END WHEN 4 THEN 'patch' WHEN 5 THEN CASE WHEN k % 3 = 2 THEN 'error' ELSE 'unknown' END
 WHEN 6 THEN CASE WHEN k % 3 = 2 THEN 'error' ELSE 'notice' END WHEN 7 THEN 'usage' WHEN 8 THEN 'reasoning' ELSE CASE WHEN k % 3 = 2 THEN 'error' ELSE 'unknown' END END AS kind FROM {usage_raw}""")
def event_kind(t):
    kinds = _KINDS.replace("mcp_tool_call_output", "mcp_tool_output")
    rows = _parsed(t, _ROLES).withColumn("type", F.expr(kinds))
    return rows.select("id", D.event_kind("type", "v").alias("kind"))
