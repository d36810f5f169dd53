"""Queries over session transcripts whose lines are derived from the events table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import text as T, variants as V
from ..operators import replay as Y, summaries as R, tree as G
from ..session import store
from ..sources import normalize as N
from .inputs import METRIC_SQL, START, WINDOW, r6
from .logs import _json, _lines
from .registry import query


def _iso(ts: str) -> str:
    return f"""=date_format(timestamp_millis({ts}), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")"""


def _message(ts: str, **payload):
    return _json(timestamp=_iso(ts), type="event_msg", payload=payload)


def _item(ts: str, **payload):
    return _json(timestamp=_iso(ts), type="response_item", payload=payload)


_RPATH = "concat('r/', session, '.jsonl')"


def transcript_lines(t):
    """Ten line numbers per event, after a head; what an event becomes depends on its type."""
    raw = t.usage_raw
    at = lambda test, j, value: F.when(F.expr(test), F.struct(F.expr(f"CAST(10 * event_id + {100 + j} AS BIGINT)").alias("line"), value.alias("value")))
    heads = raw.select("session", "project", (F.col("user_id") % 3).alias("b"), "user_id").dropDuplicates()
    meta = {"id": "=session", "cwd": "=project", "cli_version": "1.2", "git": {"branch": "=concat('b', user_id)"}, "base_instructions": {"text": "=concat('Base ', b)"}}
    signup, view, click, error, buy = [f"event_type = '{n}'" for n in ("signup", "view", "click", "error", "purchase")]
    turn = "=concat('t', event_id)"
    open_cell = f"{click} AND k % 4 = 0"
    said = """=CASE k % 4 WHEN 0 THEN concat('Script running with cell ID c', event_id) WHEN 1 THEN 'Process exited with code 0'
      WHEN 2 THEN 'Process exited with code 3' ELSE 'Process stopped with signal SIGTERM' END"""
    used = {"input_tokens": "=input + cached", "cached_input_tokens": "=cached", "output_tokens": "=output", "reasoning_output_tokens": "=reasoning"}
    parts = [
        at(signup, 0, _json(timestamp=_iso("ts"), type="turn_context", payload={"turn_id": turn, "model": "GLM-5.3-Flash", "cwd": "=project"})),
        at(signup, 1, _message("ts", type="task_started", turn_id=turn)),
        at(f"{signup} AND k % 2 = 0", 2, _message("ts + k * 10", type="task_complete", turn_id=turn)),
        at(view, 0, _message("ts", type="user_message", message="=concat('hi ', k % 3)")),
        at(f"{view} AND k % 2 = 0", 1, _item("ts", type="message", role="user", content="=concat('hi ', k % 3)")),
        at(view, 2, _message("ts", type="agent_message", message="=concat('ok ', k)")),
        at(f"{view} AND k % 7 = 0", 3, _message("ts", type="=concat('mystery', k % 2)")),
        at(f"{view} AND k % 11 = 0", 4, F.lit('{"type":"event_msg",')),
        at(click, 0, _item("ts", type="function_call", name="exec_command", call_id="=id", arguments="""=concat('{"cmd":"cat f', k, '"}')""")),
        at(click, 1, _item("ts + 100", type="function_call_output", call_id="=id", output=said)),
        at(open_cell, 2, _item("ts + 200", type="function_call", name="write_stdin", call_id="=concat(id, 'w')", arguments="""=concat('{"session_id":"c', event_id, '","chars":"y"}')""")),
        at(open_cell, 3, _item("ts + 300", type="function_call_output", call_id="=concat(id, 'w')", output="=concat('done\\nProcess exited with code 0')")),
        at(f"{error} AND k % 2 = 0", 0, _message("ts", type="error", message="=concat('bad ', k)")),
        at(f"{error} AND k % 2 = 1", 0, _message("ts", type="patch_apply_end", call_id="=concat('p', k % 3)", success=F.expr("k % 3 = 0"), stdout="=concat('patch ', k)")),
        at(buy, 0, _message("ts", type="token_count", info={"last_token_usage": used})),
    ]
    each = raw.select(F.expr(_RPATH).alias("path"), F.explode(F.array_compact(F.array(*parts))).alias("l"))  # events are read once
    return _lines(heads, _RPATH, _json(type="session_meta", payload=meta), "1").unionByName(each.select("path", "l.line", "l.value"))


def _written(t):
    """The derived lines, written once per query like the log files they stand for."""
    if "_transcript" not in t.__dict__:
        t.__dict__["_transcript"] = store(transcript_lines(t), "transcript")
    return t.__dict__["_transcript"]


def _rows(t):
    return Y.turn_assign(Y.records(_written(t)))


def _events(t):
    return N.norm_cumulative_log(_written(t), "codex")["events"]


_X = """(SELECT *, 'r/' || session || '.jsonl' AS path, 10 * event_id + 100 AS base,
 coalesce(last_value(CASE WHEN event_type = 'signup' THEN 't' || event_id END IGNORE NULLS) OVER w, 'Ungrouped') AS turn_id
 FROM {usage_raw} WINDOW w AS (PARTITION BY session ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


# Which lines an event has after its first, as transcript_lines writes them.
_MORE = {1: "event_type IN ('signup', 'click') OR (event_type = 'view' AND k % 2 = 0)", 3: "(event_type = 'view' AND k % 7 = 0) OR (event_type = 'click' AND k % 4 = 0)",
         2: "event_type = 'view' OR (event_type = 'signup' AND k % 2 = 0) OR (event_type = 'click' AND k % 4 = 0)"}


@query("turn_assign", f"SELECT path, base AS line, turn_id FROM {_X} x UNION ALL SELECT DISTINCT 'r/' || session || '.jsonl', 1, 'Ungrouped' FROM {{usage_raw}} "
       + " ".join(f"UNION ALL SELECT path, base + {j}, turn_id FROM {_X} x WHERE {test}" for j, test in _MORE.items()))
def turn_assign(t):
    return _rows(t).select("path", "line", "turn_id")


_TURNS = f"""SELECT path, turn_id, max(CASE WHEN event_type = 'signup' THEN ts END) AS start_ms,
 max(CASE WHEN event_type = 'signup' AND k % 2 = 0 THEN ts + k * 10 END) AS end_ms,
 max(CASE WHEN event_type = 'signup' AND k % 2 = 0 THEN k * 10 END) AS duration_ms FROM {_X} x
 WHERE event_type <> 'purchase' GROUP BY path, turn_id"""


@query("turn_bounds", _TURNS)
def turn_bounds(t):
    return Y.turn_bounds(_rows(t)).drop("first_line")


_TOLD = f"""SELECT path, turn_id, base AS line, 'user' AS kind, 'hi ' || k % 3 AS text FROM {_X} x WHERE event_type = 'view'
UNION ALL SELECT path, turn_id, base + 2, 'assistant', 'ok ' || k FROM {_X} x WHERE event_type = 'view'"""


@query("mirror_message_flag", _TOLD)
def mirror_message_flag(t):
    return Y.drop_mirrors(Y.messages(_rows(t))).select("path", "turn_id", "line", "kind", "text")


@query("base_messages", "SELECT DISTINCT 'r/' || session || '.jsonl' AS path, 'Base ' || user_id % 3 AS text, 1 AS line FROM {usage_raw}")
def base_messages(t):
    return Y.base_messages(_rows(t))


@query("turn_base_counts", f"SELECT path, turn_id, 1 AS base_messages FROM ({_TURNS}) b")
def turn_base_counts(t):
    rows = _rows(t)
    return Y.turn_base_counts(Y.turn_bounds(rows), Y.base_messages(rows))


_TOOLS = f"""SELECT path, base AS line, turn_id, id AS call_id, CASE k % 4 WHEN 2 THEN 'failed' WHEN 3 THEN 'stopped' ELSE 'completed' END AS status, k % 4 = 2 AS is_error,
 CASE WHEN k % 4 = 0 THEN 300 ELSE 100 END AS duration_ms, CASE k % 4 WHEN 0 THEN 'Script running with cell ID c' || event_id || chr(10) || '› Sent: y' || chr(10) || 'done' || chr(10) || 'Process exited with code 0' || chr(10) || 'Process exited with code 0'
  WHEN 1 THEN 'Process exited with code 0' WHEN 2 THEN 'Process exited with code 3' ELSE 'Process stopped with signal SIGTERM' END AS output,
 CASE WHEN k % 4 = 0 THEN 2 ELSE 1 END AS outputs FROM {_X} x WHERE event_type = 'click'"""


@query("tool_calls", _TOOLS)
def tool_calls(t):
    return Y.tool_calls(_rows(t)).select("path", "line", "turn_id", "call_id", "status", "is_error", "duration_ms", "output", "outputs")


def _named_rows(t):
    """Calls of two names; some answered by id, some by outputs that only bear the name, one or two at once, some never."""
    click, turn = t.usage_raw.where("event_type = 'click'"), t.usage_raw.where("event_type = 'signup'")
    at = lambda rows, j, value: _lines(rows, _RPATH, value, f"10 * event_id + {100 + j}")
    name = "=CASE k % 3 WHEN 0 THEN 'Read' ELSE 'Bash' END"
    bare = _item("ts + 50", type="function_call_output", name=name, output="=concat('out ', k)")
    parts = [
        at(turn, 0, _json(timestamp=_iso("ts"), type="turn_context", payload={"turn_id": "=concat('t', event_id)", "model": "m", "cwd": "=project"})),
        at(click, 0, _item("ts", type="function_call", name=name, call_id="=id", arguments="{}")),
        at(click.where("k % 4 = 0"), 1, _item("ts + 50", type="function_call_output", call_id="=id", output="=concat('own ', k)")),
        at(click.where("k % 4 = 1 OR k % 4 = 2"), 1, bare), at(click.where("k % 8 = 5"), 2, bare),
    ]
    return Y.turn_assign(Y.records(store(reduce(lambda a, b: a.unionByName(b), parts), "named")))


@query("output_name_match", f"""WITH RECURSIVE c AS (SELECT path, base, k, turn_id, CASE k % 3 WHEN 0 THEN 'Read' ELSE 'Bash' END AS name FROM {_X} x WHERE event_type = 'click'),
e AS (SELECT path, turn_id, name, line, step, row_number() OVER (PARTITION BY path, turn_id, name ORDER BY line) AS n FROM (
 SELECT path, turn_id, name, base AS line, 1 AS step FROM c WHERE k % 4 <> 0 UNION ALL SELECT path, turn_id, name, base + 1, -1 FROM c WHERE k % 4 = 1 OR k % 4 = 2
 UNION ALL SELECT path, turn_id, name, base + 2, -1 FROM c WHERE k % 8 = 5) u),
r AS (SELECT path, turn_id, name, n, line, step, CASE WHEN step = 1 THEN [line] ELSE CAST([] AS BIGINT[]) END AS stack, CAST(NULL AS BIGINT) AS call_line FROM e WHERE n = 1
 UNION ALL SELECT e.path, e.turn_id, e.name, e.n, e.line, e.step, CASE WHEN e.step = 1 THEN list_append(r.stack, e.line) ELSE r.stack[1:len(r.stack) - 1] END,
  CASE WHEN e.step = -1 THEN r.stack[len(r.stack)] END FROM r JOIN e ON e.path = r.path AND e.turn_id = r.turn_id AND e.name = r.name AND e.n = r.n + 1)
SELECT path, line, call_line FROM r WHERE step = -1 UNION ALL SELECT path, base + 1, base FROM c WHERE k % 4 = 0""")
def output_name_match(t):
    rows = _named_rows(t)
    paired = Y.pair_calls(Y.call_rows(rows), Y.output_rows(rows))
    return paired.select("path", "line", F.col("opened.call_line").alias("call_line"))


@query("tool_status", f"""SELECT base + 1 AS line, CASE k % 4 WHEN 0 THEN 'running' WHEN 2 THEN 'failed' WHEN 3 THEN 'stopped' ELSE 'completed' END AS status, k % 4 = 2 AS is_error
 FROM {_X} x WHERE event_type = 'click' UNION ALL SELECT base + 3, 'completed', false FROM {_X} x WHERE event_type = 'click' AND k % 4 = 0""")
def tool_status(t):
    return Y.process_continuations(_rows(t)).select("line", "status", "is_error")


@query("call_output_join", f"SELECT base + 1 AS line, id AS call_id, base AS call_line FROM {_X} x WHERE event_type = 'click' UNION ALL SELECT base + 3, id || 'w', base + 2 FROM {_X} x WHERE event_type = 'click' AND k % 4 = 0")
def call_output_join(t):
    rows = _rows(t)
    paired = Y.pair_calls(Y.call_rows(rows), Y.output_rows(rows))
    return paired.select("line", "call_id", F.col("opened.call_line").alias("call_line"))


@query("process_continuations", f"SELECT base + 3 AS line, base AS root_line FROM {_X} x WHERE event_type = 'click' AND k % 4 = 0")
def process_continuations(t):
    return Y.process_continuations(_rows(t)).where("continued").select("line", "root_line")


@query("patches", f"SELECT path, base AS line, turn_id, 'p' || k % 3 AS call_id, k % 3 = 0 AS success, 'patch ' || k AS output FROM {_X} x WHERE event_type = 'error' AND k % 2 = 1")
def patches(t):
    return Y.patches(_rows(t)).select("path", "line", "turn_id", "call_id", "success", "output")


@query("patch_count", f"SELECT path, turn_id, count(DISTINCT k % 3) AS patches FROM {_X} x WHERE event_type = 'error' AND k % 2 = 1 GROUP BY path, turn_id")
def patch_count(t):
    return Y.patch_count(_rows(t))


_USED = f"SELECT * FROM {_X} x WHERE event_type = 'purchase' AND input + cached + output > 0"


@query("token_items", f"""SELECT path, base AS line, turn_id, ts, CASE WHEN turn_id = 'Ungrouped' THEN 'unknown' ELSE 'glm-5.3-flash' END AS model,
 input, cached, 0 AS cache_write, output, reasoning FROM ({_USED}) u""")
def token_items(t):
    return Y.token_items(_events(t), _rows(t))


_ATTACHED = f"""SELECT path, base AS line, CASE WHEN p_type = 'click' AND p_turn = turn_id THEN p_base END AS tool_line FROM
 (SELECT *, lag(event_type) OVER w AS p_type, lag(turn_id) OVER w AS p_turn, lag(base) OVER w AS p_base FROM {_X} x
  WHERE event_type = 'click' OR (event_type = 'purchase' AND input + cached + output > 0) WINDOW w AS (PARTITION BY path ORDER BY base)) y WHERE event_type = 'purchase'"""


@query("attach_usage_to_tool", _ATTACHED)
def attach_usage_to_tool(t):
    rows = _rows(t)
    usage = Y.token_items(_events(t), rows)
    return Y.attach_usage(usage, Y.process_continuations(rows)).select("path", "line", "tool_line")


@query("timeline", f"""SELECT path, turn_id, line AS anchor, 0 AS after, line, kind AS item FROM ({_TOLD}) m
UNION ALL SELECT path, turn_id, base, 0, base, 'tool_call' FROM {_X} x WHERE event_type = 'click'
UNION ALL SELECT path, turn_id, base, 0, base, CASE WHEN k % 2 = 0 THEN 'error' ELSE 'patch' END FROM {_X} x WHERE event_type = 'error'
UNION ALL SELECT u.path, u.turn_id, coalesce(a.tool_line, u.base), 1, u.base, 'usage' FROM ({_USED}) u JOIN ({_ATTACHED}) a ON a.path = u.path AND a.line = u.base""")
def timeline(t):
    return Y.timeline(_rows(t), _events(t)).select("path", "turn_id", "anchor", "after", "line", "item")


@query("unknown_types", f"SELECT path, count(DISTINCT k % 2) AS unknown_types FROM {_X} x WHERE event_type = 'view' AND k % 7 = 0 GROUP BY path")
def unknown_types(t):
    return Y.unknown_types(_rows(t))


@query("replay_meta", "SELECT DISTINCT 'r/' || session || '.jsonl' AS path, nullif(project, '') AS cwd, '1.2' AS cli_version, 'b' || user_id AS branch FROM {usage_raw}")
def replay_meta(t):
    return Y.session_meta(_rows(t)).select("path", "cwd", "cli_version", F.col("git")["branch"].alias("branch"))


_USED = f"""SELECT c.*, (input * ri + cached * rc + output * ro) / 1e6 / CASE currency WHEN 'CNY' THEN 6.7521 ELSE 1 END AS cost FROM (
 SELECT *, CASE turn_id WHEN 'Ungrouped' THEN 'unknown' ELSE 'glm-5.3-flash' END AS model, CASE WHEN project = '' THEN '' ELSE regexp_extract(rtrim(replace(project, '{{BS}}', '/'), '/'), '[^/]+$') END AS name
 FROM {_X} x WHERE event_type = 'purchase' AND input + cached + output > 0) c
 LEFT JOIN {{named_spans}} s ON s.name = c.model AND c.ts >= s.from_ms AND c.ts < s.to_ms"""


@query("replay_summary", f"""WITH u AS (SELECT path, min(ts) AS first, CAST(sum(input + cached) AS BIGINT) AS input, CAST(sum(cached) AS BIGINT) AS cached, CAST(sum(output) AS BIGINT) AS output,
  CAST(sum(reasoning) AS BIGINT) AS reasoning, CAST(sum(input + cached + output) AS BIGINT) AS total_tokens, sum(cost) AS cost, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM ({_USED}) c GROUP BY path),
p AS (SELECT path, string_agg(DISTINCT name, ',' ORDER BY name) AS projects FROM (SELECT path, name FROM ({_USED}) c UNION SELECT path, project FROM {_X} x WHERE project <> '') n GROUP BY path),
s AS (SELECT path, max(nullif(project, '')) AS cwd, max(user_id) AS user_id, min(ts) AS start_ms,
 max(CASE WHEN event_type = 'signup' AND k % 2 = 0 THEN ts + k * 10 WHEN event_type = 'click' THEN ts + CASE WHEN k % 4 = 0 THEN 300 ELSE 100 END ELSE ts END) AS end_ms,
 count(DISTINCT CASE WHEN event_type <> 'purchase' THEN turn_id END) AS turns, 2 * count(*) FILTER (event_type = 'view') AS messages,
 count(*) FILTER (event_type = 'click') AS tools, count(*) FILTER (event_type = 'error' AND k % 2 = 1) AS patches,
 count(*) FILTER ((event_type = 'error' AND (k % 2 = 0 OR k % 3 <> 0)) OR (event_type = 'click' AND k % 4 = 2)) AS errors,
 count(DISTINCT CASE WHEN event_type = 'view' AND k % 7 = 0 THEN k % 2 END) AS unknown_types, count(*) FILTER (event_type = 'view' AND k % 11 = 0) AS malformed_lines,
 max(base + CASE WHEN event_type = 'view' AND k % 11 = 0 THEN 4 {' '.join(f'WHEN {_MORE[j]} THEN {j}' for j in (3, 2, 1))} ELSE 0 END) AS raw_lines FROM {_X} x GROUP BY path)
SELECT s.path, start_ms, end_ms, end_ms - start_ms AS duration_ms, CASE WHEN first IS NOT NULL THEN greatest(first - start_ms, 0) END AS first_token_ms, cwd, '1.2' AS cli_version, 'b' || user_id AS branch,
 coalesce(models, '') AS models, coalesce(projects, '') AS projects, coalesce(input, 0) AS input, coalesce(cached, 0) AS cached, coalesce(output, 0) AS output, coalesce(reasoning, 0) AS reasoning,
 coalesce(total_tokens, 0) AS total_tokens, {r6('coalesce(cost, 0)')} AS cost, turns, messages, tools, patches, errors, unknown_types, malformed_lines, raw_lines
FROM s LEFT JOIN u ON u.path = s.path LEFT JOIN p ON p.path = s.path""")
def replay_summary(t):
    lines = _written(t).withColumn("terminated", F.lit(True))
    rows = Y.replay_summary(_rows(t), t.price(_events(t)), lines).withColumn("branch", F.col("git")["branch"])
    return rows.withColumns({c: F.array_join(c, ",") for c in ("models", "projects")}).drop("git")


# --- reading order of a conversation ---------------------------------------------------------------

_ITEMS = """SELECT 'f' || user_id % 7 AS path, 'u' || user_id AS turn_id, event_id AS seq,
 CASE event_type WHEN 'view' THEN 'user' WHEN 'error' THEN 'patch' ELSE 'usage' END AS item, event_type <> 'error' OR k % 2 = 0 AS visible, 'm' || k % 2 AS model FROM {usage_raw}"""


@query("islands_usage_fold", f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY seq) AS n FROM ({_ITEMS}) i WHERE visible),
r AS (SELECT turn_id, n, path, seq, item, CASE WHEN item = 'usage' THEN seq END AS shown, item = 'usage' AS own_entry, CAST(NULL AS VARCHAR) AS badge, CAST(NULL AS BIGINT) AS badge_seq FROM s WHERE n = 1
 UNION ALL SELECT s.turn_id, s.n, s.path, s.seq, s.item,
  CASE WHEN s.item <> 'usage' THEN NULL WHEN r.badge IS NULL THEN s.seq WHEN r.badge = s.model THEN r.badge_seq ELSE s.seq END,
  s.item = 'usage' AND r.badge IS NOT NULL AND r.badge <> s.model,
  CASE WHEN s.item <> 'usage' THEN NULL WHEN r.badge IS NULL OR r.badge = s.model THEN s.model END,
  CASE WHEN s.item <> 'usage' THEN NULL WHEN r.badge IS NULL THEN s.seq WHEN r.badge = s.model THEN r.badge_seq END
 FROM r JOIN s ON s.turn_id = r.turn_id AND s.n = r.n + 1)
SELECT path, turn_id, seq, shown, own_entry FROM r WHERE item = 'usage'""")
def islands_usage_fold(t):
    items = t.usage_raw.selectExpr(
        "concat('f', user_id % 7) AS path", "concat('u', user_id) AS turn_id", "event_id AS seq",
        "CASE event_type WHEN 'view' THEN 'user' WHEN 'error' THEN 'patch' ELSE 'usage' END AS item",
        "event_type != 'error' OR k % 2 = 0 AS visible", "concat('m', k % 2) AS model",
    )
    return Y.fold_usage(items).select("path", "turn_id", "seq", "shown", "own_entry")


_ENTRIES = "SELECT 'u' || user_id AS turn_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'Read' WHEN 'click' THEN 'Search' WHEN 'signup' THEN 'List' END AS label FROM {usage_raw}"


@query("islands_exploration", f"""SELECT turn_id, min(seq) AS first_seq, count(*) AS entries, count(*) FILTER (label = 'Read') AS reads, count(*) FILTER (label = 'Search') AS searches, count(*) FILTER (label = 'List') AS lists
FROM (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY seq) - row_number() OVER (PARTITION BY turn_id, label IS NULL ORDER BY seq) AS g FROM ({_ENTRIES}) e) x WHERE label IS NOT NULL GROUP BY turn_id, g""")
def islands_exploration(t):
    command = F.expr("CASE event_type WHEN 'view' THEN 'cat a' WHEN 'click' THEN 'rg x' WHEN 'signup' THEN 'ls' ELSE 'make' END")
    entries = t.usage_raw.select(F.lit("f").alias("path"), F.expr("concat('u', user_id)").alias("turn_id"), F.col("event_id").alias("seq"), T.command_label(command).alias("label"))
    return Y.exploration_blocks(entries).drop("path", "run")


@query("conversation_turns", """SELECT 'c' || conv_id AS path, count(*) FILTER (role = 'user') AS users, count(*) FILTER (role = 'assistant') AS assistants,
 count(*) FILTER (role = 'system') AS systems FROM conversations WHERE trim(text, chr(32) || chr(9) || chr(10) || chr(13)) <> '' GROUP BY conv_id""")
def conversation_turns(t):
    text = _json(type="message", role="=role", content="=text")
    lines = t.conversations.select(F.expr("concat('c', conv_id)").alias("path"), (F.col("turn") + 1).alias("line"), text.alias("value"))
    told = Y.messages(Y.turn_assign(Y.records(lines)))
    count = lambda kind: F.count_if(F.col("kind") == kind)
    return told.groupBy("path").agg(count("user").alias("users"), count("assistant").alias("assistants"), count("system").alias("systems"))


# --- families -----------------------------------------------------------------------------------------

_NODES = """SELECT DISTINCT 'n/' || user_id || '.jsonl' AS path, 'u' || user_id AS id, CASE WHEN user_id > 2 THEN 'u' || user_id // 3 END AS parent, CASE WHEN user_id > 2 THEN 1 ELSE 0 END AS depth FROM {usage_raw}"""


def _nodes(t):
    users = t.usage_raw.select("user_id").dropDuplicates()
    spawn = {"parent_thread_id": "=IF(user_id > 2, concat('u', user_id div 3), NULL)", "depth": "=IF(user_id > 2, 1, 0)", "agent_path": "=concat('/root/', user_id)"}
    value = _json(type="session_meta", payload={"id": "=concat('u', user_id)", "source": {"subagent": {"thread_spawn": spawn}}})
    lines = _lines(users, "concat('n/', user_id, '.jsonl')", value, "1")
    return G.session_nodes(N.parsed(lines))


@query("session_nodes", _NODES)
def session_nodes(t):
    return _nodes(t).select("path", "id", "parent", "depth")


_FOREST = f"""WITH RECURSIVE n AS ({_NODES}), f AS (SELECT id, id AS root, 0 AS hops FROM n WHERE parent IS NULL OR parent NOT IN (SELECT id FROM n)
 UNION ALL SELECT n.id, f.root, f.hops + 1 FROM n JOIN f ON n.parent = f.id)"""


@query("session_forest", f"{_FOREST} SELECT id, root, CAST(hops AS BIGINT) AS hops FROM f")
def session_forest(t):
    return G.session_forest(_nodes(t)).select("id", "root", "hops")


@query("session_tree", f"{_FOREST} SELECT f.id, n.path, n.depth - (SELECT min(depth) FROM n JOIN f USING (id) WHERE f.root = (SELECT root FROM f WHERE id = 'u8')) AS depth FROM f JOIN n ON n.id = f.id WHERE f.root = (SELECT root FROM f WHERE id = 'u8')")
def session_tree(t):
    return G.session_tree(_nodes(t), "n/8.jsonl").select("id", "path", "depth")


_FAMILY = f"""{_FOREST} SELECT f.id, f.root, CAST(sum(p.input + p.cached + p.cache_write + p.output) AS BIGINT) AS tokens, CASE WHEN count(p.id) > 0 AND count(*) FILTER (p.cost IS NULL) = 0 THEN {r6('sum(p.cost)')} END AS cost
FROM f LEFT JOIN (SELECT 'u' || regexp_extract(session, '^s([0-9]+)-', 1) AS u, * FROM {{priced}}) p ON p.u = f.id GROUP BY f.id, f.root"""


def _by_user(t):
    owner = F.concat(F.lit("u"), F.regexp_extract("session", "^s([0-9]+)-", 1))
    return t.priced.withColumn("session", owner)


@query("family_cost", _FAMILY)
def family_cost(t):
    from ..functions.scalars import money

    costs = G.family_cost(G.session_forest(_nodes(t)), _by_user(t))
    return costs.select("id", "root", "tokens", money("cost").alias("cost"))


@query("family_totals", f"SELECT root, count(*) AS sessions, CAST(sum(tokens) AS BIGINT) AS tokens, CASE WHEN count(cost) = count(*) THEN {r6('sum(cost)')} END AS cost FROM ({_FAMILY}) c GROUP BY root")
def family_totals(t):
    from ..functions.scalars import money

    totals = G.family_totals(G.family_cost(G.session_forest(_nodes(t)), _by_user(t)))
    return totals.withColumn("cost", money("cost"))


@query("range_totals", f"SELECT {METRIC_SQL} FROM {{priced}} WHERE session = 's8-2024-01-01' AND ts < {START + 43200000}")
def range_totals(t):
    from dataclasses import replace

    from ..operators.query import select_events

    q = replace(WINDOW, session="s8-2024-01-01", end=START + 43200000)
    return R.totals(t.price(select_events(t.usage_events, q)))
