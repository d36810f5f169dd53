"""Log layouts to one event table, one activity table and one table of observations.

Every normaliser takes lines ``[path, line, value]`` and is a projection over windows of a
file. State that runs through a file (session, project, model, previous totals) is carried
with the sliced operators, so one file with a large share of all lines is still split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S, variants as V
from ..session import store
from ..operators.counters import cumulative_delta
from ..operators.ordered import LINES_PER_SLICE, change_points, with_carried

ZERO_LINE = 0
EVENT = (
    "id", "agent", "session", "project", "model", "ts", "input", "cached", "cache_write",
    "output", "reasoning", "path", "line",
)
# Longest title, and the model name of records that are no request.
TITLE_LENGTH = 180
SYNTHETIC = "<synthetic>"
_FILE, _LINE = ["path"], ["line"]


def parsed(lines: DataFrame) -> DataFrame:
    """Lines with their record as VARIANT; lines that are not JSON are gone."""
    return V.settled(lines.withColumn("v", V.parse("value")), "v").where("v IS NOT NULL").drop("value")


def _kind() -> Column:
    return F.coalesce(V.text_at("v", "type"), F.lit(""))


def _payload_kind() -> Column:
    return F.coalesce(V.text_at("v", "payload.type"), F.lit(""))


def record_ts() -> Column:
    return F.coalesce(V.ts_ms("v", "timestamp"), V.ts_ms("v", "time"), V.ts_ms("v", "message.timestamp"))


def carries_usage() -> Column:
    found = _payload_kind() == "token_count"
    for path in ("message.usage", "params.update.usage", "data.usage", "data.chunk.usage"):
        found = found | V.is_object("v", path)
    return found


def malformed_count(lines: DataFrame) -> DataFrame:
    """Malformed lines per file: complete lines that are not JSON, and usage without a time.

    An unfinished last line may still be being written and is not counted.
    """
    rows = V.settled(lines.withColumn("v", V.parse("value")), "v")
    broken = F.col("v").isNull() & F.col("terminated") & (F.btrim("value", F.lit(S.BLANKS)) != "")
    timeless = F.col("v").isNotNull() & record_ts().isNull() & carries_usage()
    return rows.groupBy("path").agg(F.count_if(broken | timeless).alias("malformed"))


def context_of(rows: DataFrame, session_paths: tuple[str, ...] = (), cwd_path: str | None = None) -> tuple[DataFrame, dict[str, Column]]:
    """``rows`` with helper columns, and what a record says about the running session, project and model; NULL keeps the last.

    Fields are only read from records of the types that have them, and once.
    """
    kind, payload = F.col("_kind"), "payload"
    at = lambda p: V.filled_at("v", p)
    rows = V.settled(rows.withColumns({"_kind": _kind(), "_inner": _payload_kind()}), "_kind", "_inner")
    session = F.coalesce(
        *[at(p) for p in session_paths],
        F.when(kind == "session_meta", F.coalesce(at(f"{payload}.id"), at(f"{payload}.session_id"))).when(kind == "session", at("id")),
    )
    folder = F.coalesce(
        *([at(cwd_path)] if cwd_path else []),
        F.when(kind.isin("session_meta", "turn_context"), at(f"{payload}.cwd")).when(kind == "session", at("cwd")),
    )
    model = (
        F.when(F.col("_inner") == "thread_settings_applied", at("payload.thread_settings.model"))
        .when(kind == "turn_context", at("payload.model"))
        .when(kind == "request/header", at("data.header.config.model"))
    )
    rows = V.settled(rows.withColumns({"_session": session, "_folder": folder, "_model": model}).drop("_kind", "_inner"), "_session", "_folder", "_model")
    return rows, {"session": F.col("_session"), "project": F.nullif(S.project_name("_folder"), F.lit("")), "model": F.col("_model")}


def carry_context(
    rows: DataFrame, session_paths: tuple[str, ...] = (), cwd_path: str | None = None,
    default_session: Column | None = None, default_project: Column | None = None,
    also_model: Column | None = None,
) -> DataFrame:
    """Adds session, project and model as known at each line. Blank values never overwrite."""
    rows = rows.withColumn("_also", also_model if also_model is not None else F.lit(None).cast("string"))
    rows, said = context_of(rows, session_paths, cwd_path)
    said["model"] = F.coalesce("_also", said["model"])
    carried = with_carried(rows, _FILE, _LINE, said, LINES_PER_SLICE).drop("_session", "_folder", "_model", "_also")
    session = default_session if default_session is not None else S.file_stem("path")
    project = default_project if default_project is not None else F.lit("")
    return carried.withColumns(
        {
            "session": F.coalesce("session", session),
            "project": F.coalesce("project", project),
            "model": F.coalesce("model", F.lit(S.UNKNOWN_MODEL)),
        }
    )


def session_title(rows: DataFrame) -> DataFrame:
    """[path, title, label]: the first user message of each file, whole for searches and cut to TITLE_LENGTH
    characters for display."""
    from_user = (
        (_kind() == "user") | (_payload_kind() == "user_message") | (V.text_at("v", "message.role") == "user")
    )
    text = F.coalesce(
        *[V.filled_at("v", p) for p in ("payload.message", "message.content", "message.content[0].text")]
    )
    told = rows.select("path", "line", F.when(from_user, text).alias("title")).where("title IS NOT NULL")
    first = told.groupBy("path").agg(F.min_by("title", "line").alias("title"))
    return first.withColumn("label", F.left("title", F.lit(TITLE_LENGTH)))


def event_rows(rows: DataFrame, agent: str) -> DataFrame:
    """Event layout; a record without tokens is no request."""
    out = rows.withColumns({"agent": F.lit(agent), "model": S.normalize_model("model")})
    return out.select(*EVENT).where(S.total_tokens() > 0)


def activity_rows(calls: DataFrame, agent: str | None = None) -> DataFrame:
    """Tool calls: id is ``session:call``, or the line where the call has no id of its own."""
    own = F.nullif("call_id", F.lit(""))
    spot = F.concat(F.lit("line:"), F.col("line").cast("string"))
    named = calls.where(F.coalesce(F.col("name"), F.lit("")) != "")
    if agent is not None:
        named = named.withColumn("agent", F.lit(agent))
    return named.withColumn("id", F.concat_ws(":", "session", F.coalesce(own, spot))).select(
        "id", "agent", "session", "ts", "name", "path", "line"
    )


def _tokens(rows: DataFrame, usage: Column) -> DataFrame:
    return rows.withColumn("_u", usage).withColumns(
        {t: F.col(f"_u.{t}") for t in ("input", "cached", "cache_write", "output", "reasoning")}
    ).drop("_u")


def _inclusive_tokens(rows: DataFrame, usage: Column) -> DataFrame:
    """Token columns of a usage whose input includes cache reads."""
    return rows.withColumn("_u", usage).withColumns(
        {
            "input": F.col("_u.whole") - F.col("_u.cached"),
            **{t: F.col(f"_u.{t}") for t in ("cached", "cache_write", "output", "reasoning")},
        }
    ).drop("_u")


def _plain_tokens(base: str, **names: str) -> Column:
    return F.struct(*[V.count_of("v", f"{base}.{path}").alias(name) for name, path in names.items()])


# --- cumulative log -------------------------------------------------------------------------------


def norm_cumulative_log(lines: DataFrame, agent: str) -> dict[str, DataFrame]:
    """Records with running totals: events, tool calls and changed quota snapshots."""
    named = F.when(_payload_kind() == "token_count", V.filled_at("v", "payload.info.model"))
    counts, info = _payload_kind() == "token_count", "payload.info"
    has_total = counts & V.is_object("v", f"{info}.total_token_usage")
    has_last = counts & V.is_object("v", f"{info}.last_token_usage")
    called = (_kind() == "response_item") & _payload_kind().isin("function_call", "custom_tool_call")
    rows = parsed(lines).select(
        "path", "line", "v", record_ts().alias("ts"), counts.alias("_counts"), called.alias("_called"),
        F.when(has_total, S.openai_tokens("v", f"{info}.total_token_usage")).alias("_t"),
        F.when(has_last, S.openai_tokens("v", f"{info}.last_token_usage")).alias("_l"),
        F.when(~has_total & has_last, F.to_json(V.at("v", f"{info}.last_token_usage"))).alias("_text"),
        F.when(called, V.text_at("v", "payload.name")).alias("name"), F.when(called, V.text_at("v", "payload.call_id")).alias("call_id"),
        F.when(counts & V.is_object("v", "payload.rate_limits"), F.to_json(V.at("v", "payload.rate_limits"))).alias("payload"),
    )
    # Several jobs read these rows, so they are parsed and carried once, and only fields are shuffled and kept.
    timed = store(carry_context(rows, also_model=named).drop("v"), "context").where("ts IS NOT NULL")
    usage = timed.where("_counts").select("path", "line", "ts", "session", "project", "model", "_t", "_l", "_text")
    total, last = F.col("_t"), F.col("_l")
    samples = usage.where("_t IS NOT NULL").withColumns(
        {
            "c_input": total["whole"], "c_cached": total["cached"],
            "c_cache_write": total["cache_write"], "c_output": total["output"],
            "c_reasoning": total["reasoning"], "spelling": total["spelling"],
            "last_input": last["whole"] - last["cached"],
            **{f"last_{n}": last[n] for n in ("cached", "cache_write", "output", "reasoning")},
            "id": F.concat_ws(
                ":", "session", F.col("ts").cast("string"),
                *[x.cast("string") for x in (S.total_tokens(total["whole"], F.lit(0), total["cache_write"], total["output"]), total["cached"], total["reasoning"])],
            ),
        }
    )
    stepped = cumulative_delta(samples, _FILE, _LINE, "spelling", LINES_PER_SLICE).where("input IS NOT NULL")
    single = _inclusive_tokens(usage.where("_t IS NULL AND _l IS NOT NULL"), F.col("_l")).withColumn(
        "id", F.concat_ws(":", "session", F.col("ts").cast("string"), "_text")
    )
    calls = timed.where("_called")
    limits = timed.where("payload IS NOT NULL").select("path", F.lit(agent).alias("agent"), "session", "ts", "line", "payload")
    return {
        "events": event_rows(stepped, agent).unionByName(event_rows(single, agent)),
        "activities": activity_rows(calls, agent),
        "quota": change_points(limits, ["path", "session"], _LINE, "payload", LINES_PER_SLICE),
    }


# --- message log -------------------------------------------------------------------------------------


def _blocks(rows: DataFrame, block_type: str, fallback: Column) -> DataFrame:
    """Tool blocks of a message's content; ``fallback`` names a block without an id."""
    opened = rows.select("*", F.posexplode(V.array_at("v", "message.content")).alias("_i", "_b"))
    return opened.where(V.text_at("_b", "type") == block_type).withColumns(
        {"name": V.text_at("_b", "name"), "call_id": F.coalesce(V.filled_at("_b", "id"), fallback)}
    )


def norm_message_log(lines: DataFrame, agent: str) -> dict[str, DataFrame]:
    """Assistant messages with usage; needs a message id and a real model."""
    rows = carry_context(parsed(lines), ("sessionId", "session_id"), "cwd").withColumn("ts", record_ts())
    model = V.filled_at("v", "message.model")
    real = rows.where(
        F.col("ts").isNotNull() & (_kind() == "assistant") & V.is_object("v", "message.usage")
        & V.filled_at("v", "message.id").isNotNull() & model.isNotNull() & (model != SYNTHETIC)
    ).withColumns({"model": model, "_mid": V.filled_at("v", "message.id")})
    usage = _tokens(
        real.withColumn("id", F.concat("_mid", F.coalesce(V.text_at("v", "requestId"), F.lit("")))),
        _plain_tokens(
            "message.usage", input="input_tokens", cached="cache_read_input_tokens",
            cache_write="cache_creation_input_tokens", output="output_tokens",
            reasoning="output_tokens_details.thinking_tokens",
        ),
    )
    blocks = _blocks(real, "tool_use", F.concat_ws(":", "_mid", F.col("_i").cast("string")))
    return {"events": event_rows(usage, agent), "activities": activity_rows(blocks, agent)}


def norm_callid_log(lines: DataFrame, agent: str) -> dict[str, DataFrame]:
    """Usage rows need their own id; calls need a call id. Input includes cache."""
    rows = carry_context(parsed(lines), ("sessionId",), default_project=S.marker_project("path"))
    timed = rows.withColumn("ts", record_ts()).where("ts IS NOT NULL")
    used = timed.where(V.is_object("v", "message.usage") & V.filled_at("v", "id").isNotNull()).withColumns(
        {"id": V.filled_at("v", "id"), "model": F.coalesce(V.filled_at("v", "providerData.model"), F.lit(S.UNKNOWN_MODEL))}
    )
    calls = timed.where((_kind() == "function_call") & V.filled_at("v", "callId").isNotNull())
    calls = calls.withColumns({"name": V.text_at("v", "name"), "call_id": V.text_at("v", "callId")})
    usage = _inclusive_tokens(used, S.openai_tokens("v", "message.usage"))
    return {"events": event_rows(usage, agent), "activities": activity_rows(calls, agent)}


def norm_role_log(lines: DataFrame, agent: str) -> dict[str, DataFrame]:
    """Messages of the assistant; the id is the record's or the response's."""
    usage = _plain_tokens("message.usage", input="input", cached="cacheRead", cache_write="cacheWrite", output="output", reasoning="reasoning")
    rows = carry_context(parsed(lines).withColumns(
        {
            "ts": record_ts(), "_said": (_kind() == "message") & (V.text_at("v", "message.role") == "assistant"),
            "_id": F.coalesce(V.filled_at("v", "id"), V.filled_at("v", "message.responseId")),
            "_named": F.coalesce(V.filled_at("v", "message.model"), F.lit(S.UNKNOWN_MODEL)),
            "_usage": F.when(V.is_object("v", "message.usage"), usage),
        }
    ))
    said = rows.where("ts IS NOT NULL AND _said")
    used = said.where("_usage IS NOT NULL AND _id IS NOT NULL").withColumns({"id": F.concat_ws(":", "session", "_id"), "model": F.col("_named")})
    usage = _tokens(used, F.col("_usage"))
    blocks = _blocks(said, "toolCall", F.col("_i").cast("string"))
    return {"events": event_rows(usage, agent), "activities": activity_rows(blocks, agent)}


def _as_written(path: str) -> Column:
    """A label that may be text, a number or absent; absent differs from 0."""
    text = F.coalesce(V.text_at("v", path), F.to_json(V.at("v", path)))
    return F.when(V.is_null("v", path), F.lit("")).otherwise(text)


def norm_chunk_log(lines: DataFrame, agent: str) -> dict[str, DataFrame]:
    """Two generations of records; the older needs turn and step in its key."""
    new, old = _kind() == "assistant/message", (_kind() == "assistant/chunk") & (V.text_at("v", "data.chunk.type") == "usage")
    model = F.when(new | old, V.filled_at("v", "data.message.source.model"))
    rows = carry_context(parsed(lines), default_session=S.path_part("path", 2), also_model=model)
    timed = rows.withColumn("ts", record_ts()).where("ts IS NOT NULL")
    names = dict(
        input="inputTokens", cached="cacheReadTokens", cache_write="cacheWriteTokens",
        output="outputTokens", reasoning="reasoningTokens",
    )
    seq = F.coalesce(F.to_json(V.at("v", "seq")), F.lit("null"))
    stem = F.concat_ws(":", "session", S.path_part("path", 1), seq)
    fresh = _tokens(
        timed.where(new & V.is_object("v", "data.usage")).withColumn("id", stem), _plain_tokens("data.usage", **names)
    )
    older = _tokens(
        timed.where(old & V.is_object("v", "data.chunk.usage")).withColumn(
            "id", F.concat_ws(":", stem, _as_written("data.turn"), _as_written("data.step"))
        ),
        _plain_tokens("data.chunk.usage", **names),
    )
    return {"events": event_rows(fresh, agent).unionByName(event_rows(older, agent))}


def norm_turn_log(lines: DataFrame, agent: str, whole_turn_model: str = "grok") -> dict[str, DataFrame]:
    """Finished turns: one event per model of the turn, or one for the whole turn."""
    update = "params.update"
    per_model = V.map_at("v", f"{update}.usage.modelUsage")
    whole = F.create_map(F.lit(whole_turn_model), V.at("v", f"{update}.usage"))
    step = V.text_at("v", f"{update}.sessionUpdate")
    prompt = F.coalesce(V.text_at("v", f"{update}.prompt_id"), F.to_json(V.at("v", f"{update}.prompt_id")))
    read = parsed(lines).withColumns({"ts": record_ts(), "_step": step, "_prompt": prompt, "_models": per_model}).withColumn(
        "_usage", F.when(F.col("_step") == "turn_completed", F.when(F.size("_models") > 0, F.col("_models")).otherwise(whole))
    ).drop("_models")
    timed = carry_context(
        read, ("params.sessionId",), default_session=S.path_part("path", 2), default_project=S.encoded_dir_project("path"),
    ).where("ts IS NOT NULL")
    opened = timed.where("_step = 'turn_completed'").select(
        "path", "line", "ts", "session", "project", F.coalesce("_prompt", F.col("ts").cast("string")).alias("_prompt"),
        F.explode("_usage").alias("model", "v"),
    )
    whole_input = V.count_of("v", "inputTokens")
    cached = F.least(V.count_of("v", "cachedReadTokens"), whole_input)
    usage = _tokens(
        opened.withColumn("id", F.concat_ws(":", "session", "_prompt", "model")),
        F.struct(
            (whole_input - cached).alias("input"), cached.alias("cached"),
            V.count_of("v", "cacheCreationTokens").alias("cache_write"),
            V.count_of("v", "outputTokens").alias("output"), V.count_of("v", "reasoningTokens").alias("reasoning"),
        ),
    )
    calls = timed.where((F.col("_step") == "tool_call") & V.filled_at("v", f"{update}.toolCallId").isNotNull())
    calls = calls.withColumns(
        {"name": F.coalesce(V.filled_at("v", f"{update}.title"), V.filled_at("v", f"{update}.kind")), "call_id": V.text_at("v", f"{update}.toolCallId")}
    )
    return {"events": event_rows(usage, agent), "activities": activity_rows(calls, agent)}


def norm_credit_log(lines: DataFrame, agent: str = S.CREDIT_AGENT) -> dict[str, DataFrame]:
    """Per-request credits; never tokens. Credits without a request id are malformed."""
    usage = "message.usage"
    credits, model = V.number_at("v", f"{usage}.credits"), F.coalesce(V.text_at("v", "message.model"), F.lit(""))
    rows = parsed(lines).withColumns(
        {
            "ts": record_ts(), "_billed": (_kind() == "assistant") & V.is_object("v", usage), "_named": model, "credits": credits,
            "request_id": F.coalesce(V.filled_at("v", f"{usage}.request_id"), V.filled_at("v", "requestTokenAnchor.requestId")),
            "original_credits": V.number_at("v", f"{usage}.original_credits"), "billable_requests": V.bool_at("v", f"{usage}.billable").cast("bigint"),
            "context_usage_ratio": V.number_at("v", f"{usage}.context_usage_ratio"),
        }
    )
    rows = carry_context(rows, ("sessionId", "session_id"), "cwd")
    billed = rows.where((F.col("_named") != SYNTHETIC) & F.expr("ts IS NOT NULL AND _billed AND credits >= 0"))
    good = billed.where("request_id IS NOT NULL").select(
        "path", F.lit(agent).alias("agent"), "request_id", "session", "project", F.col("_named").alias("model"), "ts",
        F.lit(1).cast("bigint").alias("requests"), "credits", "original_credits", "billable_requests", "context_usage_ratio",
    )
    bad = billed.where("request_id IS NULL").groupBy("path").agg(F.count(F.lit(1)).alias("malformed"))
    return {"credits": good, "malformed": bad}


# --- state snapshots ---------------------------------------------------------------------------------

_STATE_SPOTS = ("total", "usage", "total_token_usage", "data.total", "data.usage", "data.total_token_usage", "")


def norm_state_snapshot(rows: DataFrame) -> DataFrame:
    """State documents ``[path, value]`` to snapshots; the first usable spot wins.

    A zero total is a valid reset mark. Documents without a session are something else.
    """
    docs = V.settled(rows.withColumn("v", V.parse("value")), "v")

    def usable(c: Column) -> Column:
        fine = V.is_object(c, "") & (V.long_at(c, "input_tokens") >= 0) & (V.long_at(c, "output_tokens") >= 0)
        for name in ("cache_read_input_tokens", "cache_creation_input_tokens", "reasoning_output_tokens"):
            fine = fine & (V.at(c, name).isNull() | (F.coalesce(V.long_at(c, name), F.lit(-1)) >= 0))
        return fine & (V.count_of(c, "cache_read_input_tokens") <= V.long_at(c, "input_tokens"))

    spots = F.array_compact(F.array(*[V.at("v", s) for s in _STATE_SPOTS]))
    docs = V.settled(docs.withColumn("_spot", F.try_element_at(F.filter(spots, usable), F.lit(1))), "_spot")
    tokens = F.when(F.col("_spot").isNotNull(), S.openai_tokens("_spot", ""))
    shaped = docs.select(
        "path", V.filled_at("v", "sessionId").alias("session"), V.ts_ms("v", "updatedAt").alias("ts"),
        V.ts_ms("v", "createdAt").alias("created_at"),
        F.coalesce(V.filled_at("v", "model"), V.filled_at("v", "data.model"), F.lit(S.UNKNOWN_MODEL)).alias("model"),
        F.coalesce(
            F.nullif(S.project_name(V.filled_at("v", "cwd")), F.lit("")),
            S.project_name(V.filled_at("v", "data.cwd")), F.lit(""),
        ).alias("project"),
        tokens.alias("t"),
    )
    good = V.settled(shaped, "session", "ts", "t").where("session IS NOT NULL AND ts > 0 AND t IS NOT NULL")
    t = F.col("t")
    return good.select(
        "path", "session", "ts", "created_at", "model", "project",
        t["whole"].alias("c_input"), t["cached"].alias("c_cached"),
        t["cache_write"].alias("c_cache_write"), t["output"].alias("c_output"), t["reasoning"].alias("c_reasoning"),
    )


def malformed_states(rows: DataFrame) -> DataFrame:
    """State documents of a session that gave no snapshot."""
    docs = V.settled(rows.withColumn("v", V.parse("value")), "v")
    suspects = docs.where(F.col("v").isNull() | V.filled_at("v", "sessionId").isNotNull())
    return suspects.select("path").join(norm_state_snapshot(rows).select("path"), ["path"], "left_anti")
