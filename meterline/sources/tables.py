"""Relational sources, landed as tables, to events and tool calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S, variants as V
from .normalize import activity_rows, event_rows


def _count(c: str) -> Column:
    return F.greatest(F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))


def with_directory(rows: DataFrame, session: DataFrame) -> DataFrame:
    """Adds ``project``: the last segment of the session's directory."""
    folders = session.select(F.col("id").alias("session_id"), "directory")
    joined = rows.join(folders, ["session_id"], "left")
    return joined.withColumn("project", S.project_name(F.coalesce("directory", F.lit("")))).drop("directory")


def normalize_model_usage(
    model_usage: DataFrame, session: DataFrame, agent: str, path: str
) -> tuple[DataFrame, DataFrame]:
    """(events, one-row malformed count). Unusable rows are lost one by one, not the source."""
    usable = F.col("id").isNotNull() & F.col("session_id").isNotNull() & F.col("started_at").isNotNull()
    whole = _count("input_tokens")
    cached = F.least(_count("cache_read_input_tokens"), whole)
    rows = with_directory(model_usage.where(usable), session).select(
        "id", F.col("session_id").alias("session"), "project", F.coalesce("model_id", F.lit("")).alias("model"),
        F.col("started_at").alias("ts"), (whole - cached).alias("input"), cached.alias("cached"),
        _count("cache_creation_input_tokens").alias("cache_write"), _count("output_tokens").alias("output"),
        _count("reasoning_tokens").alias("reasoning"), F.lit(path).alias("path"), F.lit(0).cast("bigint").alias("line"),
    )
    return event_rows(rows, agent), model_usage.agg(F.count_if(~usable).alias("malformed"))


def normalize_tool_usage(tool_usage: DataFrame, agent: str, path: str) -> tuple[DataFrame, DataFrame]:
    """(activities, one-row malformed count). A call without a session, name or time is lost by itself; one
    with an empty name is no call."""
    usable = F.col("session_id").isNotNull() & F.col("tool_name").isNotNull() & F.col("started_at").isNotNull()
    calls = tool_usage.where(usable).select(
        F.col("session_id").alias("session"), F.col("tool_name").alias("name"), F.col("started_at").alias("ts"),
        F.col("rowid").cast("string").alias("call_id"), F.lit(path).alias("path"), F.lit(0).cast("bigint").alias("line"),
    )
    return activity_rows(calls, agent), tool_usage.agg(F.count_if(~usable).alias("malformed"))


def normalize_message_table(
    message: DataFrame, session: DataFrame, agent: str, path: str, additive_reasoning: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(events, one-row malformed count) of JSON message rows.

    With ``additive_reasoning`` the output excludes reasoning and a positive reported total
    must equal the sum of the parts.
    """
    rows = message.withColumn("v", V.parse("data"))
    broken = F.col("v").isNull() | F.col("id").isNull() | F.col("session_id").isNull() | F.col("time_created").isNull()
    told = ~broken & (V.text_at("v", "role") == "assistant") & V.is_object("v", "tokens")
    sane = (V.long_at("v", "tokens.input") >= 0) & (V.long_at("v", "tokens.output") >= 0)
    reasoning = V.count_of("v", "tokens.reasoning")
    output = V.count_of("v", "tokens.output") + (reasoning if additive_reasoning else F.lit(0))
    parts = {
        "input": V.count_of("v", "tokens.input"), "cached": V.count_of("v", "tokens.cache.read"),
        "cache_write": V.count_of("v", "tokens.cache.write"), "output": output, "reasoning": reasoning,
    }
    counted = rows.withColumn("_told", F.coalesce(told, F.lit(False))).withColumns(parts)
    reported = V.long_at("v", "tokens.total")
    differs = (reported > 0) & (reported != S.total_tokens()) if additive_reasoning else F.lit(False)
    wrong = F.col("_told") & (~F.coalesce(sane, F.lit(False)) | F.coalesce(differs, F.lit(False)))
    flagged = counted.withColumn("_bad", F.coalesce(broken | wrong, F.lit(True)))
    good = with_directory(flagged.where("_told AND NOT _bad"), session).select(
        "id", F.col("session_id").alias("session"), "project",
        F.coalesce(V.filled_at("v", "modelID"), F.lit(S.UNKNOWN_MODEL)).alias("model"),
        F.coalesce(V.ts_ms("v", "time.created"), "time_created").alias("ts"),
        "input", "cached", "cache_write", "output", "reasoning",
        F.lit(path).alias("path"), F.lit(0).cast("bigint").alias("line"),
    )
    return event_rows(good, agent), flagged.agg(F.count_if(F.col("_bad")).alias("malformed"))


def normalize_parts(part: DataFrame, agent: str, path: str) -> DataFrame:
    """Tool parts; the time the tool started is preferred over the row's own."""
    rows = part.withColumn("v", V.parse("data")).where(V.text_at("v", "type") == "tool")
    calls = rows.select(
        F.col("session_id").alias("session"), V.text_at("v", "tool").alias("name"),
        F.coalesce(V.ts_ms("v", "state.time.start"), "time_created").alias("ts"),
        F.coalesce(V.filled_at("v", "callID"), "id").alias("call_id"),
        F.lit(path).alias("path"), F.lit(0).cast("bigint").alias("line"),
    )
    return activity_rows(calls.where("ts > 0"), agent)


def with_step_time(gen: DataFrame, steps: DataFrame) -> DataFrame:
    """Adds ``ts``: the generation's own completion time, else the step's of the same index."""
    times = steps.select("session", "idx", S.sec_nanos_ms("sec", "nanos").alias("_step"))
    own = S.sec_nanos_ms("done_s", "done_ns")
    joined = gen.join(times, ["session", "idx"], "left")
    zero = F.lit(0).cast("bigint")
    return joined.withColumn("ts", F.when(own > 0, own).otherwise(F.coalesce("_step", zero))).drop("_step")


def with_project(gen: DataFrame, summaries: DataFrame) -> DataFrame:
    """Adds ``project`` from the conversation index."""
    names = summaries.select(F.col("conversation_id").alias("session"), S.uri_project("workspace_uris").alias("project"))
    return gen.join(names, ["session"], "left").withColumn("project", F.coalesce("project", F.lit("")))


def normalize_generations(
    gen: DataFrame, steps: DataFrame, summaries: DataFrame, agent: str
) -> tuple[DataFrame, DataFrame]:
    """(events, malformed per path) of decoded generation rows; f-columns are field numbers."""
    zero = F.lit(0).cast("bigint")
    n = lambda c: F.greatest(F.coalesce(F.col(c), zero), zero)
    timed = with_step_time(with_project(gen, summaries), steps)
    thinking = n("f9")
    output = (
        F.when(n("f3") > 0, n("f3")).when(F.col("f10").isNotNull(), n("f10") + thinking).otherwise(thinking)
    )
    rows = timed.where("ts > 0").select(
        F.concat_ws(":", "session", F.col("idx").cast("string")).alias("id"), "session", "project",
        F.coalesce(F.nullif("model", F.lit("")), F.lit(S.UNKNOWN_MODEL)).alias("model"), "ts",
        n("f2").alias("input"), n("f5").alias("cached"), n("f4").alias("cache_write"),
        output.alias("output"), thinking.alias("reasoning"), "path", F.lit(0).cast("bigint").alias("line"),
    )
    asked = rows.where("input > 0 OR output > 0 OR cached > 0")
    return event_rows(asked, agent), timed.groupBy("path").agg(F.count_if(F.col("ts") <= 0).alias("malformed"))
