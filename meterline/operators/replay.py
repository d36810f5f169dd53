"""Session transcripts as tables: turns, messages, tool calls, patches, usage, summaries.

All jobs run over every file at once; one session is a filter on ``path``. Order inside a
file is the line number, and everything that runs through a file uses the sliced operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import records as D, scalars as S, text as T, variants as V
from ..session import store
from ..sources.normalize import malformed_count
from .ordered import LINES_PER_SLICE, with_carried, with_previous, with_running_sum, with_run_id
from .tree import resolve_ends

# Name of the turn before any turn, and words of a tool's outcome.
UNGROUPED = "Ungrouped"
FINE = ("success", "ok", "completed", "running", "stopped")
MESSAGE_KINDS = ("user", "assistant", "system", "reasoning")
# Kinds whose record makes its turn exist.
_TURN_KINDS = (*MESSAGE_KINDS, "context", "start", "end", "tool_call", "tool_output", "patch", "error", "notice")
_FILE, _LINE = ["path"], ["line"]


def records(lines: DataFrame) -> DataFrame:
    """Parsed lines with the fields every replay job needs: kind, turn, time, event body ``e``
    (for records that wrap none, the whole record).

    Parsed once and stored: a dozen jobs read different kinds of records from this table.
    """
    rows = V.settled(lines.select("path", "line", V.parse("value").alias("v")), "v").where("v IS NOT NULL")
    rows = rows.withColumn("outer", F.coalesce(V.text_at("v", "type"), F.lit("")))
    wrapped = F.col("outer").isin("event_msg", "response_item")
    rows = V.settled(rows.withColumn("e", F.when(wrapped, V.at("v", "payload")).otherwise(F.col("v"))), "outer", "e")
    inner = F.when(F.col("outer").isin("session_meta", "turn_context"), F.col("outer")).otherwise(
        F.coalesce(V.text_at("e", "type"), F.col("outer"))
    )
    own = D.turn_id_of("e")
    rows = rows.withColumns(
        {
            "type": inner, **D.kind_facts("e"), "ts": V.rfc3339_ms(V.text_at("v", "timestamp")),
            "own_turn": F.coalesce(own, F.when(wrapped, D.turn_id_of("v"))),  # else e is v
        }
    )
    kind = D.kind_of("type", "role", "level", "said", "item_type")
    return store(rows.withColumn("kind", kind).drop("v", "outer", "role", "level", "said", "item_type"), "records")


def turn_assign(rows: DataFrame) -> DataFrame:
    """Adds ``turn_id``: the latest turn named at or before the line. Stored, as all jobs read it."""
    carried = with_carried(rows, _FILE, _LINE, {"turn_id": F.col("own_turn")}, LINES_PER_SLICE).drop("own_turn")
    return store(carried.withColumn("turn_id", F.coalesce("turn_id", F.lit(UNGROUPED))), "turns")


def turn_bounds(rows: DataFrame) -> DataFrame:
    """Start, end and duration per turn. A started task overrules the turn's context line."""
    pick = lambda kind: F.when(F.col("kind") == kind, F.col("line"))
    bounds = rows.where(F.col("kind").isin(*_TURN_KINDS)).groupBy("path", "turn_id").agg(
        F.max_by("ts", pick("start")).alias("_task"), F.min_by("ts", pick("context")).alias("_context"),
        F.max_by("ts", pick("end")).alias("end_ms"), F.min("line").alias("first_line"),
    )
    start = F.coalesce("_task", "_context")
    gap = F.col("end_ms") - F.col("start_ms")
    return bounds.withColumn("start_ms", start).withColumn(
        "duration_ms", F.when(gap.isNotNull(), F.greatest(gap, F.lit(0).cast("bigint")))
    ).select("path", "turn_id", "start_ms", "end_ms", "duration_ms", "first_line")


# --- messages ---------------------------------------------------------------------------------------


def base_messages(rows: DataFrame) -> DataFrame:
    """Base instructions, once per text and file."""
    told = rows.where("kind = 'meta'").select("path", "line", D.prompt_text(V.at("e", "payload")).alias("text"))
    return told.where("text IS NOT NULL").groupBy("path", "text").agg(F.min("line").alias("line"))


def turn_base_counts(bounds: DataFrame, base: DataFrame) -> DataFrame:
    """How many base instructions each turn started under."""
    marks = base.select("path", "line", F.lit(None).cast("string").alias("turn_id"), F.lit(1).cast("bigint").alias("_one"))
    turns = bounds.select("path", F.col("first_line").alias("line"), "turn_id", F.lit(0).cast("bigint").alias("_one"))
    counted = with_running_sum(marks.unionByName(turns), _FILE, _LINE, {"base_messages": F.col("_one")}, LINES_PER_SLICE)
    return counted.where("turn_id IS NOT NULL").select("path", "turn_id", "base_messages")


def messages(rows: DataFrame) -> DataFrame:
    """All message records with text; live repeats of a base instruction are left out."""
    told = rows.where(F.col("kind").isin(*MESSAGE_KINDS)).select(
        "path", "line", "turn_id", "ts", "kind", "type", D.text_of("e").alias("text")
    )
    told = V.settled(told, "text").where("text IS NOT NULL")
    base = base_messages(rows).select("path", "text", F.col("line").alias("_base"), F.lit("system").alias("kind"))
    known = told.join(base, ["path", "text", "kind"], "left")
    return known.where("_base IS NULL OR _base > line").drop("_base")


def drop_mirrors(told: DataFrame) -> DataFrame:
    """Rollouts write a message twice, as an event and as a response item: keep the first form.

    Within a run of equal texts every kept row has the form of the run's first row, so the
    form at the run's start is carried along and compared. Rows are stored before each scan, as it reads them twice.
    """
    keys = ["path", "turn_id", "kind"]
    seen = store(with_previous(store(told, "messages"), keys, _LINE, ["text"], "_prev", LINES_PER_SLICE), "mirrors")
    starts = F.col("_prev").isNull() | (F.col("_prev.text") != F.col("text"))
    form = F.col("type") == "message"
    carried = with_carried(seen.withColumn("_start", starts), keys, _LINE, {"_head": F.when(F.col("_start"), form)}, LINES_PER_SLICE)
    return carried.where(F.col("_head") == form).drop("_prev", "_start", "_head")


# --- tool calls ---------------------------------------------------------------------------------------


def is_exec(name, arguments) -> Column:
    name, arguments = F.col(name), F.col(arguments)
    base = F.substring_index(name, ".", -1)
    return (base == "exec_command") | F.coalesce(arguments.contains("tools.exec_command"), F.lit(False))


def _argument(arguments: str, key: str) -> Column:
    """A scalar argument by name, in JSON or in a nested call's text."""
    found = F.regexp_extract(F.col(arguments), key + r"""[\\"']*\s*[:=]\s*[\\"']*([^\s,})\\"']+)""", 1)
    return F.nullif(found, F.lit(""))


def call_rows(rows: DataFrame) -> DataFrame:
    """Tool calls as recorded, with what makes a call the continuation of a running process. Stored, as pairing reads them often."""
    calls = rows.where("kind = 'tool_call'").select(
        "path", "line", "turn_id", "ts", D.call_id_of("e").alias("call_id"),
        F.coalesce(D.tool_name_of("e"), F.col("type")).alias("name"), D.arguments_of("e").alias("arguments"),
    )
    base = F.substring_index("name", ".", -1)
    args = F.coalesce("arguments", F.lit(""))
    writes = (base == "write_stdin") | args.contains("tools.write_stdin")
    waits = (base == "wait") | args.contains("tools.wait")
    calls = calls.withColumns(
        {"poll": F.when(writes, "write").when(waits, "wait"), "exec": is_exec("name", "arguments")}
    )
    chars = F.coalesce(V.text_at(V.parse("arguments"), "chars"), F.lit(""))
    calls = calls.withColumns(
        {
            "cell": F.when(F.col("poll") == "write", _argument("arguments", "session_id")).when(F.col("poll") == "wait", _argument("arguments", "cell_id")),
            "input": F.nullif(F.when(F.col("poll") == "write", chars), F.lit("")),
        }
    )
    return store(calls, "calls")


def _decoded(output: Column) -> Column:
    """Output given as an array of text blocks reads as its texts, one per line."""
    blocks = V.array_at(V.parse(output), "")
    texts = F.array_compact(F.transform(blocks, lambda b: V.text_at(b, "text")))
    return F.coalesce(F.nullif(F.array_join(texts, "\n"), F.lit("")), output)


def output_rows(rows: DataFrame) -> DataFrame:
    """Tool outputs with the process facts their text gives away. Stored like the calls."""
    outs = rows.where("kind = 'tool_output'").select(
        "path", "line", "turn_id", "ts", D.call_id_of("e").alias("call_id"),
        F.coalesce(D.tool_name_of("e"), F.lit("tool")).alias("name"), D.output_of("e").alias("raw_output"),
        D.stderr_of("e").alias("stderr"), V.trimmed_at("e", "status").alias("said"),
    )
    decoded = F.when(F.col("raw_output").startswith("["), _decoded(F.col("raw_output")))
    outs = outs.withColumn("output", F.coalesce(decoded, F.col("raw_output"))).drop("raw_output")
    body = F.col("output")
    script = F.nullif(F.btrim(F.regexp_extract(body, r"Script running with cell ID ([^\r\n]*)", 1)), F.lit(""))
    marked = F.nullif(F.regexp_extract(body, r"(?m)^\s*SESSION_ID=\s*([0-9]+)\s*$", 1), F.lit(""))
    inner = F.nullif(F.regexp_extract(body, r'(?m)^\s*\{.*"session_id"\s*:\s*"?([^",}\s]+)', 1), F.lit(""))
    outs = outs.withColumns(
        {
            "exit_text": T.exit_code_of("output"), "signal_text": T.signal_of("output"), "wall_ms": T.wall_ms_of("output"),
            "cell_out": F.coalesce(script, marked, inner),
            "results": T.results_in("output"),
            "script_failed": F.lower(body).startswith("script failed"),
        }
    )
    return store(outs, "call-outputs")


def pair_calls(calls: DataFrame, outputs: DataFrame) -> DataFrame:
    """Each output with the latest earlier call of its id in the file; else with the call of its name that it closes
    (:func:`match_by_name`); no call gives NULLs."""
    opened = F.struct("turn_id", "name", "arguments", F.col("line").alias("call_line"), "ts", "poll", "cell", "input", "exec")
    marks = calls.where("call_id IS NOT NULL").select("path", "call_id", "line", opened.alias("call"), F.lit(None).cast("bigint").alias("out_line"))
    asks = outputs.where("call_id IS NOT NULL").select(
        "path", "call_id", "line", F.lit(None).cast(marks.schema["call"].dataType).alias("call"), F.col("line").alias("out_line")
    )
    paired = with_carried(marks.unionByName(asks), ["path", "call_id"], _LINE, {"opened": F.col("call")}, LINES_PER_SLICE)
    found = paired.where("out_line IS NOT NULL").select("path", F.col("out_line").alias("line"), "opened")
    found = store(outputs.join(found, ["path", "line"], "left"), "answered")
    named = match_by_name(calls, found)
    return found.join(named, ["path", "line"], "left").withColumn("opened", F.coalesce("opened", "_named")).drop("_named")


def match_by_name(calls: DataFrame, found: DataFrame) -> DataFrame:
    """[path, line, _named]: outputs without a known call close the latest open call of their name in their turn.

    Calls that their own id answers take no part. The others and the outputs are brackets: a running sum per turn
    and name gives their depth, and an output at depth d closes the last call that went up to d + 1. Sums and the
    last call per depth are carried over slices, so a turn of very many calls is many tasks.
    """
    keys = ["path", "turn_id", "name"]
    opened = F.struct("turn_id", "name", "arguments", F.col("line").alias("call_line"), "ts", "poll", "cell", "input", "exec")
    answered = found.where("opened IS NOT NULL").select("path", F.col("opened.call_line").alias("line")).dropDuplicates()
    orphans = found.where("opened IS NULL").select(*keys, "line")
    left = calls.join(answered, ["path", "line"], "left_anti").join(orphans.select(*keys).dropDuplicates(), keys, "left_semi")
    ups = left.select(*keys, "line", F.lit(1).cast("bigint").alias("step"), opened.alias("call"))
    downs = orphans.select(*keys, "line", F.lit(-1).cast("bigint").alias("step"), F.lit(None).cast(ups.schema["call"].dataType).alias("call"))
    deep = with_running_sum(ups.unionByName(downs), keys, _LINE, {"depth": F.col("step")}, LINES_PER_SLICE)
    level = deep.withColumn("level", F.when(F.col("step") == 1, F.col("depth")).otherwise(F.col("depth") + 1))
    matched = with_carried(level, [*keys, "level"], _LINE, {"_named": F.col("call")}, LINES_PER_SLICE)
    return matched.where("step = -1 AND _named IS NOT NULL").select("path", "line", "_named")


def exec_exits(rows: DataFrame, calls: DataFrame) -> DataFrame:
    """Exit codes recorded beside the text, for the command running at that line."""
    codes = rows.where("kind = 'exec_exit'").select(
        "path", "line", F.lit(None).cast("string").alias("call_id"), V.long_at("e", "item.exit_code").alias("code")
    ).where("code IS NOT NULL")
    runs = calls.where("(exec OR poll IS NOT NULL) AND call_id IS NOT NULL").select("path", "line", "call_id", F.lit(None).cast("bigint").alias("code"))
    active = with_carried(runs.unionByName(codes), _FILE, _LINE, {"active": F.col("call_id")}, LINES_PER_SLICE)
    return active.where("code IS NOT NULL AND active IS NOT NULL").select("path", "line", F.col("active").alias("call_id"), "code")


def with_exit_codes(paired: DataFrame, exits: DataFrame) -> DataFrame:
    """Adds ``recorded``: the exit code recorded before the output, if exactly one was."""
    first_out = paired.where("call_id IS NOT NULL").groupBy("path", "call_id").agg(F.min("line").alias("_out"))
    timely = exits.join(first_out, ["path", "call_id"]).where("line < _out")
    counted = timely.groupBy("path", "call_id", F.col("_out").alias("line")).agg(
        F.count(F.lit(1)).alias("_n"), F.max("code").alias("_code")
    )
    joined = paired.join(counted, ["path", "call_id", "line"], "left")
    return joined.withColumn("recorded", F.when(F.col("_n") == 1, F.col("_code"))).drop("_n", "_code")


def process_roots(calls: DataFrame, paired: DataFrame) -> DataFrame:
    """[path, line, root_line]: for every continuation, the call that started its process.

    An output that names a cell registers it for its call; a later poll of that cell points at
    that call. Polls can chain over several cells, so pointers are followed to their end.
    """
    made = paired.where("cell_out IS NOT NULL AND opened IS NOT NULL").select(
        "path", F.col("cell_out").alias("cell"), "line", F.col("opened.call_line").alias("owner"), F.lit(None).cast("bigint").alias("poll_line")
    )
    polls = calls.where("cell IS NOT NULL AND call_id IS NOT NULL").select(
        "path", "cell", "line", F.lit(None).cast("bigint").alias("owner"), F.col("line").alias("poll_line")
    )
    known = with_carried(made.unionByName(polls), ["path", "cell"], _LINE, {"up": F.col("owner")}, LINES_PER_SLICE)
    edges = store(
        known.where("poll_line IS NOT NULL AND up IS NOT NULL").select("path", F.col("poll_line").alias("line"), "up"), "polls"
    )
    ident = lambda line: F.concat_ws("#", "path", F.col(line).cast("string"))
    ups = edges.select(ident("up").alias("id")).join(edges.select(ident("line").alias("id")), ["id"], "left_anti").dropDuplicates()
    nodes = edges.select(ident("line").alias("id"), ident("up").alias("parent")).unionByName(ups.select("id", F.lit(None).cast("string").alias("parent")))
    roots = resolve_ends(nodes).where("hops > 0 AND root IS NOT NULL")
    return roots.select(
        F.regexp_extract("id", "^(.*)#[0-9]+$", 1).alias("path"), F.substring_index("id", "#", -1).cast("bigint").alias("line"),
        F.substring_index("root", "#", -1).cast("bigint").alias("root_line"),
    )


def tool_status(paired: DataFrame) -> DataFrame:
    """Adds ``status`` and ``is_error``. ``paired`` has the call (``opened``), ``recorded`` and
    ``continued`` (the call polls a running process).

    A recorded exit code beats the text; a signal means stopped; text on the error stream only
    decides when nothing else does.
    """
    none = F.col("recorded").isNull()
    no = F.lit(False)
    rows = paired.withColumns(
        {
            "_exit": F.coalesce("recorded", "exit_text"), "_signal": F.when(none, F.col("signal_text")),
            "_exec": F.coalesce(F.col("opened.exec"), no),
            "_ctrl_c": F.coalesce(F.col("continued") & (F.col("opened.input") == "\x03"), no),
            "_writes": F.coalesce(F.col("continued") & (F.col("opened.poll") == "write"), no),
            "_bad_start": none & F.coalesce(F.col("script_failed"), no),
        }
    )
    rows = rows.withColumn("_ended", F.col("_exit").isNotNull() | F.col("_signal").isNotNull())
    batched = (F.coalesce(F.col("results"), F.lit(0)) > 1) & F.col("_exec")
    process = F.col("continued") | F.col("_exec") | F.col("cell_out").isNotNull() | F.col("_ended")
    failed = F.col("_signal").isNull() & ((F.coalesce(F.col("_exit"), F.lit(0)) != 0) | F.col("_bad_start"))
    rows = rows.withColumns({"process": ~batched & process, "_failed": failed})
    stopped = F.col("process") & (F.col("_signal").isNotNull() | (F.col("_ctrl_c") & F.col("_ended")))
    rows = rows.withColumns({"_stopped": stopped, "_running": F.col("cell_out").isNotNull() & ~F.col("_ended")})
    status = (
        F.when(F.col("_stopped"), "stopped").when(F.col("process") & F.col("_failed"), "failed")
        .when(F.col("_writes") & ~F.col("_ended"), "running").when(F.col("_running"), "running")
        .otherwise(F.coalesce("said", F.lit("completed")))
    )
    noisy = F.col("said").isNull() & F.col("_exit").isNull() & F.coalesce(F.btrim("stderr") != "", no)
    odd = F.coalesce(~F.col("said").isin(*FINE), no)
    bad = ~F.col("_stopped") & ((F.col("process") & F.col("_failed")) | odd | noisy)
    return rows.withColumns({"status": status, "is_error": bad}).drop(
        "_exec", "_ctrl_c", "_writes", "_bad_start", "_ended", "_failed", "_stopped", "_running"
    )


def _result_text(line: Column) -> Column:
    """A line that is a structured result reads as its output and error text."""
    v = V.parse(line)
    inner = F.coalesce(F.when(V.text_at(v, "status") == "fulfilled", V.at(v, "value")), v)
    told = F.concat_ws("\n", V.filled_at(inner, "output"), V.filled_at(inner, "stderr"))
    return F.when(line.startswith("{") & V.text_at(inner, "output").isNotNull(), told).otherwise(line)


def _also(text: str, more: str) -> Column:
    """Both texts, one per line; a repeated or absent one adds nothing."""
    first, second = F.col(text), F.col(more)
    return F.when(first.eqNullSafe(second), first).otherwise(F.nullif(F.concat_ws("\n", first, second), F.lit("")))


def with_chunk(judged: DataFrame) -> DataFrame:
    """Adds ``chunk``, what one output adds to its process: what was typed, the text after the
    header, and the outcome in its usual words. Columns are built step by step, so no step
    repeats the work of another."""
    blank = lambda x: F.nullif(F.btrim(x, F.lit(" \r\n\t")), F.lit(""))
    rows = judged.withColumn("_body", F.regexp_replace(F.col("output"), r"(?s)^.*?\r?\nOutput:\r?\n", ""))
    rows = rows.withColumn("_body", F.regexp_replace("_body", r"(?m)^\s*SESSION_ID=\s*[0-9]+\s*$\n?", ""))
    lines = F.array_join(F.transform(F.split("_body", "\n"), _result_text), "\n")
    typed = F.col("opened.input")
    rows = rows.withColumns(
        {
            "_kept": blank(F.when(F.col("_body").contains("{"), lines).otherwise(F.col("_body"))),
            "_code": F.concat(F.lit("Process exited with code "), F.col("_exit").cast("string")),
            "_sig": F.concat(F.lit("Process stopped with signal "), F.col("_signal")),
            "_sent": F.when(typed == "\x03", F.lit("› Sent Ctrl+C")).when(
                typed.isNotNull() & F.col("continued"), F.concat(F.lit("› Sent: "), F.rtrim(typed, F.lit("\r\n")))
            ),
        }
    )
    rows = rows.withColumn("_kept", _also("_kept", "_code"))
    rows = rows.withColumn("_kept", _also("_kept", "_sig"))
    rows = rows.withColumn("_kept", _also("_sent", "_kept"))
    chunk = F.when(F.col("process"), F.col("_kept")).otherwise(F.col("output"))
    return rows.withColumn("chunk", chunk).drop("_body", "_kept", "_code", "_sig", "_sent", "_exit", "_signal")


def process_continuations(rows: DataFrame) -> DataFrame:
    """Every output with its verdict and the call it belongs to in the end (``root_line``)."""
    calls = call_rows(rows)
    paired = store(with_exit_codes(pair_calls(calls, output_rows(rows)), exec_exits(rows, calls)), "outputs")
    roots = process_roots(calls, paired).withColumnRenamed("line", "_call")
    joined = paired.withColumn("_call", F.col("opened.call_line")).join(roots, ["path", "_call"], "left")
    judged = with_chunk(tool_status(joined.withColumn("continued", F.col("root_line").isNotNull())))
    return store(judged.withColumn("root_line", F.coalesce("root_line", "_call")).drop("_call"), "verdicts")


TAIL = 4_096


def _fold(parts: Column) -> Column:
    """Joins chunks in order; a chunk equal to all that came before it adds nothing.

    What came before is kept as blocks and a short tail with its length, and only compared with a chunk
    of the same length, so the work is linear in the text.
    """
    none = F.struct(F.lit(-1).cast("bigint").alias("size"), F.lit(None).cast("string").alias("tail"), F.array().cast("array<string>").alias("blocks"))
    whole = lambda s: F.array_join(F.concat(s["blocks"], F.array(s["tail"])), "\n")
    state = lambda size, tail, blocks: F.struct(size.cast("bigint").alias("size"), tail.alias("tail"), blocks.alias("blocks"))

    def step(s: Column, part: Column) -> Column:
        chunk, size = part["chunk"], s["size"] + 1 + F.length(part["chunk"])
        return (
            F.when(s["size"] < 0, state(F.length(chunk), chunk, s["blocks"]))
            .when((s["size"] == F.length(chunk)) & (whole(s) == chunk), s)
            .when(F.length(s["tail"]) >= TAIL, state(size, chunk, F.concat(s["blocks"], F.array(s["tail"]))))
            .otherwise(state(size, F.concat(s["tail"], F.lit("\n"), chunk), s["blocks"]))
        )

    return F.aggregate(F.array_sort(parts), none, step, lambda s: F.when(s["size"] >= 0, whole(s)))


def tool_calls(rows: DataFrame) -> DataFrame:
    """One row per call that is not a continuation: outputs joined, last verdict kept.

    The joined text of one call is one value, so its chunks meet in one place; use
    :func:`process_continuations` to keep them as rows.
    """
    outs = process_continuations(rows).where("root_line IS NOT NULL")
    polls = outs.where("continued").select("path", F.col("opened.call_line").alias("line"))
    final = F.max_by(F.struct("ts", "status", "is_error", "stderr", "wall_ms", "process"), "line")
    sums = outs.groupBy("path", F.col("root_line").alias("line")).agg(
        final.alias("_f"), F.count(F.lit(1)).alias("outputs"),
        _fold(F.collect_list(F.when(F.col("chunk").isNotNull(), F.struct("line", "chunk")))).alias("output"),
    )
    calls = call_rows(rows).join(polls, ["path", "line"], "left_anti").join(sums, ["path", "line"], "left")
    done = F.when(F.col("_f.status") != "running", F.col("_f.ts"))
    gap = lambda end: F.when((end - F.col("ts")).isNotNull(), F.greatest(end - F.col("ts"), F.lit(0).cast("bigint")))
    lasted = F.when(F.col("_f.process"), F.coalesce(gap(F.col("_f.ts")), "_f.wall_ms")).otherwise(
        F.coalesce(F.col("_f.wall_ms"), gap(done))
    )
    return calls.select(
        "path", "line", "turn_id", "call_id", "name", "arguments", F.col("ts").alias("started_at"),
        done.alias("completed_at"), lasted.alias("duration_ms"), F.col("_f.status").alias("status"),
        F.coalesce("_f.is_error", F.lit(False)).alias("is_error"), "output", F.col("_f.stderr").alias("stderr"),
        F.coalesce("outputs", F.lit(0).cast("bigint")).alias("outputs"),
    )


# --- patches and usage -------------------------------------------------------------------------------------


def patches(rows: DataFrame) -> DataFrame:
    success = F.coalesce(V.bool_at("e", "success"), V.bool_at("e", "payload.success"))
    return rows.where("kind = 'patch'").select(
        "path", "line", "turn_id", "ts", D.call_id_of("e").alias("call_id"), success.alias("success"),
        F.coalesce(D.output_of("e"), D.text_of("e")).alias("output"), F.coalesce(~success, F.lit(False)).alias("is_error"),
    )


def patch_count(rows: DataFrame) -> DataFrame:
    """Patches per turn; a call and its result with one id are one patch."""
    results = patches(rows).select("path", "turn_id", "line", "call_id")
    calls = call_rows(rows).where(F.substring_index("name", ".", -1) == "apply_patch").select("path", "turn_id", "line", "call_id")
    ident = F.coalesce("call_id", F.concat(F.lit("line:"), F.col("line").cast("string")))
    once = results.unionByName(calls).select("path", "turn_id", ident.alias("ident")).dropDuplicates()
    return once.groupBy("path", "turn_id").agg(F.count(F.lit(1)).alias("patches"))


def token_items(events: DataFrame, rows: DataFrame) -> DataFrame:
    """Per-request usage in its turn. ``events`` come from the cumulative normaliser, so the
    timeline shows the amounts of the event table."""
    turns = rows.where("kind = 'usage'").select("path", "line", "turn_id")
    return events.join(turns, ["path", "line"]).select(
        "path", "line", "turn_id", "ts", "model", "input", "cached", "cache_write", "output", "reasoning"
    )


def attach_usage(usage: DataFrame, outputs: DataFrame) -> DataFrame:
    """Adds ``tool_line``: the call whose output directly precedes the usage in its turn."""
    outs = outputs.where("root_line IS NOT NULL").select("path", "line", F.col("opened.turn_id").alias("_turn"), F.col("root_line").alias("_tool"))
    asks = usage.select("path", "line", F.lit(None).cast("string").alias("_turn"), F.lit(None).cast("bigint").alias("_tool"))
    seen = with_previous(outs.unionByName(asks), _FILE, _LINE, ["_turn", "_tool"], "prev", LINES_PER_SLICE)
    hits = seen.where("_tool IS NULL AND prev._tool IS NOT NULL").select("path", "line", "prev._turn", "prev._tool")
    joined = usage.join(hits, ["path", "line"], "left")
    same = F.col("_turn") == F.col("turn_id")
    return joined.withColumn("tool_line", F.when(same, F.col("_tool"))).drop("_turn", "_tool")


def timeline(rows: DataFrame, events: DataFrame) -> DataFrame:
    """All items of all turns. Order by path, anchor, after, line: usage follows its tool."""
    zero, no_text = F.lit(0).cast("int"), F.lit(None).cast("string")

    def item(df: DataFrame, kind, text, anchor="line", after=zero, ok=F.lit(True)) -> DataFrame:
        return df.select(
            "path", "turn_id", F.col(anchor).alias("anchor"), after.alias("after"), "line", kind.alias("item"),
            text.alias("text"), ok.alias("visible"),
        )

    told = drop_mirrors(messages(rows))
    outs = process_continuations(rows)
    polls = outs.where("continued").select("path", F.col("opened.call_line").alias("line"))
    calls = call_rows(rows).join(polls, ["path", "line"], "left_anti")
    used = attach_usage(token_items(events, rows), outs).withColumn("_anchor", F.coalesce("tool_line", "line"))
    fixed = patches(rows)
    errors = rows.where("kind = 'error'").withColumn("_text", F.coalesce(D.error_text_of("e"), F.col("type")))
    notices = rows.where("kind = 'notice'").withColumn("_text", V.trimmed_at("e", "message"))
    orphans = outs.where("opened IS NULL")
    parts = [
        item(told, F.col("kind"), F.col("text")), item(calls, F.lit("tool_call"), F.col("name")),
        item(orphans, F.lit("tool_call"), F.col("name")),
        item(fixed, F.lit("patch"), F.col("output"), ok=F.col("is_error")), item(errors, F.lit("error"), F.col("_text")),
        item(notices, F.lit("notice"), F.col("_text")), item(used, F.lit("usage"), no_text, "_anchor", F.lit(1)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fold_usage(items: DataFrame) -> DataFrame:
    """Usage rows with the entry that shows them: [path, turn_id, seq, host, shown].

    ``items``: path, turn_id, seq, item, visible, model. ``host`` numbers the visible items of
    the turn. Usage attaches to the item before it; more of the same model folds in; another
    model gets an entry of its own, to which the next usage attaches. ``shown`` is the first
    seq of the usage rows that are one entry's badge, or the row's own seq for a new entry.

    The rule alternates over runs of one model: a run of two or more after a change always
    leaves the next run 'alone first', a run of one flips the state. So the state of a run only
    depends on how many single runs follow the last longer one.
    """
    keys = ["path", "turn_id"]
    shown_item = ((F.col("item") != "usage") & F.col("visible")).cast("bigint")
    hosted = with_running_sum(items, keys, ["seq"], {"host": shown_item}, LINES_PER_SLICE).where("item = 'usage'")
    named = hosted.withColumn("_what", F.concat_ws("#", F.col("host").cast("string"), "model"))
    runs = with_run_id(named, keys, ["seq"], "_what", "run", LINES_PER_SLICE).drop("_what")
    sizes = runs.groupBy(*keys, "run").agg(
        F.count(F.lit(1)).alias("_n"), F.min("seq").alias("_first"), F.min("host").alias("_host")
    )
    seen = with_previous(sizes, keys, ["run"], ["_host"], "_p", LINES_PER_SLICE)
    opens = F.col("_p").isNull() | (F.col("_p._host") != F.col("_host"))
    # State before the run: alone = its first row becomes an entry. A host's first run attaches.
    sizes = seen.withColumn("_reset", F.when(opens, F.struct(F.col("run").alias("at"), (F.col("_host") == 0).alias("alone"))))
    after_long = with_previous(sizes.drop("_p"), keys, ["run"], ["_n"], "_b", LINES_PER_SLICE)
    fixed = F.when(F.col("_reset").isNotNull(), F.col("_reset")).when(
        F.col("_b._n") >= 2, F.struct(F.col("run").alias("at"), F.lit(True).alias("alone"))
    )
    known = with_carried(after_long, keys, ["run"], {"_s": fixed}, LINES_PER_SLICE)
    flips = (F.col("run") - F.col("_s.at")) % 2 == 1
    alone = F.when(flips, ~F.col("_s.alone")).otherwise(F.col("_s.alone"))
    states = known.select(*keys, "run", "_first", alone.alias("_alone"))
    joined = runs.join(states, [*keys, "run"])
    # The badge of a run that began alone starts with its second row.
    second = joined.where("seq > _first").groupBy(*keys, "run").agg(F.min("seq").alias("_second"))
    joined = joined.join(second, [*keys, "run"], "left")
    first = F.col("seq") == F.col("_first")
    shown = F.when(~F.col("_alone"), F.col("_first")).when(first, F.col("seq")).otherwise(F.col("_second"))
    return joined.select(
        *keys, "seq", "host", "run", shown.alias("shown"), (F.col("_alone") & first).alias("own_entry")
    )


def exploration_blocks(entries: DataFrame) -> DataFrame:
    """Adjacent successful read-only commands of a turn as one block.

    ``entries``: path, turn_id, seq, label (NULL for anything else). Returns one row per block
    of labelled entries.
    """
    keys = ["path", "turn_id"]
    marked = entries.withColumn("_is", F.col("label").isNotNull())
    runs = with_run_id(marked, keys, ["seq"], "_is", "run", LINES_PER_SLICE).where("_is")
    count = lambda word: F.count_if(F.col("label") == word)
    return runs.groupBy(*keys, "run").agg(
        F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("entries"), count("Read").alias("reads"),
        count("Search").alias("searches"), count("List").alias("lists"),
    )


# --- summaries ---------------------------------------------------------------------------------------------------


def unknown_types(rows: DataFrame) -> DataFrame:
    """Distinct record types nothing recognises, so a partial replay never looks complete."""
    return rows.where("kind = 'unknown'").groupBy("path").agg(F.countDistinct("type").alias("unknown_types"))


def session_meta(rows: DataFrame) -> DataFrame:
    """Working folder, client version and git facts of each file; the last value wins."""
    metas = rows.where("kind IN ('meta', 'context')").select("path", "line", "kind", V.at("e", "payload").alias("p"))
    is_meta = F.col("kind") == "meta"
    cwd, git = V.trimmed_at("p", "cwd"), V.map_at("p", "git")
    version = F.coalesce(*[V.trimmed_at("p", n) for n in ("cli_version", "cliVersion", "version")])
    last = lambda x, test=F.lit(True): F.max_by(x, F.when(test & x.isNotNull(), F.col("line")))
    heads = metas.groupBy("path").agg(
        last(cwd, is_meta).alias("cwd"), last(cwd).alias("project_path"), last(version, is_meta).alias("cli_version")
    )
    pairs = metas.where(is_meta).select("path", "line", F.explode(git).alias("name", "_val")).select(
        "path", "line", "name", F.when(F.schema_of_variant("_val") == "STRING", F.try_variant_get("_val", "$", "string")).alias("value")
    ).where("value IS NOT NULL")
    once = pairs.groupBy("path", "name").agg(F.max_by("value", "line").alias("value"))
    gits = once.groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("git"))
    return heads.join(gits, ["path"], "left").withColumn("cwd", F.coalesce("cwd", "project_path"))


def replay_summary(rows: DataFrame, events: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per file: span, time to the first token, where it ran, tokens by kind (input includes cache), known
    cost, models and projects in order, counts, and how many lines the file has and how many can't be read.

    ``events`` are the file's own usage rows with their price, ``lines`` its lines as scanned.
    """
    span = rows.groupBy("path").agg(F.min("ts").alias("start_ms"), F.max("ts").alias("end_ms"))
    count = lambda name: F.count(F.lit(1)).alias(name)
    texted = messages(rows).where("kind != 'system'")
    kept = drop_mirrors(texted).groupBy("path").agg(count("messages"))
    with_text = messages(rows).select("path", "turn_id").unionByName(
        rows.where(F.col("kind").isin(*_TURN_KINDS) & ~F.col("kind").isin(*MESSAGE_KINDS)).select("path", "turn_id")
    )
    turns = with_text.dropDuplicates().groupBy("path").agg(count("turns"))
    tools = tool_calls(rows).groupBy("path").agg(count("tools"), F.count_if(F.col("is_error")).alias("_te"))
    fixes = patches(rows).groupBy("path").agg(count("patches"), F.count_if(F.col("is_error")).alias("_pe"))
    errors = rows.where("kind = 'error'").groupBy("path").agg(count("_ee"))
    whole_input = S.total_tokens("input", "cached", "cache_write", F.lit(0).cast("bigint"))
    used = events.groupBy("path").agg(
        F.min("ts").alias("_first"), S.saturating_sum(whole_input).alias("input"),
        *[S.saturating_sum(c).alias(c) for c in ("cached", "output", "reasoning")],
        S.saturating_sum(S.total_tokens()).alias("total_tokens"), F.sum("cost").alias("_cost"),
        F.collect_set("model").alias("_models"), F.collect_set("project").alias("_projects"),
    )
    read = malformed_count(lines).join(lines.groupBy("path").agg(F.max("line").alias("raw_lines")), ["path"])
    out = span
    for part in (session_meta(rows), turns, kept, tools, fixes, errors, unknown_types(rows), used, read):
        out = out.join(part, ["path"], "left")
    zero, none = F.lit(0).cast("bigint"), F.array().cast("array<string>")
    n = lambda c: F.coalesce(F.col(c), zero)
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(none)
    names = lambda c, *more: F.array_sort(F.array_distinct(F.concat(F.coalesce(c, none), *map(one, more))))
    gap = lambda a, b: F.when((F.col(b) - F.col(a)).isNotNull(), F.greatest(F.col(b) - F.col(a), zero))
    return out.select(
        "path", "start_ms", "end_ms", gap("start_ms", "end_ms").alias("duration_ms"), gap("start_ms", "_first").alias("first_token_ms"),
        "cwd", "cli_version", "git", names("_models").alias("models"), names("_projects", "project_path").alias("projects"),
        *[n(c).alias(c) for c in ("input", "cached", "output", "reasoning", "total_tokens")], S.money(F.coalesce("_cost", F.lit(0.0))).alias("cost"),
        *[n(c).alias(c) for c in ("turns", "messages", "tools", "patches")], (n("_te") + n("_pe") + n("_ee")).alias("errors"),
        n("unknown_types").alias("unknown_types"), n("malformed").alias("malformed_lines"), n("raw_lines").alias("raw_lines"),
    )
