"""Reading one transcript record (a VARIANT): its kind, text, ids and tool fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import variants as V

# Record type names of each kind.
USER_TYPES = ("user_message", "user_message_delta", "input_text")
ASSISTANT_TYPES = ("assistant_message", "agent_message", "assistant_message_delta", "output_text")
REASONING_TYPES = (
    "reasoning", "reasoning_summary", "reasoning_summary_part", "agent_reasoning",
    "reasoning_output", "response.reasoning_summary_text.delta",
    "response.reasoning_summary_text.done",
)
CALL_TYPES = (
    "function_call", "custom_tool_call", "local_shell_call", "tool_search_call",
    "web_search_call", "image_generation_call", "exec_command_begin", "mcp_tool_call_begin",
)
OUTPUT_TYPES = (
    "exec_command_end", "mcp_tool_call_end", "web_search_end", "image_generation_end",
    "function_call_output", "custom_tool_call_output", "tool_search_output",
)
NOTICE_TYPES = ("context_compacted", "compacted")
# Names of tools whose records carry none.
IMPLIED_NAMES = {
    "local_shell_call": "local_shell", "tool_search_call": "tool_search",
    "web_search_call": "web_search", "web_search_end": "web_search",
    "image_generation_call": "image_generation", "image_generation_end": "image_generation",
}
ARGUMENT_FIELDS = ("arguments", "args", "params", "input", "action", "execution", "revised_prompt")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def kind_of(kind, role, level, status, item) -> Column:
    """The timeline kind of a record type; '' has none, unseen types are 'unknown'."""
    t, role, level, status, item = [_c(x) for x in (kind, role, level, status, item)]
    message = t == "message"
    has = lambda word: t.contains(word)
    user = t.isin(*USER_TYPES) | has("user_message") | (message & (role == "user"))
    assistant = (
        t.isin(*ASSISTANT_TYPES) | has("assistant_message") | has("agent_message")
        | (message & (role == "assistant"))
    )
    output = has("tool_result") | has("tool_output") | t.isin(*OUTPUT_TYPES)
    call = (has("tool_call") & ~output) | t.isin(*CALL_TYPES)
    return (
        F.when(t == "session_meta", "meta").when(t == "turn_context", "context")
        .when(t == "token_count", "usage").when(t == "thread_settings_applied", "settings")
        .when((t == "item_completed") & (item == "CommandExecution"), "exec_exit").when(t == "task_started", "start")
        .when(t.isin("task_complete", "task_completed"), "end")
        .when(user, "user").when(assistant, "assistant").when(message & role.isin("system", "developer"), "system")
        .when(t.isin(*REASONING_TYPES), "reasoning").when(call, "tool_call").when(output, "tool_output")
        .when(has("patch_apply") | has("apply_patch"), "patch")
        .when((t == "error") | (level == "error") | (status == "failed"), "error")
        .when(t.isin(*NOTICE_TYPES), "notice").when(t == "", "none").otherwise("unknown")
    )


def kind_facts(v) -> dict[str, Column]:
    """The fields of a record body that decide its kind, for :func:`kind_of`."""
    return {
        "role": V.trimmed_at(v, "role"), "level": V.trimmed_at(v, "level"),
        "said": V.trimmed_at(v, "status"), "item_type": V.text_at(v, "item.type"),
    }


def event_kind(kind, v) -> Column:
    return kind_of(kind, *kind_facts(v).values())


def _compact(v, path: str) -> Column:
    present = V.at(v, path)
    return F.coalesce(V.text_at(v, path), F.when(present.isNotNull(), F.to_json(present)))


def _parts_text(v, path: str) -> Column:
    """Texts of an array of parts, one per line; a part without text is named by its type."""

    def one(part: Column) -> Column:
        kind = V.trimmed_at(part, "type")
        value = F.coalesce(
            V.trimmed_at(part, "image_url"), V.trimmed_at(part, "file_url"), V.trimmed_at(part, "name")
        )
        shown = F.when(value.startswith("data:"), F.lit("embedded data")).otherwise(value)
        named = F.when(shown.isNull(), F.concat(F.lit("["), kind, F.lit("]"))).otherwise(
            F.concat(F.lit("["), kind, F.lit(": "), shown, F.lit("]"))
        )
        return F.coalesce(V.trimmed_at(part, "text"), V.trimmed_at(part, "content"), named)

    texts = F.array_compact(F.transform(V.array_at(v, path), one))
    return F.when(F.size(texts) > 0, F.array_join(texts, "\n"))


def text_of(v) -> Column:
    """First text among the places where records keep their message."""
    plain = [
        V.trimmed_at(v, p)
        for p in ("message", "text", "content", "message.content", "message.text", "item.text", "item.content")
    ]
    whole = F.when(V.is_array(v, "content") | V.is_object(v, "content"), _compact(v, "content"))
    return F.coalesce(*plain, _parts_text(v, "content"), _parts_text(v, "summary"), whole)


def prompt_text(v) -> Column:
    """Base instructions of a session record."""
    return F.coalesce(
        *[V.trimmed_at(v, p) for p in ("base_instructions.text", "system_prompt", "systemPrompt", "instructions")]
    )


def turn_id_of(v) -> Column:
    return F.coalesce(
        *[V.trimmed_at(v, p) for p in ("turn_id", "turnId", "payload.turn_id", "payload.turnId")]
    )


def call_id_of(v) -> Column:
    return F.coalesce(*[V.trimmed_at(v, p) for p in ("call_id", "callId", "id", "output.call_id")])


def tool_name_of(v) -> Column:
    kind = V.text_at(v, "type")
    implied = None
    for t, name in IMPLIED_NAMES.items():
        implied = F.when(kind == t, name) if implied is None else implied.when(kind == t, name)
    return F.coalesce(
        *[V.trimmed_at(v, p) for p in ("name", "tool_name", "command", "tool.name")],
        V.text_at(v, "tool"), implied,
    )


def arguments_of(v) -> Column:
    return F.coalesce(*[_compact(v, p) for p in ARGUMENT_FIELDS])


def output_of(v) -> Column:
    rich = lambda p: F.when(~V.is_null(v, p), _compact(v, p))
    return F.coalesce(
        *[V.trimmed_at(v, p) for p in ("output", "stdout", "stderr", "result")],
        rich("results"), V.trimmed_at(v, "saved_path"), rich("output"),
    )


def stderr_of(v) -> Column:
    return F.coalesce(V.trimmed_at(v, "stderr"), V.trimmed_at(v, "output.stderr"))


def error_text_of(v) -> Column:
    return F.coalesce(
        V.trimmed_at(v, "error"), V.trimmed_at(v, "message"),
        F.when(~V.is_null(v, "error"), _compact(v, "error")),
    )
