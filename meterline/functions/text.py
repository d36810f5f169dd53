"""Reading verdicts out of process output text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from . import variants as V

_ESC = "\\x1b"
# Terminal escape sequences, and control characters other than tab and newline.
ANSI = _ESC + r"(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])"
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_text(text) -> Column:
    lines = F.regexp_replace(F.regexp_replace(_c(text), "\r\n", "\n"), "\r", "\n")
    return F.regexp_replace(F.regexp_replace(lines, ANSI, ""), CONTROLS, "")


def _lines(text) -> Column:
    return F.split(_c(text), r"\r?\n", -1)


# The line forms in which an exit code or a signal is reported.
EXIT_LINE = r"(?i)^\s*(?:exit code:|process exited with code|command failed with exit code)\s*([+-]?[0-9]+)\.*\s*$"
SIGNALS = ("SIGINT", "SIGTERM", "SIGKILL", "SIGHUP")
SIGNAL_LINE = "Process stopped with signal "


def _is_json(line: Column) -> Column:
    return F.ltrim(line).startswith("{")


def _of_json(line: Column, read: Callable[[Column], Column]) -> Column:
    """What ``read`` takes from the line's object; a lambda binds it, so it is parsed once."""
    return F.get(F.transform(F.array(V.parse(line)), read), F.lit(0))


def _result_exit(v: Column) -> Column:
    """A result's own exit code, or its value's once that is fulfilled."""
    fulfilled = F.coalesce((V.text_at(v, "status") == "fulfilled") & V.at(v, "value").isNotNull(), F.lit(False))
    return F.when(fulfilled, V.long_at(v, "value.exit_code")).otherwise(V.long_at(v, "exit_code"))


def _exit_of_line(line: Column) -> Column:
    """A JSON line tells as a result, any other in words."""
    words = F.regexp_extract(line, EXIT_LINE, 1).try_cast("bigint")
    return F.when(_is_json(line), _of_json(line, _result_exit)).otherwise(words)


def results_in(text) -> Column:
    """How many JSON lines of the text are results with an exit code."""
    return F.size(F.filter(_lines(text), lambda x: F.when(_is_json(x), _of_json(x, _result_exit)).isNotNull()))


def exit_code_of(text) -> Column:
    """Exit code reported in the text; a failure wins over a success, then the larger. NULL if none."""
    codes = F.transform(_lines(text), _exit_of_line)
    ranked = F.transform(F.filter(codes, lambda x: x.isNotNull()), lambda x: F.struct((x != 0).alias("bad"), x.alias("code")))
    return F.array_max(ranked)["code"]


def _signals_of_line(line: Column) -> Column:
    words = F.when(line.startswith(SIGNAL_LINE), F.substring(line, F.lit(len(SIGNAL_LINE) + 1), F.length(line)))
    return F.when(_is_json(line), _of_json(line, lambda v: F.array(V.text_at(v, "signal"), V.text_at(v, "value.signal")))).otherwise(F.array(words))


def signal_of(text) -> Column:
    """The first of SIGNALS that a line reports, in words or at a JSON line's top level or value."""
    named = F.flatten(F.transform(_lines(text), lambda x: F.coalesce(_signals_of_line(x), F.array(F.lit(None).cast("string")))))
    return F.coalesce(*(F.when(F.array_contains(named, name), F.lit(name)) for name in SIGNALS))


def wall_ms_of(text) -> Column:
    """'Wall time N' or 'Wait time N' in seconds, as whole milliseconds."""

    def after(prefix: str) -> Column:
        word = F.regexp_extract(_c(text), prefix + r"\s*(\S+)", 1)
        seconds = F.when(word.rlike(r"^[+-]?[0-9]*\.?[0-9]+$"), word.try_cast("double"))
        return F.round(seconds * 1000.0).cast("bigint")

    return F.coalesce(after("Wall time "), after("Wait time "))


_WORD = r"[^\s;&|<>\"'`$\\()#-][^\s;&|<>\"'`$\\()#]*"
# The literal read-only commands that are given a label.
COMMANDS = {
    "Read": [rf"(?:rtk )?(?:proxy )?cat(?: {_WORD})+", rf"(?:rtk )?(?:proxy )?sed -n [0-9]+(?:,[0-9]+)?p {_WORD}"],
    "List": [rf"(?:rtk )?(?:proxy )?ls(?: -[alhAF1]+| {_WORD})*", rf"(?:rtk )?(?:proxy )?rg(?: -[nilwSF]+| --hidden| {_WORD})* --files(?: -[nilwSF]+| --hidden| {_WORD})*"],
    "Search": [rf"(?:rtk )?(?:proxy )?(?:rg|grep)(?: -[nilwSF]+| --hidden)*(?: {_WORD})(?: -[nilwSF]+| --hidden| {_WORD})*"],
}


def command_label(command) -> Column:
    """Read, List or Search for one plain read-only command; NULL for any shell syntax."""
    cmd = F.btrim(_c(command), F.lit(" "))
    out = None
    for label, forms in COMMANDS.items():
        test = cmd.rlike("^(?:" + "|".join(forms) + ")$")
        out = F.when(test, label) if out is None else out.when(test, label)
    return out
