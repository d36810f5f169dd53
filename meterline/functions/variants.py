"""Typed reads from a VARIANT column: a value of the wrong JSON type reads as missing."""

from pyspark.sql import Column, DataFrame, functions as F

MAX_LONG = 9223372036854775807
_NUMERIC_TEXT = r"^\s*\+?((?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*$"
_RFC3339 = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?"
    r"([Zz]|[+-][0-9]{2}:[0-9]{2})$"
)


def _col(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def parse(text) -> Column:
    """Text to VARIANT, NULL where the text is not JSON. A byte-order mark is ignored."""
    return F.try_parse_json(F.ltrim(_col(text), F.lit("\ufeff")))


def settled(df: DataFrame, *names: str) -> DataFrame:
    """The same rows with the columns ``names`` last. They pass a generator, which later filters aren't pushed
    through: pushed, a filter on a record's fields would parse the text again for every field."""
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.inline(F.array(F.struct(*names))))


def at(v, path: str) -> Column:
    return F.try_variant_get(_col(v), f"$.{path}" if path else "$", "variant")


def _get(v, path: str, kind: str) -> Column:
    return F.try_variant_get(_col(v), f"$.{path}" if path else "$", kind)


def type_at(v, path: str = "") -> Column:
    """STRING, BIGINT, DOUBLE, DECIMAL(p,s), BOOLEAN, VOID, OBJECT<..>, ARRAY<..> or NULL."""
    return F.schema_of_variant(at(v, path))


def text_at(v, path: str) -> Column:
    """The string at ``path``; numbers, objects and nulls there count as absent."""
    return F.when(type_at(v, path) == "STRING", _get(v, path, "string"))


def filled_at(v, path: str) -> Column:
    """Like :func:`text_at`, with an empty string also read as absent."""
    return F.nullif(text_at(v, path), F.lit(""))


def trimmed_at(v, path: str) -> Column:
    """Like :func:`filled_at` on the text without outer blanks."""
    return F.nullif(F.btrim(text_at(v, path), F.lit(" \t\r\n")), F.lit(""))


def map_at(v, path: str) -> Column:
    """The object at ``path`` as a map, NULL for anything else."""
    return _get(v, path, "map<string,variant>")


def array_at(v, path: str) -> Column:
    """The array at ``path``, NULL for anything else."""
    return _get(v, path, "array<variant>")


def is_object(v, path: str) -> Column:
    return map_at(v, path).isNotNull()


def is_array(v, path: str) -> Column:
    return array_at(v, path).isNotNull()


def is_null(v, path: str) -> Column:
    """Absent, or an explicit JSON null."""
    return F.coalesce(type_at(v, path) == "VOID", F.lit(True))


def number_at(v, path: str) -> Column:
    """The JSON number at ``path`` as double; numeric text is absent here."""
    return F.when(type_at(v, path).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), _get(v, path, "double"))


def long_at(v, path: str) -> Column:
    """The JSON integer at ``path``; fractions and text are absent."""
    return F.when(type_at(v, path) == "BIGINT", _get(v, path, "bigint"))


def bool_at(v, path: str) -> Column:
    return F.when(type_at(v, path) == "BOOLEAN", _get(v, path, "boolean"))


def count_of_text(text) -> Column:
    """Numeric text to a whole count; anything unreadable, negative or too large is 0.

    Plain digits take the long path and stay exact; other forms go through a decimal.
    """
    t = _col(text)
    digits = F.regexp_extract(t, _NUMERIC_TEXT, 1)
    whole = F.floor(digits.try_cast("decimal(38,10)")).try_cast("bigint")
    return F.greatest(F.coalesce(t.try_cast("bigint"), whole), F.lit(0).cast("bigint"))


def count_of(v, path: str) -> Column:
    """A token count: number or numeric text, floored; anything else is 0."""
    return count_of_text(_get(v, path, "string"))


def rfc3339_ms(text) -> Column:
    """Epoch ms of an RFC 3339 text. Text without a zone is unreadable, not local time."""
    shaped = F.regexp_extract(_col(text), _RFC3339, 0)
    return F.unix_millis(F.upper(shaped).try_cast("timestamp"))


def epoch_ms(number) -> Column:
    """Numbers below 1e11 are seconds, above are milliseconds; nothing at or below zero."""
    n = _col(number)
    ms = F.when(n < 100_000_000_000.0, n * 1000.0).otherwise(n)
    return F.when(n > 0, ms.try_cast("bigint"))


def ts_ms(v, path: str) -> Column:
    """A time at ``path``: a number, or text with a zone."""
    return F.coalesce(epoch_ms(number_at(v, path)), rfc3339_ms(text_at(v, path)))
