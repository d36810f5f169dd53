"""Column builders for identities, counters and calendar keys. No Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import variants as V

MAX_LONG = V.MAX_LONG

# The Unicode White_Space characters.
BLANKS = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Sentinels that appear in results.
UNKNOWN_MODEL = "unknown"
CREDIT_AGENT = "qoder"
UNATTRIBUTED_MODEL = "qoder:unattributed"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- identities ---------------------------------------------------------------


def normalize_model(name) -> Column:
    cleaned = F.lower(F.btrim(_c(name), F.lit(BLANKS)))
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(UNKNOWN_MODEL))


def model_key(agent="agent", model="model") -> Column:
    """Grouping key of a model: usage nobody could attribute gets its own key."""
    nameless = (_c(agent) == CREDIT_AGENT) & (_c(model) == UNKNOWN_MODEL)
    return F.when(nameless, F.lit(UNATTRIBUTED_MODEL)).otherwise(_c(model))


def project_key(project) -> Column:
    """Drive and UNC paths fold separators and ASCII case; other paths stay as written."""
    p = _c(project)
    windows = p.rlike(r"^([A-Za-z]:[/\\]|\\\\|//)")
    folded = F.translate(p, "\\" + _UPPER, "/" + _UPPER.lower())
    return F.when(windows, F.rtrim(folded, F.lit("/"))).otherwise(p)


def project_name(path) -> Column:
    """Last segment under either separator; a bare root is kept whole."""
    p = _c(path)
    body = F.rtrim(p, F.lit("/\\"))
    last = F.regexp_extract(body, r"[^/\\]*$", 0)
    bare = F.when(body.rlike(r"^[A-Za-z]:"), F.substring(body, 3, MAX_INT)).otherwise(body)
    base = F.when(body.rlike(r"[/\\]"), last).otherwise(bare)
    return F.when(base == "", p).otherwise(base)


MAX_INT = 2147483647


def display_path(path) -> Column:
    """Verbatim prefixes are for storage only: strip them for readers."""
    p = _c(path)
    return (
        F.when(p.startswith("\\\\?\\UNC\\"), F.concat(F.lit("\\\\"), F.substring(p, 9, MAX_INT)))
        .when(p.startswith("\\\\?\\"), F.substring(p, 5, MAX_INT))
        .otherwise(p)
    )


def percent_decode(text) -> Column:
    """Percent decoding that keeps '+' and leaves broken escapes as they are."""
    safe = F.regexp_replace(_c(text), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(F.replace(safe, F.lit("+"), F.lit("%2B")))


def uri_project(uris_json) -> Column:
    """Project of the first ``file://`` entry in a JSON array of workspace URIs."""
    uris = F.from_json(_c(uris_json), "array<string>")
    first = F.try_element_at(F.filter(uris, lambda u: u.startswith("file://")), F.lit(1))
    rest = F.substring(first, 8, MAX_INT)
    local = F.when(rest.rlike(r"^/[A-Za-z]:"), F.substring(rest, 2, MAX_INT)).otherwise(rest)
    return F.coalesce(project_name(percent_decode(local)), F.lit(""))


def path_part(path, back: int) -> Column:
    """The ``back``-th path component from the end (1 = file name), '' when absent."""
    parts = F.split(_c(path), r"[/\\]")
    return F.coalesce(F.try_element_at(parts, F.lit(-back)), F.lit(""))


def file_stem(path) -> Column:
    return F.regexp_replace(path_part(path, 1), r"(?<=.)\.[^.]*$", "")


# Fixed value: marker between prefix and project in one source's folder names.
PROJECT_MARKER = "-WorkBuddy-"


def marker_project(path) -> Column:
    """Project after the marker in the parent folder's name, else the whole name."""
    folder = path_part(path, 2)
    found = F.locate(PROJECT_MARKER, folder)
    after = F.substr(folder, found + F.lit(len(PROJECT_MARKER)))
    return F.when((found > 0) & (after != ""), after).otherwise(folder)


def encoded_dir_project(path) -> Column:
    """The grandparent folder holds a percent-encoded absolute path."""
    return F.coalesce(project_name(percent_decode(path_part(path, 3))), F.lit(""))


# --- counters -------------------------------------------------------------------


def cache_write_of(v, path: str) -> Column:
    """struct(value, spelling). Two names for one counter: 1 and 2 are the single names,
    3 both and equal, 4 both and different (value unusable, 0), 0 neither."""
    base = f"{path}." if path else ""
    names = (f"{base}cache_creation_input_tokens", f"{base}cache_write_input_tokens")
    has_a, has_b = [V.at(v, n).isNotNull() for n in names]
    a, b = [V.count_of(v, n) for n in names]
    spelling = F.when(has_a & has_b, F.when(a == b, 3).otherwise(4)).otherwise(
        has_a.cast("int") + 2 * has_b.cast("int")
    )
    # The absent name counts 0, so the larger one is the value unless the two disagree.
    value = F.when(has_a & has_b & (a != b), F.lit(0).cast("bigint")).otherwise(F.greatest(a, b))
    return F.struct(value.alias("value"), spelling.cast("int").alias("spelling"))


def openai_tokens(v, path: str) -> Column:
    """Usage whose input includes cache reads, as running totals use it: ``whole`` is the input
    as written, ``cached`` the part of it that was read from cache."""
    base = f"{path}." if path else ""
    whole = V.count_of(v, f"{base}input_tokens")
    cached = F.greatest(
        V.count_of(v, f"{base}cached_input_tokens"), V.count_of(v, f"{base}cache_read_input_tokens")
    )
    write = cache_write_of(v, path)
    return F.struct(
        whole.alias("whole"),
        F.least(cached, whole).alias("cached"),
        write["value"].alias("cache_write"),
        V.count_of(v, f"{base}output_tokens").alias("output"),
        V.count_of(v, f"{base}reasoning_output_tokens").alias("reasoning"),
        write["spelling"].alias("spelling"),
    )


def total_tokens(i="input", c="cached", w="cache_write", o="output") -> Column:
    """Saturating total; reasoning is inside output and never added."""
    total = F.try_add(F.try_add(F.try_add(_c(i), _c(c)), _c(w)), _c(o))
    return F.coalesce(total, F.lit(MAX_LONG))


def saturating_sum(x, has_nulls: bool = True) -> Column:
    """Sum of non-negative longs that stops at the largest long instead of failing.

    ``try_sum`` keeps an 8-byte buffer, so this stays in the hash aggregate. A sum over no
    value is 0; columns without NULLs share one row count to tell that case apart.
    """
    c = _c(x)
    values = F.count(c) if has_nulls else F.count(F.lit(1))
    return F.coalesce(F.try_sum(c), F.when(values == 0, F.lit(0)).otherwise(F.lit(MAX_LONG)).cast("bigint"))


# --- time ---------------------------------------------------------------------------


def sec_nanos_ms(sec, nanos) -> Column:
    """Seconds and nanoseconds to ms; overflow or a non-positive result is 0."""
    ms = F.try_add(
        F.try_multiply(_c(sec).cast("bigint"), F.lit(1000).cast("bigint")),
        (_c(nanos).cast("bigint") / F.lit(1_000_000)).cast("bigint"),
    )
    return F.greatest(F.coalesce(ms, F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))


def bucket_floor(ts, width: int, shift: int = 0) -> Column:
    """Start of the ``width`` ms bucket, aligned to midnight at ``shift`` ms east of UTC."""
    moved = _c(ts) + F.lit(shift).cast("bigint")
    return moved - F.pmod(moved, F.lit(width).cast("bigint")) - F.lit(shift).cast("bigint")


def _local(ts, zone: str | None, offset_minutes: int) -> Column:
    if zone is not None:
        return F.from_utc_timestamp(F.timestamp_millis(_c(ts)), zone)
    return F.timestamp_millis(_c(ts) + F.lit(offset_minutes * 60_000).cast("bigint"))


def local_day(ts, zone: str | None = None, offset_minutes: int = 0) -> Column:
    return F.date_format(_local(ts, zone, offset_minutes), "yyyy-MM-dd")


def local_month(ts, zone: str | None = None, offset_minutes: int = 0) -> Column:
    return F.date_format(_local(ts, zone, offset_minutes), "yyyy-MM")


def midnight_ms(day, zone: str | None = None, offset_minutes: int = 0) -> Column:
    """First instant of a local date; of two midnights the earlier one, and where a clock change leaves midnight out, the
    first minute after it that the zone has."""
    naive = F.unix_millis(_c(day).cast("date").cast("timestamp"))
    if zone is None:
        return naive - F.lit(offset_minutes * 60_000).cast("bigint")
    at = F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(naive), zone))
    local = lambda t: F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(t), zone))
    # inside a gap Spark goes on by the gap's length; the gap's end lies at most that long before
    beyond = F.array_max(F.filter(F.sequence(F.lit(0), F.greatest((local(at) - naive) / 60_000, F.lit(0)).cast("int")), lambda m: local(at - m * 60_000) >= naive))
    return F.when(local(at) == naive, at).otherwise(at - beyond.cast("bigint") * 60_000)


def day_bounds(key, zone: str | None = None, offset_minutes: int = 0) -> tuple[Column, Column]:
    day = _c(key).cast("date")
    return (
        midnight_ms(day, zone, offset_minutes),
        midnight_ms(F.date_add(day, 1), zone, offset_minutes),
    )


def month_bounds(key, zone: str | None = None, offset_minutes: int = 0) -> tuple[Column, Column]:
    first = F.concat(_c(key), F.lit("-01")).cast("date")
    return (
        midnight_ms(first, zone, offset_minutes),
        midnight_ms(F.add_months(first, 1), zone, offset_minutes),
    )


def duration_ms(start, end) -> Column:
    """Milliseconds between two RFC 3339 texts, never negative, NULL if either is unreadable."""
    gap = V.rfc3339_ms(end) - V.rfc3339_ms(start)
    return F.when(gap.isNotNull(), F.greatest(gap, F.lit(0).cast("bigint")))


def minutes_to_reset(now_ms, reset_ms) -> Column:
    """Whole minutes until a reset, rounded up; 0 when past, NULL when unknown."""
    left = _c(reset_ms) - _c(now_ms)
    return F.when(left <= 0, F.lit(0).cast("bigint")).otherwise(
        F.ceil(left / F.lit(60_000.0)).cast("bigint")
    )


# --- money and ratios -------------------------------------------------------------------


def money(x, digits: int = 6) -> Column:
    """Round at the edge through a decimal, so ties do not depend on binary noise."""
    return F.round(_c(x).cast("decimal(38,10)"), digits).cast("double")


def display_cost(usd, currency: str, fx: float | None) -> Column:
    """Text of a cost in the display currency: 8 decimals, or the word for 'no price'."""
    factor = fx if currency == "CNY" and fx is not None else 1.0
    shown = F.format_string("%.8f", _c(usd) * F.lit(float(factor)))
    return F.when(_c(usd).isNull(), F.lit("unpriced")).otherwise(shown)


def cache_hit_rate(i="input", c="cached", w="cache_write") -> Column:
    """cached / (input + cached + cache_write), NULL when nothing was sent."""
    return F.try_divide(_c(c).cast("double"), (_c(i) + _c(c) + _c(w)).cast("double"))


def effective_price(cost="cost", total="total_tokens") -> Column:
    """Cost per million tokens; NULL when the cost is unknown or nothing was used."""
    return F.try_divide(_c(cost), _c(total).cast("double")) * 1_000_000.0


def component_price(cost, part_cost, part_tokens) -> Column:
    known = _c(cost).isNotNull()
    return F.when(known, effective_price(part_cost, part_tokens))


def csv_safe(text) -> Column:
    """A quote in front of anything a spreadsheet could read as a formula."""
    t = _c(text)
    return F.when(t.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), t)).otherwise(t)
