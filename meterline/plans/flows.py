"""Queries that write or stream tables derived from the events and read the result back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import prices as P
from ..schema import TOKENS
from ..session import scratch_path
from ..sinks import exports as W
from ..sources import files as X, normalize as N
from ..streaming import jobs as J, refresh as RF
from .inputs import EVENT_COLUMNS, END, START, USD_CNY, r6
from .logs import _json
from .registry import query

_COLS = ", ".join(EVENT_COLUMNS)


@query("export_csv", f"""SELECT CASE WHEN ts % 1000 = 0 THEN strftime(make_timestamp(ts * 1000), '%Y-%m-%dT%H:%M:%S+00:00') ELSE strftime(make_timestamp(ts * 1000), '%Y-%m-%dT%H:%M:%S.%g+00:00') END AS "time",
 agent, session, project, model, CAST(input + cached + cache_write + output AS VARCHAR) AS total, {r6('round(CAST(cost * 6.7521 AS DECIMAL(38,12)), 8)')} AS cost, path AS source FROM {{priced}}""")
def export_csv(t):
    folder = scratch_path(t.spark, "export")
    W.export_csv(t.priced.withColumn("line", F.lit(0)), folder, "CNY", USD_CNY)
    rows = t.spark.read.options(header=True, escape='"', emptyValue="", nullValue="\x00").csv(folder)
    cost = F.when(F.col("Estimated CNY") != "unpriced", F.col("Estimated CNY").try_cast("double"))
    named = {"Time (UTC)": "time", "Agent": "agent", "Session": "session", "Project": "project", "Model": "model", "Total": "total", "Source": "source"}
    return rows.select(*[F.col(f"`{a}`").alias(b) for a, b in named.items()], S.money(cost).alias("cost"))


# What is compared of each maintained table: all of its columns, as id, path, ts, a number and a text.
_WRITTEN = {
    "events": ("usage_events", "id", "path", "ts", "input + 3 * cached + 5 * cache_write + 7 * output + 11 * reasoning", "agent session project model"),
    "activities": ("activity_copies", "id", "path", "ts", "0", "agent session name"),
    "quota": ("quota", "''", "path", "ts", "0", "agent session payload"),
    "credits": ("credits", "request_id", "path", "ts", "requests + 2 * coalesce(billable_requests, 99)", "agent session project model credits original_credits context_usage_ratio"),
    "source_files": ("source_files", "''", "path", "mtime", "0", "agent title"),
}


def _written_sql(name: str, source: str, text) -> str:
    _, key, path, ts, n, fields = _WRITTEN[name]
    return f"SELECT '{name}' AS tbl, {key} AS id, {path} AS path, {ts} AS ts, CAST({n} AS BIGINT) AS n, {text(fields.split())} AS text FROM {source}"


def _text(kind: str):
    value = lambda c: f"CAST(CAST({c} AS DECIMAL(18,6)) AS {kind})" if c in ("credits", "original_credits", "context_usage_ratio") else c
    return lambda fields: " || '|' || ".join(f"coalesce({value(c)}, '~')" for c in fields)


@query("write_tables", " UNION ALL ".join(_written_sql(n, f"{{{v[0]}}}", _text("VARCHAR")) for n, v in _WRITTEN.items()))
def write_tables(t):
    """All tables published twice, the first time some of them in part; the newest version is read back whole."""
    folder = scratch_path(t.spark, "tables")
    tables = {name: getattr(t, source[0]) for name, source in _WRITTEN.items()}
    W.write_tables({"events": tables["events"].where("ts % 2 = 0"), "quota": tables["quota"]}, folder)
    W.write_tables(tables, folder)
    read = W.read_tables(t.spark, folder)
    return reduce(lambda a, b: a.unionByName(b), [t.spark.sql(_written_sql(n, "{rows}", _text("STRING")), rows=read[n]) for n in _WRITTEN])


_PRICES = """{"version":1,"currency":"cny","displayCurrency":"CNY","usdCny":6.7521,"aliases":{"Alias-A":"m-cny"},"models":{
"GLM-5.3-Flash":[{"input":1.0,"cached":0.2,"cacheWrite":1.0,"output":4.0},{"effectiveFrom":"2024-01-15T00:00:00Z","input":2.0,"cached":0.4,"cacheWrite":2.0,"output":8.0}],
"m-cny":[{"effectiveFrom":"2024-01-10T00:00:00Z","input":3.0,"cached":0.3,"cacheWrite":3.75,"output":15.0}],
"unknown":[{"currency":"usd","input":0.5,"cached":0.05,"cacheWrite":0.5,"output":2.0}]}}"""


@query("price_table_load", f"SELECT id, agent, {r6('cost')} AS cost FROM {{priced}}")
def price_table_load(t):
    folder = scratch_path(t.spark, "prices")
    t.spark.createDataFrame([(_PRICES.replace("\n", ""),)], "value string").coalesce(1).write.text(folder)
    rates, aliases, fx = P.load_prices(t.spark, folder)
    chosen = t.usage_events.where((F.col("ts") >= START) & (F.col("ts") < END))
    return P.price(chosen, rates, aliases, fx).select("id", "agent", S.money("cost").alias("cost"))


# --- streams -----------------------------------------------------------------------------------


def _in_two(t, df, first: str, folder: str):
    """The table in two arrivals; the caller runs its stream after each."""
    df.where(first).write.mode("append").parquet(folder)
    yield t.spark.readStream.schema(df.schema).parquet(folder)
    df.where(f"NOT ({first})").write.mode("append").parquet(folder)
    yield t.spark.readStream.schema(df.schema).parquet(folder)


# Names with a blank, a percent sign and pattern characters are file names like any other.
_NAMES = ("plain.txt", "with blank.txt", "per%20cent.txt", "[odd]{x}.txt")


def _publish(t, rows, folder: str) -> None:
    """Writes [file (number), value] rows as one file per number below ``folder``, over what is there: for a
    reader, a file that was there before has grown or changed."""
    made = scratch_path(t.spark, "made")
    rows.repartition("file").sortWithinPartitions("file", "value").write.partitionBy("file").text(made)
    hadoop = t.spark._jvm.org.apache.hadoop.fs
    system = hadoop.Path(made).getFileSystem(t.spark._jsc.hadoopConfiguration())
    system.mkdirs(hadoop.Path(folder))
    for number, name in enumerate(_NAMES):
        here = hadoop.Path(f"{made}/file={number}")
        for status in system.listStatus(here) if system.exists(here) else ():
            if status.getPath().getName().startswith("part-"):
                system.delete(hadoop.Path(hadoop.Path(folder), name), False)
                system.rename(status.getPath(), hadoop.Path(hadoop.Path(folder), name))


def _reader(t):
    def read(paths: list[str]):
        v = N.parsed(X.scan_jsonl(t.spark, paths, "*"))
        get = lambda name, kind: f"try_variant_get(v, '$.{name}', '{kind}') AS {name}"
        return v.selectExpr("path", "'log' AS agent", get("id", "string"), get("session", "string"), get("ts", "bigint"), get("output", "bigint"))

    return read


_FILE = f"event_id % {len(_NAMES)} AS file"


@query("stream_ingest", "SELECT id, session, ts FROM {usage_raw}")
def stream_ingest(t):
    """Half of each file arrives first; then the same files have grown by the other half."""
    source, sink = [scratch_path(t.spark, n) for n in ("in", "sink")]
    text = t.usage_raw.withColumn("value", _json(id="=id", session="=session", ts="=ts", output="=output")).selectExpr("value", _FILE, "event_id")
    for part in (text.where("event_id % 8 < 4"), text):
        _publish(t, part.select("value", "file"), source)
        J.stream_ingest(t.spark, source, "*.txt", _reader(t), sink)
    return J.ingested(t.spark, sink).select("id", "session", "ts")


@query("refresh", """SELECT id, output, file FROM (SELECT id, output + CASE WHEN file = 1 THEN 7 ELSE 0 END AS output, file,
 row_number() OVER (PARTITION BY id ORDER BY ts + CASE WHEN file = 1 THEN 5 ELSE 0 END DESC, file) AS rn FROM (
 SELECT id, output, ts, event_id % 4 AS file FROM {usage_raw} UNION ALL SELECT id, output, ts, 1 FROM {usage_raw} WHERE k % 10 = 0) u WHERE file <> 3) e WHERE rn = 1""")
def refresh(t):
    """Four files with copies across them; then one has changed and one has vanished. Winners after both rounds."""
    source, sink = [scratch_path(t.spark, n) for n in ("in", "sink")]
    raw = t.usage_raw.selectExpr("id", "session", "ts", "output", "k", _FILE)
    both = raw.unionByName(raw.where("k % 10 = 0").withColumn("file", F.lit(1).cast(raw.schema["file"].dataType)))
    value = lambda rows: rows.select(_json(id="=id", session="=session", ts="=ts", output="=output").alias("value"), "file")
    _publish(t, value(both), source)
    RF.refresh(t.spark, source, "*.txt", _reader(t), sink, "log")
    _publish(t, value(both.where("file = 1").withColumns({"output": F.col("output") + 7, "ts": F.col("ts") + 5})), source)
    hadoop = t.spark._jvm.org.apache.hadoop.fs
    gone = hadoop.Path(hadoop.Path(source), _NAMES[3])
    gone.getFileSystem(t.spark._jsc.hadoopConfiguration()).delete(gone, False)
    RF.refresh(t.spark, source, "*.txt", _reader(t), sink, "log")
    name = F.substring_index("path", "/", -1)
    number = F.coalesce(*[F.when(name == n, F.lit(i)) for i, n in enumerate(_NAMES)])
    return RF.current_rows(t.spark, sink, "winners").select("id", "output", number.cast("bigint").alias("file"))


_TOTALS = ", ".join(f"lag({c}) OVER w AS p_{c[2:]}" for c in ("c_input", "c_cached", "c_cache_write", "c_output", "c_reasoning"))


@query("stream_delta", f"""WITH s AS (SELECT *, row_number() OVER w AS n, {_TOTALS} FROM {{counters}} WINDOW w AS (PARTITION BY session ORDER BY CAST(substr(id, 2) AS BIGINT))),
u AS (SELECT *, n = 1 OR c_input < p_input OR c_output < p_output AS own FROM s
 WHERE NOT (n > 1 AND c_input = p_input AND c_cached = p_cached AND c_cache_write = p_cache_write AND c_output = p_output AND c_reasoning = p_reasoning))
SELECT id, CASE WHEN own THEN last_output ELSE greatest(c_output - p_output, 0) END AS output,
 CASE WHEN own THEN last_cached ELSE least(greatest(c_cached - p_cached, 0), greatest(c_input - p_input, 0)) END AS cached,
 CASE WHEN own THEN last_input ELSE greatest(c_input - p_input, 0) - least(greatest(c_cached - p_cached, 0), greatest(c_input - p_input, 0)) END AS input,
 CASE WHEN own THEN last_cache_write ELSE greatest(c_cache_write - p_cache_write, 0) END AS cache_write,
 CASE WHEN own THEN last_reasoning ELSE greatest(c_reasoning - p_reasoning, 0) END AS reasoning FROM u""")
def stream_delta(t):
    source, sink, mark = [scratch_path(t.spark, n) for n in ("in", "sink", "mark")]
    samples = t.counters.select("id", F.col("session").alias("path"), F.expr("CAST(substring(id, 2) AS BIGINT)").alias("line"), *J.COUNTERS, *J.LAST)
    middle = samples.agg(F.expr("CAST(avg(line) AS BIGINT)").alias("m")).first()["m"]
    for stream in _in_two(t, samples, f"line < {middle or 0}", source):
        J.stream_delta(stream, sink, mark)
    return t.spark.read.parquet(f"{sink}/usage").select("id", *TOKENS)


@query("stream_elect", f"SELECT {_COLS} FROM {{usage_events}}")
def stream_elect(t):
    from ..operators.elect import with_mtime

    source, sink, mark = [scratch_path(t.spark, n) for n in ("in", "sink", "mark")]
    raw = with_mtime(t.raw_events, t.source_files).select(*EVENT_COLUMNS, "mtime")
    for stream in _in_two(t, raw, "path LIKE 'archive/%'", source):
        J.stream_elect(stream, sink, mark)
    return J.winners(t.spark, sink, raw.schema).select(*EVENT_COLUMNS)


@query("stream_series", "SELECT ts - ts % 3600000 AS bucket, count(*) AS events, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in TOKENS) + " FROM {usage_raw} GROUP BY 1")
def stream_series(t):
    source, sink, mark = [scratch_path(t.spark, n) for n in ("in", "sink", "mark")]
    rows = t.usage_raw.select("ts", *TOKENS)
    middle = rows.agg(F.expr("CAST(avg(ts) AS BIGINT)").alias("m")).first()["m"]
    for stream in _in_two(t, rows, f"ts >= {middle or 0}", source):  # the older half comes last
        J.stream_series(stream, 3_600_000, sink, mark)
    J.compact_series(t.spark, sink)
    return J.series(t.spark, sink).select("bucket", "events", *TOKENS)
