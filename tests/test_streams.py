"""Continuous jobs: grown, changed and vanished files, late and repeated batches, bounded logs."""

from pyspark.sql import functions as F

from meterline.sources import files
from meterline.streaming import jobs as J, logs, refresh as RF


def reader(spark):
    def read(paths):
        rows = files.scan_jsonl(spark, paths, "*")
        part = F.split("value", ",")
        return rows.select("path", F.lit("log").alias("agent"), part[0].alias("id"), part[1].cast("long").alias("ts"))

    return read


def ids(rows):
    return sorted((r["id"], r["ts"]) for r in rows.collect())


def test_files_that_grow_change_and_vanish(spark, tmp_path):
    source, sink = tmp_path / "in", str(tmp_path / "sink")
    source.mkdir()
    one, two = source / "a b%20c.txt", source / "[x]{y}.txt"
    one.write_text("e1,1\ne2,2\n")
    two.write_text("e2,5\ne3,3\n")
    go = lambda: RF.refresh(spark, str(source), "*.txt", reader(spark), sink, "log")
    assert go() == {"read": 2, "failed": 0, "vanished": 0} and go() == {"read": 0, "failed": 0, "vanished": 0}
    assert ids(RF.current_rows(spark, sink, "winners")) == [("e1", 1), ("e2", 5), ("e3", 3)]
    with one.open("a") as file:
        file.write("e4,4\ne3,9\n")
    assert go() == {"read": 1, "failed": 0, "vanished": 0}
    assert ids(RF.current_rows(spark, sink)) == [("e1", 1), ("e2", 2), ("e2", 5), ("e3", 3), ("e3", 9), ("e4", 4)]
    assert ids(RF.current_rows(spark, sink, "winners")) == [("e1", 1), ("e2", 5), ("e3", 9), ("e4", 4)]
    two.unlink()
    assert go() == {"read": 0, "failed": 0, "vanished": 1}
    assert ids(RF.current_rows(spark, sink, "winners")) == [("e1", 1), ("e2", 2), ("e3", 9), ("e4", 4)]
    one.rename(source / "a.gone")
    assert go() == {"read": 0, "failed": 0, "vanished": 0}  # an empty listing retracts nothing
    assert len(ids(RF.current_rows(spark, sink))) == 4


def batch(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).parquet(folder)


def test_late_and_repeated_rows_in_election_and_series(spark, tmp_path):
    schema = "agent string, id string, ts long, mtime long, path string, input long, cached long, cache_write long, output long, reasoning long"
    folder, sink = str(tmp_path / "in"), str(tmp_path / "sink")
    row = lambda i, ts, path: ("a", i, ts, 0, path, 1, 0, 0, 2, 0)
    parts = [[row("x", 9_000, "p1"), row("y", 1, "p1")], [row("x", 100, "p2"), row("y", 7_000, "p2")], [row("x", 9_000, "p0")], [row("z", 50, "p9")]]
    for part in parts:
        J.stream_elect(batch(spark, folder, part, schema), sink, f"{tmp_path}/m1")
        J.stream_series(spark.readStream.schema(schema).parquet(folder), 1_000, sink, f"{tmp_path}/m2")
    want = [("x", 9_000, "p0"), ("y", 7_000, "p2"), ("z", 50, "p9")]
    found = lambda: sorted((r["id"], r["ts"], r["path"]) for r in J.winners(spark, sink, spark.createDataFrame([], schema).schema).collect())
    sums = lambda: sorted((r["bucket"], r["events"], r["output"]) for r in J.series(spark, sink).collect())
    assert found() == want and sums() == [(0, 3, 6), (7_000, 1, 2), (9_000, 2, 4)]
    J.compact_winners(spark, sink, spark.createDataFrame([], schema).schema)
    J.compact_series(spark, sink)
    assert found() == want and sums() == [(0, 3, 6), (7_000, 1, 2), (9_000, 2, 4)]
    assert len(logs.batches(spark, f"{sink}/winners")) == 2
    again = spark.createDataFrame(parts[3], schema)  # a batch that runs again writes over itself
    logs.write_batch(J._winning(again, ["agent", "id"]), f"{sink}/winners", 3)
    assert found() == want


def counter_rows():
    """Totals that rise, repeat, fall and change their spelling, for three paths."""
    from meterline.operators.counters import COUNTERS

    width = len(COUNTERS) + len(J.LAST)
    total = lambda n: [n * 10] * len(COUNTERS) + [5] * (width - len(COUNTERS))
    rows = [[f"p{i % 3}", i, *total(i if i not in (13, 16) else 2), 1 + (i > 18)] for i in range(24)]
    rows[9][2:7] = rows[6][2:7]
    rows[20][-1] = None
    return [tuple(r) for r in rows], "path string, line long, " + ", ".join(f"{c} long" for c in (*COUNTERS, *J.LAST, "spelling"))


def test_counters_across_batches_and_restarts(spark, tmp_path):
    from meterline.operators.counters import cumulative_delta

    rows, schema = counter_rows()
    folder, sink = str(tmp_path / "in"), str(tmp_path / "sink")
    for at in range(0, 24, 4):  # every call is a restart from the checkpoint
        part = [rows[at + 3], *rows[at : at + 3]]
        J.stream_delta(batch(spark, folder, part, schema), sink, f"{tmp_path}/m", "spelling")
    columns = ["path", "line", "input", "cached", "cache_write", "output", "reasoning"]
    key = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    whole = cumulative_delta(spark.createDataFrame(rows, schema), ["path"], ["line"], "spelling", 100).where("input IS NOT NULL")
    assert key(spark.read.parquet(f"{sink}/usage")) == key(whole)
    state = spark.read.format("statestore").option("stateVarName", "last").load(f"{tmp_path}/m")
    assert state.count() == 3  # a row per path, whatever came before


def test_numbers_cross_to_python_as_one_column(spark, tmp_path):
    """Nulls, other columns and their types come back as they were; the operator itself sees keys, line and one text of numbers."""
    from meterline.streaming import counters

    _, schema = counter_rows()
    schema = f"`odd name` double, {schema}, note string"
    row = lambda path, line, total, note: (line / 2, path, line, *[total] * len(J.COUNTERS), *[None if line == 2 else 7] * len(J.LAST), None, note)
    part = [row("p", 1, 10, "a,b"), row("p", 2, 4, None), row("p", 3, 9, ""), row("q", 1, 2**60, "x")]
    J.stream_delta(batch(spark, f"{tmp_path}/in", part, schema), f"{tmp_path}/sink", f"{tmp_path}/m", "spelling")
    got = spark.read.parquet(f"{tmp_path}/sink/usage")
    assert got.columns[:3] == ["odd name", "path", "line"] and got.columns[-len(counters.TOKENS) :] == list(counters.TOKENS)
    rows = sorted(map(tuple, got.select("odd name", "path", "line", "c_input", "last_input", "spelling", "note", "input", "cached").collect()), key=lambda r: (r[1], r[2]))
    assert rows == [(0.5, "p", 1, 10, 7, None, "a,b", 7, 7), (1.5, "p", 3, 9, 7, None, "", 0, 5), (0.5, "q", 1, 2**60, 7, None, "x", 7, 7)]
    assert counters.NUMBERS not in got.columns
