"""Long chains, many chunks, null keys and exit codes: the cases that used to be slow or wrong."""

import time

import pytest
from pyspark.sql import functions as F

from meterline.functions import text as T
from meterline.operators import ordered as O, pages, replay
from meterline.operators.tree import resolve_ends


def test_long_chains_and_cycles_end(spark):
    links = [(f"n{i:05d}", f"n{i - 1:05d}" if i else None) for i in range(20_000)] + [("a", "b"), ("b", "a"), ("c", "a"), ("d", "gone")]
    start = time.time()
    found = {r["id"]: (r["root"], r["hops"]) for r in resolve_ends(spark.createDataFrame(links, "id string, parent string")).collect()}
    assert time.time() - start < 120
    assert found["n19999"] == ("n00000", 19_999) and found["n00000"] == ("n00000", 0)
    assert {found[x][0] for x in "abc"} == {None} and found["d"] == ("d", 0)


def fold(spark, chunks):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(chunks)], "line int, chunk string")
    parts = F.collect_list(F.when(F.col("chunk").isNotNull(), F.struct("line", "chunk")))
    return rows.agg(replay._fold(parts).alias("t")).first()["t"]


def plain(chunks):
    sofar = None
    for c in chunks:
        sofar = c if sofar is None else sofar if sofar == c else f"{sofar}\n{c}"
    return sofar


def test_chunks_join_in_linear_time(spark):
    long = ["x" * 5_000, "y" * 5_000]
    for chunks in ([], ["a"], ["a", "a", "b"], ["a", "b", "a\nb", "c", "a\nb\nc"], ["", "", "x"], [*long, "\n".join(long), "z"]):
        assert fold(spark, chunks) == plain(chunks)
    many = [f"chunk {i}" for i in range(50_000)]
    start = time.time()
    assert fold(spark, many) == "\n".join(many)
    assert time.time() - start < 30


def test_null_keys_are_keys(spark):
    rows = spark.createDataFrame([(None, 1, 1), (None, 5, 2), ("a", 1, 3), ("a", 9, None)], "k string, at long, v long")
    got = {(r["k"], r["at"]): r["prev"] and r["prev"]["v"] for r in O.with_previous(rows, ["k"], ["at"], ["v"], width=3).collect()}
    assert got == {(None, 1): None, (None, 5): 1, ("a", 1): None, ("a", 9): 3}
    carried = {(r["k"], r["at"]): r["c"] for r in O.with_carried(rows, ["k"], ["at"], {"c": F.col("v")}, width=3).collect()}
    assert carried == {(None, 1): 1, (None, 5): 2, ("a", 1): 3, ("a", 9): 3}
    summed = {(r["k"], r["at"]): r["s"] for r in O.with_running_sum(rows.na.fill(0), ["k"], ["at"], {"s": F.col("v")}, width=3).collect()}
    assert summed == {(None, 1): 1, (None, 5): 3, ("a", 1): 3, ("a", 9): 3}


def test_exit_codes_and_signals_are_read_by_parsing(spark):
    cases = [
        ('{"meta":{"exit_code":7}}', None, None), ('{"exit_code":7 broken', None, None), ('{"value":{"exit_code":4}}', None, None),
        ('{"status":"fulfilled","value":{"exit_code":4}}', 4, None), ('{"exit_code":0}\n{"exit_code":3}\nexit code: 9', 9, None),
        ("Exit code: +5", 5, None), ("  process exited with code -2..", -2, None), ("exit code: 0\nexit code: -1", -1, None), ("exit code: x", None, None),
        ('{"value":{"signal":"SIGKILL"}}', None, "SIGKILL"), ("Process stopped with signal SIGHUP\nProcess stopped with signal SIGINT", None, "SIGINT"),
        ('{"a":{"signal":"SIGINT"}}', None, None), ("", None, None), (None, None, None), ('  {"exit_code": 6}\r\n', 6, None),
    ]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    got = {r["i"]: (r["code"], r["signal"]) for r in rows.select("i", T.exit_code_of("t").alias("code"), T.signal_of("t").alias("signal")).collect()}
    assert got == {i: (code, signal) for i, (_, code, signal) in enumerate(cases)}


def test_pages_beyond_the_limit_are_refused(spark):
    rows = spark.createDataFrame([(1, "a", "x")], "ts long, agent string, id string")
    for make, most in ((pages.event_page, 500), (pages.activity_page, 1_000)):
        assert make(rows, 0, most)[1].count() == 1
        for size in (0, most + 1):
            with pytest.raises(ValueError):
                make(rows, 0, size)
