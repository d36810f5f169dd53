"""Published versions: one consistent answer while another version is written, and pages of any depth."""

import random

import pytest
from pyspark.sql import functions as F

from meterline.operators import answers, pages
from meterline.plans.inputs import USD_CNY, WINDOW, Inputs
from meterline.sinks import exports, versions

SMALL = "/root/testdata/sf0.001"


def test_an_answer_is_of_one_version(spark, tmp_path):
    t = Inputs(spark, SMALL)
    names = {"events": "usage_events", "source_files": "source_files", "activities": "activity_copies", "quota": "quota", "credits": "credits"}
    full = {n: getattr(t, v) for n, v in names.items()}
    part = {n: d.where("path LIKE 'archive/%'") for n, d in full.items()}
    status = spark.createDataFrame([("codex", "ready")], "agent string, state string")
    folder = str(tmp_path / "tables")
    exports.write_tables({**part, "status": status}, folder)

    def result(parts):
        return {n: sorted(map(repr, d.collect())) for n, d in parts.items()}

    ask = lambda tables: answers.answer(tables, WINDOW, t.rates, t.aliases, USD_CNY)
    old = result(ask(exports.read_tables(spark, folder)))
    open_ = ask(exports.read_tables(spark, folder))  # asked before, read after the next version
    exports.write_tables(full, folder)
    new = result(ask(exports.read_tables(spark, folder)))
    assert result(open_) == old and result(ask(exports.read_tables(spark, folder, 1))) == old
    assert all(new[n] != old[n] for n in ("total", "model", "tools", "board", "credits")) and new["status"] == old["status"]
    total = new["total"][0]
    assert {n for n in new} >= {"total", "model", "project", "agent", "session", "day", "month", "series", "tools", "board", "credits", "status"} and total


def test_a_version_that_is_not_published_is_not_seen(spark, tmp_path, monkeypatch):
    frame = spark.range(5).toDF("n")
    exports.write_tables({"a": frame, "b": frame}, str(tmp_path))
    with monkeypatch.context() as broken:
        broken.setattr(versions.Tables, "publish", lambda *a: (_ for _ in ()).throw(OSError))
        with pytest.raises(OSError):
            exports.write_tables({"a": spark.range(9).toDF("n")}, str(tmp_path))
    assert {n: d.count() for n, d in exports.read_tables(spark, str(tmp_path)).items()} == {"a": 5, "b": 5}
    exports.write_tables({"a": spark.range(9).toDF("n")}, str(tmp_path))
    assert {n: d.count() for n, d in exports.read_tables(spark, str(tmp_path)).items()} == {"a": 9, "b": 5}
    assert len(list((tmp_path / "a").iterdir())) == 2  # what the dead round left is gone


def test_pages_of_any_depth(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice([5, rng.randrange(50)]), rng.choice("ab"), f"i{k}") for k in range(3_000)]  # a third in one moment
    frame = spark.createDataFrame(rows, "ts long, agent string, id string")
    kept = pages.in_order(frame, str(tmp_path / "p"), rows_per_range=100)
    want = sorted(rows, key=lambda r: (-r[0], r[1], r[2]))
    assert kept.total == 3_000 and kept.index.agg(F.max("n")).first()[0] <= 100
    for offset in (0, 95, 1_234, 2_950, 3_000):
        got = [tuple(r) for r in pages.page_at(spark, kept, offset, 70).collect()]
        assert got == want[offset : offset + 70]
        assert len(pages.page_at(spark, kept, offset, 70).inputFiles()) <= 3
    assert pages.page_at(spark, pages.in_order(frame.limit(0)), 0, 10).count() == 0
