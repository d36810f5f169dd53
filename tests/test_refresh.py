"""Refresh rounds: buckets that split, rounds that die at any point, files that can't be read, and what a round reads."""

import random
from collections import defaultdict

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from meterline.sinks import versions as V
from meterline.sources import files
from meterline.streaming import refresh as RF


def reader(spark, bad=()):
    def read(paths):
        if any(b in p for p in paths for b in bad):
            raise AnalysisException("unreadable")
        part = F.split("value", ",")
        return files.scan_jsonl(spark, paths, "*").select("path", F.lit("log").alias("agent"), part[0].alias("id"), part[1].cast("long").alias("ts"), part[2].alias("pad"))

    return read


def write(source, rows):
    for name, lines in rows.items():
        (source / name).write_text("".join(f"{i},{ts},{pad}\n" for i, ts, pad in lines))


def state(spark, sink):
    tables = V.Tables(spark, sink)
    at = tables.version()
    out = {n: sorted(map(repr, tables.read(at, n).collect())) for n in at.tables}
    out["ledger"] = sorted((r["path"], r["size"], r["reason"]) for r in tables.read(at, "ledger").collect())
    return out


def expected(source, rows):
    """Events and winners by plain Python."""
    events = [(i, ts, f"{source}/{n}") for n, lines in rows.items() for i, ts, _ in lines]
    best = {}
    for i, ts, path in sorted(events, key=lambda e: (-e[1], e[2])):
        best.setdefault(i, (i, ts, path))
    return sorted(events), sorted(best.values())


def found(spark, sink):
    row = lambda r: (r["id"], r["ts"], r["path"])
    return tuple(sorted(map(row, RF.current_rows(spark, sink, n).collect())) for n in ("events", "winners"))


def many(rng, files_=6, rows=40):
    return {f"f{k}.txt": [(f"e{i}", rng.randrange(30), rng.randbytes(8).hex()) for i in rng.sample(range(60), rows)] for k in range(files_)}


def test_bucket_numbers_split_one_by_one(spark):
    rows = spark.range(2_000).select(F.xxhash64("id").alias("h")).select(*(V.bucket_of(F.col("h"), n).alias(f"b{n}") for n in range(1, 20))).collect()
    for n in range(1, 19):
        for r in rows:
            now, after = r[f"b{n}"], r[f"b{n + 1}"]
            assert now < n and (after == now or (after == n and now == V.parent(n, n)))


def test_rounds_with_buckets_that_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "BUCKET_BYTES", 2_500)
    source, sink, rng = tmp_path / "in", str(tmp_path / "sink"), random.Random(2)
    source.mkdir()
    rows = many(rng, 3)
    for turn in range(5):
        write(source, rows)
        RF.refresh(spark, str(source), "*.txt", reader(spark), sink, "log")
        assert found(spark, sink) == expected(source, rows)
        rows[f"g{turn}.txt"] = many(rng, 1)["f0.txt"]  # a new file, a grown one, a changed one, a vanished one
        rows["f0.txt"] = rows["f0.txt"] + [("e1", 99 + turn, "x")]
        rows[f"f{1 + turn % 2}.txt"] = [("e2", 3, "y"), ("e3", 500 - turn, "yy" * turn)]
        if turn == 3:
            (source / "g1.txt").unlink()
            del rows["g1.txt"]
    at = V.Tables(spark, sink).version()
    assert at.tables["events"].buckets > 3 and at.tables["winners"].buckets > 1
    assert len(V.Tables(spark, sink).numbers()) <= V.KEPT + 1


def test_a_round_reads_and_writes_only_its_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "BUCKET_BYTES", 3_000)
    source, sink, rng = tmp_path / "in", str(tmp_path / "sink"), random.Random(4)
    source.mkdir()
    rows = {f"f{k:02}.txt": [(f"{k}-{i}", i, rng.randbytes(10).hex()) for i in range(60)] for k in range(24)}
    rows["f00.txt"].append(("7-3", 0, "an older copy"))
    write(source, rows)
    RF.refresh(spark, str(source), "*.txt", reader(spark), sink, "log")
    reads, writes = defaultdict(set), defaultdict(set)
    read, written = V.Tables.read, V.Tables.write
    monkeypatch.setattr(V.Tables, "read", lambda self, at, name, buckets=None: reads[name].update(at.tables[name].folders if buckets is None else buckets) or read(self, at, name, buckets))

    def watch(self, name, df, keys, base=None, replaced=(), buckets=1):
        table = written(self, name, df, keys, base, replaced, buckets)
        writes[name] |= {b for b, f in table.folders.items() if not base or base.folders.get(b) != f}
        return table

    monkeypatch.setattr(V.Tables, "write", watch)
    monkeypatch.setattr(V, "BUCKET_BYTES", 1 << 30)  # none splits from here on
    total = V.Tables(spark, sink).version().tables["events"].buckets
    assert total >= 8
    rows["f07.txt"] = [(i, ts, "changed") for i, ts, _ in rows["f07.txt"] if i != "7-3"]  # the winner of 7-3 is lost
    write(source, {"f07.txt": rows["f07.txt"]})
    assert RF.refresh(spark, str(source), "*.txt", reader(spark), sink, "log") == {"read": 1, "failed": 0, "vanished": 0}
    assert found(spark, sink) == expected(source, rows)
    assert len(reads["events"]) <= total and len(writes["events"]) == 1


class Died(Exception):
    pass


@pytest.mark.parametrize("point", range(5))
def test_a_round_that_dies_is_done_by_the_next(spark, tmp_path, monkeypatch, point):
    """Kills the second round at its nth write, or at the publication, and runs it again."""
    source, rng = tmp_path / "in", random.Random(7)
    source.mkdir()
    first = many(rng, 4)
    second = {**{k: v for k, v in first.items() if k != "f3.txt"}, "f0.txt": first["f0.txt"][:5] + [("e9", 77, "z")], "f9.txt": [("e1", 1, "n")]}
    sink = str(tmp_path / "sink")
    go = lambda: RF.refresh(spark, str(source), "*.txt", reader(spark), sink, "log")
    write(source, first)
    go()
    before = state(spark, sink)
    write(source, {k: second[k] for k in ("f0.txt", "f9.txt")})
    (source / "f3.txt").unlink()
    with monkeypatch.context() as broken:
        done = []
        name = "publish" if point == 4 else "write"
        real = getattr(V.Tables, name)

        def dies(self, *args, **kwargs):
            if len(done) == point % 4:
                if name == "write":
                    real(self, *args, **kwargs)  # its files are there, half a round is not
                raise Died
            done.append(1)
            return real(self, *args, **kwargs)

        broken.setattr(V.Tables, name, dies)
        with pytest.raises(Died):
            go()
    assert state(spark, sink) == before
    assert go() == {"read": 2, "failed": 0, "vanished": 1}
    assert found(spark, sink) == expected(source, second)
    other = str(tmp_path / "fresh")
    RF.refresh(spark, str(source), "*.txt", reader(spark), other, "log")
    assert state(spark, sink) == state(spark, other)


def test_an_unreadable_file_waits_and_holds_up_no_other(spark, tmp_path):
    source, sink = tmp_path / "in", str(tmp_path / "sink")
    source.mkdir()
    rows = {"a.txt": [("e1", 1, "")], "bad.txt": [("e1", 5, "")], "c.txt": [("e2", 2, "")]}
    write(source, rows)
    go = lambda now, bad=("bad",): RF.refresh(spark, str(source), "*.txt", reader(spark, bad), sink, "log", now_ms=now)
    good = {k: v for k, v in rows.items() if k != "bad.txt"}
    assert go(1_000) == {"read": 2, "failed": 1, "vanished": 0}
    assert found(spark, sink) == expected(source, good)
    wait = lambda: [(r["attempt"], r["retry_at"]) for r in RF.known_files(spark, sink).where("reason IS NOT NULL").collect()]
    assert wait() == [(1, 1_000)]
    assert go(1_000) == go(1_001) == {"read": 0, "failed": 1, "vanished": 0}
    assert wait() == [(3, 61_001)]
    assert go(61_000) == {"read": 0, "failed": 0, "vanished": 0}  # not before its time
    write(source, {"bad.txt": [("e1", 6, "other")]})  # a changed file starts over
    assert go(61_000) == {"read": 0, "failed": 1, "vanished": 0} and wait() == [(1, 61_000)]
    assert go(61_000, ()) == {"read": 1, "failed": 0, "vanished": 0} and wait() == []
    assert found(spark, sink) == expected(source, {**rows, "bad.txt": [("e1", 6, "other")]})


def test_a_reader_keeps_its_version(spark, tmp_path):
    source, sink = tmp_path / "in", str(tmp_path / "sink")
    source.mkdir()
    write(source, {"a.txt": [("e1", 1, "old")]})
    go = lambda: RF.refresh(spark, str(source), "*.txt", reader(spark), sink, "log")
    go()
    tables = V.Tables(spark, sink)
    at = tables.version()
    open_ = {n: tables.read(at, n) for n in at.tables}
    write(source, {"a.txt": [("e1", 2, "newer"), ("e2", 2, "newer")]})
    go()
    assert [r["ts"] for r in open_["winners"].collect()] == [1] == [r["ts"] for r in open_["events"].collect()]
    assert sorted(r["ts"] for r in RF.current_rows(spark, sink, "winners").collect()) == [2, 2]
