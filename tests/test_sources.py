"""Log layouts, files and ledgers against the golden numbers."""

import random
import json

import pytest
from pyspark.sql import functions as F

from meterline.operators import counters as C
from meterline.sources import files as X, ledger as L, normalize as N, tables as B

TS = 1_800_000_000_000
ISO = "2027-01-15T08:00:00Z"


def lines_of(rows, path, records):
    data = [(path, i + 1, r if isinstance(r, str) else json.dumps(r), True) for i, r in enumerate(records)]
    return rows("path string, line long, value string, terminated boolean", data)


def total(df):
    return df.agg(F.sum(F.col("input") + F.col("cached") + F.col("cache_write") + F.col("output"))).first()[0]


def usage(i, c, o, w=None, name="cache_write_input_tokens", r=0):
    out = {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o, "reasoning_output_tokens": r}
    return out if w is None else {**out, name: w}


def count(total_usage, last=None, ts=ISO):
    info = {"total_token_usage": total_usage}
    if last:
        info["last_token_usage"] = last
    return {"timestamp": ts, "type": "event_msg", "payload": {"type": "token_count", "info": info}}


HEAD = [{"type": "session_meta", "payload": {"id": "s1", "cwd": "C:\\w\\App"}}, {"type": "turn_context", "payload": {"model": " GPT-X "}}]


def test_cumulative_log(rows):
    log = HEAD + [
        count(usage(100, 40, 10), usage(100, 40, 10)), count(usage(100, 40, 10)),  # a repeat
        count(usage(180, 90, 30)), count(usage(20, 0, 5), usage(20, 0, 5)),  # a reset
        count(usage(50, 0, 9, 7)), count(usage(80, 0, 12, 9, "cache_creation_input_tokens"), usage(30, 0, 3, 2)),
        {"timestamp": ISO, "type": "response_item", "payload": {"type": "function_call", "name": "exec", "call_id": "c1"}},
        {"timestamp": ISO, "type": "event_msg", "payload": {"type": "function_call", "name": "exec", "call_id": "c1"}},
    ]
    got = N.norm_cumulative_log(lines_of(rows, "r/x.jsonl", log), "codex")
    events = got["events"].orderBy("line").collect()
    assert [(e.input, e.cached, e.cache_write, e.output) for e in events] == [
        (60, 40, 0, 10), (30, 50, 0, 20), (20, 0, 0, 5), (30, 0, 7, 4), (30, 0, 2, 3),
    ]
    assert {(e.session, e.project, e.model) for e in events} == {("s1", "App", "gpt-x")}
    assert [a.id for a in got["activities"].collect()] == ["s1:c1"]


def test_first_sample_without_last_usage_is_not_counted(rows):
    got = N.norm_cumulative_log(lines_of(rows, "r/x.jsonl", HEAD + [count(usage(900, 0, 9)), count(usage(950, 0, 10))]), "codex")
    assert total(got["events"]) == 51


def test_slices_do_not_change_the_differences(rows):
    samples = [("p", i, 100 * i, 10 * i, i, 7 * i, 0, 1, 1, 1, 1, 1) for i in range(1, 40)]
    schema = "path string, line long, c_input long, c_cached long, c_cache_write long, c_output long, c_reasoning long, last_input long, last_cached long, last_cache_write long, last_output long, last_reasoning long"
    df = rows(schema, samples)
    whole, cut = [C.cumulative_delta(df, ["path"], ["line"], width=w).orderBy("line").collect() for w in (1000, 3)]
    assert whole == cut and whole[5].input == 90


@pytest.mark.parametrize(
    "norm, path, record, expected",
    [
        ("norm_message_log", "c/s.jsonl", {"timestamp": ISO, "type": "assistant", "sessionId": "s", "requestId": "q", "message": {"id": "m", "model": "x", "usage": {"input_tokens": 40, "cache_read_input_tokens": 30, "cache_creation_input_tokens": 20, "output_tokens": 10}}}, 100),
        ("norm_callid_log", "w/a-WorkBuddy-P/s.jsonl", {"timestamp": TS, "id": "i", "message": {"usage": {"input_tokens": 500, "cache_read_input_tokens": 100, "output_tokens": 50}}}, 550),
        ("norm_role_log", "p/s.jsonl", {"timestamp": ISO, "type": "message", "id": "i", "message": {"role": "assistant", "model": "x", "usage": {"input": "1000", "cacheRead": 500, "cacheWrite": 10, "output": 200}}}, 1710),
        ("norm_chunk_log", "d/sess/f.zstd", {"type": "assistant/message", "seq": 1, "time": TS, "data": {"message": {"source": {"model": "x"}}, "usage": {"inputTokens": 1000, "cacheReadTokens": 400, "cacheWriteTokens": 30, "outputTokens": 50}}}, 1480),
        ("norm_turn_log", "g/%2Fw%2FApp/sess/u.jsonl", {"timestamp": TS // 1000, "params": {"update": {"sessionUpdate": "turn_completed", "prompt_id": "p", "usage": {"modelUsage": {}, "inputTokens": 2000, "cachedReadTokens": 500, "cacheCreationTokens": 80, "outputTokens": 100}}}}, 2180),
    ],
)
def test_one_event_per_layout(rows, norm, path, record, expected):
    events = getattr(N, norm)(lines_of(rows, path, [record]), "agent")["events"]
    assert events.count() == 1 and total(events) == expected and events.first().ts == TS


def test_synthetic_and_nameless_messages_are_no_requests(rows):
    base = {"timestamp": ISO, "type": "assistant", "sessionId": "s"}
    said = lambda **m: {**base, "message": {"id": "m", "model": "x", "usage": {"output_tokens": 5}, **m}}
    log = [said(model="<synthetic>"), said(model=""), said(id=""), said(usage={"output_tokens": 0}), said(id=7)]
    assert N.norm_message_log(lines_of(rows, "c/s.jsonl", log), "a")["events"].count() == 0


def test_malformed_lines(rows):
    log = ["{", json.dumps({"type": "assistant", "message": {"usage": {}}}), json.dumps({"type": "session_meta"}), '{"timestamp":']
    lines = lines_of(rows, "f", log).withColumn("terminated", F.col("line") < 4)
    assert N.malformed_count(lines).first().malformed == 2


def snapshot(ts, whole, created=0, path="live"):
    return (path, "s", ts, created, "m", "p", whole, 0, 0, 0, 0)


SNAP = "path string, session string, ts long, created_at long, model string, project string, c_input long, c_cached long, c_cache_write long, c_output long, c_reasoning long"


def booked(rows, snaps):
    return [e.input for e in C.snapshot_ledger(rows(SNAP, snaps)).orderBy("ts").collect()]


def test_snapshot_ledger(rows):
    seen = [snapshot(60000, 70), snapshot(180000, 170)]
    assert booked(rows, seen) == [70, 100]
    late = [*seen, snapshot(120000, 120), snapshot(120000, 120, path="archive")]
    assert booked(rows, late) == [70, 50, 50]
    assert sum(booked(rows, [*late, snapshot(240000, 0), snapshot(300000, 13)])) == 183


def test_snapshots_across_days(rows):
    day = 86_400_000
    snaps = [snapshot(day + 1, 100), snapshot(day + 2, 130), snapshot(2 * day + 1, 200), snapshot(2 * day + 2, 215)]
    assert booked(rows, snaps) == [30, 15]


def test_state_documents(rows):
    good = {"sessionId": "s", "createdAt": ISO, "updatedAt": ISO, "cwd": "/w/App", "total": {"input_tokens": 130, "cache_read_input_tokens": 100, "cache_creation_input_tokens": 20, "output_tokens": 10}}
    bad = {**good, "total": {"input_tokens": -1, "output_tokens": 1}}
    df = rows("path string, value string", [("a", json.dumps(good)), ("b", json.dumps(bad)), ("c", "{"), ("d", "{}")])
    row = N.norm_state_snapshot(df).first()
    assert (row.c_input + row.c_cache_write + row.c_output, row.project, row.ts) == (160, "App", TS)
    assert {r.path for r in N.malformed_states(df).collect()} == {"b", "c"}


# --- files ----------------------------------------------------------------------------------------


def test_scan_numbers_lines_and_marks_the_tail(spark, tmp_path):
    folder = tmp_path / "a b 中" / "deep"
    folder.mkdir(parents=True)
    (folder / "X.JSONL").write_bytes(b'\xef\xbb\xbf{"a":1}\r\n\n{"b":"\xff"}\n{"cut"')
    (folder / "y.jsonl").write_text('{"c":1}\n')
    (folder / "z.txt").write_text("no\n")
    got = {(r.path.split("/")[-1], r.line): (r.value, r.terminated) for r in X.scan_jsonl(spark, str(tmp_path)).collect()}
    assert got == {
        ("X.JSONL", 1): ('{"a":1}\r', True), ("X.JSONL", 3): ('{"b":"�"}', True), ("X.JSONL", 4): ('{"cut"', False),
        ("y.jsonl", 1): ('{"c":1}', True),
    }
    assert all(str(folder) in r.path for r in X.list_files(spark, str(tmp_path)).collect())


def test_scan_is_exact_over_many_splits(spark, tmp_path):
    text = "".join(f'{{"n":{i}}}\n' for i in range(1, 2001))
    (tmp_path / "big.jsonl").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = X.scan_jsonl(spark, str(tmp_path))
        assert lines.where(F.get_json_object("value", "$.n").cast("long") == F.col("line")).count() == 2000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_scan_zstd_frames(spark, tmp_path):
    zstandard = pytest.importorskip("zstandard")
    pack = lambda s: zstandard.ZstdCompressor().compress(s.encode())
    (tmp_path / "a.zst").write_bytes(pack('{"n":1}\n') + pack('{"n":2}\n'))
    (tmp_path / "b.zstd").write_bytes(pack('{"n":3}\n') + pack('{"n":4}\n' * 500)[:20])
    got = N.parsed(X.scan_jsonl_zst(spark, str(tmp_path))).selectExpr("try_variant_get(v, '$.n', 'int') AS n").collect()
    assert {r.n for r in got} >= {1, 2, 3}


def test_page_of_lines_refuses_a_changed_file(rows):
    lines = rows("path string, line long, value string", [("f", i, str(i)) for i in range(1, 10)])
    ledger = rows("path string, size long", [("f", 50)])
    assert [r.line for r in X.raw_lines_page(lines, ledger, "f", 2, 3, 50).collect()] == [3, 4, 5]
    with pytest.raises(X.FileChanged):
        X.raw_lines_page(lines, ledger, "f", 0, 3, 49)


# --- ledgers ---------------------------------------------------------------------------------------


def test_retry_curve(rows):
    schema = "path string, agent string, size long, mtime long, reason string, attempt long, retry_at long"
    before = rows(schema, [(f"f{n}", "a", 1, 1, "bad", n - 1, 0) for n in range(1, 9)] + [("g", "a", 1, 1, "bad", 7, 0)])
    now = rows("path string, agent string, size long, mtime long, reason string", [(f"f{n}", "a", 1, 1, "bad") for n in range(1, 9)] + [("g", "a", 2, 1, "bad")])
    got = {r.path: (r.attempt, r.retry_at - 1000) for r in L.next_failures(before, now, 1000).collect()}
    waits = [0, 0, 60, 120, 240, 480, 960, 1800]
    assert got == {f"f{n}": (n, 1000 * waits[n - 1]) for n in range(1, 9)} | {"g": (1, 0)}


def test_missing_root_removes_nothing(rows):
    ledger = rows("path string, agent string", [("f", "a"), ("g", "b")])
    listing = rows("path string, agent string", [])
    ok = rows("agent string, ok boolean", [("a", True), ("b", False)])
    assert [r.path for r in L.stale_files(ledger, listing, ok).collect()] == ["f"]


# --- landed tables -------------------------------------------------------------------------------------


def test_generations_prefer_inline_time_and_total_output(rows):
    gen = rows(
        "session string, idx long, path string, model string, f2 long, f3 long, f4 long, f5 long, f9 long, f10 long, done_s long, done_ns long",
        [("s", 0, "p", "M", 1000, 0, 0, 36, 40, 60, 0, 0), ("s", 1, "p", "", 5, 0, 0, 0, 0, None, 0, 0), ("s", 2, "p", "", 0, 0, 9, 0, 0, None, 7, 0)],
    )
    steps = rows("session string, idx long, sec long, nanos long", [("s", 0, TS // 1000, 5_000_000)])
    index = rows("conversation_id string, workspace_uris string", [("s", '["untitled:1","file:///D:/w/App%20X"]')])
    events, bad = B.normalize_generations(gen, steps, index, "g")
    row = events.first()
    assert events.count() == 1 and (row.ts, row.project, row.output, total(events)) == (TS + 5, "App X", 100, 1136)
    assert bad.first().malformed == 1


def test_message_tables_check_their_totals(rows):
    data = lambda **t: json.dumps({"role": "assistant", "modelID": "M", "time": {"created": TS}, "tokens": {"input": 500, "output": 100, "reasoning": 40, "cache": {"read": 50, "write": 10}, **t}})
    message = rows("id string, session_id string, time_created long, data string", [("a", "s", 1, data(total=700)), ("b", "s", 1, data(total=701)), ("c", "s", 1, data(input=-1)), ("d", "s", 1, "{")])
    session = rows("id string, directory string", [("s", "C:\\w\\App")])
    events, bad = B.normalize_message_table(message, session, "m", "db", additive_reasoning=True)
    assert total(events) == 700 and events.first().project == "App" and bad.first().malformed == 3


def test_scan_states(rows):
    schema = "agent string, path string, outcome string, malformed_lines long, error string, retry_at long"
    results = rows(schema, [("a", "1", "failed", 0, "bad", 9), ("b", "1", "failed", 0, None, 5), ("b", "2", "parsed", 0, None, None), ("c", "1", "reused", 2, None, None), ("d", "1", "parsed", 0, None, None)])
    agents = rows("agent string", [(x,) for x in "abcdef"])
    got = {r.agent: r.state for r in L.scan_status(results, agents, ["f"]).collect()}
    assert got == {"a": "error", "b": "degraded", "c": "warning", "d": "ready", "e": "missing", "f": "disabled"}
    assert [r.error for r in L.scan_errors(results).collect()] == ["bad"]


def test_golden_log_of_running_totals(rows):
    """Seven samples give six events: first sample, differences, another spelling, both spellings, a fall, a repeat."""
    write, create = "cache_write_input_tokens", "cache_creation_input_tokens"
    both = lambda i, c, a, b, o, r: {**usage(i, c, o, a, create, r), write: b}
    log = HEAD + [
        count(usage(800_000, 600_000, 50_000, 30_000, r=20_000), usage(800_000, 600_000, 50_000, 30_000, r=20_000)),
        count(usage(1_200_000, 900_000, 80_000, 40_000, r=30_000), usage(400_000, 300_000, 30_000, 10_000, r=10_000)),
        count(usage(1_400_000, 1_000_000, 100_000, 60_000, create, 35_000), usage(200_000, 100_000, 20_000, 20_000, create, 5_000)),
        count(both(1_600_000, 1_100_000, 80_000, 90_000, 130_000, 40_000), both(200_000, 100_000, 80_000, 90_000, 30_000, 5_000)),
        count(usage(300_000, 100_000, 40_000, 5_000, r=15_000), usage(300_000, 100_000, 40_000, 5_000, r=15_000)),
        count(usage(500_000, 150_000, 60_000, 8_000, r=20_000), usage(200_000, 50_000, 20_000, 3_000, r=5_000)),
        count(usage(500_000, 150_000, 60_000, 8_000, r=20_000), usage(200_000, 50_000, 20_000, 3_000, r=5_000)),
    ]
    events = N.norm_cumulative_log(lines_of(rows, "r/golden.jsonl", log), "codex")["events"].orderBy("line").collect()
    assert [e["input"] + e["cached"] + e["cache_write"] + e["output"] for e in events] == [880_000, 440_000, 240_000, 230_000, 345_000, 223_000]
    assert sum(e["cached"] for e in events) == 1_250_000


@pytest.mark.parametrize("range_bytes", [1, 60, 1 << 20])
def test_zstd_ranges_give_the_lines_of_the_whole_file(spark, tmp_path, monkeypatch, range_bytes):
    """Lines that cross frames and ranges, blank lines, odd bytes, unfinished and damaged ends."""
    zstandard = pytest.importorskip("zstandard")
    from meterline.sources import frames

    monkeypatch.setattr(frames, "RANGE_BYTES", range_bytes)
    rng = random.Random(range_bytes)

    def pack(data):
        return zstandard.ZstdCompressor(write_checksum=rng.random() < 0.5, write_content_size=rng.random() < 0.5).compress(data)

    whole = {}
    for k in range(8):
        text = "".join(rng.choice(["\n", "a", "é\n", "中", "long " * 50 + "\n", "x" * 9]) for _ in range(120)).encode() + (b"\xff\n" if k % 2 else b"end")
        cuts = sorted(rng.choices(range(len(text)), k=rng.randrange(12)))
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        data = b"".join(pack(p) + (b"\x50\x2a\x4d\x18\x03\x00\x00\x00abc" if rng.random() < 0.2 else b"") for p in parts)
        (tmp_path / f"f{k}.jsonl.zst").write_bytes(data)
        whole[f"f{k}.jsonl.zst"] = text
    (tmp_path / "cut.zst").write_bytes(pack(b"one\ntwo") + pack(b"!\nthree\n" * 99)[:-30])
    (tmp_path / "bad.zst").write_bytes(pack(b"one\ntwo\nthr") + b"not a frame at all")
    (tmp_path / "none.zst").write_bytes(b"")
    whole |= {"cut.zst": b"one\ntwo", "bad.zst": b"one\ntwo\nthr"}
    want = set()
    for name, text in whole.items():
        for i, line in enumerate(text.split(b"\n")):
            if line.strip(b" \t\r\n"):
                want.add((name, i + 1, line.decode("utf-8", "replace"), i < text.count(b"\n")))
    got = {(r["path"].rsplit("/", 1)[1], r["line"], r["value"], r["terminated"]) for r in X.scan_jsonl_zst(spark, str(tmp_path)).collect()}
    assert got == want


def test_one_zstd_file_is_many_tasks(spark, tmp_path, monkeypatch):
    zstandard = pytest.importorskip("zstandard")
    from meterline.sources import frames

    monkeypatch.setattr(frames, "RANGE_BYTES", 400)
    pack = zstandard.ZstdCompressor().compress
    (tmp_path / "one.zst").write_bytes(b"".join(pack(f'{{"n":{i}}}\n'.encode()) for i in range(400)) + pack(b"{broken\n"))
    with (tmp_path / "one.zst").open("rb") as file:
        import pyarrow as pa

        assert len(list(frames.frames(pa.PythonFile(file)))) == 401
    lines = X.scan_jsonl_zst(spark, str(tmp_path))
    assert lines.count() == 401 and [r["malformed"] for r in N.malformed_count(lines).collect()] == [1]


def test_zst_files_of_partitions_without_rows(spark, rows):
    from types import SimpleNamespace

    from meterline.plans import logs

    raw = rows("id string, session string, ts long", [("e1", "s", 5)]).repartition(4, "id")
    got = logs.scan_jsonl_zst(SimpleNamespace(spark=spark, usage_raw=raw)).collect()
    assert [tuple(r) for r in got] == [("e1", "s", 5)]


def test_filters_on_fields_dont_parse_again(rows):
    lines = lines_of(rows, "a", [{"timestamp": TS, "type": "x"}, {"type": "y"}])
    timed = N.parsed(lines).withColumn("ts", N.record_ts()).where("ts IS NOT NULL")
    plan = timed._jdf.queryExecution().optimizedPlan().toString().lower()
    assert timed.count() == 1 and max(plan.count("parse_json("), plan.count("parsejson(")) <= 1, plan
