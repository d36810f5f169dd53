"""Transcripts and families; ordered rules are checked against plain sequential code."""

import json
import random

from meterline.operators import ordered as O, replay as Y, tree as G
from meterline.streaming import jobs as J

LINES = "path string, line long, value string"


def test_mirrors_against_the_sequential_rule(rows):
    rng = random.Random(3)
    data, expected = [], set()
    for p in range(60):
        kept = None
        for line in range(12):
            text, kind = rng.choice("ab"), rng.choice(["message", "user_message"])
            data.append((f"p{p}", line, "t", "user", kind, text))
            if kept and kept[0] == text and (kept[1] == "message") != (kind == "message"):
                continue
            kept = (text, kind)
            expected.add((f"p{p}", line))
    told = rows("path string, line long, turn_id string, kind string, type string, text string", data)
    assert {(r.path, r.line) for r in Y.drop_mirrors(told).collect()} == expected


def test_usage_folding_against_the_sequential_rule(rows):
    rng = random.Random(5)
    data, expected = [], {}
    for p in range(80):
        badge, host = None, False
        for seq in range(14):
            item = rng.choice(["usage", "usage", "user", "patch"])
            model = rng.choice("xy")
            data.append((f"p{p}", "t", seq, item, item != "patch", model))
            if item == "user":
                badge, host = None, True
            elif item == "usage":
                if badge and badge[0] == model:
                    shown, own = badge[1], False
                elif badge is None and host:
                    badge, shown, own = (model, seq), seq, False
                else:
                    badge, host, shown, own = None, True, seq, True
                expected[(f"p{p}", seq)] = (shown, own)
    items = rows("path string, turn_id string, seq long, item string, visible boolean, model string", data)
    assert {(r.path, r.seq): (r.shown, r.own_entry) for r in Y.fold_usage(items).collect()} == expected


def test_carry_and_sums_do_not_depend_on_slices(rows):
    rng = random.Random(7)
    data = [(f"k{rng.randrange(3)}", i, rng.choice([None, "a", "b"]), rng.randrange(9)) for i in range(200)]
    df = rows("key string, at long, word string, n long", data)
    from pyspark.sql import functions as F

    def run(width):
        out = O.with_carried(df, ["key"], ["at"], {"last": F.col("word")}, width)
        out = O.with_running_sum(out, ["key"], ["at"], {"sum": F.col("n")}, width)
        out = O.with_run_id(out, ["key"], ["at"], "word", "run", width)
        return out.orderBy("at").select("key", "at", "last", "sum", "run").collect()

    assert run(10_000) == run(7)


def rec(kind, ts="2026-01-01T00:00:00Z", **payload):
    outer = "event_msg" if kind == "event" else "response_item"
    return json.dumps({"timestamp": ts, "type": outer, "payload": payload})


def transcript(rows, records):
    lines = rows(LINES, [("f", i + 1, r) for i, r in enumerate(records)])
    return Y.turn_assign(Y.records(lines))


def call(ident, name="exec_command", **arguments):
    return rec("item", type="function_call", name=name, call_id=ident, arguments=json.dumps(arguments))


def out(ident, text, **more):
    return rec("item", "2026-01-01T00:00:02Z", type="function_call_output", call_id=ident, output=text, **more)


def test_tool_outcomes(rows):
    log = [
        call("a", cmd="x"), out("a", "Process exited with code 0\nexit code: 3"),
        call("b", name="other"), out("b", "fine", stderr="npm notice"),
        call("c", cmd="x"), out("c", "fine\nProcess exited with code 0", stderr="npm notice"),
        call("d", cmd="x"), rec("event", type="item_completed", item={"type": "CommandExecution", "exit_code": 0}), out("d", "exit code: 9"),
        call("e", name="other"), out("e", "x", status="failed"),
    ]
    got = {r.call_id: (r.status, r.is_error) for r in Y.tool_calls(transcript(rows, log)).collect()}
    assert got == {"a": ("failed", True), "b": ("completed", True), "c": ("completed", False), "d": ("completed", False), "e": ("failed", True)}


def test_polls_join_their_process_over_several_cells(rows):
    log = [
        call("a", cmd="x"), out("a", "Script running with cell ID 1\nWall time 2 seconds\nOutput:\none"),
        call("b", "wait", cell_id="1"), out("b", "Script running with cell ID 2\nOutput:\ntwo"),
        call("c", "write_stdin", session_id=2, chars="\x03"), out("c", "Output:\nbye\nProcess exited with code 1"),
        call("d", "wait", cell_id="77"), out("d", "nothing"),
    ]
    got = {r.call_id: r for r in Y.tool_calls(transcript(rows, log)).collect()}
    assert set(got) == {"a", "d"}
    assert (got["a"].status, got["a"].is_error, got["a"].outputs) == ("stopped", False, 3)
    assert got["a"].output.startswith("one\ntwo\n› Sent Ctrl+C\n")


def test_turns_base_texts_and_unknown_types(rows):
    log = [
        json.dumps({"type": "session_meta", "payload": {"id": "s", "base_instructions": {"text": "be kind"}}}),
        rec("event", type="task_started", turn_id="t1"), rec("item", type="message", role="developer", content=[{"text": "be kind"}]),
        rec("event", type="error_cleared"), rec("event", "2026-01-01T00:00:05Z", type="task_complete", turn_id="t1"),
    ]
    table = transcript(rows, log)
    turn = Y.turn_bounds(table).first()
    assert (turn.turn_id, turn.duration_ms) == ("t1", 5000)
    assert Y.messages(table).count() == 0
    assert Y.turn_base_counts(Y.turn_bounds(table), Y.base_messages(table)).first().base_messages == 1
    assert Y.unknown_types(table).first().unknown_types == 1


NODE = "path string, id string, parent string, depth long, agent_path string"


def test_family_is_depth_first_and_rebased(rows):
    nodes = rows(NODE, [("f3", "c", "r", 1, "/root/b"), ("f1", "r", "gone", 0, "/root"), ("f2", "k", "c", 2, "/root/b/k"), ("f4", "a", "r", 1, "/root/a"), ("f5", "z", None, 0, "/root")])
    got = G.session_tree(nodes, "f2").collect()
    assert [(r.id, r.depth) for r in got] == [("r", 0), ("a", 1), ("c", 1), ("k", 2)]


def test_cycles_end(rows):
    nodes = rows(NODE, [("f1", "a", "b", 1, "/x"), ("f2", "b", "a", 2, "/x/y"), ("f3", "c", "b", 3, "/x/z")])
    forest = {r.id: r.root for r in G.session_forest(nodes).collect()}
    assert forest == {"a": None, "b": None, "c": None}
    assert {r.id for r in G.session_tree(nodes, "f1").collect()} == {"a", "b", "c"}


def test_stream_election_accepts_any_lateness(spark, rows, tmp_path):
    schema = "path string, agent string, id string, ts long, mtime long, output long"
    source, sink, mark = [str(tmp_path / n) for n in ("in", "sink", "mark")]
    for batch in ([("z", "a", "1", 61, 1, 40)], [("a", "a", "1", 60, 9, 30), ("b", "a", "2", 1, 1, 5)]):
        rows(schema, batch).write.mode("append").parquet(source)
        J.stream_elect(spark.readStream.schema(schema).parquet(source), sink, mark)
    assert {(r.id, r.output) for r in J.winners(spark, sink, schema).collect()} == {("1", 40), ("2", 5)}


def test_a_long_cycle_with_branches_is_a_family(rows):
    """A session that hangs on a cycle of 150: the family is all below the first session of the cycle that its climb meets."""
    links = [(f"c{i:03}", f"c{(i + 1) % 150:03}") for i in range(150)] + [("b1", "c100"), ("b2", "b1"), ("b3", "b1"), ("d", "c120"), ("far", None)]
    nodes = rows("id string, parent string, agent_path string, path string, depth long", [(i, p, f"/{i}", f"{i}.jsonl", 0) for i, p in links])
    for start, top in (("b2", "c100"), ("c007", "c007")):
        family = {r["id"]: r for r in G.session_tree(nodes, f"{start}.jsonl").collect()}
        assert set(family) == {i for i, _ in links} - {"far"}
        assert family[top]["hops"] == 0 and all(r["root"] == top for r in family.values())
        assert family[top]["parent"] == dict(links)[top]
    assert family["b1"]["hops"] == family["c100"]["hops"] + 1
