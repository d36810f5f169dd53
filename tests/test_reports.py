"""Golden numbers of pricing, ranges, groups and calendar."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from meterline.functions import scalars as S
from meterline.operators import elect as E, prices as P, query as Q, quotas as K, summaries as R
from meterline.operators.query import Query, QueryError

EVENT = (
    "id string, agent string, session string, project string, model string, ts long, input long, "
    "cached long, cache_write long, output long, reasoning long, path string"
)
RATE = "model string, effective_from_ms long, currency string, input double, cached double, cache_write double, output double"


def event(ident, ts, model="m", tokens=(10, 0, 0, 0, 0), agent="a", session="s", project="p", path="f"):
    return (ident, agent, session, project, model, ts, *tokens, path)


def priced(rows, events, rates=(), aliases=(), fx=None):
    return P.price(
        rows(EVENT, list(events)), rows(RATE, list(rates)), rows("alias string, model string", list(aliases)), fx
    )


def test_historical_price_and_components(rows):
    million = (1_000_000,) * 4 + (0,)
    rates = [("m", None, "USD", 1.0, 0.1, 2.0, 3.0), ("m", 1000, "USD", 2.0, 0.2, 4.0, 6.0)]
    df = priced(rows, [event("a", 999, tokens=million), event("b", 1000, tokens=million)], rates)
    costs = {r.id: round(r.cost, 9) for r in df.collect()}
    assert costs == {"a": 6.1, "b": 12.2}
    total = R.totals(df).first()
    assert total.cost == 18.3
    parts = [total[f"known_cost_{p}"] for p in ("input", "cached", "cache_write", "output")]
    assert parts == [3.0, 0.3, 6.0, 9.0]


def test_alias_case_and_padding(rows):
    used = (301_200, 1_240_000, 60_000, 140_000, 0)
    rates = [("target", None, "USD", 1.0, 1.0, 1.0, 1.0)]
    df = priced(rows, [event("a", 5, " Nick ", used)], rates, [("nick", "target")])
    assert round(df.first().cost, 9) == 1.7412


def test_unknown_price_is_not_zero(rows):
    rates = [("m", None, "USD", 1.0, 1.0, 1.0, 1.0), ("c", None, "CNY", 1.0, 1.0, 1.0, 1.0)]
    events = [event("a", 5), event("b", 6, "none"), event("c", 7, "c")]
    total = R.totals(priced(rows, events, rates)).first()
    assert total.cost is None and total.unpriced_events == 2 and total.unpriced_tokens == 20
    assert total.known_cost == pytest.approx(1e-5)
    assert R.totals(priced(rows, [], rates)).first().cost == 0.0


def test_half_open_range_and_series(rows):
    df = priced(rows, [event("a", 60000), event("b", 119999), event("c", 120000)])
    window = Query(60000, 120000)
    assert R.totals(df.where(Q.predicate(window))).first().total_tokens == 20
    wide = Query(60000, 300000)
    points = R.series(df.where(Q.predicate(wide)), wide).orderBy("bucket").collect()
    assert [(p.bucket, p.total_tokens) for p in points] == [(60000, 20), (120000, 10), (180000, 0), (240000, 0)]
    assert points[-1].cost == 0.0 and points[0].cost is None


@pytest.mark.parametrize(
    "zone, day, hours",
    [("America/New_York", "2026-03-08", 23), ("America/New_York", "2026-11-01", 25), ("Asia/Shanghai", "2026-03-08", 24)],
)
def test_day_lengths(spark, zone, day, hours):
    start, end = S.day_bounds("d", zone)
    row = spark.createDataFrame([(day,)], "d string").select(start.alias("a"), end.alias("b")).first()
    assert row.b - row.a == hours * 3_600_000


def test_every_grouping_sums_to_the_same(rows):
    rates = [("m", None, "USD", 1.0, 1.0, 1.0, 1.0)]
    events = [event(f"e{i}", 1000 * i, "m" if i % 3 else "x", (i, i, i, i, 0), f"a{i % 2}", f"s{i % 4}", f"P{i % 3}") for i in range(40)]
    files = rows("path string, agent string, title string, mtime long", [("f", "a0", "T", 1)])
    q = Query(0, 86_400_000)
    out = R.dashboard_all(priced(rows, events, rates), files, q).groupBy("dimension").agg(F.sum("total_tokens").alias("n")).collect()
    assert {r.n for r in out} == {4 * sum(range(40))} and len(out) == 8
    tables = R.dashboard(R.dashboard_all(priced(rows, events, rates), files, q), q)
    assert tables["series"].count() == 1440
    assert {r.label for r in tables["session"].where("agent IS NULL OR key LIKE 'a0:%'".replace("agent IS NULL OR ", "")).collect()} == {"T"}


def test_project_keys_fold_windows_spellings_only(rows):
    names = ["C:\\Work\\App", "c:/work/app/", "C:/WORK/APP", "/home/x/App", "/home/x/app", "\\\\srv\\Share\\", "C:\\"]
    got = [r.k for r in rows("p string", [(n,) for n in names]).select(S.project_key("p").alias("k")).collect()]
    assert got == ["c:/work/app"] * 3 + ["/home/x/App", "/home/x/app", "//srv/share", "c:"]


def test_saturating_totals(rows):
    top = S.MAX_LONG
    df = priced(rows, [event("a", 1, tokens=(top, 10, 0, 0, 0)), event("b", 2, tokens=(top, top, 0, 5, 0))])
    total = R.totals(df).first()
    assert (total.input, total.total_tokens, total.cached) == (top, top, top)


def test_the_caller_may_set_the_bucket_width(rows):
    df = priced(rows, [event("a", 1), event("b", 6_500)])
    q = Query(0, 10_000, bucket_ms=5_000)
    points = R.series(df, q).orderBy("bucket").collect()
    assert [(p.bucket, p.events) for p in points] == [(0, 1), (5_000, 1)]
    with pytest.raises(Exception, match="bad bucket"):
        Query(0, 1, bucket_ms=0).validate()


def test_query_is_checked_in_order():
    for bad in (dict(start=60000, end=60000), dict(start=-1, end=5), dict(start=0, end=32_503_680_000_001)):
        with pytest.raises(QueryError, match="range"):
            Query(**bad, time_zone="Mars/Olympus_Mons").validate()
    with pytest.raises(QueryError, match="offset"):
        Query(0, 5, offset_minutes=1441).validate()
    for zone in ("Mars/Olympus_Mons", "UTC+9", ""):
        with pytest.raises(QueryError, match="zone"):
            Query(0, 5, time_zone=zone).validate()
    assert Query(0, 5, offset_minutes=1440, time_zone="Asia/Shanghai").validate()


def test_election_prefers_time_then_mtime_then_path(rows):
    raw = rows("path string, agent string, id string, ts long, output long", [("z-live", "c", "r", 61000, 40), ("a-archive", "c", "r", 60000, 30)])
    files = lambda a, z: rows("path string, agent string, mtime long", [("a-archive", "c", a), ("z-live", "c", z)])
    assert E.elect(raw, files(9, 1)).first().output == 40
    tie = raw.withColumn("ts", F.lit(61000).cast("long"))
    assert E.elect(tie, files(9, 1)).first().output == 30
    assert E.elect(tie, files(1, 1)).first().path == "a-archive"
    gone = E.forget_files({"events": tie}, rows("path string, agent string", [("a-archive", "c")]))["events"]
    assert E.elect(gone, files(9, 1)).first().output == 40


def test_election_cuts_copies_before_the_shuffle(rows):
    raw = rows("path string, agent string, id string, ts long", [("p", "c", "r", 1)])
    plan = E.first_by(raw, ["agent", "id"], [F.col("ts").desc()])._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan


def test_credits_deduplicate_before_the_range(rows):
    schema = "path string, agent string, request_id string, session string, project string, model string, ts long, requests long, credits double, original_credits double, billable_requests long, context_usage_ratio double"
    data = [
        (path, "qoder", f"r{i}", "s", "p", f"m{i % 2}", 1000 * i + late, 1, 0.25, None, 1, 0.5)
        for i in range(150) for path, late in (("a", 0), ("b", 0), ("c", 500_000))
    ]
    credits = rows(schema, data)
    every = K.credit_requests(credits, Query(0, 10_000_000))
    assert every.count() == 150
    row = K.credit_by_session(every).first()
    assert (row.credits, row.original_credits, row.requests) == (37.5, None, 150)
    assert row.model_credits == {"m0": 18.75, "m1": 18.75}
    assert K.credit_windows(every).first().original_credits is None
    assert K.credit_requests(credits, Query(1000, 4000)).count() == 3


def _price_doc(**change):
    import json

    doc = {"version": 1, "currency": "USD", "aliases": {}, "models": {"m": [{"input": 1, "cached": 1, "cacheWrite": 1, "output": 1}]}}
    return json.dumps({**doc, **change})


@pytest.mark.parametrize(
    "change, reason",
    [
        ({"version": 2}, "version"), ({"currency": "EUR"}, "currency must"), ({"usdCny": 0}, "positive"),
        ({"currency": "CNY"}, "rate is missing"), ({"displayCurrency": "cny"}, "rate is missing"),
        ({"models": {"m": []}}, "no rates"), ({"aliases": {"x": "nowhere"}}, "priced model"),
        ({"models": {"m": [{"input": -1, "cached": 1, "cacheWrite": 1, "output": 1}]}}, "not negative"),
        ({"models": {"M": [{"input": 1, "cached": 1, "cacheWrite": 1, "output": 1}], "m ": [{"input": 1, "cached": 1, "cacheWrite": 1, "output": 1}]}}, "twice"),
        ({"models": {"m": [{"input": 1, "cached": 1, "cacheWrite": 1, "output": 1, "effectiveFrom": "2024-01-01T00:00:00"}]}}, "zone"),
        ({"models": {"m": [{"input": 1, "cached": 1, "cacheWrite": 1, "output": 1}, {"input": 2, "cached": 1, "cacheWrite": 1, "output": 1}]}}, "time appears twice"),
        ({"models": {n: [{"input": 1, "cached": 1, "cacheWrite": 1, "output": 1}] for n in "ab"}, "aliases": {"A": "b"}}, "hides"),
    ],
)
def test_price_list_is_checked(spark, tmp_path, change, reason):
    (tmp_path / "prices.json").write_text(_price_doc(**change))
    with pytest.raises(P.PriceListError, match=reason):
        P.load_prices(spark, str(tmp_path / "prices.json"))


def test_price_list_loads(spark, tmp_path):
    (tmp_path / "prices.json").write_text(_price_doc(usdCny=7, aliases={"Nick ": "M", "m": "m"}))
    rates, aliases, fx = P.load_prices(spark, str(tmp_path / "prices.json"))
    assert fx == 7 and rates.count() == 1
    assert {(r.alias, r.model) for r in aliases.collect()} == {("nick", "m"), ("m", "m")}


def test_unknown_values_sort_last_both_ways(rows):
    df = rows("key string, cost double", [("a", 1.0), ("b", None), ("c", 2.0)])
    order = lambda desc: [r.key for r in R.sort_summaries(df, "cost", desc).collect()]
    assert order(True) == ["c", "a", "b"] and order(False) == ["a", "c", "b"]


def test_pages_are_newest_first_and_exports_oldest_first(rows):
    from meterline.operators import pages

    df = rows(EVENT, [event(f"e{i:02}", 100 * (i // 2), agent=f"a{i % 2}") for i in range(20)])
    count, slice_ = pages.event_page(df, 4, 3)
    first = [(r.ts, r.agent) for r in slice_.collect()]
    assert count.first().total == 20 and first == [(700, "a0"), (700, "a1"), (600, "a0")]
    after = [r.id for r in pages.page_after(df, (800, "a1", "e17"), 3).collect()]
    assert after == [r.id for r in slice_.collect()]
    assert [r.id for r in pages.export_rows(df).collect()] == [f"e{i:02}" for i in range(20)]


def test_rollup_per_file_and_day_nests_by_model_and_project(rows):
    rates = [("m", None, "USD", 1.0, 1.0, 1.0, 1.0)]
    day = 86_400_000
    df = priced(rows, [event("a", 1), event("b", day - 1, "x", (1, 2, 3, 4, 5)), event("c", day)], rates)
    nested = {r.usage.total_tokens: r for r in R.nest_rollup(R.session_daily_rollup(df)).collect()}
    first = nested[20]
    assert first.usage.input == 16 and first.usage.unpriced_events == 1
    assert {k: v.total_tokens for k, v in first.models.items()} == {"m": 10, "x": 10}
    assert first.projects["p"].reasoning == 5 and nested[10].day == "1970-01-02"


def test_export_text_is_guarded_and_says_unpriced(spark, rows, tmp_path):
    from meterline.sinks import exports as W

    rates = [("m", None, "USD", 1.0, 1.0, 1.0, 1.0)]
    events = [event("a", 1500, session="=1+1", project='x"y', path="\\\\?\\Q:\\f"), event("b", 1000, "none")]
    df = priced(rows, events, rates).withColumn("line", F.lit(3))
    W.export_csv(df, str(tmp_path / "out"), "CNY", 7.0)
    text = [t for p in sorted((tmp_path / "out").glob("part-*")) for t in p.read_text().splitlines()]
    body = [t for t in text if not t.startswith('"Time')]
    assert body[0].startswith('"1970-01-01T00:00:01+00:00","a","s","p","none"') and '"unpriced"' in body[0]
    assert '"1970-01-01T00:00:01.500+00:00"' in body[1] and '"\'=1+1"' in body[1] and '"x""y"' in body[1]
    assert '"0.00007000"' in body[1] and '"Q:\\f"' in body[1]


@pytest.mark.parametrize("zone, day, start, hours", [
    ("America/Toronto", "1919-03-31", "1919-03-31T04:30:00", 23.5),  # from 23:30 to 00:30: midnight is left out
    ("America/Toronto", "1919-03-30", "1919-03-30T05:00:00", 23.5),
    ("Africa/Cairo", "2024-04-26", "2024-04-25T22:00:00", 23),  # midnight itself is left out
    ("Pacific/Apia", "2011-12-30", "2011-12-30T10:00:00", 0),  # the whole date is left out
    ("Pacific/Apia", "2011-12-31", "2011-12-30T10:00:00", 24),
    ("America/Havana", "2024-11-03", "2024-11-03T04:00:00", 25),  # midnight comes twice
    ("Asia/Shanghai", "2024-01-05", "2024-01-04T16:00:00", 24),
])
def test_days_start_at_the_first_instant_they_have(spark, zone, day, start, hours):
    row = spark.createDataFrame([(day,)], "day string").select(*(b.alias(n) for b, n in zip(S.day_bounds("day", zone), "ab"))).first()
    at = datetime.fromisoformat(start).replace(tzinfo=timezone.utc).timestamp() * 1000
    assert row["a"] == at and row["b"] - row["a"] == hours * 3_600_000


def test_labels_sort_as_people_read_them(spark):
    labels = ["m10", "m2", "M2", "模型10", "模型2", "m002", "b", "a", "B", "", None, "m2"]
    frame = spark.createDataFrame([(f"k{i:02}", x) for i, x in enumerate(labels)], "key string, label string")
    up, down = ([(r["label"], r["key"]) for r in R.sort_summaries(frame, "label", d).collect()] for d in (False, True))
    assert [x for x, _ in up] == ["", "模型2", "模型10", "a", "b", "B", "m2", "m002", "m2", "M2", "m10", None]
    assert [k for x, k in up if x and x in ("m2", "m002")] == ["k01", "k05", "k11"]  # ties by key
    assert [x for x, _ in down][0] == "m10" and down[-1][0] is None
