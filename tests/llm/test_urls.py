"""URL verdicts: rules by brute force, trees that learn what is there to learn and block nothing where there is nothing."""

import random
import string

import pytest

from meterline.llm import urls

PAGES = "page_id long, url string, html string, host string, label string, fold string, score string"


def plain(url):
    """host, path, rule and the rule's verdict, by the contract."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        host = "".join(c.lower() if c in string.ascii_uppercase else c for c in host)
    best = None
    for rule, verdict in urls.RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best


def page_rows():
    rng, rows = random.Random(4), []
    hosts = ["example.com", "www.example.com", "EXAMPLE.com", "a.b.net", "net", "com", "notcom", "x.org", "é.org", "example.com.org", ""]
    for k in range(400):
        rows.append((k, f"{rng.choice(['http', 'https', ''])}{rng.choice(['://', ':/', '://'])}{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/es/x', '/fr', '/fr/', '/EN/'])}{rng.choice(['', '?a=1/en/', '#/es/', '?x://y'])}"))
    return rows + [(1000, None), (1001, ""), (1002, "://"), (1003, "no scheme/en/"), (1004, "a://b://c/es/"), (None, "http://x.net/es/"), (5, "http://x.net/es/"), (5, "http://x.net/es/"), (1005, "h://" + "long" * 9_000 + ".net/fr/")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], PAGES)


def test_rules_and_odd_urls_against_brute_force(spark):
    rows = page_rows()
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = urls.report(frame(spark, rows), labels).collect()
    want = []
    for page_id, url in rows:
        host, path, best = plain(url)
        want.append((page_id, host, path, best and best[0]))
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"]) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r["verdict"] == dict(urls.RULES)[r["rule"]] for r in got if r["rule"])
    assert {r["verdict"] for r in got} <= {"allow", "block"}


def labelled(spark, signal, n=4_000):
    """URLs of undecided hosts; a quarter is bad, by their looks or by chance."""
    rng, rows = random.Random(9), []
    for k in range(n):
        bad = rng.random() < 0.25
        shown = bad if signal else rng.random() < 0.25
        host = "".join(rng.choices(string.ascii_lowercase[:6] if not shown else string.ascii_lowercase + string.digits, k=rng.randrange(6, 12) + 12 * shown))
        query = "?" + "&".join(f"p{i}={rng.randrange(10**6)}" for i in range(rng.randrange(3, 7))) if shown else ""
        rows.append((f"http://{host}.org/{'a' * rng.randrange(9)}{k}{query}", int(bad)))
    return rows


@pytest.mark.parametrize("signal", [True, False])
def test_trees_decide_only_where_labels_follow_from_urls(spark, signal):
    rows = labelled(spark, signal)
    model = urls.UrlModel.fit(spark.createDataFrame(rows, "url string, bad int"))
    fresh = labelled(spark, signal, 4_500)[4_000:]
    got = {r["url"]: r["verdict"] for r in urls.judge(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(fresh)], "page_id long, url string"), model).collect()}
    blocked = [u for u, _ in fresh if got[u] == "block"]
    if signal:
        bad = {u for u, b in fresh if b}
        assert model.auc > 0.9 and model.cutoff is not None
        assert len(bad & {*blocked}) > 0.8 * len(bad) and len({*blocked} - bad) < 0.1 * len(blocked)
    else:
        assert 0.4 < model.auc < 0.6 and model.cutoff is None and not blocked


def test_a_label_is_not_read_off_the_suffix_statistics(spark):
    """Many suffixes with labels by chance: out of fold they tell nothing."""
    rng = random.Random(2)
    rows = [(f"http://h{k}.s{rng.randrange(40)}.org/{k}", int(rng.random() < 0.3)) for k in range(3_000)]
    model = urls.UrlModel.fit(spark.createDataFrame(rows, "url string, bad int"))
    assert model.cutoff is None and 0.35 < model.auc < 0.65


def test_labels_reach_the_trees_through_the_table(spark):
    rows = labelled(spark, True, 3_000)
    pages = frame(spark, [(i, u) for i, (u, _) in enumerate(rows)] + [(9_000, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = urls.report(pages, none, spark.createDataFrame(rows, "url string, bad int")).collect()
    assert sum(r["verdict"] == "block" for r in got) > 0.15 * len(rows)
    assert not [r for r in urls.report(pages, none).collect() if r["verdict"] == "block"]


def test_no_pages(spark):
    assert urls.report(frame(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
