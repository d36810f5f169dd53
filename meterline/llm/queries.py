"""Queries of the text operators over the test tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_session
from . import alignment, decontaminate, html_text, kd_shards, mixing, pii, quality, repeats, simhash, spelling, token_files, urls, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[Callable[[str], DataFrame]], DataFrame]):
    """Registers ``fn(table) -> DataFrame`` under its name; ``table(name)`` reads one of the tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_session(spark)
        return fn(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

    QUERIES[fn.__name__] = run
    return fn


@query
def op1_url_trees(table):
    return urls.report(table("pages"), table("labels"))


@query
def op2_repeats(table):
    return repeats.report(table("documents"))


@query
def op3_decontaminate(table):
    return decontaminate.report(table("documents"), table("benchmark"))


@query
def op4_html_text(table):
    return html_text.report(table("pages"))


@query
def op5_token_files(table):
    return token_files.report(table("documents"))


@query
def op6_kd_shards(table):
    return kd_shards.report(table("documents"))


@query
def op7_quality(table):
    return quality.report(table("documents"), table("labels"))


@query
def op8_pii(table):
    return pii.report(table("documents"))


@query
def op9_mixing(table):
    return mixing.report(table("documents"))


@query
def op10_simhash(table):
    return simhash.report(table("documents"))


@query
def op11_spelling(table):
    return spelling.report(table("documents"))


@query
def op12_alignment(table):
    return alignment.report(table("documents"))


@query
def op13_warc(table):
    return warc.report(table("pages"))


ORACLES["op3_decontaminate"] = r"""
WITH d AS (
 SELECT doc_id, rowid AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM (SELECT *, row_number() OVER () AS rowid FROM documents) s),
b AS (
 SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
 SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
 FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0) s),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
 SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
 FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k) s),
h AS (SELECT dw.r, dw.i, dw.k, bw.item_id FROM dw JOIN bw USING (k, g)),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM h) s GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM h) s GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
 sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.r = d.r LEFT JOIN items ON items.r = d.r
"""

ORACLES["op2_repeats"] = r"""
WITH d AS (
 SELECT doc_id, r, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
 FROM (SELECT *, row_number() OVER () AS r FROM documents) s),
g AS (
 SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13) s),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (
 SELECT r, list(DISTINCT p) AS ps FROM (SELECT r, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (g) WHERE f.first < g.doc_id) s GROUP BY r),
kept AS (
 SELECT d.r, d.doc_id, len(d.w) AS n, len(coalesce(gone.ps, [])) AS m,
  list_filter(d.w, lambda x, i: NOT list_contains(coalesce(gone.ps, []), i)) AS k FROM d LEFT JOIN gone ON gone.r = d.r)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(m AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v{g} >> {5 * (3 - k)}) & 31 AS BIGINT) + 1, 1)" for g in range(8) for k in range(4)
)
_HEXADECIMAL = ", ".join(f"CAST('0x' || substr(x, {5 * g + 1}, 5) AS BIGINT) AS v{g}" for g in range(8))
ORACLES["op13_warc"] = f"""
WITH p AS (SELECT page_id, row_number() OVER () AS r, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, r, t, sha1(t) AS x FROM p),
v AS (SELECT *, {_HEXADECIMAL} FROM h),
f AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY page_id NULLS LAST, r) AS k, first_value(page_id) OVER (PARTITION BY t ORDER BY page_id NULLS LAST, r) AS a FROM v)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
 CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN a END AS refers_to FROM f
"""

ORACLES["op11_spelling"] = r"""
WITH RECURSIVE t AS (
 SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
r AS (
 SELECT coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' AS d, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
 FROM documents),
g AS (SELECT d, w, count(*) AS n FROM r WHERE length(w) >= 6 GROUP BY d, w),
h AS (
 SELECT w, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(d || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)]
  ELSE [CAST(192 + (unicode(c) >> 6) AS BIGINT), CAST(128 + (unicode(c) & 63) AS BIGINT)] END))), lambda c, b: xor(c >> 8, t.t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM g, t),
v AS (
 SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT CASE WHEN h % 199 = 0 THEN left(w, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, n FROM h) s
 GROUP BY word HAVING length(word) >= 6 AND sum(n) >= 5),
x AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v) s),
e AS (
 SELECT a.word AS word, b.word AS near, b.n AS m FROM x a JOIN x b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
 UNION SELECT x.word, v.word, v.n FROM x JOIN v ON v.word = x.less
 UNION SELECT v.word, x.word, x.n FROM x JOIN v ON v.word = x.less),
b AS (SELECT word, count(*) AS c, max(m) AS m FROM e GROUP BY word),
f AS (
 SELECT v.word, v.n, coalesce(b.c, 0) AS n_near, CASE WHEN b.m >= 5 * v.n THEN b.m END AS form_n,
  CASE WHEN b.m >= 5 * v.n THEN (SELECT min(e.near) FROM e WHERE e.word = v.word AND e.m = b.m) END AS form
 FROM v LEFT JOIN b USING (word)),
p AS (SELECT word, word AS root FROM f UNION ALL SELECT p.word, f.form FROM p JOIN f ON f.word = p.root WHERE f.form IS NOT NULL),
q AS (SELECT p.word, p.root FROM p JOIN f ON f.word = p.root WHERE f.form IS NULL)
SELECT f.word, f.form, q.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM f JOIN q USING (word)
"""
