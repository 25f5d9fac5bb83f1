"""URL filters: host, path and rule against SQL on the whole table, and odd rows."""

import duckdb
from pyspark.sql import functions as F

from tessera.llm import urlfilter

SQL = """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM '{sf}/pages.parquet'),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM u),
r(h, p, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
SELECT page_id, host, path, max_by(h || r.p, length(h || r.p)) AS rule, max_by(r.verdict, length(h || r.p)) AS verdict
FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p) GROUP BY ALL
"""


def test_host_path_and_rule_equal_sql(spark):
    sf = "/root/testdata/sf0.01"
    want = {r[0]: r[1:] for r in duckdb.sql(SQL.format(sf=sf)).fetchall()}
    got = urlfilter.op1_url_filter(spark, sf).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in got} == {k: v[:3] for k, v in want.items()}
    assert all(r["verdict"] == want[r["page_id"]][3] for r in got if r["rule"])
    assert all(r["verdict"] == ("block" if r["score"] >= 0.5 else "allow") for r in got if not r["rule"])


def test_odd_rows(spark):
    long = "http://a.net/" + "x" * 100_000
    d = spark.createDataFrame([(1, None), (2, ""), (3, long), (3, long), (None, "http://fr.com/fr/é")], "page_id long, url string").withColumn("rule", F.lit(5))
    m = urlfilter.fit(urlfilter.labelled(d))
    rows = urlfilter.judge(d, m).collect()
    assert len(rows) == 5 and {r["verdict"] for r in rows} == {"allow"} and sum(r["rule"] == "com/fr/" for r in rows) == 1
    assert urlfilter.judge(d.limit(0), m).count() == 0 and urlfilter.labelled(d.limit(0)) == []
