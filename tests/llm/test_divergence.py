"""The audit against a plain count of everything, on texts with nulls, ties, long runs and words of other scripts."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least):
    """(lang, source, part, item, value, rank) by the definition, every term with every source."""
    n, docs = Counter(), Counter()
    groups = {(lang or "", source or "") for _, lang, source in rows}
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        for t in terms:
            n[lang or "", source or "", t] += 1
        for t in set(terms):
            docs[lang or "", t] += 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), d in docs.items() if x == lang and d >= least)
        sources = sorted(s for x, s in groups if x == lang)

        def p(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        ps = {s: p({t: n[lang, s, t] for t in kept}) for s in sources}
        q = p({t: sum(n[lang, s, t] for s in sources) for t in kept})
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(ps[s][t], ps[o][t]) for t in kept), o) for o in sources if o != s)
            terms = sorted((-f(ps[s][t], q[t]), t.encode()) for t in kept if n[lang, s, t] and ps[s][t] > q[t])[:10]
            out += [(lang, s, "pair", o, -v, i) for i, (v, o) in enumerate(pairs, 1)]
            out += [(lang, s, "term", t.decode(), -v, i) for i, (v, t) in enumerate(terms, 1)]
    return sorted(out)


def audit(spark, rows, least):
    d = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"n": F.lit("clash"), "term": F.lit(1), "value": F.lit(None).cast("int")})
    from pyspark.sql import Window

    a = divergence.Audit(d, least_docs=least)
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "other")
    pairs = a.pairs().select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value", F.row_number().over(w).alias("rank"))
    terms = a.ranked_terms().select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return sorted(tuple(r) for r in pairs.unionByName(terms).collect())


def test_audit_against_brute_force(spark):
    import random

    r = random.Random(4)
    words = ["Alpha", "beta", "ÉTÉ", "été", "straße", "日本", "a", "B", "x1y", "don't", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = [(" ".join(r.choices(words, k=r.randint(0, 40))), r.choice(["en", "de", None]), r.choice(["s1", "s2", "s3", None, "é"])) for _ in range(200)]
    rows += [(None, "en", "s1"), ("", "xx", "alone"), ("@@ 123 __", "yy", "s1"), ("rare", "yy", "s2"), *[("same words here", "en", "s9")] * 12]
    assert audit(spark, rows, 3) == brute(rows, 3)
    assert audit(spark, rows, 10) == brute(rows, 10)


def test_long_texts_and_one_hot_source(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SEGMENT", 64)
    monkeypatch.setattr(divergence, "ENTRIES", 20)
    rows = [("one two three " * 500, "en", "hot"), ("x" * 5000 + " two", "en", "hot"), *[(f"two word{'abc'[i % 3]}", "en", "hot") for i in range(60)], ("two three", "en", "cold"), ("ünï" * 400, "en", "cold")]
    assert audit(spark, rows, 1) == brute(rows, 1)
    assert b" ".join(divergence.segments(b"ab cd " * 50, 7)) == b"ab cd " * 50


def test_empty_table(spark):
    assert audit(spark, [], 1) == []


@pytest.mark.parametrize("sql", [divergence.OP11_SQL])
def test_query_equals_sql(spark, sf, sql):
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = c.sql(sql).fetchall()
    got = divergence.op11_divergence(spark, sf)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and sorted(tuple(r) for r in got.collect()) == sorted(want)
