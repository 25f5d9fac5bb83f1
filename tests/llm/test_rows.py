"""Operators that judge rows: URL filters, toxicity, language, quality."""

import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import common, langid, quality, toxicity, urlfilter


def strings(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def test_url_parts_and_rules(spark):
    urls = [None, "no scheme", "http://", "HTTP://A.Example.ORG/es/x?q#f", "https://example.org/en/12", "ftp://x.com#f", "http://b.com/de/1://z", "http://example.org", "http://notorg/x", "http://fr.com/fr/?a"]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in urlfilter.judge(d, urlfilter.fit([])).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(10)] == [
        ("", "", None), ("", "", None), ("", "", None), ("a.example.org", "/es/x", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"),
        ("x.com", "", None), ("b.com", "/de/1://z", "com/de/"), ("example.org", "", None), ("notorg", "/x", None), ("fr.com", "/fr/", "com/fr/"),
    ]
    assert [got[i]["verdict"] for i in (3, 4, 6, 9)] == ["block", "block", "block", "allow"]


def test_url_model_learns(spark):
    rows = [(f"spam{i}.net", f"/win/{i}", 1) for i in range(40)] + [(f"news{i}.net", f"/story/{i}", 0) for i in range(40)]
    m = urlfilter.fit(rows)
    assert m.score(urlfilter.grams("spam99.net", "/win/7")) > 0.8 and m.score(urlfilter.grams("news99.net", "/story/7")) < 0.2
    assert len(urlfilter.grams("é", "")) == len(urlfilter.grams("e", ""))  # of characters, not bytes


def test_url_query_covers_all_pages(spark, sf):
    out = urlfilter.op1_url_filter(spark, sf)
    assert out.count() == spark.read.parquet(f"{sf}/pages.parquet").count() and out.filter("verdict not in ('allow', 'block')").count() == 0


def test_toxicity_finds_planted_words(spark):
    clean = [f"plain words about rivers number {i} and hills {i % 7}" for i in range(160)]
    bad = [f"plain words about rivers you {w} thing {i}" for i, w in enumerate(["zorgling", "frumpkin"] * 20)]
    rows = list(enumerate([*clean, *bad, *bad[:3], "", None]))
    labels = spark.createDataFrame([(i, int(160 <= i < 203)) for i, _ in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    d = strings(spark, rows)
    ix = toxicity.build(d, labels)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(d.withColumn("score", F.lit("clash")), ix).collect()}
    assert all(got[i]["score"] >= 0.3 and got[i]["evidence"] for i in range(160, 203)) and all(got[i]["score"] < 0.3 for i in range(160))
    assert 0 <= got[203]["score"] < 0.3 and got[204]["evidence"] == []
    none = toxicity.build(d, labels.filter("toxic = 0"))
    assert toxicity.score(d, none).agg(F.max("toxicity.score")).first()[0] == 0.0
    assert toxicity.score(d.limit(0), ix).count() == 0


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.op2_toxicity(spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("held_out")
    assert out.filter("toxic = 0 and predicted = 1").count() <= 0.05 * out.filter("toxic = 0").count()
    assert out.filter("toxic = 1 and predicted = 1").count() >= 0.5 * out.filter("toxic = 1").count() and docs.count() == 1000


def test_language_on_held_out_rows(spark, sf):
    out = langid.op6_language_id(spark, sf)
    j = out.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = j.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.min("score"), F.max("score")).first()
    assert r["a"] > 0.95 and 0 <= r[1] <= r[2] <= 1
    assert {r["doc_id"]: r["held_out"] for r in out.collect()} == {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in out.collect()}


def test_language_edge_cases(spark):
    base = [(i, "the cat and the dog are here now" if i % 2 else "der hund und die katze sind nun hier", "en" if i % 2 else "de") for i in range(40)]
    d = spark.createDataFrame([*base, (100, None, "en"), (101, "", "en"), (102, "123 !?", None), (103, "the dog " * 50000, None)], "doc_id long, text string, lang string")
    m = langid.train(d)
    got = {r["doc_id"]: r["language"]["lang_pred"] for r in langid.predict(d, m).collect()}
    assert (got[100], got[101], got[102], got[103], got[1], got[2]) == ("und", "und", "und", "en", "en", "de")
    empty = langid.train(d.limit(0))
    assert langid.predict(d, empty).filter("language.lang_pred <> 'und'").count() == 0
    assert langid.stage(spark, d.withColumn("language", F.lit(1)), "").count() == 41


@pytest.mark.parametrize("k", [1, 2, 3, 4, 6, 7, 12])
def test_codewords_differ(k):
    c = langid.codewords(k)
    assert len({tuple(r) for r in c.tolist()}) == k


def brute_repeats(words):
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    return len({i + j for v in at.values() if len(v) > 1 for i in v for j in range(5)})


def test_quality_counts(spark):
    import random

    random.seed(2)
    texts = [None, "", " \t\n", "a b c d e a b c d e", "x\ny\nx\n\n\nx \n", "héllo wörld #1 $2 <b> &|", "\x1c odd \x85 spaces here", *(" ".join(random.choice("abc") for _ in range(random.randint(1, 60))) for _ in range(40))]
    path = common.tokenizer_path(quality.VOCABULARY)
    for t in texts:
        m, raw = quality.measure(t, path), (t or "").encode()
        words = raw.split()
        assert m["n_words"] == len(words) and m["word_chars"] == sum(len(w.decode()) for w in words)
        assert m["n_repeat_words"] == brute_repeats(words) and m["n_symbols"] == sum(c in "#*$%&|<>" for c in t or "")
        lines = [x for x in (t or "").split("\n") if x.strip(common.SPACES)]
        assert m["n_dup_lines"] == len(lines) - len(set(lines))
    out = quality.judge(strings(spark, list(enumerate(texts))).withColumn("kept", F.lit(1)))
    assert out.count() == len(texts) and out.filter("doc_id < 3 and kept").count() == 0


def test_quality_rejects_junk_and_keeps_prose(spark):
    prose = "the quick brown fox jumps over the lazy dog while many other animals look on from afar and wonder about it all " * 1
    junk = " ".join(f"{w}***%%%$$$" for w in (prose * 8).split()[:150:1])
    d = strings(spark, [(1, prose), (2, "͸͹ " * 200), (3, junk)])
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(d).collect()}
    assert kept == {1: True, 2: False, 3: False}
