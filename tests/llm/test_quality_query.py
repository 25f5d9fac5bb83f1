"""Quality rules: the query's base counts by their definition, junk of several kinds against prose, odd rows."""

import random

from pyspark.sql import functions as F

from tessera.llm import common, quality


def by_definition(text):
    text = text or ""
    words = text.encode().split()
    at: dict = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    lines = [x for x in text.split("\n") if x.strip(common.SPACES)]
    repeated = len({i + j for v in at.values() if len(v) > 1 for i in v for j in range(5)})
    failed = len(words) < 10 or 100 * repeated > 20 * len(words)
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeated, failed


def test_query_equals_its_definition(spark, sf):
    got = {r["doc_id"]: r for r in quality.op9_quality(spark, sf).collect()}
    docs = common.table(spark, sf, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        r = got[d["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == by_definition(d["text"])
        assert not (r["base_failed"] and r["kept"])
    prose = [d for d in docs if not got[d["doc_id"]]["base_failed"]]
    assert sum(got[d["doc_id"]]["kept"] for d in prose) > 0.9 * len(prose)


def test_each_measure_can_reject(spark):
    rnd = random.Random(7)
    draw = lambda chars, n: " ".join("".join(rnd.choice(chars) for _ in range(6)) for _ in range(n))
    prose = "the quick brown fox jumps over a lazy dog while many other animals look on from afar and wonder what it is all about today"
    rows = [("prose", prose), ("signs", draw("!?@^~=+;:", 200)), ("private", draw([chr(c) for c in range(0xE000, 0xE400)], 200)), ("emoji", draw("😀😁😂🤣😃😄", 200)), ("one", " ".join(f"a{'b' * (i % 3)}" for i in range(11)))]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert [k for k, r in got.items() if r["kept"]] == ["prose"]
    assert got["prose"]["chars_per_token_multi"] > 2.5 and got["private"]["chars_per_token_multi"] < 0.5


def test_odd_rows(spark):
    long = "x" * 300_000
    d = spark.createDataFrame([(1, None), (2, ""), (3, long), (4, "word " * 100_000), (4, "word " * 100_000), (None, "a b")], "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    got = quality.judge(d).collect()
    assert len(got) == 6 and not any(r["kept"] for r in got) and {r["n_words"] for r in got if r["doc_id"] == 4} == {100_000}
    assert quality.judge(d.limit(0)).count() == 0
