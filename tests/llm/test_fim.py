"""Fill-in-the-middle: cuts by code points, marks wherever they stand, round trips, chunks and what they say of a text."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import common, fim


def brute(doc_id, text, fim_percent=90, spm_percent=20):
    """(n, form, prefix_chars, middle_chars, output) by the definition."""
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(t)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim_percent:
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    if h4 % 100 < spm_percent:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def texts():
    r = random.Random(7)
    some = ["".join(r.choices("ab<>PSM é日𝄞\n", k=r.randint(0, 80))) for _ in range(150)]
    base = "".join(r.choices("abcdefghij klm é日\n", k=30_000))
    many = [base, base[:20_000] + "<M>" + base[20_000:], "x" * 50_000, "é" * 9000, "<" * 40 + "P", "<P", "P>", base[5:25_000]]
    return [None, "", *some, *many, *many]


def test_against_brute_force(spark):
    rows = [*enumerate(texts()), (None, "null id"), (5, "again"), (5, "again")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"form": F.lit(1), "n": F.lit("clash"), "h1": F.lit(None).cast("int")})
    for kw in ({}, {"fim_percent": 100, "spm_percent": 50}):
        done = fim.restore(fim.transform(d, **kw)).collect()
        assert len(done) == len(rows)
        got = sorted((str(r["doc_id"]), r["n"], r["form"], r["prefix_chars"] is None, r["prefix_chars"] or 0, r["middle_chars"] or 0, r["output"], r["restored"]) for r in done)
        want = []
        for i, t in rows:
            n, form, a, b, out = brute(i, t, **kw)
            want.append((str(i), n, form, a is None, a or 0, b or 0, out, t or ""))
        assert got == sorted(want)
    assert fim.restore(fim.transform(d.limit(0))).count() == 0


def test_restore_without_output(spark):
    d = spark.createDataFrame([(1, None, "psm", 3), (2, "abc", None, 3), (3, "<P>a<S>c<M>b", "psm", 3)], "doc_id int, output string, form string, restored int")
    out = fim.restore(d)
    assert out.columns == ["doc_id", "output", "form", "restored", "_restored"] and [r["_restored"] for r in out.orderBy("doc_id").collect()] == [None, None, "abc"]


def test_chunks_follow_content_and_are_bounded():
    r = random.Random(3)
    passage = bytes(r.randrange(97, 123) for _ in range(20_000))
    a, b = passage, b"some other start " * 7 + passage
    cut = lambda d: {d[lo:hi] for lo, hi in zip([0, *fim.chunk_ends(np.frombuffer(d, np.uint8))[:-1]], fim.chunk_ends(np.frombuffer(d, np.uint8)), strict=True)}
    assert b"".join(a[lo:hi] for lo, hi in zip([0, *fim.chunk_ends(np.frombuffer(a, np.uint8))[:-1]], fim.chunk_ends(np.frombuffer(a, np.uint8)), strict=True)) == a
    assert len(cut(a) & cut(b)) >= len(cut(a)) - 2 and len(cut(a)) > 15
    flat = fim.chunk_ends(np.zeros(100_000, np.uint8))
    assert np.diff(flat, prepend=0).max() <= fim.LONGEST and flat[-1] == 100_000
    for k in (1, 2, 31, 32, 33):
        assert fim.chunk_ends(np.full(k, 7, np.uint8))[-1] == k


def test_cache_serves_equal_chunks_and_forgets():
    c = fim.Chunks(most=3000)
    raw = bytes(random.Random(1).randrange(97, 123) for _ in range(5000))
    for _ in range(3):
        fim.Text(np.frombuffer(raw, np.uint8), raw, c)
    assert c.made < c.asked and c.held <= 3000 + fim.LONGEST + 200


def test_query_equals_sql(spark, sf):
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = fim.op12_fim(spark, sf)
    want = c.sql(fim.OP12_SQL)
    key = lambda r: tuple(str(x) for x in r)
    assert got.columns == want.columns and sorted(map(key, map(tuple, got.collect()))) == sorted(map(key, want.fetchall()))


def test_slices_by_bytes():
    b = common.batch(x=["a" * 10, None, "b" * 3, "c" * 30, ""])
    assert [s.num_rows for s in common.by_bytes(b, "x", 13)] == [3, 1, 1] and list(common.by_bytes(b.slice(0, 0), "x", 13)) == []
    assert common.strings([b"a", None, "é".encode()]).to_pylist() == ["a", None, "é"] and common.strings([]).to_pylist() == []
