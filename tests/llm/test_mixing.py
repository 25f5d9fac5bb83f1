"""The mix against a walk through all rows in the order of their hashes, and targets against repeated resharing."""

import random
from fractions import Fraction

from pyspark.sql import functions as F

from tessera.llm import mixing


def brute_targets(sizes):
    """Shares by weight, with what is beyond three times a size reshared until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = Fraction(total - sum(3 * sizes[s] for s in full))
        rest = sum(w[s] for s in order if s not in full) or 1
        got = {s: Fraction(3 * sizes[s]) if s in full else left * w[s] / rest for s in order}
        above = {s for s in order if s not in full and got[s] > 3 * sizes[s]}
        if not above:
            return got
        full |= above


def docs(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return d.withColumns({"size": F.lit("clash"), "gap": F.lit(1), "steps": F.lit(2), "src": F.lit(3), "h1": F.lit(None).cast("long")})


def rows_of(seed, n, sources):
    r = random.Random(seed)
    return [(i if r.random() < 0.95 else None, None if r.random() < 0.05 else " ".join(["w"] * int(r.paretovariate(0.7) * 3 % 4000)), r.choice(sources)) for i in range(n)]


def check(spark, rows, near=0.001, **kw):
    out = mixing.mix(docs(spark, rows), near=near, **kw)
    got = [r.asDict() for r in out.collect()]
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    assert len(got) == len(rows) and {(r["source"], r["source_size"]) for r in got} == set(sizes.items())
    for r in got:
        assert abs(r["target"] - float(want[r["source"]])) <= 1e-9 * max(1, float(want[r["source"]])) and 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["copies"]
    for s, goal in want.items():
        mine = [r for r in got if r["source"] == s]
        taken, base = sum(r["taken"] for r in mine), int(goal // sizes[s]) if sizes[s] else 0
        assert all(r["copies"] in (base, base + 1) for r in mine)
        left = [r["size"] for r in mine if r["size"] and r["copies"] == base]
        short = float(goal) - taken
        if abs(short) > near * float(goal) + 1:  # then no row left fits, and the shortest would not bring it nearer
            assert all(x > short for x in left) and (short < 0 or all(x >= 2 * int(short) for x in left)), (s, goal, taken, sorted(left)[:3])
            assert short > 0 or abs(short) <= min([r["size"] for r in mine if r["copies"] > base])
    return got


def test_mix_against_the_definition(spark):
    check(spark, rows_of(1, 600, ["a", "b", "é", "z", None, "B"]))
    check(spark, [*rows_of(2, 300, ["hot"]), *rows_of(3, 20, ["t1", "t2", "t3"]), (7, "", "empty"), (8, None, "void")])


def test_first_step_is_a_walk_in_hash_order(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 13)), "ab"[i % 5 == 0]) for i in range(900)]
    d = docs(spark, rows)
    got = {r["doc_id"]: r for r in mixing.mix(d, near=0.0).collect()}
    order = d.select("doc_id", F.xxhash64(F.lit(0), F.col("doc_id").cast("string"), F.col("source").cast("string"), F.size(F.split("text", " ")).cast("long")).alias("h")).orderBy("h").collect()
    sizes = {s: sum(1 + i % 13 for i, _, x in rows if x == s) for s in "ab"}
    for s, goal in brute_targets(sizes).items():
        base, gap = int(goal // sizes[s]), int(goal) - int(goal // sizes[s]) * sizes[s]
        for r in order:  # every row that still fits is taken
            g = got[r["doc_id"]]
            if g["source"] == s:
                fits = g["size"] <= gap
                gap -= g["size"] * fits
                assert g["copies"] == base + fits
        assert gap == 0


def test_copies_of_a_row_and_reruns(spark):
    rows = [(1, "one two three", "a")] * 400 + [(i, "w " * (i % 9), "b") for i in range(200)] + [(None, "x", None)] * 50
    got = check(spark, rows)
    again = mixing.mix(docs(spark, rows).repartition(5)).collect()
    key = lambda r: tuple(str(v) for v in (r["doc_id"], r["source"], r["size"], r["taken"]))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_words_and_long_texts(spark):
    t = [None, "", " \t\n", "a", " a  b\x0b\x0cc\rd ", "é x $1 \\", "w " * 200_000]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(t)], "i int, t string")
    assert [r["n"] for r in d.select("i", mixing.words(F.col("t")).alias("n")).orderBy("i").collect()] == [0, 0, 0, 1, 4, 3, 200_000]


def test_empty_and_wordless_tables(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    out = mixing.mix(docs(spark, [(1, "", "a"), (2, None, None)])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in out] == [(0, 0.0, 0)] * 2


def test_no_python_on_the_main_path(spark, sf):
    plan = mixing.op13_mixing(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
