"""The network a level at a time, clustering of all nodes together, descent, exact quantiles, and the privacy budget of any tree."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import rng
from tessera.operators import descent, dp, encode, quantiles, spn, structure


def jobs(spark, work):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    out = work()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup(uuid.uuid4().hex, "")
    return out, n


def blobs(spark, n=4000):
    u = lambda k: rng.uniform(3, k, F.col("id"))
    d = spark.range(n).withColumn("g", F.floor(u("g") * 4).cast("int"))
    return d.select("id", (F.col("g") * 10 + u("x")).alias("x"), (F.col("g") % 2 * 7 + u("y")).alias("y"), u("z").alias("z"), F.concat(F.lit("c"), F.col("g").cast("string")).alias("c"))


def fitted(df, **params):
    specs = encode.fit(df)
    return spn.SPN(spn.SPNParams(**params), specs).fit(encode.transform(df, specs)), specs


def test_tree_of_independent_parts(spark):
    d = blobs(spark).drop("id")
    m, _ = fitted(d, beta=500, max_depth=3)
    assert m.root.kind == "product" and {tuple(c.scope) for c in m.root.children} == {("x", "y", "c"), ("z",)}
    mix = next(c for c in m.root.children if len(c.scope) == 3)
    assert mix.kind == "sum" and len(mix.children) == 4 and all(abs(w - 0.25) < 0.03 for w in mix.weights)
    again, _ = fitted(d.repartition(7), beta=500, max_depth=3)
    assert again.root.count() == m.root.count() and [c.kind for c in again.root.children] == [c.kind for c in m.root.children]


def test_jobs_grow_with_depth_not_with_nodes(spark):
    u = lambda k: rng.uniform(5, k, F.col("id"))
    d = spark.range(6000).select(*[(u("g") * 9 + u(f"x{i}")).alias(f"x{i}") for i in range(4)]).persist()
    specs = encode.fit(d)
    enc = encode.transform(d, specs)
    few, n = jobs(spark, lambda: spn.SPN(spn.SPNParams(beta=5000, max_depth=2), specs).fit(enc))
    many, m = jobs(spark, lambda: spn.SPN(spn.SPNParams(beta=150, max_depth=2), specs).fit(enc))
    assert many.root.count() > 3 * few.root.count() and m < 2.5 * max(n, 60), (few.root.count(), n, many.root.count(), m)


def test_empty_and_tiny_tables(spark):
    d = blobs(spark).drop("id")
    specs = encode.fit(d)
    for k in (0, 1, 3):
        m = spn.SPN(spn.SPNParams(beta=2), specs).fit(encode.transform(d.limit(k), specs))
        assert m.sample(spark.range(5), "id", 1, "t").count() == 5
    one = spn.SPN(spn.SPNParams(beta=2), specs[:1]).fit(encode.transform(d.limit(50), specs[:1]))
    assert one.root.kind == "histogram"


def test_lloyd_equals_a_single_node(spark):
    r = np.random.default_rng(1)
    data = {n: r.normal(size=(300, 3)) + n for n in (4, 7)}
    feats = spark.createDataFrame([(n, x.tolist()) for n, xs in data.items() for x in xs], "_node int, x array<double>").repartition(5)
    start = {(n, s): data[n][s * 3 : s * 3 + 2 + s] for n in data for s in range(2)}
    got, step = structure.lloyd(feats, start, rounds=4)
    for (n, s), c in start.items():
        c = c.copy()
        for _ in range(4):
            k = ((data[n][:, None] - c) ** 2).sum(-1).argmin(1)
            c = np.array([data[n][k == j].mean(0) if (k == j).any() else c[j] for j in range(len(c))])
        far = ((data[n][:, None] - c) ** 2).sum(-1)
        assert np.allclose(got[n, s], c) and abs(step[n, s][2] - far.min(1).sum()) < 1e-6 and step[n, s][0].sum() == 300


def test_first_centres_of_repeated_rows(spark):
    feats = spark.range(3000).select(F.lit(0).alias("_node"), F.array(F.when(F.col("id") < 2900, 1.0).otherwise((F.col("id") % 3).cast("double"))).alias("x"))
    got = structure.first_centres(feats, {0: 3}, 1)
    assert all(sorted(c.ravel()) == [0.0, 1.0, 2.0] for c in got.values()) and len(got) == 4


def test_sums_beside_each_other_are_not_multiplied_out(spark):
    leaf = lambda c, v: spn.Node("categorical", [c], codes=[float(v)], probs=[1.0])
    cols = [f"x{i}" for i in range(20)]
    root = spn.Node("product", cols, children=[spn.Node("sum", [c], [1, 1, 1, 1], [leaf(c, v) for v in range(4)]) for c in cols])
    out = descent.sample(spark.range(2000), root, cols, "id", 1, "wide")
    r = out.agg(*[F.avg(c) for c in cols], F.corr("x0", "x1")).first()
    assert all(abs(v - 1.5) < 0.12 for v in r[:20]) and abs(r[20]) < 0.08
    given = descent.sample(spark.range(50), root, cols, "id", 1, "wide", {"x3": F.lit(2.0)})
    assert {r["x3"] for r in given.collect()} == {2.0} and given.columns == ["id", *cols]
    again = descent.sample(spark.range(2000).repartition(7), root, cols, "id", 1, "wide")
    assert out.exceptAll(again).isEmpty()


def test_evidence_reaches_through_the_tree(spark):
    m, specs = fitted(blobs(spark).drop("id"), beta=300, max_depth=3)
    c = next(s for s in specs if s.name == "c")
    for g in range(4):
        out = m.sample(spark.range(200), "id", 1, "t", {"c": F.lit(float(c.categories.index(f"c{g}")))})
        r = out.agg(F.min("x"), F.max("x"), F.avg("y")).first()
        assert g * 10 - 0.1 <= r[0] and r[1] <= g * 10 + 1.1 and abs(r[2] - (g % 2 * 7 + 0.5)) < 0.3
    null = m.sample(spark.range(20), "id", 1, "t", {"x": F.lit(None).cast("double")}).collect()
    assert len(null) == 20 and {r["x"] for r in null} == {None}


def test_a_network_beyond_the_limit_says_so(monkeypatch):
    monkeypatch.setattr(descent, "LARGEST", 10)
    with pytest.raises(ValueError, match="raise beta"):
        descent.Layout(spn.Node("categorical", ["c"], codes=[1.0] * 9, probs=[1 / 9] * 9), ["c"])


def test_quantiles_equal_sorting(spark):
    n = 5000
    r = random.Random(1)
    cols = {"skew": [2.0 ** r.uniform(-60, 60) for _ in range(n)], "tied": [float(r.choice([1, 1, 1, 1, 2, 9])) for _ in range(n)], "flat": [3.5] * n, "holes": [None if i % 3 else r.gauss(0, 1) for i in range(n)], "none": [None] * n, "far": [1e300 * (i % 2) - (i % 5) for i in range(n)]}
    d = spark.createDataFrame(list(zip(range(n), *cols.values(), strict=True)), "g int, " + ", ".join(f"{c} double" for c in cols)).repartition(6)
    shares = [0, 0.01, 0.125, 1 / 3, 0.5, 0.9, 0.999, 1]
    for size in ({}, {"together": 3, "buckets": 4}):
        got = quantiles.quantiles(d, list(cols), shares, **size)
        assert got.pop("none") is None
        for c, v in got.items():
            assert np.allclose(v, np.quantile([x for x in cols[c] if x is not None], shares), rtol=1e-12), (c, size)
    by = quantiles.grouped(d.withColumn("g", F.col("g") % 3), "g", ["skew"], lambda g, c, n: [0.5] if g else [0.25, 0.75], together=50)
    for g in range(3):
        assert np.allclose(by[g, "skew"], np.quantile(cols["skew"][g::3], [0.25, 0.75] if g == 0 else [0.5]))
    assert quantiles.quantiles(d.limit(0), ["skew"], [0.5]) == {"skew": None}


def test_no_tree_spends_more_than_epsilon(spark):
    """The worst of trees: each level with products and sums, each mechanism at each level."""
    ledger = dp.PrivacyLedger(2.0, 6, max_depth=4, seed=3)
    for level in range(4):
        for share in (1.0, 0.5, 0.25):
            ledger.node_size(100, level, share)
            ledger.contingency([5, 6], 3, level, share)
            ledger.kmeans_share(level)
            ledger.weights([5, 6], level, share)
    for c in range(6):
        for _ in range(9):
            ledger.counts([1, 2, 3], ledger.per_column, f"column_{c}")
    assert ledger.report()["spent"] <= 2.0 + 1e-9
    d = blobs(spark, 3000).drop("id")
    specs = encode.fit(d)
    m = spn.SPN(spn.SPNParams(beta=50, private=True, epsilon=1.0, max_depth=2), specs)
    m.ledger = dp.PrivacyLedger(1.0, len(m.columns), 2, 0.35, seed=1)
    m.fit(encode.transform(d, specs))
    assert 0.3 < m.ledger.report()["spent"] <= 1.0 + 1e-9
    assert m.sample(spark.range(30), "id", 1, "t").count() == 30


def test_private_structure_is_decided_by_noise(spark):
    """Tables that differ in a row, or have none at all, can give each other's structure: nothing that is counted shows as it is."""
    d = blobs(spark, 40).drop("id")
    specs = encode.fit(blobs(spark).drop("id"))
    kinds = set()
    for df in (d, d.limit(0)):
        for seed in range(2):
            m = spn.SPN(spn.SPNParams(beta=20, private=True, epsilon=0.5, max_depth=1), specs)
            m.ledger = dp.PrivacyLedger(0.5, len(m.columns), 1, 0.35, seed=seed)
            m.fit(encode.transform(df, specs))
            kinds.add((df is d, m.root.kind, len(m.root.children)))
            leaves = [m.root]
            while any(n.children for n in leaves):
                leaves = [c for n in leaves for c in n.children or [n]]
            assert all(-1.0 in n.codes for n in leaves if n.kind == "categorical") and not any(n.kind == "constant" for n in leaves)
    assert len({k[1:] for k in kinds if k[0]} & {k[1:] for k in kinds if not k[0]}) >= 1


def test_cells_are_counted_in_tasks(spark):
    r = random.Random(4)
    data = [(r.choice((3, 8)), r.choice((0.0, 1.0, None)), r.choice((None, float("nan"), *map(float, range(9)))), r.random()) for _ in range(700)]
    rows = spark.createDataFrame(data, "_node int, c double, x double, y double").repartition(5)
    specs = {"c": encode.ColumnSpec("c", "categorical"), "x": encode.ColumnSpec("x", "numerical"), "y": encode.ColumnSpec("y", "numerical")}
    edges = {3: {"x": [2.0, 5.0], "y": [0.5]}, 8: {"x": [], "y": [0.1, 0.2]}}
    got = structure.tables(rows, {3: structure.Open(3, ["c", "x", "y"]), 8: structure.Open(8, ["x", "y"])}, specs, edges)
    place = lambda n, c, v: -1.0 if v is None else v if c == "c" else float(sum(not v < e for e in edges[n][c]))
    want = {(3, 0, 1): {}, (3, 0, 2): {}, (3, 1, 2): {}, (8, 1, 2): {}}
    for n, *v in data:
        b = [place(n, c, z) if (n, c) != (8, "c") else None for c, z in zip("cxy", v, strict=True)]
        for node, i, j in want:
            if node == n:
                want[node, i, j][b[i], b[j]] = want[node, i, j].get((b[i], b[j]), 0) + 1
    assert got == want


def test_rows_move_with_their_lists(spark):
    rows = spark.createDataFrame([(1.0, [5, 6], [1]), (9.0, [6], []), (None, [7, 5], [2, 3]), (4.0, [], [4])], "a double, _open array<int>, _leaf array<int>").coalesce(1)
    far = [np.array([[0.0], [8.0]]).tolist()]
    decided = [([20, 21], [], [], [], [], [], None), ([30, 31], [], [0], [7.0], [0.0], [1.0], far[0]), ([], [7], [], [], [], [], None)]
    got = structure._moved(rows, 5, decided, F.array("a")).collect()
    assert [(r["_open"], r["_leaf"]) for r in got] == [([20, 21, 30], [1]), ([31], []), ([20, 21], [2, 3, 7]), ([], [4])]


def test_an_evidence_row_by_row(spark):
    """Draws of all rows of a batch at once against one row at a time, with histograms, constants, nulls and evidence beyond all leaves."""
    leaf = lambda c, kind, **how: spn.Node(kind, [c], **how)
    one = [leaf("a", "histogram", probs=[0.5, 0.5], edges=[0.0, 1.0, 4.0], null=0.25), leaf("b", "categorical", codes=[-1.0, 2.0], probs=[0.3, 0.7])]
    two = [leaf("a", "constant", value=3.0), leaf("b", "constant")]
    root = spn.Node("sum", ["a", "b"], [0.4, 0.6], [spn.Node("product", ["a", "b"], children=x) for x in (one, two)])
    given = [0.5, 3.0, None, 99.0, float("nan")]
    rows = spark.range(400).withColumn("g", F.element_at(F.array(*[F.lit(v).cast("double") for v in given]), (F.col("id") % 5 + 1).cast("int")))
    shares = {r["id"]: r["posterior"][0] for r in descent.posterior(rows, root, ["a", "b"], {"a": F.col("g")}).collect()}
    for r in descent.sample(rows, root, ["a", "b"], "id", 3, "t", {"a": F.col("g")}).collect():
        first = _uniform(3, "t:0|0", r["id"]) < shares[r["id"]]
        u = _uniform(3, "t:b", r["id"])
        assert r["b"] == ((-1.0 if u < 0.3 else 2.0) if first else None)
    free = descent.sample(spark.range(3000), root, ["a", "b"], "id", 3, "t").agg(F.count("a"), F.count_if(F.col("a") == 3), F.count("b")).first()
    assert abs(free[0] - 3000 * (0.6 + 0.4 * 0.75)) < 110 and abs(free[1] - 1800) < 110 and abs(free[2] - 1200) < 110


def _uniform(seed, stream, rid):
    import hashlib

    return int(hashlib.md5(f"{seed}|{stream}|{rid}".encode()).hexdigest()[:13], 16) / rng.SCALE


def test_ends_of_a_cut_are_those_of_its_rows(spark):
    values = [-1e300, -2.5, -1e-320, 0.0, 5e-324, 1.0, 1e9]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", quantiles.magnitude(F.col("x")).alias("m")).collect()
    assert all(abs(r["m"] - quantiles._magnitude(r["x"])) < 1e-9 for r in got)
    t = quantiles.Interval((0, 0), -4.0, 1e9, 9, 0, [1], 1)
    assert t.by_logarithm() and t.span()[0] == quantiles._magnitude(-4.0) and quantiles.Interval((0, 0), 2.0, 6.0, 9, 0, [1]).span() == (1.0, 2.0)


def test_keys_are_made_before_values(spark, monkeypatch):
    from tessera.operators import relational
    from tessera.types import ForeignKey, TableSpec

    seen, mint = [], encode.mint_keys

    def minted(df, *how):
        seen.append(df.columns)
        return mint(df, *how)

    c = spark.range(80).select(F.col("id").alias("cid"), (F.col("id") % 7).cast("double").alias("a"))
    o = spark.range(200).select(F.col("id").alias("oid"), (F.col("id") % 80).alias("cid"), rng.uniform(1, "b", F.col("id")).alias("b"))
    m = relational.RelationalModel({"c": TableSpec("c", "cid"), "o": TableSpec("o", "oid", [ForeignKey("o", ["cid"], "c", ["cid"])])}, spn.SPNParams(beta=500, max_depth=1)).fit({"c": c, "o": o})
    monkeypatch.setattr(encode, "mint_keys", minted)
    out = m.sample(spark, {"c": 40})
    assert len(seen) == 2 and not {"a", "b"} & {x for cols in seen for x in cols}  # a sort of rows with values would draw them twice
    n = out["o"].count()
    assert out["c"].select("cid").distinct().count() == 40 and out["o"].select("oid").distinct().count() == n and out["o"].join(out["c"], "cid", "left_anti").isEmpty()
