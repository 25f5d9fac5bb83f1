"""Leaves of forests: the index against the race of all leaves, the small-leaf rule, draws by weight, and the out-of-bag score."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import rng
from tessera.operators import arf, leaves
from tessera.operators.joins import bootstrap
from tessera.sources.tables import settled
from tessera.types import ColumnSpec

SPECS = [ColumnSpec("x", "numerical"), ColumnSpec("c", "categorical"), ColumnSpec("z", "numerical")]


def rows(spark, n=4000):
    """Numbers of which some are null, codes, and a column that is constant in many leaves."""
    u = lambda k: rng.uniform(5, k, F.col("id"))
    x = F.when(u("null") > 0.1, u("x") * 100)
    return spark.range(n).select("id", x.alias("x"), F.when(u("cn") > 0.05, F.floor(u("c") * 5 + F.coalesce(x, F.lit(0.0)) / 50)).cast("double").alias("c"), F.floor(u("z") * 3).cast("double").alias("z"))


def table(spark, n=4000):
    d = rows(spark, n)
    node = F.floor(F.coalesce(F.col("x"), F.lit(-10.0)) / 2) * 10 + F.col("z")
    return d, settled(leaves.densities(d.select("x", "c", "z", F.lit(0).alias("tree"), node.alias("node")), SPECS, 0.5), "leaves")


def test_small_leaves_take_whole_columns(spark):
    d = spark.createDataFrame([(0, i % 2, float(i), 1.0) for i in range(20)] + [(0, 7, 1000.0, 2.0), (0, 7, None, None)], "tree int, node int, x double, c double")
    got = {r["node"]: r for r in leaves.densities(d, SPECS[:2], 0.5).collect()}
    xs = [float(i) for i in range(20)] + [1000.0]
    assert got[7]["n"] == 2 and abs(got[7]["x"]["mean"] - np.mean(xs)) < 1e-9 and got[7]["x"]["high"] == 1000.0 and abs(got[7]["x"]["nul"] - 1 / 22) < 1e-12
    assert [e["v"] for e in got[7]["c"]] == [-1.0, 1.0, 2.0] and abs(got[7]["c"][0]["cum"] - 1.5 / 23.5) < 1e-12
    assert got[0]["x"]["high"] == 18.0 and got[1]["x"]["low"] == 1.0 and abs(got[7]["weight"] - 2 / 22) < 1e-12 and abs(max(r["cum"] for r in got.values()) - 1) < 1e-12


def test_index_gives_the_leaf_of_the_whole_race(spark, monkeypatch):
    d, found = table(spark)
    index = leaves.LeafIndex(found, SPECS)
    asked = d.filter("id < 400").select("id", "x", "c", "z")
    for given in (["x"], ["x", "c"], ["c", "z"], ["x", "c", "z"]):
        quick = {r["id"]: (r["leaf"], r["n_scored"]) for r in index.best(asked, "id", given, 3, "t").collect()}
        with monkeypatch.context() as m:
            m.setattr(leaves, "SLACK", 1e9)  # bounds that rule nothing out
            whole = {r["id"]: (r["leaf"], r["n_scored"]) for r in index.best(asked, "id", given, 3, "t").collect()}
        assert len(quick) == 400 and {n for _, n in whole.values()} == {index.n}
        assert {k: v[0] for k, v in quick.items()} == {k: v[0] for k, v in whole.items()}
        if "x" in given:
            assert sum(n for _, n in quick.values()) < 0.5 * 400 * index.n


def test_race_draws_by_weight_and_density(spark):
    _, found = table(spark)
    index = leaves.LeafIndex(found, SPECS)
    asked = spark.range(6000).select("id", F.lit(41.0).alias("x"), F.lit(2.0).alias("c"))
    got = Counter(r["leaf"] for r in index.best(asked, "id", ["x", "c"], 9, "t").collect())
    score = {}
    for r in found.collect():
        x, cum = r["x"], [0.0] + [e["cum"] for e in r["c"]]
        p = {e["v"]: cum[i + 1] - cum[i] for i, e in enumerate(r["c"])}.get(2.0, 1e-12)
        if x["mean"] is None:
            body = -30
        else:
            body = -(((41.0 - x["mean"]) / x["std"]) ** 2) / 2 - math.log(x["std"]) if x["std"] > 1e-9 else (0 if abs(41.0 - x["mean"]) < 1e-6 else -30)
            body -= 10 if 41.0 < x["low"] or 41.0 > x["high"] else 0
        score[r["leaf"]] = r["weight"] * p * math.exp(body) * max(1 - x["nul"], 1e-12)
    total = sum(score.values())
    assert sum(abs(got[k] / 6000 - v / total) for k, v in score.items()) / 2 < 0.03


def test_draws_by_weight_alone(spark):
    _, found = table(spark)
    index = leaves.LeafIndex(found, SPECS)
    got = index.drawn(spark.range(3000).select("id", rng.uniform(1, "u", F.col("id")).alias("u")), "u").select("id", "u", "leaf").collect()
    cum = [r["cum"] for r in found.orderBy("leaf").collect()]
    assert len(got) == 3000
    assert all(r["leaf"] == min(int(np.searchsorted(cum, r["u"], "right")), len(cum) - 1) for r in got)


def test_a_model_too_large_to_send_is_joined_by_shuffles(spark, monkeypatch):
    d, found = table(spark, 800)
    asked = d.filter("id < 50")
    near = {r["id"]: r["leaf"] for r in leaves.LeafIndex(found, SPECS).best(asked, "id", ["x", "z"], 3, "t").collect()}
    monkeypatch.setattr(leaves, "LARGEST", 1)
    far = leaves.LeafIndex(found, SPECS)
    assert not far.small and {r["id"]: r["leaf"] for r in far.best(asked, "id", ["x", "z"], 3, "t").collect()} == near


def test_out_of_bag_score_by_brute_force(spark):
    d = rows(spark, 600).fillna(0.0)
    fake = bootstrap(d, ["x", "c", "z"], 1, "id", number="id")
    assert [r["id"] for r in fake.orderBy("id").collect()] == list(range(600))
    both = d.select("x", "c", "z", F.col("id").cast("string").alias("_id"), F.lit(1.0).alias("y")).unionByName(fake.select("x", "c", "z", F.col("id").cast("string").alias("_id"), F.lit(0.0).alias("y")))
    vec = arf._vectors(both, ["x", "c", "z"], {"x": 0.0, "c": 0.0, "z": 0.0}, "y", "_id")
    p = arf.ARFParams(trees=7, max_depth=4, seed=3)
    models, score = arf.discriminator(vec, p, 0)
    assert [m.getNumTrees for m in models] == [3, 2, 2]
    own = vec.withColumn("part", arf.part_of(p, 0, F.col("_id"), F.col("y"))).collect()
    assert {r["part"] for r in own} == {0, 1, 2}
    votes = [np.sum([np.array(t.predictProbability(r["_v"]).toArray()) for t in models[r["part"]].trees], axis=0) for r in own[:200]]
    hits = {(r["_id"], r["y"]): float(np.argmax(v)) == r["y"] for r, v in zip(own, votes, strict=False)}
    judged = {}
    for i, m in enumerate(models):
        for r in m.transform(vec).select("_id", "y", "prediction").collect():
            judged[i, r["_id"], r["y"]] = r["prediction"] == r["y"]
    assert all(judged[r["part"], r["_id"], r["y"]] == hits[r["_id"], r["y"]] for r in own[:200])
    assert abs(score - np.mean([judged[r["part"], r["_id"], r["y"]] for r in own])) < 1e-12


def test_rounds_stop_when_nothing_tells_real_from_drawn(spark):
    d = rows(spark, 900).fillna(0.0)
    m = arf.ARF(arf.ARFParams(trees=6, max_depth=3, rounds=4, delta=0.5), SPECS).fit(d, "id")
    assert len(m.history) == 1 and m.converged
    m = arf.ARF(arf.ARFParams(trees=6, max_depth=3, rounds=2, delta=-1.0), SPECS).fit(d, "id")
    assert len(m.history) == 2 and not m.converged and abs(sum(r["weight"] for r in m.leaves.collect()) - 1) < 1e-9
