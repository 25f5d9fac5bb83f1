"""Series statistics by a segmented scan: a key with most rows lies in many parts, and all is as in one walk through each key."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import aggregate as agg


def brute(rows, lags, first, last):
    """{key: statistics} by a walk through each key's values in order."""
    by = {}
    for key, at, v, s in sorted(rows, key=lambda r: r[1]):
        by.setdefault(key, []).append((v, s))
    out = {}
    for key, pairs in by.items():
        x = [v for v, _ in pairs if v is not None]
        t = [s for _, s in pairs if s is not None]
        steps = [b - a for a, b in zip(x, x[1:], strict=False)]
        w = max(len(x) - 1, 1)
        d = {"increase_ratio": np.mean([s > 0 for s in steps]) if steps else None, "is_decreasing": float(all(s <= 0 for s in steps)) if steps else None, "end_start_diff": x[-1] - x[0] if len(x) > 1 else None}
        if x:
            d |= {"first_max_pos": x.index(max(x)) / w, "last_min_pos": (len(x) - 1 - x[::-1].index(min(x))) / w}
        for k in lags:
            a, b = np.array(x[k:]), np.array(x[:-k])
            d[f"autocorr{k}"] = None if len(x) <= k else float(np.corrcoef(a, b)[0, 1]) if len(a) > 1 and a.std() > 0 and b.std() > 0 else 0.0
        d |= {f"first{k + 1}": x[k] if k < len(x) else None for k in range(first)} | {f"last{k + 1}": x[-1 - k] if k < len(x) else None for k in range(last)}
        out[key] = {f"v__{k}": v for k, v in d.items()} | {"s__first1": t[0] if t else None, "s__last2": t[-2] if len(t) > 1 else None}
    return out


def test_a_hot_key_is_spread_and_nothing_changes(spark):
    r = random.Random(5)
    rows = [("hot" if r.random() < 0.6 else r.choice(["a", "b", "c", None, *(f"k{i}" for i in range(30))]), i, None if r.random() < 0.2 else float(r.randint(0, 50)), r.choice(["x", "y", None])) for i in range(4000)]
    rows += [("one", 1, 3.0, "x"), ("two", 1, 3.0, None), ("two", 2, 4.0, None), ("null", 1, None, None), ("flat", 1, 2.0, "z"), ("flat", 2, 2.0, "z"), ("flat", 3, 2.0, "z")]
    r.shuffle(rows)
    d = spark.createDataFrame(rows, "k string, at long, v double, s string")
    config = agg.AggregationConfig(k_first=3, k_last=3, autocorr_lags=(1, 3), increase_ratio=True, is_decreasing=True, end_start_diff=True, first_max_pos=True, last_min_pos=True, most_columns=200)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {x["k"]: x.asDict() for x in agg.aggregate(d, ["k"], ["v", "s"], config, ["at"]).collect()}
        scan = agg.placed(d.select("k", "at", F.col("v").alias("x")), ["k"], ["at"], {"x": (True, [2])})
        n = scan.filter("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(n) > 2 and max(x["count"] for x in n) < 1500
    for key, want in brute(rows, (1, 3), 3, 3).items():
        for c, v in want.items():
            g = got[key][c]
            assert g == v or (v is not None and g is not None and not isinstance(v, str) and math.isclose(g, v, abs_tol=1e-9)), (key, c, g, v)


def test_series_of_no_rows(spark):
    d = spark.createDataFrame([], "k string, at long, v double")
    assert agg.aggregate(d, ["k"], ["v"], agg.AggregationConfig(k_last=2, increase_ratio=True, autocorr_lags=(1,)), ["at"]).count() == 0


def test_fingerprints_of_many_columns(spark, monkeypatch):
    from tessera.operators import profile

    d = spark.range(300).select(*[(F.col("id") * (i % 97) % 11).cast("double").alias(f"c{i}") for i in range(200)], F.when(F.col("id") == 7, None).otherwise(F.lit(0.0)).alias("gap"))
    many = d.unionByName(d).repartition(6)
    got = {r["duplicate"]: r["source"] for r in profile.duplicate_columns(many).collect()}
    values = {c: tuple(x) for c, x in zip(d.columns, zip(*d.collect(), strict=True), strict=True)}
    first = {}
    for c, v in values.items():
        first.setdefault(v, c)
    assert got == {c: first[v] for c, v in values.items() if first[v] != c} and len(got) > 90 and "gap" not in got
    monkeypatch.setattr(profile, "fingerprints", lambda df, cols: dict.fromkeys(cols, 1))  # chance can only cost time
    few = [f"c{i}" for i in (1, 2, 98, 99, 5)]
    assert {r["duplicate"]: r["source"] for r in profile.duplicate_columns(d, few).collect()} == {"c98": "c1", "c99": "c2"}
    monkeypatch.undo()
    swapped = spark.createDataFrame([("a", "b"), ("b", "a")], "x string, y string")
    assert profile.duplicate_columns(swapped).count() == 0 and profile.mirrors(swapped.limit(0)) == {}


def test_correlation_of_constants(spark):
    from tessera.operators import report

    d = spark.range(20).select(F.col("id").cast("double").alias("a"), F.lit(1.0).alias("b"), (F.col("id") * 2).cast("double").alias("c"))
    assert report.correlation_delta(d, d, ["a", "b", "c"]).first()["delta"] == 0.0
