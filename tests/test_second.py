"""Ranks without single tasks, long tails, masks, autoconfiguration, evaluation over tables, demonstration tables, sinks."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tessera.functions import rng
from tessera.operators import autoconfigure, encode, evaluate, joins, masks, profile
from tessera.sources import demo
from tessera.sources import tables as io


def test_running_total(spark):
    d = spark.range(1, 1001).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("v")).repartition(9)
    got = {r["k"]: r["t"] for r in joins.running_total(d, "k", "v", "t").collect()}
    assert all(got[k] == sum(i % 7 for i in range(1, k)) for k in (1, 2, 500, 1000))
    assert joins.running_total(d.limit(0), "k", "v", "t").count() == 0


def test_split_of_a_label_with_most_rows(spark):
    d = spark.range(3000).select("id", F.when(F.col("id") % 10 == 0, "rare").when(F.col("id") % 10 < 9, "common").alias("label"))
    n = {(r["label"], r["part"]): r["n"] for r in joins.stratified_split(d, "label", 0.7, 3, "id").groupBy("label", "part").agg(F.count("*").alias("n")).collect()}
    assert n == {("rare", "train"): 210, ("rare", "test"): 90, ("common", "train"): 1680, ("common", "test"): 720, (None, "train"): 210, (None, "test"): 90}


def test_bootstrap_draws_columns_apart(spark):
    d = spark.range(500).select("id", F.col("id").alias("a"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("b"))
    got = joins.bootstrap(d, ["a", "b"], 1, "id")
    r = got.agg(F.count("*"), F.count("a"), F.count_distinct("a"), F.count("b"), F.avg((F.col("a") == F.col("b")).cast("int"))).first()
    assert r[0] == r[1] == 500 and 250 < r[2] < 380 and 200 < r[3] < 300 and r[4] < 0.05


def test_categories_rank_all_values(spark):
    d = spark.range(400).select((F.col("id") % 130).cast("string").alias("v"))
    rows = profile.categories(d, "v", 50).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 131)) and sum(r["category"] != "__other__" for r in rows) == 49
    assert [r["n"] for r in rows] == sorted((r["n"] for r in rows), reverse=True)


def test_a_tail_beyond_the_list_is_drawn_from_in_full(spark):
    d = spark.range(9000).select("id", F.when(F.col("id") < 3000, F.lit("often")).otherwise(F.concat(F.lit("v"), (F.col("id") % 3000).cast("string"))).alias("c"))
    (s,) = encode.fit(d.select("c"), {"c": "categorical"})
    assert s.tail == [] and s.tail_size == 3001 - 49 and "__other__" in s.categories
    back = encode.inverse_transform(encode.transform(d, [s], keep=["id"]), [s], "id", 1)
    r = back.agg(F.count("*"), F.count_distinct("c"), F.count_if(F.col("c") == "often"), F.count_if(F.col("c").isNull())).first()
    assert r[0] == 9000 and r[1] > 2000 and r[2] == 3000 and r[3] == 0


def test_masks_keep_formats_and_hide_values(spark):
    d = spark.range(400).select(F.format_string("ACC-%05d", F.col("id") + 10000).alias("v"))
    (m,) = masks.likeliest(d, "v")
    assert m["mask"] == "AAA-DDDDD" and m["alphabets"] == ["A", "C", "C", "-", "1", "0", "0123456789", "0123456789", "0123456789"]
    names = spark.createDataFrame([(f"{a}{'x' * i} {b}",) for i in range(15) for a, b in (("Ann", "Li"), ("Bo", "Day"))], "v string")
    irregular = masks.formats(names, "v").collect()
    assert len(irregular) == 30 and all(len(x) in (1, 10, 26) and x != "A" for r in irregular for x in r["alphabets"])
    few = spark.createDataFrame([("X-1",), ("X-2",), (None,), ("",)], "v string")
    assert masks.likeliest(few, "v")[0]["alphabets"][0] == "ABCDEFGHIJKLMNOPQRSTUVWXYZ"  # too few rows to tell a constant
    assert masks.likeliest(few.limit(0), "v") == []


def test_autoconfigure(spark):
    t = demo.retail(spark, 600)
    t = {k: v.persist() for k, v in t.items()}
    specs, beta = autoconfigure.autoconfigure(spark, t)
    o = specs["orders"]
    assert specs["customers"].primary_key == "customer_id" and o.primary_key == "order_id" and [f.parent for f in o.foreign_keys] == ["customers"]
    assert o.timeseries and o.sortby == ["order_date"] and not specs["customers"].timeseries and beta == 50 and 4 <= o.max_degree <= 2000
    assert len(o.domain["category"]["force_categories"]) == 7 and o.domain["amount"]["min_val"] > 0
    assert autoconfigure.as_rows(spark, specs).filter("table_name = 'orders' and key = 'foreign'").count() == 1
    assert autoconfigure.domain_categories(t["orders"], []) == {}


def test_demo_tables(spark):
    b = demo.banking(spark, 400)
    h = b["customer_holding"]
    assert h.count() == 400 and h.select("cif").distinct().count() == 400 and 0 < h.filter("email is null").count() < 60
    for t in ("card_txn", "product_takeup", "service_request"):
        assert b[t].join(h, "cif", "left_anti").count() == 0 and b[t].count() > 300
        key = b[t].columns[0]
        assert b[t].select(key).distinct().count() == b[t].count()
    again = demo.banking(spark, 400)["card_txn"].repartition(5)
    assert b["card_txn"].exceptAll(again).count() == 0
    share = {r["segment"]: r["count"] / 400 for r in h.groupBy("segment").count().collect()}
    assert abs(share["MASS"] - 0.62) < 0.1


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, 'a"b', None), (2, "c,d", 1.5)], "id long, name string, x double").repartition(2)
    for kind in ("parquet", "csv"):
        (m,) = io.write_tables({"t": d}, f"file://{tmp_path}/{kind}", kind)
        assert m["rows"] == 2 and m["columns"] == 3 and m["bytes"] > 0
    n = io.export_one(d, f"file://{tmp_path}/one.csv")
    assert os.path.getsize(tmp_path / "one.csv") == n and not glob.glob(f"{tmp_path}/one.csv.parts")
    back = spark.read.options(header="true", escape="\\").csv(f"file://{tmp_path}/one.csv")
    assert back.columns == d.columns and {r["name"] for r in back.collect()} == {'a"b', "c,d"}


def test_evaluate_tables(spark):
    x = spark.range(900).select((F.col("id") % 97).cast("double").alias("a"), F.col("id").alias("key"), rng.uniform(1, "n", F.col("id")).alias("u"))
    x = x.select("key", "a", F.round(2 * F.col("a") + F.col("u")).alias("b"))
    u = rng.uniform(2, "p", F.col("key"))
    train, test, synth = x.filter(u < 0.4), x.filter((u >= 0.4) & (u < 0.7)), x.filter(u >= 0.7)
    got = {(r["table_name"], r["measure"], r["target"]): r["value"] for r in evaluate.evaluate_tables(spark, {"t": train, "s": train.limit(5)}, {"t": test, "s": test}, {"t": synth, "s": synth}, trees=5).collect()}
    assert got["t", "utility_ratio", "a"] > 0.8 and 0.3 < got["t", "detection_auc", None] < 0.7 and got["s", "skipped", None] == 5
    assert ("t", "utility_ratio", "key") not in got and got[None, "mean_detection_auc", None] == pytest.approx(got["t", "detection_auc", None])
