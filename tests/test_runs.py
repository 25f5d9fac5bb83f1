"""Training and generation in one call each, with both engines, saved and loaded where the shared folder's tables are gone."""

import glob

from pyspark.sql import functions as F

from tessera.functions import rng
from tessera.operators.arf import ARFParams
from tessera.operators.relational import RelationalModel
from tessera.operators.spn import SPNParams
from tessera.plans import pipeline
from tessera.types import ForeignKey, TableSpec


def tables(spark, n=400):
    u = lambda k: rng.uniform(1, k, F.col("id"))
    c = spark.range(n).select((F.col("id") + 1000).alias("client_id"), F.format_string("CL-%05d", F.col("id") * 13).alias("ref"), F.when(u("s") < 0.5, "gold").otherwise("plain").alias("segment"), F.round(u("b") * 1000, 2).alias("balance"))
    t = spark.range(3 * n).select((F.col("id") + 5000).alias("txn_id"), (F.floor(u("c") * n) + 1000).alias("client_id"), F.round(u("a") * 50, 2).alias("amount"), F.when(u("k") < 0.3, "in").otherwise("out").alias("way"))
    return {"client": c, "txn": t}, {"client": TableSpec("client", "client_id"), "txn": TableSpec("txn", "txn_id", [ForeignKey("txn", ["client_id"], "client", ["client_id"])])}


def test_runs(spark, tmp_path):
    data, specs = tables(spark, 200)
    got = pipeline.run_training(spark, data, f"file://{tmp_path}/run", specs, params=SPNParams(beta=500, max_depth=1), trees=2)
    assert 0.5 < got["fidelity"] <= 1 and got["status"] in ("PASS", "WARN")
    assert {x.split("/")[-1] for x in glob.glob(f"{tmp_path}/run/*")} == {"model", "report", "checks", "decisions", "utility"}
    out, warnings = pipeline.run_generation(spark, f"file://{tmp_path}/run/model", f"file://{tmp_path}/out", {"client": 150, "txn": 333})
    assert {x["table"]: x["rows"] for x in out} == {"client": 150, "txn": 333} and {r["edge"] for r in warnings.collect()} == {"client to txn"}
    client, txn = (spark.read.parquet(f"file://{tmp_path}/out/{t}.parquet") for t in ("client", "txn"))
    assert txn.join(client, "client_id", "left_anti").isEmpty() and client.select("ref").distinct().count() == 150
    assert client.filter(~F.col("ref").rlike("^[A-Z]{2}-[0-9]{5}$")).isEmpty() and client.join(data["client"], "ref", "left_semi").isEmpty()


def test_forests_are_saved_with_their_tables(spark, tmp_path):
    data, specs = tables(spark, 200)
    m = RelationalModel({"client": specs["client"]}, ARFParams(trees=2, max_depth=3, rounds=1)).fit({"client": data["client"]})
    m.save(spark, f"file://{tmp_path}/m")
    back = RelationalModel.load(spark, f"file://{tmp_path}/m")
    a, b = (x.sample(spark, {"client": 60})["client"] for x in (m, back))
    assert a.exceptAll(b).isEmpty() and a.count() == 60 and a.select("ref").distinct().count() == 60
    e = back.models["client"].engine
    paths = [e.to_json()["leaves_table"], *(s.formats_table for s in e.specs if s.formats_table)]
    assert len(paths) == 2 and all(str(tmp_path) in p for p in paths)


def test_integrity_is_checked_on_written_tables(spark, monkeypatch):
    from tessera.operators import report
    from tessera.plans import models

    seen, one = {}, spark.range(3).select(F.col("id").alias("customer_id"))
    monkeypatch.setattr(models, "_generated", lambda s, d: ({}, {"customer": one}))
    monkeypatch.setattr(report, "check_integrity", lambda s, real, synth, specs: seen.update(synth))
    models.integrity_of_generation(spark, "")
    assert seen["customer"].inputFiles() and seen["customer"].count() == 3
