"""Whole models: what their queries give on real tables."""

from pyspark.sql import functions as F

from tessera.operators import arf, encode
from tessera.plans import catalog
from tessera.plans.tables import load


def test_model_queries_follow_the_data(spark, sf):
    q = catalog.queries()
    o = load(spark, sf, "orders")
    drawn = q["spn_fit_sample"](spark, sf)
    assert drawn.count() == o.count()
    share = lambda d: {r["status"]: r["n"] for r in d.groupBy("status").agg((F.count("*") / d.count()).alias("n")).collect()}
    a, b = share(o), share(drawn)
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 0.08 for k in a)
    clusters = q["kmeans_split"](spark, sf).collect()
    assert sum(r["n"] for r in clusters) == load(spark, sf, "lineitem").count() and len(clusters) == 3
    assert len(q["dp_kmeans"](spark, sf).collect()) == 3


def test_tstr_query_finds_what_copies_predict(spark, sf):
    rows = catalog.queries()["tstr"](spark, sf).collect()
    assert "mktsegment" in {r["target"] for r in rows} and all(0 <= r["ratio"] <= 2 for r in rows)


def test_evidence_keeps_rows_and_given_values(spark, sf):
    c = load(spark, sf, "customer").select("customer_id", "acctbal", "mktsegment")
    specs = encode.fit(c.drop("customer_id"))
    m = arf.ARF(arf.ARFParams(trees=3, max_depth=4, rounds=1), specs).fit(encode.transform(c, specs, keep=["customer_id"]), "customer_id")
    rows = spark.range(40).select(F.col("id").alias("rid"), F.lit(7).alias("kept"))
    out = m.sample(rows, "rid", 1, "t", {"mktsegment": F.lit(1.0)}).collect()
    assert len(out) == 40 and {r["mktsegment"] for r in out} == {1.0} and {r["kept"] for r in out} == {7}
