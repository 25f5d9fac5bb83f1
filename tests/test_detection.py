"""Detection scores every held-out row of both sides, whatever the number of rows or copies."""

from pyspark.sql import functions as F

from tessera.operators import evaluate


def test_all_held_out_rows_are_scored(spark, monkeypatch):
    seen = {}
    auc = evaluate.auc

    def spy(scored, score, label, *weight):
        n = F.col(weight[0]) if weight else F.lit(1)
        seen.update({r[label]: r["n"] for r in scored.groupBy(label).agg(F.sum(n).alias("n")).collect()})
        return auc(scored, score, label, *weight)

    monkeypatch.setattr(evaluate, "auc", spy)
    real, synth = (spark.range(6000).select((F.col("id") % 1500 + k).cast("double").alias("x")) for k in (0, 700))
    a, _, _ = evaluate.detection(real, synth, ["x"], most=500, trees=5)
    assert all(abs(seen[y] - 1800) < 200 for y in (0.0, 1.0)) and a > 0.6


def test_copies_of_one_row_do_not_fill_the_sample(spark):
    n = 3000
    for seed in range(3):  # one tuple with more copies than the sample on both sides; all else differs
        copies = spark.range(n).select(F.lit(1.0).alias("x"))
        real, synth = (copies.unionByName(spark.range(n).select((F.col("id") % 400 + k).cast("double").alias("x"))) for k in (1000, 5000))
        a, _, _ = evaluate.detection(real, synth, ["x"], most=1000, trees=5, seed=seed)
        assert 0.85 < a < 0.9  # half of each side is alike, and the rest is told apart: 1 - 1/8


def test_weights_are_copies(spark):
    d = spark.createDataFrame([(0.1, 0.0, 3), (0.1, 1.0, 1), (0.7, 1.0, 5), (0.4, 0.0, 2), (0.9, 0.0, 1)], "s double, y double, n int")
    many = d.select("s", "y", F.explode(F.sequence(F.lit(1), F.col("n"))))
    assert abs(evaluate.auc(d, "s", "y", "n") - evaluate.auc(many, "s", "y")) < 1e-12
