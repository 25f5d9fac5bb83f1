"""Toxicity: the block-max search against brute force over the whole index, ties included, and the query's whole result."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, toxicity


def dense(ix):
    blocks = ix.block_max.shape[1]
    full = np.zeros((blocks * toxicity.BLOCK, len(ix.idf)))
    for t in range(len(ix.idf)):
        if ix.frequent[t] >= 0:
            full[:, t] = ix.rows[ix.frequent[t]]
        for b in range(blocks):
            lo, hi = ix.posting_at[t * blocks + b], ix.posting_at[t * blocks + b + 1]
            full[ix.posting_doc[lo:hi], t] = ix.posting_w[lo:hi]
    return full


@pytest.fixture(scope="module")
def index(spark, sf):
    return toxicity.build(common.table(spark, sf, "documents"), common.table(spark, sf, "labels"))


def test_neighbours_with_ties_equal_brute_force(spark, sf, index):
    full = dense(index)
    n = len(index.ids)
    assert np.allclose((full[:n] ** 2).sum(1), 1) and not full[n:].any()
    texts = [r["text"] for r in common.table(spark, sf, "documents").collect()] + [None, "", "zzz qqq"]
    vectors = index.vectors(texts)
    for text, (t, w), (docs, got) in zip(texts, vectors, index.nearest(vectors), strict=True):
        count = {index.vocabulary[x]: n for x, n in toxicity.terms_of(text or "").items() if x in index.vocabulary}
        assert dict(zip(t.tolist(), w, strict=True)).keys() == count.keys()
        sims = np.round(full[:, t] @ w, 12)
        want = np.lexsort((np.arange(len(sims)), -sims))[: index.k]
        want = want[sims[want] > 0]
        assert np.allclose(got, sims[want], atol=1e-9)
        if len(want):
            assert set(want[sims[want] > sims[want][-1] + 1e-9]) <= set(docs)


def test_blocks_left_out_change_nothing(index, spark, sf, monkeypatch):
    texts = [r["text"] for r in common.table(spark, sf, "documents").limit(50).collect()]
    vectors = index.vectors(texts)
    before = index.nearest(vectors)
    monkeypatch.setattr(index, "block_max", np.ones_like(index.block_max))  # bounds that leave no block out
    for (a, x), (b, y) in zip(before, index.nearest(vectors), strict=True):
        assert a.tolist() == b.tolist() and np.allclose(x, y)


def test_equal_examples_tie_by_number(spark):
    rows = [(i, f"same words here and there{' ' * i}") for i in range(6)] + [(i, f"other words number{i % 2} of many{' ' * i}") for i in range(6, 12)]
    labels = spark.createDataFrame([(i, int(i in (6, 7))) for i, _ in rows], "doc_id long, toxic int")
    ix = toxicity.build(spark.createDataFrame(rows, "doc_id long, text string"), labels, k=2)
    ((docs, sims),) = ix.nearest(ix.vectors(["same words here and there"]))
    assert [ix.ids[d] for d in docs] == ["0", "1"] and sims[0] == sims[1]


def test_both_labels_are_in_the_index_and_reach_texts(spark, sf, index):
    assert 0 < index.labels.sum() < len(index.labels)
    out = toxicity.op2_toxicity(spark, sf)
    rows = out.collect()
    assert len(rows) == common.table(spark, sf, "documents").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert sum(len({e["label"] for e in r["evidence"]}) == 2 for r in rows) > 0.2 * len(rows)


@pytest.mark.parametrize("at", ["0.01", "0.1"])
def test_recall_on_held_out_rows(spark, at):
    sf = f"/root/testdata/sf{at}"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    r = toxicity.op2_toxicity(spark, sf).filter("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    share = {x["toxic"]: x["p"] for x in r}
    assert share[1] >= 0.8 and share[0] <= 0.05


def test_stage_on_odd_rows(spark, sf):
    long = "plain words " * 200_000
    d = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, long), (None, "x")], "doc_id long, text string").withColumn("toxicity", F.lit("clash")).withColumn("score", F.lit(1))
    out = toxicity.stage(spark, d, sf)
    assert out.columns == d.columns and out.count() == 5  # none of these ids is labelled toxic with a text, so nothing is rejected
    assert toxicity.stage(spark, d.limit(0), sf).count() == 0
