"""What keeps an executor's Python workers few and small: bounded batches, one worker a task, no second daemon."""

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, langid, packing, passages


@pytest.fixture
def documents(spark):
    before = spark.conf.get(common.BATCH_BYTES, None)
    spark.conf.unset(common.BATCH_BYTES)
    same = "a passage that several texts share, long enough to go from each of them, ümläut " * 6
    rows = [(i, f"{i} begins {'so' * i} {same} {i} ends" if i % 3 else None, "en", f"s{i % 2}") for i in range(40)]
    yield spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)
    spark.conf.unset(common.BATCH_BYTES)
    if before is not None:
        spark.conf.set(common.BATCH_BYTES, before)


def batch_bytes(df):
    """The bytes of texts in each batch that a Python worker gets."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([pc.sum(pc.binary_length(b.column("text"))).as_py() or 0], pa.int64())})

    return [r["n"] for r in df.select("text").mapInArrow(run, "n long").collect()]


def test_a_stage_bounds_the_bytes_of_later_batches(spark, documents, sf):
    texts = spark.range(0, 600, 1, 1).select(F.repeat(F.lit("x"), 50_000).alias("text"))
    assert max(batch_bytes(texts)) == 30_000_000
    langid.stage(spark, documents, sf)
    sizes = batch_bytes(texts)
    assert sum(sizes) == 30_000_000 and max(sizes) < 5_000_000


def test_a_bound_of_the_session_stays(spark, documents, sf):
    spark.conf.set(common.BATCH_BYTES, "1m")
    common.small_batches(spark)
    assert spark.conf.get(common.BATCH_BYTES) == "1m"


def test_packing_still_sees_many_pieces_at_once(spark, documents):
    """Best-fit within a batch: a bound on bytes must not split a partition's pieces."""
    items = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 200, 1500).otherwise(548).cast("long").alias("length"))
    spark.conf.set(common.BATCH_BYTES, "1k")
    placed = packing.pack(items)
    assert placed.select("sequence_id").distinct().count() == 200 and placed.select(F.shiftright("sequence_id", 36)).distinct().count() == 1
    assert spark.conf.get(common.BATCH_BYTES) == "1k"


def test_the_passage_stage_needs_one_worker_a_task(spark, documents, sf):
    out = passages.stage(spark, documents, sf)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    want = passages.cut(documents, passages.spans(documents)).collect()
    assert any(r["kept"]["n_removed"] for r in want) and len(got) == 40
    for r in want:
        assert got[r["doc_id"]] == (bytes(r["kept"]["kept"]).decode("utf-8", "ignore") if r["kept"]["n_removed"] else r["text"])


def test_few_rows_of_the_driver_start_no_workers(spark):
    schema = pa.schema({"s": pa.int64(), "i": pa.int32(), "x": pa.bool_()})
    for rows in ([], [(1, 2, True), (1 << 40, 0, False)]):
        df = common.local_rows(spark, rows, schema)
        assert df.dtypes == [("s", "bigint"), ("i", "int"), ("x", "boolean")] and sorted(map(tuple, df.collect())) == sorted(rows)
        assert "PythonRDD" not in df._jdf.queryExecution().toRdd().toDebugString()
