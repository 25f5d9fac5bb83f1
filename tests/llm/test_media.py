"""FLAC: the query's whole result by its own definition, and PCM blocks by their sample offsets."""

import hashlib
import zlib

from pyspark.sql import functions as F

from tessera.llm import common, flac


def test_query_equals_its_definition(spark, sf):
    rows = {r["doc_id"]: r for r in flac.op5_flac(spark, sf).collect()}
    docs = common.table(spark, sf, "documents").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        p, r = flac.padded(d["text"]), rows[d["doc_id"]]
        (m,) = flac.encode([p])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(common.utf8(d["text"])), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(m), hashlib.sha256(m).hexdigest(), flac.feature(p))


def test_blocks_can_be_sought(spark):
    texts = [None, "", "short", "some words in a row " * 2000, "x" * 192 * 32]
    d = spark.createDataFrame([*enumerate(texts), (3, texts[3])], "doc_id long, text string").withColumn("block", F.lit("clash"))
    media = flac.to_media(d)
    rows = flac.pcm_blocks(media).collect()
    of = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["block"])):
        assert r["first_sample"] == r["block"] * flac.SEEK_EVERY * flac.BLOCK
        of.setdefault(r["doc_id"], {})[r["first_sample"]] = bytes(r["pcm"])
    assert {i: b"".join(v for _, v in sorted(x.items())) for i, x in of.items()} == {i: flac.padded(t) for i, t in enumerate(texts)}
    stored = {r["doc_id"]: bytes(r["media"]) for r in media.collect()}
    at = max(of[3])
    assert flac.decode_from(stored[3], at, 3072) == of[3][at]
    assert flac.pcm_blocks(media.limit(0)).count() == 0
    assert flac.pcm_blocks(media.withColumn("media", F.lit(None).cast("binary"))).count() == 0
