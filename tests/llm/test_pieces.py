"""SentencePiece encoding against the library: long chunks, runs of spaces, all documents."""

import base64
import random

import sentencepiece
from pyspark.sql import functions as F

from tessera.llm import common, pieces, words

PATH = common.tokenizer_path(pieces.VOCABULARY)


def test_runs_of_spaces_and_long_chunks_equal_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rnd = random.Random(3)
    texts = [" " * n + w for n in [*range(1, 40), 100, 257] for w in ("", "the", "日本", "x", "\n y", "\t", "ß")]
    texts += [base64.b64encode(rnd.randbytes(30_000)).decode(), "日本語の文章です。" * 3000, "x" * 50_000, "ab" * 30_000, "=-" * 9000 + "thethe" * 4000]
    texts += ["".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(30_000)), "ท" * 20_000, "\U0001f600" * 9000]
    for t, ids in zip(texts, pieces.encode_texts(texts, PATH), strict=True):
        assert ids.tolist() == sp.encode(t), t[:40]


def test_blocks_that_disagree_are_done_again(monkeypatch):
    monkeypatch.setattr(pieces, "OVERLAP", 50)  # so short that few blocks can agree
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    m = pieces.Matcher(PATH)
    t = base64.b64encode(random.Random(1).randbytes(9000)).decode()
    ids, count = m._relaxed([pieces.MARK.encode() + t.encode(), b"x"], 128)
    assert ids[: count[0]].tolist() == sp.encode(t)


def test_query_ids_equal_the_library(spark):
    sf = "/root/testdata/sf0.01"
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = common.table(spark, sf, "documents").select("doc_id", "text")
    got = {r["doc_id"]: r["ids"] for r in pieces.encode(docs).collect()}
    want = {r["doc_id"]: sp.encode(r["text"] or "") for r in docs.collect()}
    assert got == want


def test_rows_of_all_kinds(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    e = pieces.encode(d)
    assert sorted(len(r["ids"]) for r in e.collect()) == [0, 0, 1, 2, 2]
    assert sorted(r["text"] for r in pieces.decode(e.union(spark.createDataFrame([(9, None)], e.schema))).collect()) == ["", "", "", "a b", "a b", "x"]
    assert pieces.encode(d.limit(0)).count() == 0 and pieces.decode(e.limit(0)).count() == 0


def test_words_that_leave_a_generation_come_back():
    t = words.WordIds(lambda w: [[len(x), ord(x[0])] for x in w], most=3)
    for batch in (["a", "bb"], ["cc", "d"], ["a", "eee"], ["f", "bb", "a"], ["d", "d", "a"]):
        ids, size = t.ids(t.numbers(batch))
        assert ids.tolist() == [v for x in batch for v in (len(x), ord(x[0]))] and size.tolist() == [2] * len(batch)
