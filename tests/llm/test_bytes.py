"""Operators that store and restore: FLAC, WARC, pieces, packing."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, flac, packing, pieces, warc

TEXTS = [None, "", "a", "hello world " * 40, "日本語 \U0001f600 ß\x00 ü", "x" * 5000, "it's <|endoftext|> !!'s ΣΑΣ H̱ello İs 123  ▁▁b c\x1cd\x85e", " lead  and trail ", "\n\t\n"]


def test_flac_round_trip():
    rnd = random.Random(1)
    payloads = [flac.padded(t) for t in TEXTS] + [bytes(rnd.randrange(256) for _ in range(192 * 5)), bytes([0, 255] * 192), bytes(192 * 40)]
    media = flac.encode(payloads)
    assert flac.decode(media) == payloads and flac.encode(payloads[2:4]) == media[2:4]
    assert flac.decode_from(media[5], 1000, 777) == payloads[5][1000:1777] and flac.decode_from(media[-1], 192 * 39 + 5, 9999) == payloads[-1][192 * 39 + 5 :]


def test_flac_checks_its_sums():
    media = bytearray(flac.encode([flac.padded("some text " * 100)])[0])
    media[-10] ^= 1
    with pytest.raises(ValueError):
        flac.decode([bytes(media)])
    with pytest.raises(ValueError):
        flac.decode([b"RIFFxxxx"])


def bits(*fields):
    s = "".join(format(v & (1 << n) - 1, f"0{n}b") for v, n in fields)
    return s


def frame(body, number=0):
    head = bytes([0xFF, 0xF8, 0x10, 0x02, number])
    crc = lambda d, t, n: int(flac.checksums(np.frombuffer(d, np.uint8), np.array([0]), np.array([len(d)]), t, n)[0])
    body += "0" * (-len(body) % 8)
    raw = head + bytes([crc(head, flac.CRC8, 8)]) + int(body, 2).to_bytes(len(body) // 8)
    return raw + crc(raw, flac.CRC16, 16).to_bytes(2)


def decode_one(raw):
    return flac.decode_frames(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]), np.array([0]))[0].tolist()


def test_flac_subframes_of_other_encoders():
    assert decode_one(frame(bits((0, 8), (-7, 8)))) == [-7] * 192
    # second order, two partitions, the second one raw with three bits
    zig = lambda r, k: "0" * (((r << 1) ^ (r >> 31)) >> k) + "1" + (format(((r << 1) ^ (r >> 31)) & (1 << k) - 1, f"0{k}b") if k else "")
    res = [(i % 5) - 2 for i in range(190)]
    body = bits((0b001010 << 1, 8), (3, 8), (5, 8), (0, 2), (1, 4), (1, 4)) + "".join(zig(r, 1) for r in res[:94]) + bits((15, 4), (3, 5)) + bits(*[(r, 3) for r in res[94:]])
    x = [3, 5]
    for r in res:
        x.append(2 * x[-1] - x[-2] + r)
    assert decode_one(frame(body)) == x
    # a long unary part
    body = bits((0b001000 << 1, 8), (0, 2), (0, 4), (0, 4)) + zig(60, 0) + "1" * 191
    assert decode_one(frame(body))[:2] == [60, 0]


def test_flac_query(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)) + [(50, TEXTS[3])], "doc_id long, text string").withColumn("media", F.lit(1))
    got = {r["doc_id"]: r for r in flac.from_media(flac.to_media(d)).collect()}
    for i, t in enumerate(TEXTS):
        p = flac.padded(t)
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["tail_crc32"]) == (len((t or "").encode()), len(p), zlib.crc32(p[-16:]))
    assert got[50]["media_sha256"] == got[3]["media_sha256"] and got[0]["payload_sha256"] == got[1]["payload_sha256"]
    assert flac.to_media(d.limit(0)).count() == 0


def test_warc_round_trip_and_damage():
    parts = [warc.member("response", "1", "http://x/\r\nInjected: 1", b"body" * 50), warc.member("revisit", "2", None, b"body" * 50, "1"), warc.member("response", "3", "u", b"")]
    got = list(warc.read(b"".join(parts)))
    assert [r.kind for r in got] == ["response", "revisit", "response"] and got[0].payload() == b"body" * 50 and "injected" not in got[0].headers
    with pytest.raises(ValueError):
        list(warc.read(parts[0][:-5]))
    import gzip

    bad = gzip.compress(gzip.decompress(parts[0]).replace(b"bodybody", b"bodyBODY", 1))
    with pytest.raises(ValueError):
        list(warc.read(bad))


def test_warc_plan(spark):
    big = "y" * 150
    rows = [(5, "u", big), (3, "u", big), (9, None, big), (1, "u", "small"), (2, "u", "small"), (7, "u", None), (8, "u", ""), (None, "u", "z" * 200), (4, "u", "z" * 200)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = sorted(((r["page"], r["record_type"], r["back"]) for r in warc.scan(warc.write(warc.plan(d))).collect()), key=str)
    assert got == sorted([("5", "revisit", "3"), ("3", "response", None), ("9", "revisit", "3"), ("1", "response", None), ("2", "response", None), ("7", "response", None), ("8", "response", None), (None, "response", None), ("4", "response", None)], key=str)
    assert warc.scan(warc.write(warc.plan(d.limit(0)))).count() == 0


def test_pieces_equal_the_library():
    import sentencepiece

    path = common.tokenizer_path(pieces.VOCABULARY)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(3)
    texts = [t for t in TEXTS if t] + ["".join(rnd.choice("abcde the ing  ation éüñ\n\t.,!$%0123456789") for _ in range(200)) for _ in range(150)]
    for t, ids in zip(texts, pieces.encode_texts(texts, path), strict=True):
        assert ids.tolist() == sp.encode(t), t
        assert pieces.decode_ids(ids, path) == t.replace("▁", " ")
    assert [len(x) for x in pieces.encode_texts([None, ""], path)] == [0, 0]


def test_pieces_query(spark, sf):
    out = pieces.op3_sentencepiece(spark, sf)
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r["text_crc32"] == zlib.crc32(docs[r["doc_id"]].encode()) for r in out.collect())


def test_ids_equal_the_library():
    from tokenizers import Tokenizer

    path = common.tokenizer_path(packing.VOCABULARY)
    t = Tokenizer.from_file(path)
    for text, ids in zip(TEXTS, packing.tokenise(TEXTS, path), strict=True):
        assert ids.tolist() == [*t.encode(text or "", add_special_tokens=False).ids, 0], text


def check_packing(rows, size):
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in used.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= size
    return len(used)


def test_best_fit_is_tight(spark):
    rnd = random.Random(5)
    lengths = [rnd.randint(1, 700) for _ in range(4000)] + [2048] * 10
    d = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long").repartition(40)
    rows = packing.pack(d).collect()
    assert len(rows) == len(lengths) and check_packing(rows, 2048) <= 1.01 * sum(lengths) / 2048 + 1
    assert packing.pack(d.limit(0)).count() == 0


def test_packing_cuts_only_long_documents(spark):
    d = spark.createDataFrame([(1, "word " * 5000), (2, None), (3, ""), (3, ""), (None, "x y")], "doc_id long, text string").withColumn("length", F.lit("clash"))
    rows = packing.stage(spark, d, "").collect()
    check_packing(rows, 2048)
    assert [(r["piece"], r["start"], r["length"]) for r in sorted(rows, key=lambda r: r["piece"]) if r["doc_id"] == 1] == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 905)]
    assert sum(r["length"] == 1 for r in rows) == 3
