"""Near-duplicates, repeated passages and the pipeline against brute force."""

import hashlib
import random

import numpy as np
import xxhash

import corpus_pipeline
from test_near import brute

from tessera.llm import common, components, passages, simhash, suffixes


def brute_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def roots(n, pairs):
    p = list(range(n))

    def top(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        p[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def test_fingerprints():
    for t in [None, "", " \n", "one", "one two", "A b C d e", "ÀB cd\x0bef\x1cgh ij " * 30, "x " * 9000]:
        assert simhash.fingerprint(common.utf8(t)) % 2**64 == brute_fingerprint(t), t


def test_bit_sliced_links_equal_brute_force():
    rnd = random.Random(4)
    fp, bucket = [], []
    for b in range(6):
        base = rnd.getrandbits(64)
        size = [1, 3, 64, 65, 200, 2][b]
        group = {base} | {base ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 4))) for _ in range(size)} if size > 1 else {base}
        fp += sorted(group)
        bucket += [b] * len(group)
    for radius in (0, 1, 2):
        pairs = [(i, j) for i in range(len(fp)) for j in range(i) if bucket[i] == bucket[j] and bin(fp[i] ^ fp[j]).count("1") <= radius]
        got = simhash.bit_sliced_links(np.array(bucket), np.array(fp, np.uint64), radius, chunk=100)
        assert got.tolist() == roots(len(fp), pairs)


def test_components(spark):
    edges = [(i, i + 1) for i in range(200) if i % 50] + [(7, 7), (1000, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 50 * ((i - 1) // 50) + 1 for i in range(1, 200) if i in got) and got[1000] == 1
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", 8)  # also through the finer buckets
    rnd = random.Random(6)
    base = [rnd.getrandbits(64) for _ in range(20)]
    fps = [b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 3))) for b in base for _ in range(15)] + [0, 0, 3, 2**64 - 1]
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    d = spark.createDataFrame([(i, f) for i, f in enumerate(signed)] + [(None, 0)], "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash.group(d).collect()}
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2])
    assert [got[f] for f in signed] == want


def test_simhash_query(spark, sf):
    rows = simhash.op7_simhash(spark, sf).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(docs)
    fp = {i: brute_fingerprint(docs[i]) for i in ids}
    want = roots(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if bin(fp[ids[a]] ^ fp[ids[b]]).count("1") <= 2])
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (format(fp[i], "016x"), ids[w]) for i, w in zip(ids, want, strict=True)}


def test_suffix_ranks_equal_sorting(spark):
    rnd = random.Random(8)
    strings = [[rnd.randint(1, rnd.choice([1, 2, 3])) for _ in range(rnd.randint(1, 30))] for _ in range(30)]
    strings += [strings[0], [1] * 40, [1] * 40]
    d = spark.createDataFrame(list(enumerate(strings)), "s long, c array<long>")
    rank = {t: k + 1 for k, t in enumerate(sorted({tuple(c[i:]) for c in strings for i in range(len(c))}))}
    got = {(r["s"], r["i"]): r["r"] for r in suffixes.final_ranks(d).collect()}
    assert got == {(s, i): rank[tuple(c[i:])] for s, c in enumerate(strings) for i in range(len(c))}


def brute_removal(texts, size=400):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for p in range(len(b) - size + 1):
            seen[b[p : p + size]] = seen.get(b[p : p + size], 0) + 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if seen[b[p : p + size]] > 1:
                gone[p : p + size] = b"\1" * size
        spans = sum(gone[i] and (not i or not gone[i - 1]) for i in range(len(b)))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def fixture():
    rnd = random.Random(10)
    words = ["".join(rnd.choice("abcdefghé") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    p, q, r = prose(120), prose(75), prose(60)
    short = p[:300]
    texts = [None, "", "tiny", "tiny", prose(300), prose(50) + p + prose(50), prose(20) + p, p + prose(30), prose(30) + q + prose(9) + q + prose(3), q[5:] + r, prose(8) + q + r + prose(2), short + prose(90), short + prose(90)]
    whole = prose(200)
    texts += [whole, whole, whole + "x", "y" + whole, "=" * 450, "-" * 1200, "-" * 399 + "=" * 399, "ab" * 300, "ab" * 150 + prose(80)]
    texts += [prose(10) + p[k : k + 420 + 3 * k] + prose(10) for k in range(0, 60, 7)]
    return texts


def test_passages_equal_brute_force(spark):
    texts = fixture()
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumnRenamed("nothing", "x").repartition(3)
    out = passages.cut(d, passages.spans(d))
    got = {r["doc_id"]: (r["kept"]["n_bytes"], r["kept"]["n_removed"], r["kept"]["n_spans"], hashlib.sha256(bytes(r["kept"]["kept"])).hexdigest()) for r in out.collect()}
    want = brute_removal(texts)
    assert [got[i] for i in range(len(texts))] == want


def test_passages_of_nothing(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert passages.cut(d, passages.spans(d)).count() == 0
    one = spark.createDataFrame([(1, None), (2, "short")], "doc_id long, text string")
    assert passages.cut(one, passages.spans(one)).filter("kept.n_removed > 0").count() == 0


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    state = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = common.written(stage(spark, state, sf), name)
        assert new.columns == docs.columns and 0 < new.count() <= state.count(), name
        if name == "simhash_near_dedup":
            before = {r["doc_id"]: r["text"] for r in state.collect()}
            ids = sorted(before)
            assert {r["doc_id"] for r in new.collect()} == {ids[i] for i in brute([before[i] for i in ids])}
        if name == "passage_dedup":
            assert {r["doc_id"] for r in new.collect()} == {r["doc_id"] for r in state.collect()}
        state = new
    packed = corpus_pipeline.STAGES[-1][1](spark, state, sf)
    assert packed.select("doc_id").distinct().count() == state.count() and corpus_pipeline.ORACLE_SQL is None
