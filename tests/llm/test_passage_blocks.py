"""Passages: work in small blocks gives what work on whole texts gives, and every string is judged as brute force judges it."""

import collections
import random
import re

import numpy as np
import pytest

from tessera.llm import common, passages

SIZE = 400


def texts():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, long = prose(150), prose(4000)
    out = [prose(300) + shared + prose(200), "", shared, prose(30), long, long[:9000] + "X" + long[9000:], "ab" * 3000 + prose(20), "ab" * 700, prose(100)]
    raw = [t.encode() for t in out]
    return np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])]


@pytest.mark.parametrize("block", [1000, 4096])
def test_blocks_change_nothing(monkeypatch, block):
    data, off = texts()
    one = lambda: {(int(i), int(p), int(h)) for i, p, h in zip(*passages.anchors(data, off, SIZE), strict=True)}
    whole = one()
    again = [np.array([p for i, p, h in whole if i == k and h % 3 == 0], np.int64) for k in range(len(off) - 1)]
    runs = passages.candidates(data, off, again, SIZE)
    monkeypatch.setattr(passages, "BLOCK", block)
    assert one() == whole
    covered = lambda rs: {(i, p) for i, lo, hi in rs for p in range(lo, hi - SIZE + 1)}
    small = passages.candidates(data, off, again, SIZE)
    assert covered(small) == covered(runs)
    parts = list(passages._parts(small, SIZE))
    starts = [(i, p) for i, lo, hi in parts for p in range(lo, hi - SIZE + 1)]
    assert len(starts) == len(set(starts)) and set(starts) == covered(small) and max(hi - lo for _, lo, hi in parts) <= block


def test_every_string_has_a_least_anchor_among_those_found():
    data, off = texts()
    found = {(int(i), int(p)) for i, p, _ in zip(*passages.anchors(data, off, SIZE), strict=True)}
    for k, (lo, hi) in enumerate(zip(off[:-1], off[1:], strict=True)):
        for p in range(0, max(hi - lo - SIZE + 1, 0), 7):
            assert any((k, q) in found for q in range(p, p + SIZE - passages.ANCHOR + 1))


def test_periodic_runs_are_what_they_say():
    rnd = random.Random(2)
    for unit in (b"x", b"ab", b"Und ", b"a longer unit of some forty bytes, more "):
        head = bytes(rnd.choice(b"abcdefgh ") for _ in range(500))
        a = np.frombuffer(head + unit * (6000 // len(unit)) + head[::-1], np.uint8)
        t = passages.phrase_table(a, np.array([0, len(a)]), SIZE)
        runs = passages.periodic(a, t["at"], t["c"], SIZE)
        assert runs and sum(e - b for b, e, _ in runs) > 4000
        for b, e, g in runs:
            assert (a[b : e - g] == a[b + g : e]).all()


def test_a_very_long_text_takes_little_memory():
    import tracemalloc

    data = np.random.default_rng(1).integers(97, 123, 8_000_000, dtype=np.uint8)
    tracemalloc.start()
    passages.anchors(data, np.array([0, len(data)]), SIZE)
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()


def brute(texts):
    """The texts without each byte that a repeated string of 400 bytes covers, or one of 50 words."""
    raw = [(t or "").encode() for t in texts]
    words = [[(m.start(), m.end()) for m in re.finditer(rb"[^ \t-\r]+", b)] for b in raw]
    strings = [[(p, p + SIZE, b[p : p + SIZE]) for p in range(len(b) - SIZE + 1)] for b in raw]
    passages_ = [[(w[p][0], w[p + 49][1], b" ".join(b[x:y] for x, y in w[p : p + 50])) for p in range(len(w) - 49)] for b, w in zip(raw, words, strict=True)]
    out = []
    for every in (strings, passages_):
        seen = collections.Counter(s for one in every for _, _, s in one)
        out.append([[(lo, hi) for lo, hi, s in one if seen[s] > 1] for one in every])
    kept = []
    for t, b, *runs in zip(texts, raw, *out, strict=True):
        gone = bytearray(len(b))
        for lo, hi in runs[0] + runs[1]:
            gone[lo:hi] = b"\1" * (hi - lo)
        kept.append(bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore") if any(gone) else t)
    return kept


def test_the_stage_takes_passages_of_fifty_words(spark):
    rnd = random.Random(11)
    word = lambda most: "".join(rnd.choice("abcdefgh\u00e9") for _ in range(rnd.randint(1, most)))
    prose = lambda n, most=7: " ".join(word(most) for _ in range(n))
    fifty, few, long = prose(55, 5), prose(49), prose(40, 20)
    assert len(fifty.encode()) < SIZE and len(long.encode()) > SIZE
    out = [None, "", " ", prose(30) + " " + fifty + " " + prose(40), fifty + "\n" + prose(60), prose(70) + "  " + fifty.replace(" ", "\t ", 3), fifty]
    out += [prose(20) + " " + few + " " + prose(20), prose(25) + " " + few, prose(9) + long + " " + prose(9), prose(30) + " " + long, "a " * 120, "a " * 49 + "b", prose(8) + " of the" * 300]
    out += [prose(20) + " " + "x" * 700 + " " + fifty, " ".join(fifty.split()[2:53]) + " " + prose(3), "y" + fifty[1:], prose(80), prose(60)]
    whole = prose(52, 3)
    out += [whole, whole, prose(45, 3)]
    d = spark.createDataFrame(list(enumerate(out)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in passages.stage(spark, common.written(d, "docs"), "").collect()}
    assert [got[i] for i in range(len(out))] == brute(out)
    assert fifty not in " ".join(t or "" for t in got.values()) and sum(few in (t or "") for t in got.values()) == 2


def test_words_are_hashed_alike_wherever_they_stand(monkeypatch):
    rnd = random.Random(3)
    texts_ = ["", " ", "a", "one  two\tone", "z" * 700 + " " + "z" * 700 + " " + "z" * 350 + "y" + "z" * 349, "", " ".join("w" * rnd.randint(1, 300) for _ in range(400)), ""]
    raw = [t.encode() for t in texts_]
    data, off = np.frombuffer(b"??" + b"".join(raw) + b"??", np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])] + 2
    codes, bounds = passages.word_codes(data, off)
    monkeypatch.setattr(passages, "BLOCK", 512)
    assert (passages.word_codes(data, off)[0] == codes).all()
    got = [codes[a:b].view("<u8").tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    words = [r.split() for r in raw]
    assert [len(g) for g in got] == [len(w) for w in words]
    pairs = {(w, g) for ws, gs in zip(words, got, strict=True) for w, g in zip(ws, gs, strict=True)}
    assert len(pairs) == len({w for w, _ in pairs}) == len({g for _, g in pairs})


def test_no_prefix_brings_a_row_of_every_segment_to_one_task(spark, monkeypatch):
    """Places without a short prefix must not meet under one key, and are judged all the same."""
    rnd = random.Random(11)
    prose = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    # of each pair a string of 400 to 409 bytes, which has few whole phrases
    texts = [prose(300) + shared + prose(300) for shared in (prose(400 + i % 10) for i in range(60)) for _ in range(2)]
    dealt, join = [], type(spark.range(1)).join

    def told(self, other, on=None, how=None):
        if on == "short" and how == "left_semi":
            dealt.append((self.groupBy("short").count().agg({"count": "max"}).first()[0], self.select("s").distinct().count()))
        return join(self, other, on, how)

    monkeypatch.setattr(type(spark.range(1)), "join", told)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["kept"]["n_removed"] for r in passages.cut(d, passages.spans(d)).collect()}
    where = collections.defaultdict(set)
    for i, t in enumerate(texts):
        for p in range(len(t) - SIZE + 1):
            where[t[p : p + SIZE]].add((i, p))
    gone = collections.defaultdict(set)
    for places in where.values():
        if len(places) > 1:
            for i, p in places:
                gone[i] |= set(range(p, p + SIZE))
    assert got == {i: len(gone[i]) for i in range(len(texts))} and min(got.values()) >= SIZE
    assert dealt and all(most <= 4 < 60 <= segments for most, segments in dealt)
