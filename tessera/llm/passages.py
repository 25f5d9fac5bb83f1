"""Suffix-array deduplication of passages.

A byte goes if a string of `size` bytes that covers it also begins anywhere else. The steps, each exact:

1. A string of `size` bytes has a least anchor: of its 64-byte substrings that of smallest hash. Where that anchor occurs once, so
   does the string; runs of other strings are segments, a fraction of the text. Equal texts count as one, known to be a copy. Of a
   long run of one short period only the ends are kept: the strings between repeat those at its beginning.
2. Segments are cut into phrases at minima of a 16-byte hash, so that equal strings are cut alike but near their ends. The phrases'
   hashes are symbols, and the distributed difference-cover algorithm (suffixes.py) sorts all phrase suffixes, to the depth of nine
   phrases or more; those that share so many stand together, equal long prefixes side by side.
3. Suffixes next to each other compare prefixes. A prefix of `size` bytes and one phrase more shared with a neighbour settles every
   string that begins in the phrase; a short prefix of two phrases shared with none settles that no string around it repeats.
4. What stays open, a few strings at the ends of each repeat, is compared by 128 bits of hash with all strings that hold the same short
   prefix at the same place.

The pipeline's stage also takes passages of 50 words, many of which have fewer bytes. A word is a hash of eight bytes, so that a text is a
second string of bytes, in which 50 words have 400; both strings of all texts go through the steps together. What begins within a
word's hash is left out at the end.

Tasks work on blocks of some 500 kB and carry one row from batch to batch, so memory grows neither with a text nor with a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.suffixes import flat, gather, merge_keys

GRAM, WINDOW = 16, 112  # of phrases
LEVELS = 1  # of recursion: suffixes are sorted by 3 ** (LEVELS + 1) phrases at least, some 500 bytes
PREFIX = 2  # phrases of a short prefix
ANCHOR = 64  # bytes of an anchor
BLOCK = 1 << 19  # bytes hashed at once
UNIT = 8  # bytes of a word's hash
_INSIDE = ~np.isin(np.arange(256), list(common.SPACES.encode()))  # bytes of words
LAGS, SPARED = 8, 256  # phrases of a period, and bytes that cutting a periodic run must spare
_M = [np.uint64((0x9E3779B97F4A7C15 + 0x6A09E667F3BCC908 * i) % 2**64 | 1) for i in range(16)]
_MASK = np.array([(1 << 8 * n) - 1 for n in range(8)], np.uint64)
_MOST = np.uint64(2**64 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def eights(a: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number; zeros follow the last byte."""
    padded = np.zeros(len(a) + 8, np.uint8)
    padded[: len(a)] = a
    return np.ndarray((len(a),), "<u8", padded.data, strides=(1,)).astype(np.uint64)


def power_hashes(v: np.ndarray, most: int, every: bool = True) -> list[np.ndarray]:
    """Hashes of all strings of 8, 16 .. most bytes, by where they begin, from eights; the last alone unless every is asked for."""
    out = [_mix(v[: max(len(v) - 7, 0)] * _M[0] + _M[1])]
    for k in range(3, most.bit_length() - 1):
        x, s = out[-1], 1 << k
        new = _mix(x[: max(len(x) - s, 0)] * _M[k] + x[s:])
        out = [*out, new] if every else [new]
    return out


def span_hash(v: np.ndarray, h: list[np.ndarray], at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of the string of some size (1 or more) at each place: of its first and last power of two of bytes, or of its few bytes."""
    at, size = np.broadcast_arrays(at, size)
    out = np.zeros(len(at), np.uint64)
    top = np.minimum(np.frexp(size.astype(float))[1] - 1, len(h) + 2)
    for j in np.unique(top):
        f = top == j
        p, n = at[f], size[f]
        few = j < 3
        x, y = (v[p] & _MASK[n], 0) if few else (h[j - 3][p], h[j - 3][p + n - (1 << int(j))])
        out[f] = _mix(_mix(x * _M[13]) * _M[14] + y * _M[15] + n.astype(np.uint64)) if few else _mix(x * _M[14] + y * _M[15] + n.astype(np.uint64))
    return out


def _over(y: np.ndarray, w: int, f, fill: int) -> np.ndarray:
    """f (minimum or maximum) of every w values in a row."""
    z = np.full(-(-len(y) // w) * w, fill, np.uint64)
    z[: len(y)] = y
    z = z.reshape(-1, w)
    left = f.accumulate(z, axis=1).ravel()
    right = f.accumulate(z[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(right[: len(y) - w + 1], left[w - 1 : len(y)])


def minima(x: np.ndarray, bounds: np.ndarray, span: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """x: hashes of span bytes of strings in a row. The least of every w in a row (0 if these are not of one string), and the places
    where a hash is the least of some such window (ties: all of them)."""
    n = int(bounds[-1])
    y = np.full(n, _MOST)
    y[: len(x)] = x[:n] | np.uint64(1)  # never 0
    least = np.zeros(n, np.uint64)
    if n >= w:
        least[: n - w + 1] = _over(y, w, np.minimum, 2**64 - 1)
    over = np.zeros(n + 1, np.int32)  # windows that would run over a string's end
    long = w - 1 + span - 1
    np.add.at(over, np.maximum(bounds[1:] - long, bounds[:-1]), 1)
    np.add.at(over, bounds[1:], -1)
    least[np.cumsum(over[:n]) > 0] = 0
    pad = np.zeros(w - 1, np.uint64)
    top = _over(np.concatenate([pad, least]), w, np.maximum, 0) if n else least
    return least, np.flatnonzero(y == top)


def blocks(off: np.ndarray, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of at most some BLOCK bytes of texts in a row, several to a block: text numbers, beginnings, ends. Parts of one text overlap."""
    which, begin, end, total = [], [], [], 0
    for i, (lo, hi) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        at = to = lo
        while to < hi:
            to = min(hi, at + BLOCK)
            if total and total + to - at > BLOCK:
                yield np.array(which), np.array(begin), np.array(end)
                which, begin, end, total = [], [], [], 0
            which.append(i)
            begin.append(at)
            end.append(to)
            total += to - at
            at = to - overlap
    if which:
        yield np.array(which), np.array(begin), np.array(end)


def _joined(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([data[a:b] for a, b in zip(begin, end, strict=True)]), np.r_[0, np.cumsum(end - begin)]


def word_places(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of texts in a row begin and end, and the bounds of each text's words among them."""
    inside = _INSIDE[data[: off[-1]]]
    inside[: off[0]] = False
    before, after = np.r_[False, inside[:-1]], np.r_[inside[1:], False]
    before[off[off < off[-1]]] = False
    after[off[off > 0] - 1] = False
    begin, end = np.flatnonzero(inside & ~before[: len(inside)]), np.flatnonzero(inside & ~after[: len(inside)]) + 1
    return begin, end, np.searchsorted(begin, off)


def word_codes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts in a row with a hash of UNIT bytes for each word, and their bounds."""
    import xxhash

    begin, end, bounds = word_places(data, off)
    out, n = np.zeros(len(begin), np.uint64), end - begin
    for lo, hi in _groups(begin // BLOCK):
        at, few = begin[lo:hi] - begin[lo], n[lo:hi] <= 256
        v = eights(data[begin[lo] : min(end[hi - 1], begin[hi - 1] + 256)])
        out[lo:hi][few] = span_hash(v, power_hashes(v, 128), at[few], n[lo:hi][few])
    for i in np.flatnonzero(n > 256).tolist():
        out[i] = xxhash.xxh64_intdigest(data[begin[i] : end[i]].tobytes(), 42)
    return out.astype("<u8").view(np.uint8), bounds * UNIT


def forms(text: pa.Array, words: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts in a row as bytes (0) and, if asked for, as hashes of words (1)."""
    data, off = common.buffers(text)
    yield 0, data, off
    if words:
        yield 1, *word_codes(data, off)


def anchors(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place in it and hash: the least anchor of every string of size bytes is among them."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for which, begin, end in blocks(off, size - 1):
        a, bounds = _joined(data, begin, end)
        x = power_hashes(eights(a), ANCHOR, False)[-1]
        _, p = minima(x, bounds, ANCHOR, size - ANCHOR + 1)
        k = np.searchsorted(bounds, p, "right") - 1
        out.append((which[k], p - bounds[k] + begin[k] - off[which[k]], x[p]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def candidates(data: np.ndarray, off: np.ndarray, again: list[np.ndarray], size: int) -> list[tuple[int, int, int]]:
    """Runs of strings of size bytes whose least anchor is one of those at the places again of a text: text, and the bytes it covers.

    Equal strings have equal least anchors, so any other string occurs once.
    """
    out: list[tuple[int, int, int]] = []
    for which, begin, end in blocks(off, size - 1):
        a, bounds = _joined(data, begin, end)
        x = power_hashes(eights(a), ANCHOR, False)[-1]
        least, _ = minima(x, bounds, ANCHOR, size - ANCHOR + 1)
        places = [again[i] + off[i] - b + at for i, b, at in zip(which, begin, bounds, strict=False)]
        places = np.concatenate([p[(p >= at) & (p + ANCHOR <= to)] for p, at, to in zip(places, bounds, bounds[1:], strict=False)])
        maybe = np.isin(least, x[places] | np.uint64(1)) if len(places) else np.zeros(len(least), bool)
        edge = np.diff(np.r_[0, maybe.astype(np.int8), 0])
        for lo, hi in zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1 + size).tolist(), strict=True):
            k = int(np.searchsorted(bounds, lo, "right")) - 1
            i, shift = int(which[k]), int(begin[k] - bounds[k] - off[which[k]])
            if out and out[-1][0] == i and lo + shift <= out[-1][2] - size + 1:  # goes on from the part before
                out[-1] = (i, out[-1][1], max(out[-1][2], hi + shift))
            else:
                out.append((i, lo + shift, hi + shift))
    return out


def _parts(runs: list[tuple[int, int, int]], size: int) -> Iterator[tuple[int, int, int]]:
    """Runs in parts of at most BLOCK bytes, so that every string of size bytes is in just one."""
    for i, lo, hi in runs:
        while hi - lo > BLOCK:
            yield i, lo, lo + BLOCK
            lo += BLOCK - size + 1
        yield i, lo, hi


def phrase_table(a: np.ndarray, bounds: np.ndarray, size: int) -> dict[str, np.ndarray]:
    """The phrases of segments in a row: of (which segment), at (place in it), c (symbol), upto, short and long.

    upto: the last window of the segment of which the phrase's cut is the least (the last of equals), -1 if none. short: hash of the
    phrase and the next (0: there is none). long: hash of the string that settles all those beginning in the phrase (0: the segment
    ends before).
    """
    v = eights(a)
    h = power_hashes(v, 256)
    least, cut = minima(h[1], bounds, GRAM, WINDOW)
    mark = np.zeros(len(a) + 1, bool)
    mark[cut] = mark[bounds[:-1]] = True
    at = np.flatnonzero(mark[:-1])
    of = np.searchsorted(bounds, at, "right") - 1
    stop = bounds[of + 1]
    end = np.minimum(np.r_[at[1:], len(a)], stop)
    n = end - at
    # the last cut in each window that is its least
    w = np.flatnonzero(least)
    k = np.searchsorted(at, w + WINDOW) - 1
    x = np.where(at < len(h[1]), h[1][np.minimum(at, max(len(h[1]) - 1, 0))] | np.uint64(1), np.uint64(0)) if len(h[1]) else np.zeros(len(at), np.uint64)
    todo = np.arange(len(w))
    while len(todo := todo[x[k[todo]] != least[w[todo]]]):
        k[todo] -= 1
    upto = np.full(len(at), -1)
    last = np.flatnonzero(np.r_[k[1:] != k[:-1], True]) if len(k) else np.zeros(0, int)
    upto[k[last]] = w[last] - bounds[of[k[last]]]
    two = np.minimum(np.arange(len(at)) + PREFIX, len(at) - 1)
    ok = (np.arange(len(at)) + PREFIX < len(at)) & (of[two] == of)
    short = np.where(ok, span_hash(v, h, at, np.where(ok, at[two] - at, 1)), np.uint64(0))
    fits = at + n + size <= stop
    long = np.where(fits, span_hash(v, h, at, np.where(fits, n + size, 1)), np.uint64(0))
    return {"of": of, "at": at - bounds[of], "c": span_hash(v, h, at, n).view(np.int64), "upto": upto, "short": short.view(np.int64), "long": long.view(np.int64)}


def periodic(a: np.ndarray, at: np.ndarray, c: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Long runs (begin, end, period) of a segment: there every byte equals the one a period on."""
    out: list[tuple[int, int, int]] = []
    for lag in range(1, min(LAGS, len(c) - 1) + 1):
        same = np.diff(np.r_[0, (c[lag:] == c[:-lag]).astype(np.int8), 0])
        for j, k in zip(np.flatnonzero(same == 1).tolist(), np.flatnonzero(same == -1).tolist(), strict=True):
            lo, g = int(at[j]), int(at[j + lag] - at[j])
            hi = int(at[k + lag - 1])
            if hi - lo >= 2 * size + 2 * g + SPARED and all(hi <= x or lo >= y for x, y, _ in out) and (a[lo : hi - g] == a[lo + g : hi]).all():
                out.append((lo, hi, g))
    return sorted(out)


def places(t: dict[str, np.ndarray], bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each string of size bytes of segments in a row: where it begins, whether it repeats for sure, whether it is open, a hash that equal
    strings share, and whether it needs comparing with strings elsewhere.

    The least of a string's first window of 16-byte hashes and that of its last are cuts in any equal string, with the same cuts
    between; so all phrases between occur around an equal string, and a short prefix among them that occurs once excludes one.
    """
    base, total = bounds[:-1], np.maximum(np.diff(bounds) - size + 1, 0)
    p = np.repeat(base - (np.cumsum(total) - total), total) + np.arange(total.sum())
    of, n = t["of"], int(bounds[-1])
    at, limit = t["at"] + base[of], (base + total)[of]
    end = np.minimum(np.r_[at[1:], n], bounds[of + 1])
    again = t["long_again"].astype(bool)
    sure = np.zeros(n + 1, np.int64)
    np.add.at(sure, np.minimum(at, limit)[again], 1)
    np.add.at(sure, np.minimum(end + 1, limit)[again], -1)
    sure = np.cumsum(sure)[p] > 0
    upto = np.maximum.accumulate(np.where(t["upto"] < 0, -1, t["upto"] + base[of]))
    first, last = np.searchsorted(upto, p), np.searchsorted(upto, p + size - GRAM - WINDOW + 1)
    short = t["short"]
    once = np.r_[0, np.cumsum((short != 0) & ~t["short_again"].astype(bool))]
    excluded = once[np.maximum(last - PREFIX + 1, first)] > once[first]
    shared = np.where(first + PREFIX <= last, short[np.minimum(first, len(short) - 1)], 0)
    # strings that begin in a phrase whose long prefix stands elsewhere too need comparing there only
    told = (again & ~t["long_first"].astype(bool))[np.searchsorted(at, p, "right") - 1]
    return p, sure, ~sure & ~excluded, shared, ~told


def _key(text) -> F.Column:
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


TABLE = ("c", "at", "upto", "short", "long")


def segments(docs: DataFrame, size: int, words: bool = False) -> tuple[DataFrame, DataFrame]:
    """docs (key, text): segments (s, key, words, begin, hi, bytes and phrases) of one document of each text, and (key, n) of the texts that
    occur n > 1 times. A row without bytes is a run of strings that repeat, from begin to hi. words: of hashes of words, not of the text."""
    places_of = ["again", "again_words"] if words else ["again"]

    def spread(c):
        # a text's two forms go by the two halves of its key
        half = np.array([(int.from_bytes(k[:8], "big", signed=True), int.from_bytes(k[8:], "big", signed=True)) for k in c["key"].to_pylist()], np.int64)
        found = []
        for form, data, off in forms(c["text"], words):
            which, at, h = anchors(data, off, size)
            found.append((half[which, form], at, h))
        short, at, h = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(h):
            return None
        place = _mix(short.view(np.uint64) * _M[3] + at.astype(np.uint64)).view(np.int64)
        return common.batch(h=h.view(np.int64), place=place, short=short, at=at.astype(np.int32))

    found = common.written(common.map_rows(docs.select("key", "text"), spread, "h long, place long, short long, at int"), "anchors")
    again = common.written(found.groupBy("h").agg(F.min("place").alias("a"), F.max("place").alias("b")).filter("a <> b").select("h"), "again")
    hits = found.join(again, "h", "left_semi").groupBy("short").agg(F.collect_set("at").alias("again"))
    copies = docs.groupBy("key").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    known = copies
    for i, name in enumerate(places_of):
        known = known.withColumn("short", F.conv(F.substring(F.hex("key"), 16 * i + 1, 16), 16, -10).cast("long")).join(hits.select("short", F.col("again").alias(name)), "short", "left").drop("short")
    somewhere = F.coalesce(*places_of).isNotNull()
    known = common.written(known.filter((F.col("n") > 1) | somewhere).select("key", "n", "first", *places_of), "known")

    def cut(c):
        of, begin, hi, piece, table, kind = [], [], [], [], [], []

        def put(form, which, pieces):
            a, bounds = np.concatenate(pieces), np.r_[0, np.cumsum([len(x) for x in pieces])]
            t = phrase_table(a, bounds, size)
            cuts = np.searchsorted(t["of"], np.arange(len(pieces) + 1))
            more = []
            for i, x in enumerate(pieces):
                one = {k: t[k][cuts[i] : cuts[i + 1]] for k in TABLE}
                doc, lo, whole = which[i]
                split = [] if whole or len(x) < 2 * size + SPARED else periodic(x, one["at"], one["c"], size)
                if not split:
                    of.append(doc)
                    kind.append(form)
                    begin.append(lo)
                    hi.append(lo + len(x) - size)
                    piece.append(x.tobytes())
                    table.append(one)
                    continue
                left = 0
                for b, e, g in split:
                    of.append(doc)
                    kind.append(form)
                    begin.append(lo + b)
                    hi.append(lo + e - size)
                    piece.append(None)
                    table.append({k: np.zeros(0, np.int64) for k in TABLE})
                    more.append((doc, lo + left, x[left : b + g + size - 1]))
                    left = e - size + 1
                more.append((doc, lo + left, x[left:]))
            return [m for m in more if len(m[2]) >= size]

        for form, data, off in forms(c["text"], words):
            again = [x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32) for x in c[places_of[form]]]
            todo, size_of = [], 0
            for i, lo, to in [*_parts(candidates(data, off, again, size), size), (-1, 0, 0)]:
                if todo and (i < 0 or size_of + to - lo > BLOCK):
                    more = put(form, [(d, b, False) for d, b, _ in todo], [x for _, _, x in todo])
                    if more:
                        put(form, [(d, b, True) for d, b, _ in more], [x for _, _, x in more])
                    todo, size_of = [], 0
                if i >= 0:
                    todo.append((i, lo, data[off[i] + lo : off[i] + to]))
                    size_of += to - lo
        if not of:
            return None
        at = pa.array(np.r_[0, np.cumsum([len(x["at"]) for x in table])], pa.int32())
        lists = {k: pa.ListArray.from_arrays(at, pa.array(np.concatenate([x[k] for x in table]).astype(np.int64))) for k in TABLE}
        key = c["key"].take(pa.array(of, pa.int64()))
        return common.batch(key=key, words=pa.array([k == 1 for k in kind]), begin=pa.array(begin, pa.int64()), hi=pa.array(hi, pa.int64()), bytes=pa.array(piece, pa.binary()), **lists)

    here = docs.join(known.filter(somewhere).select("key", "first", *places_of).hint("shuffle_hash"), ["key"]).filter("row = first")
    cuts = common.map_rows(here.select("key", "text", *places_of), cut, "key binary, words boolean, begin long, hi long, bytes binary, " + ", ".join(f"{k} array<long>" for k in TABLE), 256)
    cuts = common.written(cuts.withColumn("s", F.monotonically_increasing_id()), "segments")
    many = common.written(known.filter("n > 1").select("key", "n"), "many")
    common.free(found, again, known)
    return cuts, many


def repeats(cuts: DataFrame, size: int) -> DataFrame:
    """(s, lo, hi): runs of places in a segment (both ends included) at which a string of size bytes begins that also begins elsewhere."""
    strings = cuts.filter("bytes is not null")
    order = merge_keys(strings.select("s", "c"), LEVELS)
    keys = gather(order, "z", "e", "r").drop("i")
    both = strings.select("s", "short", "long").join(keys, "s").select("s", "short", "long", "z", "e", "r")

    def spread(batches):
        for b in batches:
            s = b.column(0).to_numpy()
            cols = [flat(b.column(k)) for k in range(1, 6)]
            n = np.diff(cols[0][1])
            i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            t = pa.RecordBatch.from_pydict({"s": np.repeat(s, n), "i": i.astype(np.int32)} | {k: pa.array(v) for k, (v, _) in zip(("short", "long", "k0", "k1", "k2"), cols, strict=True)})
            for lo in range(0, t.num_rows, 1 << 16):
                yield t.slice(lo, 1 << 16)

    rows = both.mapInArrow(spread, "s long, i int, short long, long long, k0 long, k1 int, k2 long")
    settled = adjacent(rows)
    flags = strings.select("s", "at", "upto", "short", F.octet_length("bytes").alias("n")).join(gather(settled, "short_again", "long_again", "long_first").drop("i"), "s")
    flags = common.written(flags, "flags")
    common.free(settled, order)

    def parts(b):
        """Some segments of a batch at a time: their numbers, lengths and tables."""
        cols = {k: flat(b.column(k)) for k in ("at", "upto", "short", "short_again", "long_again", "long_first")}
        s, n = b.column("s").to_numpy(), b.column("n").to_numpy().astype(np.int64)
        group = np.cumsum(n) // BLOCK
        for lo, hi in _groups(group):
            t = {k: v[o[lo] : o[hi]] for k, (v, o) in cols.items()}
            t["of"] = np.repeat(np.arange(hi - lo), np.diff(cols["at"][1])[lo:hi])
            bounds = np.r_[0, np.cumsum(n[lo:hi])]
            yield slice(lo, hi), s[lo:hi], bounds, places(t, bounds, size)

    def open_prefixes(batches):
        with common.lean():
            for b in batches:
                out = [np.unique(shared[open_]) for _, _, _, (_, _, open_, shared, _) in parts(b)]
                if out:
                    yield pa.RecordBatch.from_pydict({"short": pa.array(np.unique(np.concatenate(out)), pa.int64())})

    # a table, so that the join below may split a prefix that very many segments hold
    wanted = common.written(flags.mapInArrow(open_prefixes, "short long").distinct(), "wanted")
    # which phrases of a segment have such a prefix; any segment may have places without one (0), which are compared in any case
    has = flags.select("s", F.explode(F.array_distinct("short")).alias("short")).filter("short <> 0").join(wanted, "short", "left_semi")
    has = has.groupBy("s").agg(F.collect_set("short").alias("wanted"))
    todo = flags.join(strings.select("s", "bytes"), "s").join(has, "s", "left").withColumn("wanted", F.coalesce("wanted", F.array().cast("array<long>")))

    def compare(batches):
        with common.lean():
            for b in batches:
                data, off = common.buffers(b.column("bytes"))
                want, wo = flat(b.column("wanted"))
                for some, s, bounds, (p, _, open_, shared, alone) in parts(b):
                    at = np.flatnonzero(((shared == 0) | np.isin(shared, np.unique(want[wo[some.start] : wo[some.stop]]))) & alone)
                    if not len(at):
                        continue
                    v = eights(data[off[some.start] : off[some.stop]])
                    h = span_hash(v, power_hashes(v, 256), p[at], np.full(len(at), size))
                    of = np.searchsorted(bounds, p[at], "right") - 1
                    t = pa.RecordBatch.from_pydict({"h": h.view(np.int64), "short": shared[at], "s": s[of], "p": (p[at] - bounds[of]).astype(np.int32), "open": open_[at]})
                    for lo in range(0, t.num_rows, 1 << 15):
                        yield t.slice(lo, 1 << 15)

    windows = common.written(todo.mapInArrow(compare, "h long, short long, s long, p int, open boolean"), "windows")
    twice = common.written(windows.groupBy("h", "short").agg(F.count("*").alias("n"), F.max("open").alias("o")).filter("n > 1 and o").select("h", "short"), "twice")
    found = windows.filter("open").join(twice, ["h", "short"], "left_semi").groupBy("s").agg(F.collect_list("p").alias("found"))
    last = flags.join(found, "s", "left")

    def runs(batches):
        with common.lean():
            for b in batches:
                extra = b.column("found")
                for some, s, bounds, (p, sure, _, _, _) in parts(b):
                    hit = np.zeros(int(bounds[-1]) + 1, bool)
                    hit[p[sure]] = True
                    for j, i in enumerate(range(some.start, some.stop)):
                        if extra[i].is_valid:
                            hit[bounds[j] + extra[i].values.to_numpy()] = True
                    # a segment's last places begin no string, so runs never touch
                    edge = np.diff(np.r_[0, hit.astype(np.int8)])
                    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
                    of = np.searchsorted(bounds, lo, "right") - 1
                    yield pa.RecordBatch.from_pydict({"s": s[of], "lo": lo - bounds[of], "hi": hi - bounds[of]})

    done = common.written(last.mapInArrow(runs, "s long, lo long, hi long"), "runs")
    common.free(flags, wanted, windows, twice)
    return done


def _groups(g: np.ndarray) -> Iterator[tuple[int, int]]:
    at = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True]) if len(g) else np.zeros(1, int)
    yield from zip(at[:-1].tolist(), at[1:].tolist(), strict=True)


def adjacent(rows: DataFrame) -> DataFrame:
    """(s, i, short_again, long_again, long_first) of suffix rows: whether the one before or after in suffix order has the same prefix hash.

    long_first marks one suffix at least of those that share a long prefix: the first of a partition's. Written to the shared folder.
    """
    keys = ["k0", "k1", "k2", "long", "s", "i"]
    cols = ("s", "i", "short", "long")

    def compare(batches):
        """A batch at a time; its last row waits for the next one's first."""
        pid, held, began = TaskContext.get().partitionId(), None, False

        def rows_of(t, before, last):
            """Of columns t (row 0 is the one held): all rows but the last, unless that is the partition's last."""
            n = len(t["s"]) if last else len(t["s"]) - 1
            out = {k: t[k][:n] for k in cols}
            for k in ("short", "long"):
                same = (t[k][1:] == t[k][:-1]) & (t[k][1:] != 0)
                prev = np.r_[before[k], same]
                out[k + "_again"] = (prev | np.r_[same, False])[:n]
                out[k + "_first"] = ~prev[:n]
            end = np.zeros(n, np.int32)
            if not began:
                end[:1] += 1
            if last:
                end[-1:] += 2
            held = {k: t[k][-1:] for k in cols}, {k: bool(np.r_[before[k], (t[k][1:] == t[k][:-1]) & (t[k][1:] != 0)][-1]) for k in ("short", "long")}
            return pa.RecordBatch.from_pydict(out | {"pid": np.full(n, pid, np.int32), "end": end}), held

        for b in batches:
            if not b.num_rows:
                continue
            t = {k: b.column(k).to_numpy() for k in cols}
            before = {"short": False, "long": False}
            if held is not None:
                t, before = {k: np.r_[held[0][k], t[k]] for k in cols}, held[1]
            out, held = rows_of(t, before, False)
            if out.num_rows:
                began = True
                yield out
        if held is not None:
            yield rows_of(held[0], held[1], True)[0]

    done = common.written(rows.orderBy(*keys).mapInArrow(compare, "s long, i int, short long, long long, short_again boolean, short_first boolean, long_again boolean, long_first boolean, pid int, end int"), "order")
    # neighbours across partitions: two rows of each go to the driver
    ends = sorted(done.filter("end > 0").collect(), key=lambda r: (r["pid"], r["end"]))
    fix: dict[tuple[int, int], list[bool]] = {}
    firsts = {r["pid"]: r for r in ends if r["end"] & 1}
    lasts = {r["pid"]: r for r in ends if r["end"] & 2}
    order = sorted(firsts)
    for p, q in zip(order, order[1:], strict=False):
        a, b = lasts[p], firsts[q]
        for r in (a, b):
            f = fix.setdefault((r["s"], r["i"]), [False, False])
            for j, k in enumerate(("short", "long")):
                f[j] |= a[k] == b[k] and a[k] != 0
    schema = pa.schema({"s": pa.int64(), "i": pa.int32(), "x": pa.bool_(), "y": pa.bool_()})
    more = common.local_rows(rows.sparkSession, [(*k, *v) for k, v in fix.items()], schema)
    out = done.join(F.broadcast(more), ["s", "i"], "left")
    no = F.lit(False)
    return out.select("s", "i", (F.col("short_again") | F.coalesce("x", no)).alias("short_again"), (F.col("long_again") | F.coalesce("y", no)).alias("long_again"), "long_first")


def spans(docs: DataFrame, size: int = 400, text: str = "text", words: bool = False) -> DataFrame:
    """(key, runs, n): the bytes to remove of each text, as (begin, end) in any order; texts without any are left out.

    key is the first half of the text's SHA-256 (null: of the empty text), so copies share a row; a text of size bytes or more that
    occurs in n > 1 rows goes whole. words: strings of size / UNIT words too, by their places among hashes of words in a column words.
    """
    assert size >= GRAM + 3 * WINDOW
    d = docs.select(_key(F.col(text)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    cuts, many = segments(d, size, words)
    found = repeats(cuts, size).join(cuts.filter("bytes is not null").select("s", "key", "words", "begin"), "s")
    found = found.select("key", "words", (F.col("begin") + F.col("lo")).alias("lo"), (F.col("begin") + F.col("hi") + size).alias("hi"))
    known = cuts.filter("bytes is null").select("key", "words", F.col("begin").alias("lo"), (F.col("hi") + size).alias("hi"))
    run, of_words = F.struct("lo", "hi"), F.col("words")
    runs = [F.collect_list(F.when(~of_words, run)).alias("runs"), *([F.collect_list(F.when(of_words, run)).alias("words")] if words else [])]
    found = found.unionByName(known).groupBy("key").agg(*runs)
    return found.join(many, "key", "full")


def _of_words(raw: bytes, runs, size: int) -> list[tuple[int, int]]:
    """Bytes of a text that runs of places among its hashes of words stand for; those that hold no size / UNIT whole words are left out."""
    begin, end, _ = word_places(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    whole = ((-(-q["lo"] // UNIT), q["hi"] // UNIT) for q in runs)
    return [(int(begin[a]), int(end[b - 1])) for a, b in whole if b - a >= size // UNIT]


def cut(docs: DataFrame, found: DataFrame, size: int = 400, text: str = "text", name: str = "kept", readable: bool = False) -> DataFrame:
    """docs and a struct column: n_bytes, n_removed, n_spans and kept, the bytes that stay.

    readable: kept is text, without the parts of characters at a cut's edge, and null where nothing goes.
    """
    k, r, n, w = (common.unused(docs, x) for x in ("key", "runs", "n", "words"))
    by_words = "words" in found.columns
    other = found.select(F.col("key").alias(k), F.col("runs").alias(r), F.col("n").alias(n), F.col("words" if by_words else "runs").alias(w))
    both = docs.withColumn(k, _key(F.col(text))).join(other.hint("shuffle_hash"), k, "left")

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept " + ("string" if readable else "binary"))
    def apply(t, runs, copies, words):
        import pandas as pd

        with common.lean():
            out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
            for x, rs, c, ws in zip(t, runs, copies, words, strict=True):
                raw = common.utf8(x)
                if c == c and c is not None and c > 1 and (len(raw) >= size or by_words and len(raw.split()) >= size // UNIT):
                    merged = [[0, len(raw)]]
                else:
                    merged = []
                    gone = [(q["lo"], q["hi"]) for q in (rs if rs is not None else ())]
                    if by_words and ws is not None and len(ws):
                        gone += _of_words(raw, ws, size)
                    for lo, hi in sorted(gone):
                        if merged and lo <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], hi)
                        else:
                            merged.append([lo, hi])
                edges = [0, *(x for m in merged for x in m), len(raw)]
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(sum(b - a for a, b in merged))
                out["n_spans"].append(len(merged))
                if readable and not merged:
                    out["kept"].append(None)
                    continue
                rest = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out["kept"].append(rest.decode("utf-8", "ignore") if readable else rest)
            return pd.DataFrame(out)

    return both.withColumn(name, apply(F.col(text), F.col(r), F.col(n), F.col(w))).drop(k, r, n, w)


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of `documents`.

    Null and empty texts have no bytes; rows of one text of 400 bytes or more go whole, each of them, also where a doc_id is repeated.
    """
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = cut(docs, spans(docs))
    return out.select("doc_id", "kept.n_bytes", "kept.n_removed", "kept.n_spans", F.sha2(F.col("kept.kept"), 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages of 400 bytes or of 50 words (parts of characters at a cut's edge go too); all rows stay, null texts null, n_chars as it then is."""
    common.small_batches(spark)
    v = common.unused(docs, "kept")
    out = cut(docs, spans(docs, words=True), name=v, readable=True)
    changed = F.col(f"`{v}`.n_removed") > 0
    out = out.withColumn("text", F.when(changed, F.col(f"`{v}`.kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
