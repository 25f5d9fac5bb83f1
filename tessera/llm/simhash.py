"""SimHash near-duplicates with bit-sliced comparison.

Distinct fingerprints meet in buckets: of four 16-bit quarters two or more agree if two bits or fewer differ, so each pair of
quarters is a key. Within a bucket fingerprints are stored as bit planes, 64 of them to a word; one XOR and a carry-save counter per
plane update 64 distances at once, and words of which all distances exceed the radius are abandoned. Large buckets are divided by
the same argument on the other 32 bits, which leaves at most 65,536 fingerprints together. Links become stars inside the task, and
a distributed component search joins them.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.components import components

LARGE = 4096
ALL = np.uint64(2**64 - 1)


def fingerprint(text: bytes, size: int = 3) -> int:
    """64-bit SimHash (signed) over the XXH64 (seed 42) of word shingles, repeats included; A-Z lower-cased."""
    import xxhash

    words = text.lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    if n <= size:
        spans = [(0, len(joined))]
    else:
        spans = zip(np.r_[0, ends[: n - size] + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in spans], np.uint64)
    set_bits = np.zeros(64, np.int64)
    for lo in range(0, len(h), 4096):
        set_bits += np.unpackbits(h[lo : lo + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", size: int = 3, name: str = "fp") -> DataFrame:
    """docs and the fingerprint of each whole text as a long; a null text, or one without words, has fingerprint 0."""

    @F.pandas_udf("long")
    def of(s):
        import pandas as pd

        return pd.Series([fingerprint(common.utf8(t), size) for t in s], dtype="int64")

    return docs.withColumn(name, of(F.col(text)))


def join_labels(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest index reachable by the pairs from each of n; label: what earlier pairs gave."""
    label = np.arange(n) if label is None else label
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        a, b = a[differ], b[differ]
        np.minimum.at(label, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while (label[label] != label).any():
            label = label[label]
    return label


def bit_sliced_links(bucket: np.ndarray, fp: np.ndarray, radius: int, chunk: int = 1 << 16) -> np.ndarray:
    """Of fingerprints sorted by bucket: for each the smallest index that links of the same bucket reach."""
    n = len(fp)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    size = np.diff(np.r_[first, n])
    group = np.repeat(np.arange(len(first)), size)
    place = np.arange(n) - first[group]
    words = -(-size // 64)
    word_first = np.r_[0, np.cumsum(words)]
    word, bit = word_first[group] + place // 64, (place % 64).astype(np.uint64)
    starts = np.flatnonzero(place % 64 == 0)
    one = np.uint64(1)
    planes = [np.bitwise_or.reduceat(((fp >> np.uint64(b)) & one) << bit, starts) for b in range(64)]
    valid = np.bitwise_or.reduceat(one << bit, starts)
    later = word_first[group + 1] - word  # words from a fingerprint's own to its bucket's last
    later[place == size[group] - 1] = 0
    upto = np.r_[0, np.cumsum(later)]
    label = None
    counters = (radius + 1).bit_length()
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + chunk, "right")) - 1)
        q = np.repeat(np.arange(lo, hi), later[lo:hi])
        w = word[q] + np.arange(len(q)) - (upto[q] - upto[lo])
        own = word[q] == w
        over = ~valid[w] | np.where(own, (one << bit[q]) | ((one << bit[q]) - one), np.uint64(0))
        sums = [np.zeros(len(q), np.uint64) for _ in range(counters)]
        for b in range(64):
            carry = planes[b][w] ^ (np.uint64(0) - ((fp[q] >> np.uint64(b)) & one))
            for i in range(counters):
                sums[i], carry = sums[i] ^ carry, sums[i] & carry
            full = ALL
            for i in range(counters):
                full = full & (sums[i] if (radius + 1) >> i & 1 else ~sums[i])
            over = over | full
            if b % 6 == 5 and len(q):
                live = over != ALL
                if not live.all():
                    q, w, over, sums = q[live], w[live], over[live], [s[live] for s in sums]
        if len(q):
            hit = np.flatnonzero(over != ALL)
            r, c = np.nonzero(np.unpackbits((~over[hit]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            label = join_labels(n, q[hit][r], starts[w[hit][r]] + c, label)
        lo = hi
    return np.arange(n) if label is None else label


def _mask(blocks: tuple[int, ...], width: int) -> int:
    m = sum(((1 << width) - 1) << (b * width) for b in blocks)
    return m - (1 << 64) if m >> 63 else m


def link(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v): stars that join each distinct fingerprint of column fp to those within the radius (2 at most)."""
    assert 0 <= radius <= 2
    quarters = list(combinations(range(4), 2))
    key = lambda masks, c: F.explode(F.array(*[F.struct(F.lit(i).alias("i"), c.bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)]))
    wide = fps.select("fp", key([_mask(p, 16) for p in quarters], F.col("fp")).alias("b")).select("fp", F.col("b.i").alias("i"), F.col("b.k").alias("k"))
    count = wide.groupBy("i", "k").agg(F.count("*").alias("n")).filter("n > 1")
    met = wide.join(count, ["i", "k"])
    # the two quarters that a key leaves out, as four bytes of which two or more agree
    fine = F.lit(None).cast("array<long>")
    for i, p in enumerate(quarters):
        rest = [x for q in range(4) if q not in p for x in (2 * q, 2 * q + 1)]
        fine = F.when(F.col("i") == i, F.array(*[F.lit(_mask(two, 8)) for two in combinations(rest, 2)])).otherwise(fine)
    large = met.filter(F.col("n") > LARGE).select("fp", "i", "k", F.posexplode(fine).alias("j", "m")).select("fp", (F.col("i") + 10 * (F.col("j") + 1)).alias("i"), F.col("k").bitwiseOR(F.col("fp").bitwiseAND(F.col("m"))).alias("k"))
    rows = met.filter(F.col("n") <= LARGE).select("fp", "i", "k").unionByName(large)
    rows = rows.repartition("i", "k").sortWithinPartitions("i", "k", "fp")

    def compare(batches):
        held = None
        for b in (*batches, None):
            if b is not None:
                cols = [np.asarray(b.column(x)) for x in ("i", "k", "fp")]
                if not len(cols[0]):
                    continue
                held = cols if held is None else [np.r_[x, y] for x, y in zip(held, cols, strict=True)]
            if held is None:
                continue
            i, k, fp = held
            new = np.r_[True, (i[1:] != i[:-1]) | (k[1:] != k[:-1])]
            cut = len(fp) if b is None else int(np.flatnonzero(new)[-1])  # the last bucket may go on in the next batch
            if cut:
                g, f = np.cumsum(new)[:cut], fp[:cut]
                label = bit_sliced_links(g, f.astype(np.int64).view(np.uint64), radius)
                linked = np.flatnonzero(label != np.arange(cut))
                yield pa.RecordBatch.from_pydict({"u": f[linked], "v": f[label[linked]]})
            held = [x[cut:] for x in held] if cut < len(fp) else None

    return rows.mapInArrow(compare, "u long, v long").distinct()


def group(docs: DataFrame, doc_id: str = "doc_id", fp: str = "fp", radius: int = 2) -> DataFrame:
    """(fp, component_id): of each fingerprint the smallest id reachable. Null ids are passed over; a group of them alone has a null."""
    fps = common.written(docs.select(F.col(fp).alias("fp"), F.col(doc_id).alias("id")).groupBy("fp").agg(F.min("id").alias("id")), "fingerprints")
    roots = components(link(fps.select("fp"), radius))
    of = fps.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = of.groupBy("root").agg(F.min("id").alias("component_id"))
    return of.join(least, "root").select("fp", "component_id")


def hexadecimal(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of `documents`.

    Null and empty texts have fingerprint zero, which links like any other. Repeated rows are given again; a null doc_id is never the
    smallest of a component unless it has no other.
    """
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = common.written(fingerprints(docs).select("doc_id", "fp"), "simhash")
    return docs.join(group(docs), "fp").select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")
