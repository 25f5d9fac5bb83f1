"""Best-fit packing of documents into sequences, by hierarchical residual packing.

Each partition packs its pieces best-fit (longest first). Bins that are full but for a few tokens are done; the others become items
of the next round, where the bins of eight partitions meet and are packed again, and so on up a tree. Only documents longer than a
sequence are ever cut.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.words import WordIds

VOCABULARY = "word_bpe_49k.json"
GENERATION = 600_000  # words and parts of words of a generation


# Fixed value: the vocabulary's own rule for what merging may join, applied to lower-cased text; a space between words is kept apart.
_PARTS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+| "


#: Anything but visible ASCII and Latin letters whose normal form is the text itself, or what could begin a special token.
_ODD = re.compile("[^\\x21-\\x7e\u00a1-\u024f]|\u0130|<\\|").search


class _Words(WordIds):
    """Words and their parts in one table: many words share a part, most are one, and new parts go to the tokenizer together."""

    def __init__(self, path: str, most: int):
        import regex
        from tokenizers import Tokenizer

        super().__init__(self._each, most=most)
        self.tokenizer, self.split = Tokenizer.from_file(path), regex.compile(_PARTS).findall
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def _alone(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _each(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, sizes = [], []
        for lo in range(0, len(parts), 5000):
            some = parts[lo : lo + 5000]
            ids = np.array(self._alone(" ".join(some)), np.int32)
            end = np.flatnonzero(self.ends[ids])  # the last id of a part is marked in the vocabulary
            size = np.diff(end, prepend=-1)
            if len(size) != len(some) or len(ids) and end[-1] != len(ids) - 1:
                each = [self._alone(x) for x in some]
                ids, size = np.array([i for x in each for i in x], np.int32), np.array([len(x) for x in each])
            flat.append(ids)
            sizes.append(size)
        return np.concatenate(flat), np.concatenate(sizes)

    def _add_parts(self, parts: list[str]) -> None:
        self.new.add(parts, *self._each(parts))

    def _encoded(self, words: list[str]) -> None:
        for lo in range(0, len(words), self.step):
            some = words[lo : lo + self.step]
            if odd := [w for w in some if _ODD(w)]:
                each = [self._alone(w) for w in odd]
                self.new.add(odd, np.array([i for x in each for i in x], np.int32), np.array([len(x) for x in each]))
                known = set(odd)
                some = [w for w in some if w not in known]
            if not some:
                continue
            parts = self.split(" ".join(some).lower())
            gap = np.flatnonzero(np.fromiter(map(" ".__eq__, parts), bool, len(parts)))
            count = np.diff(np.r_[-1, gap, len(parts)]) - 1
            parts = [x for x in parts if x != " "]
            ids, per_part = self.new.ids(self._numbers(parts, self._add_parts))
            size = np.diff(np.r_[0, np.cumsum(per_part)][np.r_[0, np.cumsum(count)]])
            first = (np.cumsum(count) - count).tolist()
            more = np.array([n != 1 or parts[i] != w for n, i, w in zip(count.tolist(), first, some, strict=True)])  # others are parts themselves
            self.new.add([w for w, m in zip(some, more.tolist(), strict=True) if m], ids[np.repeat(more, size)], size[more])


def _split(text: str) -> list[str]:
    """At white space as the vocabulary's own rule has it: str.split also takes four separators that the rule does not."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [w for w in re.split("[ \t\n\r]+", text) if w]
    return text.split()


def tokenise(texts: list[str | None], path: str, generation: int = GENERATION) -> list[np.ndarray]:
    """Each whole text's ids, then id 0; a null or empty text is id 0 alone."""
    enc, out, lo = common.held(_Words, path, generation), [], 0
    while lo < len(texts):  # some 1 MB at a time
        words, counts, size, hi = [], [], 0, lo
        while hi < len(texts) and (hi == lo or size < 1 << 20):
            w = _split(texts[hi] or "")
            words += w
            counts.append(len(w))
            size += len(texts[hi] or "")
            hi += 1
        ids, per_word = enc.ids(enc.numbers(words))
        ends = np.r_[0, np.cumsum(per_word)][np.cumsum(counts)] if words else np.zeros(len(counts), np.int64)
        for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True):
            out.append(np.append(ids[a:b], 0).astype("<u4"))
        lo = hi
    return out


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 2048, vocabulary: str | None = None, generation: int = GENERATION, release: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document whole, or in pieces of size tokens if it is longer.

    generation bounds a task's table of words: fewer take less memory and more time. release: a worker drops it after each task.
    """
    path = vocabulary or common.tokenizer_path(VOCABULARY)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def cut(c):
        doc, piece, start, length, crc = [], [], [], [], []
        for i, ids in enumerate(tokenise(c["text"].to_pylist(), path, generation)):
            for k, lo in enumerate(range(0, len(ids), size)):
                part = ids[lo : lo + size]
                doc.append(i)
                piece.append(k)
                start.append(lo)
                length.append(len(part))
                crc.append(zlib.crc32(part.tobytes()))
        return common.batch(doc_id=c["doc_id"].take(pa.array(doc, pa.int64())), piece=pa.array(piece, pa.int32()), start=pa.array(start, pa.int64()), length=pa.array(length, pa.int64()), ids_crc32=pa.array(crc, pa.int64()))

    kind = dict(d.dtypes)["doc_id"]
    return common.map_rows(d, cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long", release=release)


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: of each item its bin and its place there, and the bins' fill. A bitmap of free spaces finds the least that fits."""
    bins, place = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(size + 1)]
    have, fill = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if fits := have >> n:
            room = n + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                have ^= 1 << room
        else:
            room, b = size, len(fill)
            fill.append(0)
        bins[i], place[i] = b, fill[b]
        fill[b] += n
        left = room - n
        if left:
            if not free[left]:
                have |= 1 << left
            free[left].append(b)
    return bins, place, np.array(fill, np.int64)


def pack(items: DataFrame, size: int = 2048, slack: int = 2, fan_in: int = 8) -> DataFrame:
    """items (with length, at most size each) and sequence_id, offset.

    Two bins over half full never share a sequence, and best-fit leaves a group few others. So of the bins over half full a node of the
    tree needs, of each fill, only as many as it has others to place: bins of one fill are alike. All bins go on to the next node.
    """

    def first(frames):
        pid, n = TaskContext.get().partitionId(), 0
        for f in frames:  # a batch may hold a million rows or few; bins of one batch meet those of others a round later
            b, at, fill = best_fit(f["length"].to_numpy(), size)
            yield f.assign(bin=(pid << 36) + n + b, offset=at)
            n += len(fill)

    kinds = ", ".join(f"`{c}` {t}" for c, t in items.dtypes)
    spark = items.sparkSession
    with common.large_batches(spark, 1_000_000):
        placed = common.written(items.mapInPandas(first, f"{kinds}, bin long, offset long"), "placed")
    last = placed.agg(F.max(F.shiftright("bin", 36))).first()[0]
    groups, half = (last or 0) + 1, size // 2
    bins = placed.groupBy("bin").agg(F.sum("length").alias("fill")).filter(F.col("fill") < size - slack)
    bins = common.written(bins.select("bin", "fill", F.shiftright("bin", 36).alias("g")), "bins")

    def merge(f):
        b, at, fill = best_fit(f["fill"].to_numpy(), size)
        host = np.zeros(len(fill), np.int64)
        host[b[at == 0]] = f["bin"].to_numpy()[at == 0]
        return pd.DataFrame({"bin": f["bin"], "root": host[b], "base": at, "now": fill[b]})

    up = None  # (bin, root, base): where a bin of a partition has got to
    while True:
        groups = -(-groups // fan_in)
        bins = bins.withColumn("g", F.floor(F.col("g") / fan_in))
        few = bins.filter(F.col("fill") <= half)
        most = few.groupBy("g").count().agg(F.max("count")).first()[0]
        if most:
            rank = F.row_number().over(Window.partitionBy("g", "fill").orderBy("bin"))
            many = bins.filter(F.col("fill") > half).withColumn("r", rank).filter(F.col("r") <= most).drop("r")
            step = common.written(few.unionByName(many).groupBy("g").applyInPandas(merge, "bin long, root long, base long, now long"), "merged")
            moved = step.filter("root <> bin").select("bin", "root", "base")
            if up is None:
                up = moved
            else:
                now = moved.select(F.col("bin").alias("root"), F.col("root").alias("root2"), F.col("base").alias("base2"))
                up = up.join(now, "root", "left").select("bin", F.coalesce("root2", "root").alias("root"), (F.col("base") + F.coalesce("base2", F.lit(0))).alias("base")).unionByName(moved)
            bins = bins.join(step.select("bin", "root", "now"), "bin", "left").filter("root is null or root = bin")
            bins = common.written(bins.select("bin", F.coalesce("now", "fill").alias("fill"), "g").filter(F.col("fill") < size - slack), "bins")
        if groups == 1:
            break
    out = placed if up is None else placed.join(up, "bin", "left")
    root, base = (F.lit(None).cast("long"),) * 2 if up is None else (F.col("root"), F.col("base"))
    return out.select(*items.columns, F.coalesce(root, F.col("bin")).alias("sequence_id"), (F.col("offset") + F.coalesce(base, F.lit(0))).alias("offset"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every row of `documents` with its sequence and place there.

    A null or empty text is one token long (id 0), a repeated row is packed again, and a null doc_id stays null. Which of two pieces of
    one length goes first is open, so sequence numbers and places may differ between runs; the number of sequences is best-fit's.
    """
    return pack(common.written(pieces(common.table(spark, sf_dir, "documents").select("doc_id", "text")), "pieces"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As op4_packing, of the stage's own rows; other columns do not matter. Half as many words are kept in memory, and none after a task."""
    common.ship(spark)
    common.small_batches(spark)
    return pack(common.written(pieces(docs, generation=GENERATION // 2, release=True), "pieces"))
