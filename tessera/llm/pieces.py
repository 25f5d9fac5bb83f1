"""SentencePiece encoding and decoding by suffix-array matching.

A task joins the new chunks of its batch into one text and sorts that text's suffixes; a binary search finds the range of every piece's
occurrences. The occurrences are edges, sorted by where they begin, and one pass relaxes them, all chunks in step: an edge extends a
prefix's encoding if the prefix's last piece and the edge's piece, side by side, are what byte-pair merging makes of their text. Exactly
one edge into a position passes, so the pass gives the merging's own result without any merging of the text. Characters outside the
vocabulary become their bytes' pieces.
"""

from __future__ import annotations

import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.words import WordIds

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"  # stands for a space in pieces
#: No piece holds a mark after another character, or a line feed, so chunks encode on their own.
_CHUNK = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
_END = b"\xff"  # occurs in no UTF-8 text
BLOCK, OVERLAP = 1024, 192  # bytes of a long chunk that are relaxed in step, and how many of them again with the next


class Matcher:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.rank = {t: (-sp.get_score(i), i) for i, t in enumerate(self.text) if not special[i]}
        self.unknown = n
        by_bytes = sorted((t.encode(), i) for t, (_, i) in self.rank.items())
        self.ids = np.array([i for _, i in by_bytes], np.int64)
        self.longest = max(len(b) for b, _ in by_bytes)
        self.low = np.array([b for b, _ in by_bytes], f"S{self.longest}")
        self.high = np.array([b.ljust(self.longest, _END) for b, _ in by_bytes], f"S{self.longest}")
        self.size = np.array([len(b) for b, _ in by_bytes], np.int64)
        self.bytes_of = [bytes([int(t[3:5], 16)]) if sp.is_byte(i) else b"" if special[i] else t.replace(MARK, " ").encode() for i, t in enumerate(self.text)]
        self.byte_id = {self.bytes_of[i][0]: i for i in range(n) if sp.is_byte(i)}
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.n_bytes = np.array([len(b) for b in self.bytes_of], np.int64)
        self.bytes_at = np.cumsum(self.n_bytes) - self.n_bytes
        self.byte_table = np.zeros(256, np.int64)
        for b, i in self.byte_id.items():
            self.byte_table[b] = i
        # order of forming: characters first, then pieces by rank; and the two parts that a piece is last merged from
        self.order = np.full(n + 1, -1, np.int64)
        for k, (t, (_, i)) in enumerate(sorted(self.rank.items(), key=lambda x: x[1])):
            self.order[i] = k + 1 if len(t) > 1 else 0
        # runs of marks have pieces of one rank, the last: the leftmost pair merges first, so runs fill up from the left
        runs = [t for t in self.rank if len(t) > 1 and t.count(MARK) > 1]
        assert all(set(t) == {MARK} for t in runs)
        self.mark, self.most_marks, self._runs = self.rank.get(MARK, (0, -1))[1], max(map(len, runs), default=1), {}
        self.left, self.right = np.arange(n + 1), np.arange(n + 1)
        self.alive = np.ones(n + 1, bool)
        joined = []
        for t, (_, i) in self.rank.items():
            if len(t) == 1:
                continue
            ids, last = self.merge(t)
            self.alive[i] = ids == [i]
            if last:
                self.left[i], self.right[i] = self.rank[last[0]][1], self.rank[last[1]][1]
            joined += [(self.rank[t[:k]][1] * (n + 1) + self.rank[t[k:]][1], self.order[i]) for k in range(1, len(t)) if t[:k] in self.rank and t[k:] in self.rank]
        joined.sort()
        self.join_key, self.join_order = np.array(joined, np.int64).T

    def merge(self, text: str) -> tuple[list[int], tuple[str, str] | None]:
        """Byte-pair merging of a short text, and the last pair merged: the best-ranked pair of neighbours first, the leftmost of equals.

        Unknown characters are -1.
        """
        part: list[str | None] = list(text)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(part) and (r := self.rank.get(part[i] + part[after[i]])):
                heapq.heappush(heap, (r[0], i, part[i], part[after[i]]))

        for i in range(len(part) - 1):
            offer(i)
        last = None
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if part[i] != a or after[i] >= len(part) or part[after[i]] != b:
                continue
            last = a, b
            j = after[i]
            part[i], part[j], after[i] = a + b, None, after[j]
            if after[i] < len(part):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [self.rank[p][1] if p in self.rank else -1 for p in part if p is not None], last

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves each piece a before its piece b as they are: whether no parts that meet at the border, as both are
        taken apart from the piece formed last, would have been merged while both were there. The unknown piece joins nothing."""
        n = self.unknown + 1
        out = (a == self.unknown) | (b == self.unknown)
        at = np.flatnonzero(~out)
        a, b = a[at], b[at]
        until = np.full(len(at), 1 << 40, np.int64)  # what is formed before this would have come first
        while len(at):
            key = a * n + b
            k = np.minimum(np.searchsorted(self.join_key, key), len(self.join_key) - 1)
            free = ~((self.join_key[k] == key) & (self.join_order[k] < until))
            at, a, b = at[free], a[free], b[free]
            oa, ob = self.order[a], self.order[b]
            whole_a, whole_b = self.right[a] == a, self.left[b] == b
            done = whole_a & whole_b
            out[at[done]] = True
            split_a = ~whole_a & ((oa > ob) | whole_b)
            # of two that could form at once, the left one does: so a piece on the right is still apart when its equal forms
            until = np.where(split_a, oa, ob + 1)
            a, b = np.where(split_a, self.right[a], a), np.where(split_a, b, self.left[b])
            at, a, b, until = at[~done], a[~done], b[~done], until[~done]
        return out

    def edges(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All occurrences of pieces in the text, by beginning and then length: beginning, piece, length in bytes."""
        a = np.frombuffer(data + _END * self.longest, np.uint8)
        at = np.flatnonzero((a[: len(data)] & 0xC0 != 0x80) & (a[: len(data)] != 0xFF))
        windows = np.lib.stride_tricks.sliding_window_view(a, self.longest)[at]
        suffixes = np.ascontiguousarray(windows).view(f"S{self.longest}").ravel()
        order = np.argsort(suffixes, kind="stable")
        suffixes = suffixes[order]
        lo, hi = np.searchsorted(suffixes, self.low, "left"), np.searchsorted(suffixes, self.high, "right")
        n = hi - lo
        where = at[order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]]
        piece, size = np.repeat(self.ids, n), np.repeat(self.size, n)
        return where, piece, size

    def run(self, n: int) -> list[int]:
        """The pieces of n marks in a row."""
        if n not in self._runs:
            whole, rest = divmod(n, self.most_marks)
            self._runs[n] = self.merge(MARK * self.most_marks)[0] * whole + self.merge(MARK * rest)[0]
        return self._runs[n]

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks in a row, and how many each has."""
        marks = np.array([len(c) - len(c.lstrip(MARK)) if c.startswith(MARK * 2) else 0 for c in chunks])
        raw = [(c[m - 1 :] if m else c).encode("utf-8", "surrogatepass") for c, m in zip(chunks, marks.tolist(), strict=True)]
        ids, count = self._relaxed(raw)
        if (more := np.flatnonzero(marks)).size:
            each = np.split(ids, np.cumsum(count)[:-1])
            for k in more.tolist():  # the last mark belongs to the run if nothing has joined it
                alone = each[k][:1].tolist() == [self.mark]
                each[k] = np.concatenate([self.run(int(marks[k]) - 1 + alone), each[k][alone:]]).astype(np.int32)
            ids, count = np.concatenate(each), np.array([len(x) for x in each])
        return ids.astype(np.int32), count.astype(np.int64)

    def _relaxed(self, raw: list[bytes], block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
        """As encode, of chunks' bytes. A chunk longer than a block is relaxed as several that overlap, all in step."""
        if not any(len(r) > block for r in raw):
            return self._ids(raw, *self._relax(raw))
        parts, of = [], []  # of: the chunk, where the part begins in it
        for k, r in enumerate(raw):
            lo = 0
            while lo == 0 or lo + OVERLAP < len(r):
                while lo and r[lo] & 0xC0 == 0x80:
                    lo -= 1
                parts.append(r[lo : lo + block])
                of.append((k, lo))
                lo += block - OVERLAP
        some = [self._relax(parts[i : i + 1024]) for i in range(0, len(parts), 1024)]  # some 1 MB at a time
        last, length = (np.concatenate(x) for x in zip(*some, strict=True))
        data_at = np.cumsum([len(p) + 1 for p in parts]) - [len(p) + 1 for p in parts]
        whole = {k: (np.full(len(r) + 1, -1), np.zeros(len(r) + 1, np.int64)) for k, r in enumerate(raw)}
        again = set()
        for (k, lo), at, p in zip(of, data_at.tolist(), parts, strict=True):
            a, b = whole[k]
            x, y = last[at : at + len(p) + 1], length[at : at + len(p) + 1]
            begin = 0
            if lo:  # what follows depends on as many positions as the longest piece has bytes: there both must agree
                n = min(OVERLAP, len(p))
                begin = n + 1
                if n <= self.longest or not ((a[lo + n - self.longest : lo + n + 1] == x[n - self.longest : n + 1]).all() and (b[lo + n - self.longest : lo + n + 1] == y[n - self.longest : n + 1]).all()):
                    again.add(k)
            a[lo + begin : lo + len(p) + 1], b[lo + begin : lo + len(p) + 1] = x[begin:], y[begin:]
        if again:
            order = sorted(again)
            ids, count = self._relaxed([raw[k] for k in order], block * 8)
            redone = dict(zip(order, np.split(ids, np.cumsum(count)[:-1]), strict=True))
        ids, count = self._ids(raw, np.concatenate([a for a, _ in whole.values()]), np.concatenate([b for _, b in whole.values()]))
        if again:
            each = [redone.get(k, x) for k, x in enumerate(np.split(ids, np.cumsum(count)[:-1]))]
            ids, count = np.concatenate(each), np.array([len(x) for x in each])
        return ids, count

    def _relax(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each prefix of each chunk, by where it ends in the joined text, the last piece of its encoding and that piece's bytes."""
        data = _END.join(raw) + _END
        size_of = np.array([len(r) for r in raw])
        begin = np.cumsum(size_of + 1) - size_of - 1
        where, piece, size = self.edges(data)
        # characters outside the vocabulary are edges of the unknown piece
        a = np.frombuffer(data, np.uint8)
        first = np.flatnonzero((a & 0xC0 != 0x80) & (a != 0xFF))
        lead = a[first]
        width = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0], [1, 2, 3], 4)
        # of pieces of one character there is an edge at the character's beginning
        is_char = np.zeros(len(a), bool)
        starts = np.full(len(a), -1)
        starts[first] = width
        is_char[where[size == starts[where]]] = True
        odd = ~is_char[first]
        where, piece, size = np.r_[where, first[odd]], np.r_[piece, np.full(odd.sum(), self.unknown)], np.r_[size, width[odd]]
        keep = self.alive[piece]
        where, piece, size = where[keep], piece[keep], size[keep]
        depth = where - np.repeat(begin, size_of + 1)[where]
        by = np.argsort(depth, kind="stable")
        where, piece, size, depth = where[by], piece[by], size[by], depth[by]
        cuts = np.flatnonzero(np.r_[True, depth[1:] != depth[:-1], True]) if len(depth) else np.zeros(1, int)
        none = -1
        last, length = np.full(len(a), none), np.zeros(len(a), np.int64)  # the piece that ends a prefix's encoding, by the prefix's end
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            w, p, s = where[lo:hi], piece[lo:hi], size[lo:hi]
            if depth[lo]:
                before = last[w]
                ok = np.flatnonzero(before != none)
                ok = ok[self.fit(before[ok], p[ok])]
                w, p, s = w[ok], p[ok], s[ok]
            last[w + s] = p
            length[w + s] = s
        return last, length

    def _ids(self, raw: list[bytes], last: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Back from each chunk's end: the ids in a row, and how many each chunk has."""
        a = np.frombuffer(_END.join(raw) + _END, np.uint8)
        size_of = np.array([len(r) for r in raw])
        begin = np.cumsum(size_of + 1) - size_of - 1
        at, k, steps = begin + size_of, np.arange(len(raw)), []
        while True:
            k, at = k[at > begin[k]], at[at > begin[k]]
            if not len(k):
                break
            steps.append((k, last[at], at))
            at = at - length[at]
        chunk = np.concatenate([x for x, _, _ in steps]) if steps else np.zeros(0, np.int64)
        ids = np.concatenate([x for _, x, _ in steps]) if steps else np.zeros(0, np.int64)
        end = np.concatenate([x for _, _, x in steps]) if steps else np.zeros(0, np.int64)
        by = np.lexsort((end, chunk))
        chunk, ids, end = chunk[by], ids[by], end[by]
        n = np.where(ids == self.unknown, length[end], 1)  # a character outside is as many pieces as it has bytes
        place = np.repeat(end - length[end], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ids, chunk = np.repeat(ids, n), np.repeat(chunk, n)
        ids = np.where(ids == self.unknown, self.byte_table[a[place]], ids)
        return ids, np.bincount(chunk, minlength=len(raw))


def _tables(path: str) -> tuple[Matcher, WordIds]:
    m = Matcher(path)
    return m, WordIds(m.encode, most=400_000, step=60_000)


def encode_texts(texts: list[str | None], path: str) -> list[np.ndarray]:
    """Ids of whole texts, as the vocabulary's own encoder gives them; none for null and empty texts."""
    _, table = common.held(_tables, path)
    out, lo = [], 0
    while lo < len(texts):
        chunks, counts, size, hi = [], [], 0, lo
        while hi < len(texts) and (hi == lo or size < 4 << 20):
            t = texts[hi] or ""
            found = _CHUNK.findall(MARK + t.replace(" ", MARK)) if t else []
            chunks += found
            counts.append(len(found))
            size += len(t)
            hi += 1
        ids, per = table.ids(table.numbers(chunks))
        ends = np.r_[0, np.cumsum(per)][np.cumsum(counts)] if chunks else np.zeros(len(counts), np.int64)
        out += [ids[a:b] for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)]
        lo = hi
    return out


def decode_ids(ids: np.ndarray, path: str) -> str:
    """The text of ids; bytes that are no UTF-8 become replacement characters."""
    m, _ = common.held(_tables, path)
    n = m.n_bytes[ids]
    raw = m.all_bytes[np.repeat(m.bytes_at[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()
    return raw.decode("utf-8", "replace")[1:]


def _lists(ids: pa.Array) -> list[np.ndarray]:
    """The rows of a list column; null rows are empty."""
    return [ids.values.to_numpy()[a:b] if ok else np.zeros(0, np.int32) for a, b, ok in zip(ids.offsets[:-1].to_pylist(), ids.offsets[1:].to_pylist(), ids.is_valid().to_pylist(), strict=True)]


def encode(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids) of each row."""
    path = vocabulary or common.tokenizer_path(VOCABULARY)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def rows(c):
        each = encode_texts(c["text"].to_pylist(), path)
        bounds = pa.array(np.r_[0, np.cumsum([len(x) for x in each])], pa.int32())
        return common.batch(doc_id=c["doc_id"], ids=pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([np.zeros(0, np.int32), *each]), pa.int32())))

    return common.map_rows(d, rows, f"doc_id {dict(d.dtypes)['doc_id']}, ids array<int>", rows=2048)


def decode(encoded: DataFrame, ids: str = "ids", doc_id: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) of each row; null and empty ids give an empty text."""
    path = vocabulary or common.tokenizer_path(VOCABULARY)
    d = encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"))
    rows = lambda c: common.batch(doc_id=c["doc_id"], text=pa.array([decode_ids(x, path) for x in _lists(c["ids"])], pa.string()))
    return common.map_rows(d, rows, f"doc_id {dict(d.dtypes)['doc_id']}, text string")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of `documents`: how many ids, their checksum (little-endian unsigned 32-bit), and the digest of the text decoded from them.

    A null or empty text has no ids and decodes to an empty text; a repeated row gives its values again.
    """
    path = common.tokenizer_path(VOCABULARY)
    docs = common.table(spark, sf_dir, "documents")

    def rows(c):
        ids = _lists(c["ids"])
        back = [decode_ids(x, path) for x in ids]
        return common.batch(
            doc_id=c["doc_id"],
            n_ids=pa.array([len(x) for x in ids], pa.int64()),
            ids_crc32=pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
            n_chars_decoded=pa.array([len(t) for t in back], pa.int64()),
            text_crc32=pa.array([zlib.crc32(common.utf8(t)) for t in back], pa.int64()),
        )

    return common.map_rows(encode(docs), rows, f"doc_id {dict(docs.dtypes)['doc_id']}, n_ids long, ids_crc32 long, n_chars_decoded long, text_crc32 long")
