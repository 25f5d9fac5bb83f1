"""Fill-in-the-middle: documents become prefix, suffix and middle, or stay plain, and come back.

A text is cut into chunks where a rolling hash of its last bytes says so, so that equal passages give equal chunks wherever they stand.
What a chunk adds to a text (code points, whether a mark stands in it, its first and last bytes) is computed once and kept by its bytes.
Sums over a text's chunks give its length, its marks and the chunks that hold its cuts; only those are looked at again.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

# fixed values: the marks of prefix, suffix and middle
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: The rolling hash is of so many bytes; a chunk ends on average after so many, and at most after so many.
WINDOW, AVERAGE, LONGEST = 32, 512, 8192
#: Bytes of chunks that a task's cache holds.
CACHE = 16 << 20
#: Bytes of text that are worked on at once; a longer text is worked on alone.
AT_ONCE = 4 << 20
_GEAR = np.random.default_rng(12).integers(0, 1 << 32, 256, dtype=np.uint32)


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Where the chunks of one text end: at bytes whose rolling hash starts with zeros, and each LONGEST bytes where none does."""
    n = len(data)
    h = _GEAR[data]
    for k in range(WINDOW.bit_length() - 1):  # each byte's weight doubles with its distance: windows of 2, 4, ... bytes
        s = 1 << k
        h[s:] += h[:-s] << np.uint32(s)
    ends = np.flatnonzero(h[WINDOW - 1 :] < np.uint32((1 << 32) // AVERAGE)) + WINDOW
    ends = np.concatenate([ends[ends < n], [n]])
    gaps = np.diff(ends, prepend=0)
    if gaps.max() <= LONGEST:
        return ends
    more = [np.arange(e - g + LONGEST, e, LONGEST) for e, g in zip(ends[gaps > LONGEST], gaps[gaps > LONGEST], strict=True)]
    return np.sort(np.concatenate([ends, *more]))


def marked(b: bytes) -> bool:
    return PREFIX in b or SUFFIX in b or MIDDLE in b


class Chunks:
    """Summaries of chunks by their bytes: (code points that begin in it, whether a mark lies in it). Forgets all when full."""

    def __init__(self, most: int = CACHE):
        self.most, self.held, self.known = most, 0, {}
        self.asked = self.made = 0

    def of(self, chunk: bytes) -> tuple[int, bool]:
        self.asked += 1
        got = self.known.get(chunk)  # compares the bytes, not only their hash
        if got is None:
            self.made += 1
            got = int(np.count_nonzero((np.frombuffer(chunk, np.uint8) & 0xC0) != 0x80)), marked(chunk)
            self.held += len(chunk) + 200
            if self.held > self.most:
                self.known, self.held = {}, len(chunk) + 200
            self.known[chunk] = got
        return got


class Text:
    """A text's length in code points, whether it holds a mark, and byte offsets of code points, all from its chunks."""

    def __init__(self, data: np.ndarray, raw: bytes, chunks: Chunks):
        self.raw, self.data, self.n, self.marked = raw, data, 0, False
        self.ends = [0, *chunk_ends(data).tolist()] if raw else [0]
        counts, tail = [], b""
        for lo, hi in pairwise(self.ends):
            chunk = raw[lo:hi]
            n, found = chunks.of(chunk)
            counts.append(n)
            self.marked = self.marked or found or marked(tail + chunk[:2])
            tail = (tail + chunk[-2:])[-2:]
        self.upto = list(accumulate(counts, initial=0))
        self.n = self.upto[-1]

    def offset(self, k: int) -> int:
        """Byte at which code point k begins; the end of the text for k = n."""
        if k >= self.n:
            return len(self.raw)
        at = bisect_right(self.upto, k) - 1
        lo = self.ends[at]
        return lo + int(np.flatnonzero((self.data[lo : self.ends[at + 1]] & 0xC0) != 0x80)[k - self.upto[at]])


def rebuild(output: bytes, form: str) -> bytes:
    """The text of an output. The parts hold no mark, so the first of each kind is the one that was put there."""
    if form == "plain":
        return output
    if form == "psm":
        prefix, _, rest = output[len(PREFIX) :].partition(SUFFIX)
        suffix, _, middle = rest.partition(MIDDLE)
    else:
        suffix, _, rest = output[len(SUFFIX) :].partition(PREFIX)
        prefix, _, middle = rest.partition(MIDDLE)
    return prefix + middle + suffix


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four numbers of 32 bits of each id, from the digest of seed, colon and id; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, fim_percent: int = 90, spm_percent: int = 20, seed: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row.

    Two cuts, drawn from the id, part a text of n code points. Null texts are empty; empty texts and those that hold a mark are plain.
    Repeated rows give equal rows. Texts are worked on in slices of some bytes, so a task holds a few times its longest text.
    """
    h = draws(F.col(doc_id), seed)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *[x.alias(f"h{i}") for i, x in enumerate(h, 1)])
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        chunks = Chunks()
        with common.lean():
            for b in batches:
                for part in common.by_bytes(b, "text", AT_ONCE):
                    yield _transformed(part, chunks, fim_percent, spm_percent)

    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def _transformed(b: pa.RecordBatch, chunks: Chunks, fim_percent: int, spm_percent: int) -> pa.RecordBatch:
    data, off = common.buffers(b.column("text"))
    h = [b.column(f"h{i}").to_numpy() for i in range(1, 5)]
    forms, ns, pre, mid, outs = [], [], [], [], []
    for i in range(b.num_rows):
        piece = data[off[i] : off[i + 1]]
        raw = piece.tobytes()
        t = Text(piece, raw, chunks)
        ns.append(t.n)
        if not raw or t.marked or h[2][i] % 100 >= fim_percent:
            forms.append("plain")
            pre.append(None)
            mid.append(None)
            outs.append(raw)
            continue
        x, y = sorted((int(h[0][i] % (t.n + 1)), int(h[1][i] % (t.n + 1))))
        p, q = t.offset(x), t.offset(y)
        prefix, middle, suffix = raw[:p], raw[p:q], raw[q:]
        spm = h[3][i] % 100 < spm_percent
        forms.append("spm" if spm else "psm")
        pre.append(x)
        mid.append(y - x)
        outs.append(b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle) if spm else (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)))
    long = pa.int64()
    return pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n": pa.array(ns, long), "form": pa.array(forms, pa.string()), "prefix_chars": pa.array(pre, long), "middle_chars": pa.array(mid, long), "output": common.strings(outs)})


def restore(done: DataFrame, output: str = "output", form: str = "form", name: str = "restored") -> DataFrame:
    """done and a column with the text rebuilt from output and form alone; a null output or form gives null."""
    name = common.unused(done, name)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in done.schema.fields)}, `{name}` string"

    def run(batches):
        with common.lean():
            for b in batches:
                for part in common.by_bytes(b, output, AT_ONCE):
                    got = [None if o is None or f is None else rebuild(o, f) for o, f in zip(part.column(output).cast(pa.binary()).to_pylist(), part.column(form).to_pylist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([*part.columns, common.strings(got)], [*part.schema.names, name])

    return done.mapInArrow(run, schema)


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row of `documents`. See transform()."""
    done = restore(transform(common.table(spark, sf_dir, "documents")))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
  CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS e FROM d),
f AS (SELECT *, least(a, b) AS x, greatest(a, b) AS y,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, substring(t, 1, x) AS pre, substring(t, x + 1, y - x) AS mid, substring(t, y + 1, n - y) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
