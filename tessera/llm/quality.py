"""Quality rules with tokeniser fertility.

Public vocabularies measure each whole text. One with byte fallback gives characters per token, tokens per word, the share of tokens
that are single bytes, and the entropy of the tokens; one over bytes, for many languages, gives characters per token once more. Each
script has a band for each; a text outside its script's bands is rejected, as is one that fails the base rules on length and repetition.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.words import WordIds

VOCABULARY, MULTI = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"
SYMBOLS = "#*$%&|<>"
LONG = 1000  # characters of a word that the vocabulary over bytes takes at once


@dataclass(frozen=True)
class Band:
    """Bounds of a script. Entropy is in bits a token, and never more than half of what so many different tokens would have; below
    `long` tokens fertility has a margin of a tenth of what is missing."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float
    most_fertility: float  # tokens a word
    least_chars_multi: float  # characters a token of the vocabulary over bytes
    long: int = 100


#: By script; `none` for texts without letters, `other` for the rest. From what the vocabulary gives ordinary prose, with wide margins.
#: The first vocabulary knows no letters of most scripts in `other`, so there byte share says nothing and characters a token little.
#: The second gives prose 1.5 characters a token or more in Latin letters, 1.8 in Cyrillic, 1.3 in Greek and Arabic, 0.7 in Chinese
#: and Armenian and 0.4 in Georgian, signs 1.05 and code points of no language a third: the bands are about two thirds of prose's.
BANDS = {
    "latin": Band(1.2, 9.0, 0.25, 3.0, 3.4, 1.2),
    "cyrillic": Band(0.9, 8.0, 0.25, 3.0, 7.0, 1.0),
    "greek": Band(0.5, 6.0, 0.6, 3.0, 14.0, 0.7),
    "cjk": Band(0.3, 3.0, 0.9, 3.0, 500.0, 0.4),
    "arabic": Band(0.65, 6.0, 0.25, 3.0, 8.5, 0.7),
    "hebrew": Band(0.6, 6.0, 0.25, 3.0, 10.0, 0.6),
    "thai": Band(0.75, 6.0, 0.25, 3.0, 500.0, 0.6),
    "devanagari": Band(0.6, 6.0, 0.35, 3.0, 9.0, 0.45),
    "bengali": Band(0.6, 6.0, 0.4, 3.0, 12.0, 0.28),
    "tamil": Band(0.65, 6.0, 0.35, 3.0, 24.0, 0.5),
    "armenian": Band(0.65, 6.0, 0.4, 3.0, 14.0, 0.4),
    "georgian": Band(0.7, 6.0, 0.3, 3.0, 15.0, 0.25),
    "none": Band(1.2, 9.0, 0.25, 3.0, 3.4, 1.2),
    "other": Band(0.28, 9.0, 1.0, 3.0, 60.0, 0.25),
}
_NAMES = ["", "latin", "cyrillic", "greek", "cjk", "other", "arabic", "hebrew", "thai", "devanagari", "bengali", "tamil", "armenian", "georgian"]
#: First code points of ranges, and the script of each; 0 is no letter (symbols, digits, private use, emoji).
_FIRST, _SCRIPT = (np.array(x) for x in zip(
    (0, 0), (0x41, 1), (0x5B, 0), (0x61, 1), (0x7B, 0), (0xC0, 1), (0x250, 0), (0x370, 3), (0x400, 2), (0x530, 12), (0x590, 7), (0x600, 0), (0x620, 6), (0x660, 0), (0x66E, 6),
    (0x700, 5), (0x750, 6), (0x780, 5), (0x8A0, 6), (0x900, 9), (0x980, 10), (0xA00, 5), (0xB80, 11), (0xC00, 5), (0xE00, 8), (0xE80, 5), (0x10A0, 13), (0x1100, 5),
    (0x1E00, 1), (0x1F00, 3), (0x2000, 0), (0x2C00, 5), (0x2E00, 0), (0x3040, 4), (0xA000, 5), (0xAC00, 4), (0xD7B0, 5), (0xD800, 0), (0xF900, 4), (0xFB00, 5), (0xFB1D, 7), (0xFB50, 6),
    (0xFE00, 0), (0xFE70, 6), (0xFEFF, 0), (0xFF21, 1), (0xFF3B, 0), (0xFF41, 1), (0xFF5B, 0), (0xFF66, 4), (0xFFE0, 0), (0x10000, 5), (0x1D000, 0), (0x1E000, 5), (0x1F000, 0), (0x20000, 4), (0x32000, 0),
    strict=True))


def _encoder(path: str, multi: str) -> tuple[WordIds, np.ndarray]:
    """Of a word its ids and, as the last, how many tokens it is in the vocabulary over bytes."""
    import base64

    import sentencepiece
    import tiktoken

    with open(multi, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    whole = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    byte = np.array([sp.is_byte(i) for i in range(sp.get_piece_size())])

    def encode(words):
        texts = [w.decode("utf-8", "replace") for w in words]
        return [[*ids, len(whole(t[:LONG])) if len(t) <= LONG else sum(len(whole(t[i : i + LONG])) for i in range(0, len(t), LONG))] for t, ids in zip(texts, sp.encode(texts, num_threads=1), strict=True)]

    return WordIds(encode), byte


def script(text: str) -> str:
    """The script with most letters (ties: the first in _NAMES); none if there are no letters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.bincount(_SCRIPT[np.searchsorted(_FIRST, points, "right") - 1], minlength=len(_NAMES))[1:]
    return _NAMES[1 + int(n.argmax())] if n.any() else "none"


def repeated_words(w: np.ndarray, size: int = 5) -> int:
    """How many words lie in windows of that many words that occur twice or more; w: a number for each word."""
    n = len(w) - size + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = (h ^ w[i : i + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    s = np.sort(h)
    if not (s[1:] == s[:-1]).any():  # equal windows have equal hashes
        return 0
    name = w[:n]
    for i in range(1, size):  # exact names of longer and longer windows
        name = np.unique(name * (int(w.max()) + 1) + w[i : i + n], return_inverse=True)[1]
    again = np.bincount(name)[name] > 1
    cover = np.zeros(len(w) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + size, -1)
    return int((np.cumsum(cover) > 0).sum())


def measure(text: str | None, path: str, multi: str | None = None) -> dict:
    """The base counts and the fertility of one whole text; a null text has no words."""
    raw = common.utf8(text)
    text = text or ""
    words = raw.split()
    enc, byte = common.held(_encoder, path, multi or common.tokenizer_path(MULTI))
    numbers = enc.numbers(words)
    ids, size = enc.ids(numbers)
    last = np.cumsum(size) - 1
    n_multi, own = int(ids[last].sum()), np.ones(len(ids), bool)
    own[last] = False
    ids = ids[own]
    n, t = len(words), max(len(ids), 1)
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    chars = len(text) - sum(text.count(c) for c in common.SPACES)
    count = np.bincount(ids) if len(ids) else np.zeros(1, np.int64)
    p = count[count > 0] / t
    return {
        "n_words": n,
        "word_chars": chars,
        "n_symbols": sum(text.count(c) for c in SYMBOLS),
        "n_dup_lines": dup,
        "n_repeat_words": repeated_words(numbers),
        "script": script(text),
        "n_tokens": len(ids),
        "chars_per_token": chars / t,
        "chars_per_token_multi": chars / max(n_multi, 1),
        "byte_share": float(byte[ids].sum() / t) if len(ids) else 0.0,
        "entropy": float(-(p * np.log2(p)).sum()) if len(ids) else 0.0,
    }


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, n_tokens long, chars_per_token double, chars_per_token_multi double, byte_share double, entropy double"


def judge(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str | None = None, bands: dict[str, Band] | None = None, multi: str | None = None) -> DataFrame:
    """(doc_id, base counts, fertility, base_failed, kept) of each row. Null and empty texts have no words and fail the base rules."""
    path, multi = vocabulary or common.tokenizer_path(VOCABULARY), multi or common.tokenizer_path(MULTI)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = pa.struct([(n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[k]) for n, k in (x.split() for x in SCHEMA.split(", "))])

    def rows(c):
        got = pa.array([measure(t, path, multi) for t in c["text"].to_pylist()], fields)
        return pa.RecordBatch.from_arrays([c["doc_id"], *got.flatten()], ["doc_id", *(f.name for f in fields)])

    out = common.map_rows(d, rows, f"doc_id {dict(d.dtypes)['doc_id']}, {SCHEMA}")
    fine = F.lit(False)
    for name, b in (bands or BANDS).items():
        mixed = F.col("entropy") >= F.least(F.lit(b.least_entropy), F.log2(F.greatest("n_tokens", F.lit(1))) / 2)
        split = F.col("n_tokens") <= b.most_fertility * F.col("n_words") + F.greatest(F.lit(0), b.long - F.col("n_tokens")) / 10
        ok = F.col("chars_per_token").between(b.least_chars, b.most_chars) & (F.col("chars_per_token_multi") >= b.least_chars_multi) & (F.col("byte_share") <= b.most_bytes) & mixed & split
        fine = F.when(F.col("script") == name, ok).otherwise(fine)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, base counts, fertility, base_failed, kept) of every row of `documents`.

    Null and empty texts have no words and fail the base rules; repeated rows are given again, a null doc_id stays null.
    """
    return judge(common.table(spark, sf_dir, "documents"))
