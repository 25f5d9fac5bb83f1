"""Language ID by error-correcting output codes.

Each language gets a codeword; for each bit a binary logistic classifier over hashed byte n-grams predicts it. Decoding adds up
each bit's exponential loss against every codeword, weighted by how well that bit's classifier did in training, and takes the
nearest codeword; a small gap to the second nearest flags the text as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

BITS = 12  # of the n-gram hash
#: Bytes to features: A-Z lower-cased, what is no letter in ASCII becomes a space.
_MAP = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint32)


@dataclass
class EcocModel:
    languages: list[str]
    codes: np.ndarray  # languages x bits, +-1
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit
    sharp: float = 4.0

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def decode(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row: the nearest codeword, its probability, and the gap to the second."""
        n = len(m)
        if len(self.languages) == 1:
            return np.zeros(n, int), np.ones(n), np.ones(n)
        loss = np.exp(-np.clip(m[:, None, :] * self.codes[None], -8, 8)) @ self.trust / self.trust.sum()
        z = -self.sharp * np.log(loss + 1e-9)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        two = np.sort(p, 1)[:, -2:]
        return p.argmax(1), p.max(1), two[:, 1] - two[:, 0]


def codewords(k: int) -> np.ndarray:
    """Exhaustive codes up to 6 languages, rows of a Hadamard matrix beyond; no two bits alike or constant."""
    if k == 1:
        return np.ones((1, 1), np.float32)
    if k <= 6:
        cols = [[1] + [1 if c >> j & 1 else -1 for j in range(k - 1)] for c in range(2 ** (k - 1) - 1)]
        return np.array(cols, np.float32).T
    h = np.ones((1, 1), np.float32)
    while len(h) < k:
        h = np.block([[h, h], [h, -h]])
    return np.array([c for c in h[:k].T if abs(c.sum()) < k], np.float32).T


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Square roots of hashed trigram and bigram shares, unit length; one row for each text."""
    n, size = len(off) - 1, 1 << BITS
    out = np.zeros((n, size), np.float32)
    lo = 0
    while lo < n:  # groups of texts of about 1 MB
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + (1 << 20))) - 1)
        a = _MAP[data[off[lo] : off[hi]]]
        if len(a) >= 3:
            pair = a[:-1] << 8 | a[1:]
            three = pair[:-1] << 8 | a[2:]
            row = np.repeat(np.arange(hi - lo, dtype=np.int64), np.diff(off[lo : hi + 1]))
            for g, w in ((three, 3), (pair, 2)):
                k = (g * np.uint32(2654435761 if w == 3 else 2246822519)) >> np.uint32(32 - BITS)
                inside = row[: len(k)] == row[w - 1 :]
                key = (row[: len(k)] << BITS | k)[inside]
                out[lo:hi] += np.bincount(key, minlength=(hi - lo) << BITS).reshape(hi - lo, size)
        lo = hi
    np.sqrt(out, out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = 400, epochs: int = 250) -> EcocModel:
    """Fit on at most per_language texts of each language (by id hash); rows with null text or language teach nothing.

    The tasks turn the sample into feature rows, so the driver gets per_language x languages x 16 KB at most.
    """
    d = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    d = d.filter(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    ids = common.hash_sample(d.select("id", "lang"), "id", per_language, "lang").distinct()
    sample = d.join(F.broadcast(ids), ["id", "lang"])

    def rows(c):
        x = features(*common.buffers(c["text"]))
        return common.batch(id=c["id"], lang=c["lang"], x=pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary()))

    got = common.map_rows(sample, rows, "id string, lang string, x binary").toPandas().sort_values(["lang", "id"])
    if got.empty:
        return EcocModel(["und"], np.ones((1, 1), np.float32), np.zeros((1 << BITS, 1), np.float32), np.zeros(1, np.float32), np.ones(1))
    langs = sorted(got["lang"].unique())
    x = np.stack([np.frombuffer(b, np.float16) for b in got["x"]]).astype(np.float32)
    y = got["lang"].map({v: i for i, v in enumerate(langs)}).to_numpy()
    codes = codewords(len(langs))
    t = codes[y]
    each = 1.0 / np.bincount(y)[y]
    each = (each / each.sum()).astype(np.float32)[:, None]
    w, b = np.zeros((x.shape[1], t.shape[1]), np.float32), np.zeros(t.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(epochs):  # gradient steps with momentum on the weighted logistic loss
        g = -t * each / (1 + np.exp(np.clip(t * (x @ w + b), -30, 30)))
        vw = 0.9 * vw - 8.0 * (x.T @ g + 1e-5 * w)
        vb = 0.9 * vb - 8.0 * g.sum(0)
        w, b = w + vw, b + vb
    right = ((x @ w + b) * t > 0) * each
    trust = np.log1p(right.sum(0) / np.maximum(1 - right.sum(0), 1e-3))
    return EcocModel(langs, codes, w, b, trust)


def predict(docs: DataFrame, model: EcocModel, text: str = "text", least_gap: float = 0.2, name: str = "language") -> DataFrame:
    """docs and a struct column: lang_pred, score, ambiguous.

    A null text, or one without any letter, is `und` with score 1 and not ambiguous. All other columns stay as they are.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    none = ~F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False))

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def judge(s):
        import pandas as pd

        with common.lean():
            m = shared.value
            parts = []
            for lo in range(0, len(s), 256):
                x = features(*common.buffers(pa.array(s.iloc[lo : lo + 256], pa.string(), from_pandas=True)))
                k, p, gap = m.decode(m.margins(x))
                parts.append(pd.DataFrame({"lang_pred": [m.languages[i] for i in k], "score": p.astype(float), "ambiguous": gap < least_gap}))
            return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"lang_pred": [], "score": [], "ambiguous": []})

    und = F.struct(F.lit("und").alias("lang_pred"), F.lit(1.0).alias("score"), F.lit(False).alias("ambiguous"))
    return docs.withColumn(name, judge(F.col(text))).withColumn(name, F.when(none, und).otherwise(F.col(name)))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of every row of `documents`, learnt from rows with a language that are not held out.

    Null texts and those without a letter are `und`; so are all where no row has a language. Equal losses go to the language that comes
    first by name, repeated rows give their values again, and a null doc_id is neither held out nor learnt from.
    """
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs.filter(common.learnable(F.col("doc_id"))))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score", "language.ambiguous")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents with a language: texts that are null or have no letter go. Learns as op6 does, from the stage's own rows."""
    common.small_batches(spark)
    model = train(docs.filter(common.learnable(F.col("doc_id"))))
    v = common.unused(docs, "language")
    return predict(docs, model, name=v).filter(F.col(f"`{v}`.lang_pred") != "und").select(*[F.col(f"`{c}`") for c in docs.columns])
