"""Toxicity by nearest labelled examples.

A bounded sample of labelled texts becomes TF-IDF vectors over all words, and beginnings of words, that two of them or more share. A word's inverse document
frequency carries how far the labels' shares of it differ (its log odds, never less than a tenth), as plain TF-IDF mostly finds texts
of the same common words. A block-max inverted index over the vectors gives each text its exact k nearest examples by cosine: the
blocks of the highest bounds are scored first, then all whose bound reaches the k-th best so far. Votes weighted by distance,
calibrated on the examples themselves (each left out of its own vote), give the score; the neighbours are the evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.words import WordIds

_WORD = re.compile(r"[^\W\d_]+")
BLOCK = 128
BEGINNINGS = (5, 7)  # letters
FLOOR = 0.1  # of the label factor of a word's weight
SLACK = 1e-5  # by which a bound in single precision may be short


def terms_of(text: str) -> Counter:
    """The terms of a whole text, in lower case, with their counts."""
    out: Counter = Counter()
    for w, n in Counter(_WORD.findall(text.lower())).items():
        for t in _terms(w):
            out[t] += n
    return out


def _terms(word: str) -> list[str]:
    """A word, and its beginnings where it is longer, so that inflections count."""
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)]


@dataclass
class Index:
    vocabulary: dict[str, int]
    idf: np.ndarray
    ids: list[str]  # of the examples that hold a term
    labels: np.ndarray
    weight: np.ndarray  # how many labelled rows an example stands for
    frequent: np.ndarray  # of each term its row among the frequent ones, else -1
    rows: np.ndarray  # weights of frequent terms, one for each example: long posting lists are dense
    posting_at: np.ndarray  # bounds of each (other term, block) in the postings
    posting_doc: np.ndarray
    posting_w: np.ndarray
    block_max: np.ndarray  # terms x blocks, in single precision
    prior: float  # of a text that shares no term with any example
    k: int
    curve: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    words: WordIds | None = None  # of each word met its terms' numbers; made in the task

    def vectors(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Term numbers and unit-length TF-IDF weights of whole texts."""
        if self.words is None:
            v = self.vocabulary
            self.words = WordIds(lambda words: [[v[t] for t in _terms(w) if t in v] for w in words], most=100_000)
        found = [_WORD.findall((t or "").lower()) for t in texts]
        ids, size = self.words.ids(self.words.numbers([w for f in found for w in f]))
        doc = np.repeat(np.repeat(np.arange(len(texts)), [len(f) for f in found]), size)
        key, n = np.unique(doc * (len(self.idf) + 1) + ids, return_counts=True)
        doc, term = np.divmod(key, len(self.idf) + 1)
        w = (1 + np.log(n)) * self.idf[term]
        w /= np.sqrt(np.bincount(doc, w * w, len(texts)))[doc]
        at = np.searchsorted(doc, np.arange(len(texts) + 1))
        return [(term[a:b], w[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], but: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each vector the k examples of highest positive cosine (ties: smaller number), and the cosines; but: an example to pass over."""
        q, blocks = len(vectors), self.block_max.shape[1]
        out = [(np.zeros(0, np.int64), np.zeros(0))] * q
        if not blocks or not q:
            return out
        of = np.repeat(np.arange(q), [len(t) for t, _ in vectors])
        term, w = (np.concatenate(x) for x in zip(*vectors, strict=True))
        bound = np.stack([x @ self.block_max[t] for t, x in vectors]) + SLACK
        row = self.frequent[term]
        dense = np.zeros((q, len(self.rows)))
        dense[of[row >= 0], row[row >= 0]] = w[row >= 0]
        of, term, w = of[row < 0], term[row < 0], w[row < 0]
        score = np.zeros((q, blocks * BLOCK))
        least = np.full(q, -1.0)
        order = np.argsort(-bound, axis=1, kind="stable")
        first = np.zeros_like(bound, bool)
        np.put_along_axis(first, order[:, : -(-self.k // BLOCK) + 1], True, 1)
        for here in (first, ~first):
            need = here & (bound > SLACK) & (bound >= least[:, None])
            for b in range(blocks):
                some = np.flatnonzero(need[:, b])
                if not len(some):
                    continue
                mine = need[of, b]
                cell = term[mine] * blocks + b
                lo, n = self.posting_at[cell], self.posting_at[cell + 1] - self.posting_at[cell]
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                place = np.repeat(of[mine] * BLOCK, n) + self.posting_doc[at] - b * BLOCK
                rare = np.bincount(place, np.repeat(w[mine], n) * self.posting_w[at], q * BLOCK).reshape(q, BLOCK)[some]
                # sums in another order differ in the last bits: equal cosines stay equal
                score[some, b * BLOCK : (b + 1) * BLOCK] = np.round(dense[some] @ self.rows[:, b * BLOCK : (b + 1) * BLOCK] + rare, 12)
            if but is not None:
                score[np.arange(q), but] = 0
            if score.shape[1] > self.k:
                least = np.partition(score, -self.k, axis=1)[:, -self.k]
        for i in range(q):
            docs = np.flatnonzero((score[i] > 0) & (score[i] >= least[i]))
            docs = docs[np.lexsort((docs, -score[i, docs]))[: self.k]]
            out[i] = docs, score[i, docs]
        return out

    def vote(self, docs: np.ndarray, sims: np.ndarray) -> float:
        """Share of the votes for label 1; the farther the neighbours, the more the prior counts."""
        if not len(docs):
            return self.prior
        w = self.weight[docs] * sims / (1.05 - np.minimum(sims, 1.0))
        return float((w @ self.labels[docs] + 0.01 * self.prior) / (w.sum() + 0.01))

    def score(self, vote: float) -> float:
        return float(np.clip(np.interp(vote, *self.curve), 0.0, 1.0))


def _isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean votes and label shares of the pools, rising in both."""
    pools: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        pools.append([x[i] * w[i], y[i] * w[i], w[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    p = np.array(pools)
    return np.r_[0.0, p[:, 0] / p[:, 2], 1.0], np.r_[min(p[0, 1] / p[0, 2], 0.01), p[:, 1] / p[:, 2], 1.0]


def build(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", k: int = 30, per_label: int = 750) -> Index:
    """An index over at most per_label labelled texts of each label (by id hash; equal texts once) and all words that two of them share.

    Rows without id, text or label teach nothing; of several labels of an id the larger counts. With no examples of label 1 every
    score is 0.
    """
    lab = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).filter("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    d = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).filter("id is not null and text is not null")
    known = d.select("id").distinct().join(lab, "id")
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ids = common.hash_sample(known, "id", per_label, "y")
    sample = d.join(F.broadcast(ids), "id").withColumn("same", F.xxhash64("text"))
    sample = common.written(sample.groupBy("same", "y").agg(F.min_by(F.struct("id", "text"), "id").alias("d")).select(F.col("d.id").cast("string").alias("id"), "d.text", "y"), "toxic-examples")
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    share = {y: total.get(y, 0) / max(n.get(y, 0), 1) for y in (0, 1)}

    def spread(c):
        t, y = [], []
        for s, v in zip(c["text"].to_pylist(), c["y"].to_pylist(), strict=True):
            found = terms_of(s)
            t += found
            y += [v] * len(found)
        return common.batch(term=pa.array(t, pa.string()), y=pa.array(y, pa.int32()))

    counts = common.map_rows(sample, spread, "term string, y int", 64).groupBy("term").agg(F.sum("y").alias("pos"), F.count("*").alias("df")).filter("df > 1").toArrow().sort_by("term")
    vocabulary = {t: i for i, t in enumerate(counts.column("term").to_pylist())}
    pos, df = counts.column("pos").to_numpy().astype(float), counts.column("df").to_numpy().astype(float)
    odds = np.log((pos + 1) / (n1 + 2)) - np.log((df - pos + 1) / (n0 + 2))
    sure = np.abs(odds) - 2 * np.sqrt(1 / (pos + 1) + 1 / (df - pos + 1))  # less two standard errors: rare words tell little
    idf = (np.log((1 + n0 + n1) / (1 + df)) + 1) * np.maximum(sure, FLOOR)
    p = n1 / max(n1 + n0, 1)
    none = np.zeros(0, int)
    index = Index(vocabulary, idf, [], np.zeros(0), np.zeros(0), np.full(len(idf), -1), np.zeros((0, 0)), np.zeros(1, int), none, np.zeros(0), np.zeros((len(idf), 0)), p, k)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def weigh(c):
        v = shared.value.vectors(c["text"].to_pylist())
        return common.batch(id=c["id"], y=c["y"], t=pa.array([a.astype(np.int32) for a, _ in v], pa.list_(pa.int32())), w=pa.array([b for _, b in v], pa.list_(pa.float64())))

    got = common.map_rows(sample, weigh, "id string, y int, t array<int>, w array<double>", 64).filter(F.size("t") > 0).toArrow().sort_by([("y", "ascending"), ("id", "ascending")])
    common.free(sample)
    if not got.num_rows or not n1:
        return index
    got = got.combine_chunks()
    at = got.column("t").chunk(0).offsets.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(got.num_rows), np.diff(at))
    term, w = got.column("t").chunk(0).flatten().to_numpy().astype(np.int64), got.column("w").chunk(0).flatten().to_numpy()
    blocks = -(-got.num_rows // BLOCK)
    cell = term * blocks + doc // BLOCK
    order = np.lexsort((doc, cell))
    top = np.zeros(len(idf) * blocks, np.float32)
    np.maximum.at(top, cell, w.astype(np.float32))
    often = np.flatnonzero(df >= max(got.num_rows / 16, 2))
    frequent = np.full(len(idf), -1)
    frequent[often] = np.arange(len(often))
    rows = np.zeros((len(often), blocks * BLOCK))
    known = frequent[term] >= 0
    rows[frequent[term[known]], doc[known]] = w[known]
    order = order[~known[order]]
    bounds = np.searchsorted(cell[order], np.arange(len(idf) * blocks + 1)).astype(np.int32)
    labels = got.column("y").to_numpy().astype(float)
    weight = np.array([share[0], share[1]])[labels.astype(int)]
    index = Index(vocabulary, idf, got.column("id").to_pylist(), labels, weight / weight.max(), frequent, rows, bounds, doc[order].astype(np.int32), w[order], top.reshape(len(idf), blocks), p, k)
    mine = [(term[lo:hi], w[lo:hi]) for lo, hi in zip(at[:-1] - at[0], at[1:] - at[0], strict=True)]
    near = [x for lo in range(0, len(mine), 64) for x in index.nearest(mine[lo : lo + 64], np.arange(lo, min(lo + 64, len(mine))))]
    votes = np.array([index.vote(*x) for x in near])
    index.curve = _isotonic(votes, index.labels, index.weight)
    index.prior = float(index.weight @ index.labels / index.weight.sum())
    return index


def score(docs: DataFrame, index: Index, text: str = "text", name: str = "toxicity", evidence: bool = True) -> DataFrame:
    """docs and a struct column: score (0 to 1) and evidence, the nearest examples with their cosines and labels.

    A text that shares no word with an example, empty or null, gets the share of label 1 among all labelled rows and no evidence.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)

    why_type = ", evidence array<struct<example:string,cosine:double,label:int>>" if evidence else ""

    @F.pandas_udf("score double" + why_type)
    def judge(s):
        with common.lean():
            ix, scores, why = shared.value, [], []
            none, texts = ix.prior if len(ix.ids) else 0.0, s.to_list()
            for lo in range(0, len(texts), 64):
                for docs, sims in ix.nearest(ix.vectors(texts[lo : lo + 64])):
                    scores.append(ix.score(ix.vote(docs, sims)) if len(docs) else none)
                    if evidence:
                        why.append([{"example": ix.ids[d], "cosine": float(x), "label": int(ix.labels[d])} for d, x in zip(docs, sims, strict=True)])
            out = pd.DataFrame({"score": np.array(scores, float)})
            return out.assign(evidence=pd.Series(why, dtype=object)) if evidence else out

    return docs.withColumn(name, judge(F.col(text)))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every row of `documents`, learnt from labelled rows that are not held out.

    Null and empty texts, and those of unknown words, get the labelled rows' share of label 1. A repeated row gives its values again,
    a null doc_id is not held out, and ties among neighbours go to the example of the smaller number (label, then id as text).
    """
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    index = build(docs.filter(common.learnable(F.col("doc_id"))), common.table(spark, sf_dir, "labels"))
    s = F.col("toxicity.score")
    return score(docs, index).select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), s.alias("score"), (s >= 0.3).cast("int").alias("predicted"), "toxicity.evidence")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.3) -> DataFrame:
    """Drop the documents that score at least 0.3; labels come from the labels table, texts from the stage's own rows."""
    common.small_batches(spark)
    index = build(docs.filter(common.learnable(F.col("doc_id"))), common.table(spark, sf_dir, "labels"))
    v = common.unused(docs, "toxicity")
    return score(docs, index, name=v, evidence=False).filter(F.col(f"`{v}`.score") < least).select(*[F.col(f"`{c}`") for c in docs.columns])
