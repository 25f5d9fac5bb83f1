"""URL filters: rules, and logistic regression on hashed character n-grams of host and path where no rule fits."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

BITS = 14
#: Host suffix, path prefix, verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.regexp_extract(_rest(url), r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits (host suffix at a dot, path prefix), as a struct of its text and verdict; null where none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def grams(host: str, path: str) -> np.ndarray:
    """Buckets of the character 2- to 4-grams of host and path, each marked with its part."""
    out = []
    for mark, text in (("h", host), ("p", path)):
        t = "^" + text + "$"
        out += [zlib.crc32(t[i : i + n].encode("utf-8", "surrogatepass"), n if mark == "h" else n + 16) & ((1 << BITS) - 1) for n in (2, 3, 4) for i in range(len(t) - n + 1)]
    return np.unique(np.array(out, np.int64))


@dataclass
class Logistic:
    weights: np.ndarray
    bias: float

    def score(self, g: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[g].sum() / np.sqrt(max(len(g), 1)), -30, 30))))


def fit(rows: list[tuple[str, str, int]], epochs: int = 200, rate: float = 2.0, l2: float = 1e-4) -> Logistic:
    """Full-batch gradient descent on a small table of (host, path, 1 for block); classes count alike. Without both classes all is allowed."""
    y = np.array([r[2] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return Logistic(np.zeros(1 << BITS), 5.0 if len(y) and y.min() == 1 else -5.0)
    g = [grams(h, p) for h, p, _ in rows]
    size = np.array([len(x) for x in g])
    row, col = np.repeat(np.arange(len(g)), size), np.concatenate(g)
    value = 1 / np.sqrt(size[row])
    each = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, b = np.zeros(1 << BITS), 0.0
    for _ in range(epochs):
        z = np.bincount(row, w[col] * value, len(g)) + b
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * each
        w -= rate * (np.bincount(col, d[row] * value, 1 << BITS) + l2 * w)
        b -= rate * d.sum()
    return Logistic(w, b)


def labelled(pages: DataFrame, most: int = 1000, rules=RULES, url: str = "url") -> list[tuple[str, str, int]]:
    """The small labelled table: at most that many distinct URLs of each verdict that rules decide, by hash."""
    p = pages.select(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).distinct()
    p = p.withColumn("verdict", rule_of(F.col("host"), F.col("path"), rules)["verdict"]).filter("verdict is not null").withColumn("key", F.concat_ws("|", "host", "path"))
    got = common.hash_sample(p, "key", most, "verdict").select("host", "path", "verdict").collect()
    return sorted((r["host"], r["path"], int(r["verdict"] == "block")) for r in got)


def judge(pages: DataFrame, model: Logistic, threshold: float = 0.5, rules=RULES, url: str = "url") -> DataFrame:
    """pages and host, path, rule, score, verdict: a rule's if one fits, else block from the threshold on.

    A null url, or one without ://, has empty host and path, and the model judges those. Input columns of these names are replaced.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(host: pd.Series, path: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score(grams(h, p)) for h, p in zip(host, path, strict=True)], dtype=float)

    host, path = host_of(F.col(url)), path_of(F.col(url))
    out = pages.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})
    out = out.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("score", probability("host", "path"))
    verdict = F.coalesce(F.col("rule.verdict"), F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return out.withColumn("verdict", verdict).withColumn("rule", F.col("rule.rule"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of `pages`.

    A null url, or one without ://, has empty host and path and no rule; repeated rows are given again. Without labelled URLs of both
    verdicts the model gives all it judges one verdict.
    """
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, fit(labelled(pages))).select("page_id", "host", "path", "rule", "verdict", "score")
