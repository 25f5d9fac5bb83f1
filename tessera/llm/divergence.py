"""Source divergence audit: how far the sources of a language differ, and which words set a source apart.

Words are counted in tasks, by language and source, and summed; from then on everything goes by cells. All words of a source with the same
count there and in the whole language are one cell, and all words with the same counts in all sources are one vector: a score is computed
once for a cell, times its words. Scores are whole numbers, so sums are exact in any order.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common

# fixed values: parts of a probability, and what is added to each count
SCALE, ADDED = 1_000_000_000, 2
#: Letters of ASCII in lower case, and all bytes of other characters.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_END = re.compile(rb"[^a-z\x80-\xff]")
#: Bytes of a text that are split at once, and (source, word) entries that a task holds before it hands them on.
SEGMENT, ENTRIES = 1 << 20, 200_000


def segments(data: bytes, size: int = SEGMENT):
    """A long text in parts that end between words."""
    lo = 0
    while lo < len(data):
        end = _END.search(data, min(lo + size, len(data)))
        hi = end.start() if end else len(data)
        yield data[lo:hi]
        lo = hi + 1


def counted(docs: DataFrame, group: list[Column], text: Column) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of terms and documents that hold them, summed by task; a null term counts the rows."""
    rows = docs.select(*[F.coalesce(c.cast("string"), F.lit("")).alias(n) for c, n in zip(group, ("lang", "source"), strict=True)], F.coalesce(text, F.lit("")).alias("text"))

    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        with common.lean():
            for b in batches:
                keys = list(zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True))
                texts = b.column("text").cast(pa.binary())
                for i, key in enumerate(keys):
                    if key not in held:
                        held[key] = Counter(), Counter()
                    n, docs = held[key]
                    size -= len(n)
                    docs[None] += 1
                    seen: set[bytes] = set()
                    for part in segments(texts[i].as_py().lower()):
                        terms = _TERM.findall(part)
                        n.update(terms)
                        seen.update(terms)
                    docs.update(seen)
                    size += len(n)
                    if size > ENTRIES:
                        yield from _batches(held)
                        held, size = {}, 0
            yield from _batches(held)

    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _batches(held: dict, rows: int = 20_000):
    for (lang, source), (n, docs) in held.items():
        terms = list(docs)
        for lo in range(0, len(terms), rows):
            part = terms[lo : lo + rows]
            k = len(part)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * k, pa.string()), "source": pa.array([source] * k, pa.string()), "term": common.strings(part), "n": pa.array([n[t] for t in part], pa.int64()), "docs": pa.array([docs[t] for t in part], pa.int64())})


def share(n: str, total: str, terms: str) -> Column:
    """Smoothed parts in SCALE of a term of count n, of a total over so many terms, rounded down and one more."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * cast({n} + {ADDED} as decimal(19,0))) div cast({total} + {ADDED} * {terms} as decimal(20,0))")


def score(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


class Audit:
    """Counts of the kept terms of each language, by source; see op11_divergence for the scores."""

    def __init__(self, docs: DataFrame, least_docs: int = 10, lang: str = "lang", source: str = "source", text: str = "text"):
        """Null languages, sources and texts are empty strings. A language keeps the terms that at least so many of its rows hold."""
        each = counted(docs, [F.col(lang), F.col(source)], F.col(text)).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        # a term's counts come together, at most one for each source, so a frequent term is a short row
        by = each.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("by"))
        self.kept = common.written(by.filter(F.col("term").isNull() | (F.col("docs") >= least_docs)), "terms")
        self.terms = self.kept.filter("term is not null")
        self.each = self.terms.select("lang", "term", F.col("n").alias("total"), F.explode("by").alias("x")).select("lang", "x.source", "term", "x.n", "total")
        groups = self.kept.filter("term is null").select("lang", F.explode("by.source").alias("source"))
        langs = self.terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_sum"))
        sums = self.each.groupBy("lang", "source").agg(F.sum("n").alias("sum"))
        got = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["sum", "terms", "lang_sum"])
        #: (lang, source, sum, terms, lang_sum): every group, and how many terms its language keeps.
        self.groups = common.written(got, "groups")

    def ranked_terms(self, top: int = 10) -> DataFrame:
        """(lang, source, term, value, rank): the terms that a source has more of than its language, furthest first, ties by term."""
        cells = self.each.groupBy("lang", "source", "n", "total").agg(F.count("*").alias("m")).join(self.groups.filter("terms > 0"), ["lang", "source"])
        cells = cells.withColumn("p", share("n", "sum", "terms")).withColumn("q", share("total", "lang_sum", "terms")).filter("p > q").withColumn("value", score("p", "q"))
        # equal values rank together; those that begin within the first ranks are expanded to their terms
        values = cells.groupBy("lang", "source", "value").agg(F.sum("m").alias("m"))
        w = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
        first = values.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top).withColumn("before", F.sum("m").over(w) - F.col("m")).filter(F.col("before") < top)
        open_cells = cells.join(first.select("lang", "source", "value"), ["lang", "source", "value"]).select("lang", "source", "n", "total", "value")
        named = self.each.join(open_cells, ["lang", "source", "n", "total"])
        by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
        return named.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top).select("lang", "source", "term", "value", "rank")

    def pairs(self) -> DataFrame:
        """(lang, source, other, value): the score of each two sources of a language, summed over all its terms.

        Most terms are missing from most sources. So a pair starts from the score of two zeros for every term, and adds what a term of
        one source changes where the other has none, and what the terms of both change beyond that.
        """
        zero = self.groups.withColumn("p0", F.when(F.col("terms") > 0, share("0", "sum", "nullif(terms, 0)")))
        a = zero.select("lang", F.col("source").alias("g"), F.col("sum").alias("gs"), F.col("p0").alias("g0"), "terms")
        b = zero.select("lang", F.col("source").alias("h"), F.col("sum").alias("hs"), F.col("p0").alias("h0"))
        both = a.join(b, "lang").filter("g < h").withColumn("f00", score("g0", "h0"))
        two = common.written(both, "pairs")
        one = two.select("lang", "g", "h", F.col("g").alias("source"), F.col("gs").alias("s"), F.col("h0").alias("o"), "terms", "f00")
        one = one.unionByName(two.select("lang", "g", "h", F.col("h").alias("source"), F.col("hs").alias("s"), F.col("g0").alias("o"), "terms", "f00"))
        counts = self.each.groupBy("lang", "source", "n").agg(F.count("*").alias("m"))
        single = counts.join(one, ["lang", "source"]).withColumn("p", share("n", "s", "terms")).withColumn("v", F.col("m") * (score("p", "o") - F.col("f00")))
        vectors = self.terms.groupBy("lang", "by").agg(F.count("*").alias("m")).filter(F.size("by") > 1)
        left = vectors.select("lang", "m", "by", F.explode("by").alias("x"))
        cells = left.select("lang", "m", "x", F.explode(F.filter("by", lambda y: y["source"] > F.col("x.source"))).alias("y"))
        cells = cells.groupBy("lang", F.col("x.source").alias("g"), F.col("y.source").alias("h"), F.col("x.n").alias("gn"), F.col("y.n").alias("hn")).agg(F.sum("m").alias("m"))
        common_ = cells.join(two, ["lang", "g", "h"]).withColumn("p", share("gn", "gs", "terms")).withColumn("q", share("hn", "hs", "terms"))
        common_ = common_.withColumn("v", F.col("m") * (score("p", "q") - score("p", "h0") - score("g0", "q") + F.col("f00")))
        start = two.select("lang", "g", "h", F.coalesce(F.col("terms") * F.col("f00"), F.lit(0)).alias("v"))
        total = start.unionByName(single.select("lang", "g", "h", "v")).unionByName(common_.select("lang", "g", "h", "v")).groupBy("lang", "g", "h").agg(F.sum("v").alias("value"))
        way = F.explode(F.array(F.struct(F.col("g").alias("source"), F.col("h").alias("other")), F.struct(F.col("h").alias("source"), F.col("g").alias("other"))))
        return total.select("lang", way.alias("x"), "value").select("lang", "x.source", "x.other", "value")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, source, part, item, value, rank) of `documents`: part `pair` has every other source of the language, part `term` ten terms.

    A language whose terms are all rare has pairs of value 0; a source that is alone in its language has none. Repeated rows count as
    often as they occur; an empty table gives no rows.
    """
    audit = Audit(common.table(spark, sf_dir, "documents"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "other")
    pairs = audit.pairs().withColumn("rank", F.row_number().over(w)).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value", "rank")
    return pairs.unionByName(audit.ranked_terms().select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
a AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT a.*, CAST(1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY a.lang, a.source) + 2 * v.v) AS HUGEINT) AS p FROM a JOIN v ON v.lang = a.lang),
s AS (SELECT lang, term, sum(n) AS n FROM a GROUP BY lang, term),
q AS (SELECT s.lang, s.term, CAST(1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY s.lang) + 2 * v.v) AS HUGEINT) AS q FROM s JOIN v ON v.lang = s.lang),
f AS (SELECT p.lang, p.source, o.source AS item, sum(((p.p - o.p) * (p.p - o.p)) // (p.p + o.p)) AS value FROM p JOIN p o ON o.lang = p.lang AND o.term = p.term AND o.source <> p.source GROUP BY ALL),
pairs AS (SELECT g.lang, g.source, 'pair' AS part, o.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g JOIN g o ON o.lang = g.lang AND o.source <> g.source LEFT JOIN f ON f.lang = g.lang AND f.source = g.source AND f.item = o.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST(((p.p - q.q) * (p.p - q.q)) // (p.p + q.q) AS BIGINT) AS value
  FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""
