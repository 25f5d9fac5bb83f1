"""Mixing sources to target weights, by hash-threshold histograms. DataFrame functions only.

Sources share the words of the whole table by weight. A source takes each of its documents as often as its target holds the source in
full, and once more those that a threshold on a hash of the row lets pass: words are summed by source and hash bucket, the first bucket
that goes beyond what is left of the target is cut into finer buckets, and all before it are taken. Where the document at the threshold
is too long for what is left, a further threshold follows for those that are short enough, until a source is near its target. Thresholds
are nested: a larger target takes all that a smaller one takes up to its first threshold. Nothing is sorted but buckets of one source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.operators.joins import dense_index

#: Bits of the hash that a round of histograms looks at; two longs are a row's place, the second tells rows of one hash apart.
DIGIT = 8
WEIGHTS = (1, 2, 3)
#: No document is taken more often.
MOST = 3
_STEPS = "array<struct<most:long,a:long,b:long>>"
_FIRST, _LAST = -(2**63), 2**63 - 1


def words(text: Column) -> Column:
    """How many runs of anything but the six spaces a text has; 0 for null. Takes twice the text's memory at most."""
    marks = F.regexp_replace(text, "[^\\x20\\x09-\\x0D]+", "x")
    return F.coalesce(F.length(F.translate(marks, common.SPACES, "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target, copies, gap) from (source, source_size).

    Sources in the order of their code points, null last, have the weights in turn. They share the sum of all sizes; a target stops at
    `most` times its source's size, and what is beyond goes to the others by weight until none is above. The target is copies of the
    whole source and a gap of words, both exact.
    """
    turn = F.array(*[F.lit(w) for w in weights])
    ranked = dense_index(sizes.withColumn("_last", F.col("source").isNull()), ["_last", "source"], "_i")
    s = common.written(ranked.select("source", "source_size", F.element_at(turn, (F.col("_i") % len(weights)).cast("int") + 1).cast("decimal(38,0)").alias("w")), "sources")
    size = F.col("source_size").cast("decimal(19,0)")
    r = s.agg(F.coalesce(F.sum(size), F.lit(0)).cast("decimal(38,0)").alias("t"), F.coalesce(F.sum("w"), F.lit(1)).cast("decimal(38,0)").alias("w")).first()
    total, num, den = int(r["t"]), int(r["t"]), int(r["w"])
    while True:  # num/den words for a unit of weight; it rises each time, so that a source that is full stays full
        full = F.col("w") * F.lit(num).cast("decimal(30,0)") > size * F.lit(most * den).cast("decimal(18,0)")
        r = s.agg(F.sum(F.when(full, size)).alias("c"), F.sum(F.when(~full, F.col("w"))).alias("w")).first()
        held = most * int(r["c"] or 0)
        if (total - held, int(r["w"] or 1)) == (num, den):
            break
        num, den = total - held, int(r["w"] or 1)
    share = F.col("w").cast("decimal(8,0)") * F.lit(num).cast("decimal(30,0)")
    exact = s.withColumn("full", full).withColumn("share", share).withColumn("whole", F.when(F.col("full"), F.lit(most) * F.col("source_size")).otherwise(F.expr(f"share div {den}")))
    copies = F.when(F.col("source_size") > 0, F.expr("whole div source_size")).otherwise(0)
    target = F.when(F.col("full"), F.col("whole").cast("double")).otherwise(F.col("share").cast("double") / float(den))
    return exact.select("source", "source_size", target.alias("target"), copies.cast("long").alias("copies"), (F.col("whole") - copies * F.col("source_size")).cast("long").alias("gap"))


def _before(place: Column) -> Column:
    """Whether a row's hashes lie before a place."""
    return (F.col("h1") < place["a"]) | ((F.col("h1") == place["a"]) & (F.col("h2") < place["b"]))


def _levels() -> list[tuple[int, str, int]]:
    """(bits still to come, hash that the next digit is of, bits below that digit) from the first digit to the last."""
    return [(bits, "h1" if bits > 64 else "h2", (bits - DIGIT) % 64) for bits in range(128, 0, -DIGIT)]


def _digit() -> Column:
    """A row's next digit; digits have the order of the hashes, which are signed."""
    out = F.lit(None).cast("long")
    for bits, h, below in _levels():
        d = F.shiftright(h, below)
        out = F.when(F.col("bits") == bits, d if bits % 64 == 0 else d.bitwiseAND(F.lit((1 << DIGIT) - 1).cast("long"))).otherwise(out)
    return out


def _start() -> tuple[Column, Column]:
    """Where the bucket `digit` within the current one, which starts at (a, b), starts."""
    out = {"h1": F.col("a"), "h2": F.col("b")}
    for bits, h, below in _levels():
        at = F.shiftleft("digit", below)
        out[h] = F.when(F.col("bits") == bits, at if bits % 64 == 0 else F.col("a" if h == "h1" else "b").bitwiseOR(at)).otherwise(out[h])
    return out["h1"], out["h2"]


def _inside() -> Column:
    """Whether a row lies in its source's current bucket: the digits so far agree."""
    out = F.lit(True)
    for bits, _, _ in _levels()[1:]:
        same = F.shiftright("h1", max(bits - 64, 0)) == F.shiftright("a", max(bits - 64, 0))
        out = F.when(F.col("bits") == bits, same if bits >= 64 else same & (F.shiftright("h2", bits) == F.shiftright("b", bits))).otherwise(out)
    return out


def thresholds(rows: DataFrame, goal: DataFrame, near: float = 0.001) -> DataFrame:
    """(source, steps, last): the steps (most, a, b) of each source: of its rows of at most so many words those before (a, b) are taken.

    rows: source, size, h1, h2, the latter different for all rows; goal: source, target, gap. Steps go on until the gap is at most a
    share of the target or no further row fits; then the shortest row left is `last`, if it brings the source nearer to its target.
    """
    cols = ("gap", "cap", "a", "b", "bits", "place", "steps", "done")
    first = F.struct(F.lit(_FIRST).alias("a"), F.lit(_FIRST).alias("b"))
    end = F.struct(F.lit(_LAST).alias("a"), F.lit(_LAST).alias("b"))
    enough = F.floor(F.lit(near) * F.col("target"))
    start = goal.select("source", enough.alias("enough"), "gap", F.lit(_LAST).alias("cap"), F.lit(_FIRST).alias("a"), F.lit(_FIRST).alias("b"), F.lit(128).alias("bits"), first.alias("place"), F.array().cast(_STEPS).alias("steps"), (F.col("gap") <= enough).alias("done"))
    state = common.written(start, "mix")
    while not state.filter("not done").isEmpty():
        live = rows.filter("size > 0").join(state.filter("not done").withColumnRenamed("source", "src"), F.col("source").eqNullSafe(F.col("src")))
        live = live.filter((F.col("size") <= F.col("cap")) & ~_before(F.col("place")) & _inside())
        by = live.groupBy("source", _digit().alias("digit")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.first("gap").alias("gap"))
        summed = by.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("digit")))
        # of each source the first bucket that goes beyond the gap, and all words where none does
        cut = summed.groupBy(F.col("source").alias("src")).agg(F.min(F.when(F.col("upto") > F.col("gap"), F.struct("digit", "size", "n", "upto"))).alias("c"), F.sum("size").alias("all"))
        s = state.join(cut, F.col("source").eqNullSafe(F.col("src")), "left").withColumn("digit", F.col("c.digit"))
        none = F.col("c").isNull()
        a, b = _start()
        s = s.withColumn("a2", a).withColumn("b2", b).withColumn("left", F.col("gap") - F.when(none, F.coalesce("all", F.lit(0))).otherwise(F.col("c.upto") - F.col("c.size")))
        s = s.withColumn("now", F.when(none, end).otherwise(F.greatest("place", F.struct(F.col("a2").alias("a"), F.col("b2").alias("b")))))
        settled = none | (F.col("c.n") == 1) | (F.col("bits") == DIGIT)  # a bucket of more rows is cut into finer ones
        step = F.array(F.struct(F.col("cap").alias("most"), F.col("now.a").alias("a"), F.col("now.b").alias("b")))
        new = F.struct(
            F.col("left").alias("gap"), F.when(settled, F.col("left")).otherwise(F.col("cap")).alias("cap"),
            F.when(settled, F.lit(_FIRST)).otherwise(F.col("a2")).alias("a"), F.when(settled, F.lit(_FIRST)).otherwise(F.col("b2")).alias("b"),
            F.when(settled, F.lit(128)).otherwise(F.col("bits") - DIGIT).alias("bits"), F.col("now").alias("place"),
            F.when(settled, F.concat("steps", step)).otherwise(F.col("steps")).alias("steps"), (none | (settled & (F.col("left") <= F.col("enough")))).alias("done"),
        )
        s = s.withColumn("new", new)
        state, old = common.written(s.select("source", "enough", *[F.when(F.col("done"), F.col(c)).otherwise(F.col(f"new.{c}")).alias(c) for c in cols]), "mix"), state
        common.free(old)
    short = state.filter(F.col("gap") > F.col("enough")).select(F.col("source").alias("src"), "gap", "steps")
    left = rows.filter("size > 0").join(short, F.col("source").eqNullSafe(F.col("src"))).filter(~passed(F.col("steps")))
    last = left.groupBy(F.col("source").alias("src")).agg(F.min(F.struct("size", "h1", "h2")).alias("last"), F.first("gap").alias("gap")).filter(F.col("last.size") < 2 * F.col("gap")).drop("gap")
    return state.join(last, F.col("source").eqNullSafe(F.col("src")), "left").select("source", "steps", "last")


def passed(steps: Column) -> Column:
    """Whether one of the steps takes a row."""
    return F.exists(steps, lambda s: (F.col("size") <= s["most"]) & _before(s))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, near: float = 0.001, seed: int = 0, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): how often the mix takes each document, and its words times that.

    Rows are drawn by a hash of id, source and size; rows that agree in all three are told apart by where a written table holds them,
    which changes nothing of the result since they are alike. Null and empty texts have no words and are taken with the whole source
    only; a null source is a source of its own, a null id is hashed like any other. An empty table gives no rows.
    """
    size = words(F.col(text))
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"))
    held = common.written(slim.withColumn("h1", F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.col("source").cast("string"), "size")), "sizes")
    rows = held.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("h2"))
    goal = common.written(targets(held.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    cuts = thresholds(rows, goal, near)
    plan = common.written(goal.join(cuts.withColumnRenamed("source", "src"), F.col("source").eqNullSafe(F.col("src")), "left").drop("src", "gap").withColumnRenamed("source", "src"), "mix")
    both = rows.join(plan, F.col("source").eqNullSafe(F.col("src")), "left")
    once = passed(F.col("steps")) | F.coalesce((F.col("last.h1") == F.col("h1")) & (F.col("last.h2") == F.col("h2")), F.lit(False))
    copies = F.col("copies") + F.when((F.col("size") > 0) & F.coalesce(once, F.lit(False)), 1).otherwise(0)
    return both.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, copies) of every row of `documents`: sources weigh 1, 2, 3, repeating.

    See mix() for nulls, empty texts and repeated rows. Each source's words taken are within a thousandth of its target where whole
    documents allow it, else as near as the shortest document left brings them.
    """
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
