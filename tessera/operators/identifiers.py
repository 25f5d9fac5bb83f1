"""New values in an identifier's formats, no two alike and none that the data hold.

A format's places are the digits of a number in mixed radix, and a keyed Feistel network permutes these numbers. So the place of a row in
a random order of the rows gives its value, and different rows have different values: nothing is drawn again. A value that the data hold
(known by salted digests, so that a model keeps no identifiers) is exchanged for the next number of its format that is free, by rank.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.rng import order_key, uniform
from tessera.functions.scalar import mask_of
from tessera.operators.joins import dense_index, running_total
from tessera.operators.masks import CLASSES, fixed_width, formats
from tessera.sources.tables import settled

#: Numbers of a format stay below this; places before those that it takes are drawn apart. Formats that an expression lists; more are joined.
LIMIT, LISTED = 1 << 52, 1000
ROUNDS, PRIME = 6, (1 << 31) - 1
_MAX = {"tinyint": 2**7 - 1, "smallint": 2**15 - 1, "int": 2**31 - 1, "bigint": 2**63 - 1}


def round_keys(seed: str, column: str) -> list[tuple[int, int, int]]:
    """Three numbers below the prime for each round, from a digest."""
    out = []
    for i in range(ROUNDS):
        d = hashlib.sha256(f"{seed}|{column}|{i}".encode()).digest()
        out.append(tuple(1 + int.from_bytes(d[4 * j : 4 * j + 4], "big") % (PRIME - 1) for j in range(3)))
    return out


def permute(x: Column, a: Column, b: Column, k: Column, seed: str, column: str) -> Column:
    """A permutation of the numbers below a * b, another one for each k: halves (x div b, x mod b) take turns in being shifted."""
    keys = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(c).cast("long").alias("c"), F.lit(d).cast("long").alias("d")) for m, c, d in round_keys(seed, column)])
    mixed = lambda y, r: (y * r["m"] + r["c"] + k * 7919) % PRIME
    half = lambda l, r, ml, mr: F.struct(l.alias("l"), r.alias("r"), ml.alias("ml"), mr.alias("mr"))
    turn = lambda s, r: half(s["r"], (s["l"] + (mixed(s["r"], r) * mixed(s["r"], r) + r["d"]) % PRIME) % s["ml"], s["mr"], s["ml"])
    long = lambda c: c.cast("long")
    return F.aggregate(keys, half(long(F.call_function("div", x, b)), long(x % b), long(a), long(b)), turn, lambda s: s["l"] * b + s["r"])


def digest(salt: str, value: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(salt), value))


def learn(df: DataFrame, column: str, salt: str, fixed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(formats, known), both written to the shared folder.

    formats: (k, mask, n, alphabets, places, a, b, m), most frequent first: n rows and m values of the mask, a * b numbers. A format whose
    numbers its own values fill more than half gets all characters of each place's class; whole numbers keep a first digit that is not 0
    and stay within their type. known: (h, k, r), the digest of each value and its rank among those of its format. Nulls and empty
    texts have no format. fixed: whole numbers are of one format, as long as the longest, instead of one for each length.
    """
    kind = df.schema[column].dataType.simpleString()
    v = df.select(F.col(column).cast("string").alias("v")).filter("v <> ''")
    mask = fixed_width(v) if fixed else mask_of(F.col("v"))
    found = formats(v, "v", mask)
    values = settled(v.distinct().withColumn("mask", mask), "values")
    per = values.groupBy("mask").agg(F.count("*").alias("m"))
    f = dense_index(found.join(per, "mask").withColumn("_less", -F.col("n")), ["_less", "mask"], "k")
    wide = F.transform("alphabets", lambda al, i: _whole(F.substring("mask", i + 1, F.lit(1)), al))
    f = f.withColumn("alphabets", _numbers(F.col("alphabets"), kind)).withColumn("_wide", _numbers(wide, kind))
    f = f.withColumn("_s", _space(F.col("alphabets"))).withColumn("alphabets", F.when(F.col("_s.size") < 2 * F.col("m"), F.col("_wide")).otherwise(F.col("alphabets")))
    f = f.withColumn("_s", _space(F.col("alphabets"))).withColumn("a", F.floor(F.sqrt("_s.size")).cast("long"))
    fs = settled(f.select(F.col("k").cast("long"), "mask", "n", "alphabets", F.col("_s.places").alias("places"), "a", F.call_function("div", F.col("_s.size"), F.col("a")).alias("b"), "m"), "formats")
    known = rank_within(values.join(fs.select("mask", "k"), "mask").select(digest(salt, F.col("v")).alias("h"), "k"), "k", "h", "r")
    return fs, settled(known, "known")


def _whole(symbol: Column, otherwise: Column) -> Column:
    out = otherwise
    for s, letters in CLASSES.items():
        out = F.when(symbol == s, F.lit(letters)).otherwise(out)
    return out


def _numbers(alphabets: Column, kind: str) -> Column:
    """Alphabets of a whole number: no leading zero, and nothing beyond the type. Others stay."""
    if kind not in _MAX:
        return alphabets
    top = str(_MAX[kind])
    first = F.when(F.col("mask").startswith("-"), 1).otherwise(0)
    width = F.length("mask") - first
    lead = "".join(str(d) for d in range(1, int(top[0]))) or "1"

    def digits(al: Column, i: Column) -> Column:
        longest = width == len(top)
        out = F.when((i == first) & longest, F.lit(lead)).when((i == first) & (width > 1), F.regexp_replace(al, "0", ""))
        if top[0] == "1":  # the type's largest value starts with 1: the second place stays below its second digit
            out = out.when((i == first + 1) & longest, F.lit("".join(str(d) for d in range(max(int(top[1]), 1)))))
        return out.otherwise(al)

    got = F.transform(alphabets, digits)
    return F.transform(got, lambda al: F.when(al == "", F.lit("123456789")).otherwise(al))


def _space(alphabets: Column) -> Column:
    """(size, places): numbers of the last places that fit below the limit, and each place's worth (0 for those that are drawn apart)."""
    start = F.struct(F.lit(1).cast("long").alias("size"), F.array().cast("array<long>").alias("places"), F.lit(True).alias("open"))

    def add(s: Column, al: Column) -> Column:
        size = s["size"] * F.length(al)
        fits = s["open"] & (size <= LIMIT)
        worth = F.when(fits, s["size"]).otherwise(F.lit(0).cast("long"))
        return F.struct(F.when(fits, size).otherwise(s["size"]).cast("long").alias("size"), F.concat(F.array(worth), s["places"]).alias("places"), fits.alias("open"))

    return F.aggregate(F.reverse(alphabets), start, add)


def rank_within(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Rows numbered from 0 within each key by an order, without a task for a key: the dense index less the key's first one."""
    ranked = settled(dense_index(df, [key, order], "_at"), "ranked")
    first = ranked.groupBy(F.col(key).alias("_key")).agg(F.min("_at").alias("_first"))
    return ranked.join(first, F.col(key) == F.col("_key")).withColumn(name, (F.col("_at") - F.col("_first")).cast("long")).drop("_at", "_key", "_first")


def quotas(fs: DataFrame, rows: int) -> DataFrame:
    """fs with base and quota: rows by the formats' shares, at most as many as a format has free numbers.

    What a format cannot take goes to the first ones with room; `rows` less the sum of quotas is what no format can take.
    """
    f = running_total(fs.withColumn("n", F.col("n").cast("double")), "k", "n", "_upto")
    total = fs.agg(F.sum("n")).first()[0] or 1
    cut = lambda c: F.floor(c * (rows / total)).cast("long")
    last = F.col("k") == fs.agg(F.max("k")).first()[0]
    share = F.when(last, F.lit(rows)).otherwise(cut(F.col("_upto") + F.col("n"))) - cut(F.col("_upto"))
    free = F.greatest(F.col("a") * F.col("b") - F.col("m"), F.lit(0))
    f = settled(f.withColumn("_share", share).withColumn("_q", F.least("_share", free)).withColumn("_room", free - F.col("_q")), "quotas")
    excess = f.agg(F.sum(F.col("_share") - F.col("_q"))).first()[0] or 0
    f = running_total(f, "k", "_room", "_before")
    more = F.greatest(F.least(F.lit(excess) - F.col("_before").cast("long"), F.col("_room")), F.lit(0))
    f = running_total(f.withColumn("quota", (F.col("_q") + more).cast("long")), "k", "quota", "_base")
    return settled(f.withColumn("base", F.col("_base").cast("long")).select(*fs.columns, "base", "quota"), "quotas")


def _text(v: Column, seed: str, column: str, rid: Column) -> Column:
    """The text of a number in a row's format (columns alphabets, places)."""

    def place(al: Column, i: Column) -> Column:
        worth = F.element_at("places", i + 1)
        of_number = F.call_function("div", v, F.greatest(worth, F.lit(1).cast("long"))) % F.length(al)
        drawn = F.floor(uniform(seed, f"{column}:place", i, rid) * F.length(al))
        return F.when(F.length(al) == 1, al).otherwise(F.substring(al, F.when(worth > 0, of_number).otherwise(drawn).cast("int") + 1, F.lit(1)))

    return F.array_join(F.transform("alphabets", place), "")


def _widened(text: Column, turn: Column, whole: bool, width: int) -> Column:
    """A text of an exhausted format made longer, as none in a format is: whole numbers grow at the front, others get a mark and a number."""
    if not whole:
        return F.concat(text, F.lit("~"), turn.cast("string"))
    sign = F.when(text.startswith("-"), "-").otherwise("")
    return F.concat(sign, (turn + 1).cast("string"), F.lpad(F.regexp_replace(text, "-", ""), width, "0"))


def values(order: DataFrame, rid: str, column: str, fs: DataFrame, known: DataFrame, seed: str, salt: str, kind: str = "string") -> DataFrame:
    """(rid, column) for each row of order, which has rid and its place `_j` among all rows.

    Rows beyond what all formats hold get values that are longer than any format, still all different. Without a format all are null;
    where a whole number's type has no longer values, they are null.
    """
    n = order.count()
    if fs.isEmpty() or not n:
        return order.select(rid, F.lit(None).cast(kind).alias(column))
    q = quotas(fs, n)
    stats = q.agg(F.sum("quota").alias("q"), F.count("*").alias("f"), F.max(F.length("mask")).alias("w")).first()
    turned = order.select(rid, F.pmod(F.col("_j") + int(hashlib.sha256(column.encode()).hexdigest()[:8], 16), F.lit(n)).alias("_j"))
    regular = _assigned(turned.filter(F.col("_j") < stats["q"]), q, stats["f"])
    drawn = regular.withColumn("_v", permute(F.col("_j") - F.col("base"), F.col("a"), F.col("b"), F.col("k"), seed, column))
    drawn = drawn.withColumn("_t", _text(F.col("_v"), seed, column, F.col(rid))).select(rid, "k", "_j", "_t", digest(salt, F.col("_t")).alias("h"))
    held = settled(drawn.join(known.select("h", F.lit(True).alias("_known")), "h", "left").drop("h"), "drawn")
    # free numbers beyond the quota: of so many as the data hold at least enough are free
    spare = known.join(q, "k").withColumn("_v", permute(F.col("quota") + F.col("r"), F.col("a"), F.col("b"), F.col("k"), seed, column))
    spare = spare.withColumn("_t", _text(F.col("_v"), seed, column, F.col("r"))).select("k", "r", "_t", digest(salt, F.col("_t")).alias("h"))
    free = rank_within(spare.join(known.select("h"), "h", "left_anti"), "k", "r", "_e").select("k", "_e", F.col("_t").alias("_new"))
    moved = rank_within(held.filter("_known").select(rid, "k", "_j"), "k", "_j", "_e").join(free, ["k", "_e"])
    out = held.filter("_known is null").select(rid, "_t").unionByName(moved.select(rid, F.col("_new").alias("_t")))
    if stats["q"] < n:
        one = q.filter("k = 0")
        over = turned.filter(F.col("_j") >= stats["q"]).withColumn("_w", F.col("_j") - stats["q"]).crossJoin(F.broadcast(one))
        size = F.col("a") * F.col("b")
        text = _text(permute(F.col("_w") % size, F.col("a"), F.col("b"), F.col("k"), seed, column), seed, column, F.col(rid))
        over = over.withColumn("_t", text).withColumn("_x", F.call_function("div", F.col("_w"), size))
        out = out.unionByName(over.select(rid, _widened(F.col("_t"), F.col("_x"), kind in _MAX, stats["w"]).alias("_t")))
    return out.select(rid, (F.col("_t") if kind == "string" else F.col("_t").try_cast(kind)).alias(column))


def _assigned(rows: DataFrame, q: DataFrame, count: int) -> DataFrame:
    """Rows with the format whose range of places holds theirs."""
    if count <= LISTED:
        bases = [r["base"] for r in q.select("k", "base").orderBy("k").collect()]
        k = F.size(F.filter(F.array(*[F.lit(b) for b in bases]), lambda b: b <= F.col("_j"))) - 1
        return rows.withColumn("k", k.cast("long")).join(F.broadcast(q), "k")  # at most LISTED rows
    step = 1 << 16
    some = q.filter("quota > 0").withColumn("_lo", F.explode(F.sequence("base", F.col("base") + F.col("quota") - 1, F.lit(step).cast("long"))))
    places = some.select("k", "_lo", F.least(F.col("_lo") + step, F.col("base") + F.col("quota")).alias("_hi")).repartition("_lo")
    return rows.join(places.select("k", F.explode(F.sequence("_lo", F.col("_hi") - 1)).alias("_j")), "_j").join(q, "k")


def generate(rows: DataFrame, rid: str, columns: dict[str, tuple[DataFrame, DataFrame, str, str]], seed: str) -> DataFrame:
    """(rid and a column of new values for each entry): {column: (formats, known, salt, type)}. Row ids must differ."""
    order = settled(dense_index(rows.select(rid).withColumn("_o", order_key(seed, "identifiers", F.col(rid))), ["_o", rid], "_j").select(rid, F.col("_j").cast("long")), "order")
    out = order.select(rid)
    for c, (fs, known, salt, kind) in columns.items():
        out = out.join(values(order, rid, c, fs, known, seed, salt, kind), rid)
    return out
