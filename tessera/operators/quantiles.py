"""Exact quantiles of whole columns, of many groups and columns at once, without a column in one task.

Order statistics are found by counting: a column's range is cut into buckets, only buckets that hold a wanted rank are cut again (between
the least and greatest value that they really hold), and what is left has at most some values, which are sorted where they lie together.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.tables import settled

#: Buckets that an interval is cut into, and values of an interval that are sorted together.
BUCKETS, TOGETHER = 64, 10_000
#: Intervals that are broadcast; more are joined.
LOOKED_UP = 100_000


def _long(df: DataFrame, group: str, columns: dict[str, Column]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(i).alias("c"), x.cast("double").alias("x")) for i, x in enumerate(columns.values())])
    return df.select(F.col(group).alias("_g"), F.explode(cells).alias("_x")).select("_g", "_x.c", "_x.x").filter("x is not null and not isnan(x)")


@dataclass
class Interval:
    """Values of a group's column between two that occur: so many, the first of them of some rank, and ranks that are wanted of them."""

    key: tuple
    low: float
    high: float
    rows: int
    first: int
    ranks: list[int]
    turn: int = 0

    def by_logarithm(self) -> bool:
        """Every second cut is by magnitude, where values spread over several: equal cuts alone would take a turn for each few powers of two."""
        return self.turn % 2 == 1 and (self.low * self.high <= 0 or not 0.1 < self.low / self.high < 10)

    def span(self) -> tuple[float, float]:
        """(low end, distance to the high one) on the scale of the cut."""
        lo, hi = (_magnitude(x) if self.by_logarithm() else x / 2 for x in (self.low, self.high))
        return lo, hi - lo


def _magnitude(x: float) -> float:
    """magnitude() of one number."""
    return math.copysign(max(math.log(abs(x)) + 745, 0.0), x) if x else 0.0


def magnitude(x: Column) -> Column:
    """Grows with x, in steps by its logarithm: from -1455 to 1455 over all doubles."""
    return F.signum(x) * F.greatest(F.coalesce(F.ln(F.abs(x)), F.lit(-745.0)) + 745, F.lit(0.0))


def grouped(df: DataFrame, group: str, columns: dict[str, Column] | list[str], wanted, together: int = TOGETHER, buckets: int = BUCKETS) -> dict[tuple, list[float]]:
    """{(group, column): values} at the shares that wanted(group, column, rows) asks for; linear between neighbours, nulls left out.

    A group without values has no entry. The driver gets counts of the buckets that are still open and the wanted values alone.
    """
    columns = columns if isinstance(columns, dict) else {c: F.col(f"`{c}`") for c in columns}
    names = list(columns)
    if not names:
        return {}
    long = _long(df, group, columns)
    kind = dict(long.dtypes)["_g"]
    found: dict[tuple, dict[int, float]] = {}
    shares: dict[tuple, list[float]] = {}
    sizes: dict[tuple, int] = {}
    held: list[Interval] = []
    for r in long.groupBy("_g", "c").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect():
        key, n = (r["_g"], names[r["c"]]), r["n"]
        shares[key], sizes[key], found[key] = list(wanted(*key, n)), n, {}
        ranks = sorted({k for p in shares[key] for k in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})
        held.append(Interval((r["_g"], r["c"]), r["lo"], r["hi"], n, 0, ranks))
    # at each turn `at` has the values of some intervals with the place of theirs in `now`
    now, turns = _open(held, names, found), 0
    at = long.join(_looked_up(df, [(*t.key, i) for i, t in enumerate(now)], f"_g {kind}, c int, _i int"), ["_g", "c"]).select("_i", "x") if now else None
    parts = []
    while now:
        if any(t.rows <= together for t in now):
            parts.append(_sorted_ranks(df, at, [(i, t) for i, t in enumerate(now) if t.rows <= together]))
        large = [(i, t) for i, t in enumerate(now) if t.rows > together]
        if not large:
            break
        # an interval's ends are worked out once, not for each row, which keeps what runs for a row small enough to be compiled
        bounds = _looked_up(df, [(i, t.by_logarithm(), *t.span()) for i, t in large], "_i int, log boolean, lo double, span double")
        even = F.when(F.col("log"), magnitude(F.col("x"))).otherwise(F.col("x") / 2)
        share = F.when(F.col("span") > 0, (even - F.col("lo")) / F.col("span") * buckets).otherwise(0.0)
        bucket = F.least(F.greatest(F.floor(F.when(F.isnan(share), F.lit(0.0)).otherwise(share)), F.lit(0)), F.lit(buckets - 1)).cast("int")
        cut = at.join(bounds, "_i").select("_i", "x", bucket.alias("b"))
        got: dict[int, list] = {}
        for r in cut.groupBy("_i", "b").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect():
            got.setdefault(r["_i"], []).append((r["b"], r["lo"], r["hi"], r["n"]))
        finer, slots = [], {}
        for i, t in large:
            first = t.first
            slots[i] = [-1] * buckets
            for b, lo, hi, n in sorted(got[i]):
                inside = [k for k in t.ranks if first <= k < first + n]
                if one := _open([Interval(t.key, lo, hi, n, first, inside, t.turn + 1)], names, found) if inside else []:
                    slots[i][b] = len(finer)
                    finer += one
                first += n
        if finer:
            to = _looked_up(df, list(slots.items()), "_i int, slots array<int>")
            at = cut.join(to, "_i").select(F.element_at("slots", F.col("b") + 1).alias("_i"), "x").filter("_i >= 0")
        now, turns = finer, turns + 1
        if now and turns % 3 == 0:  # a plan reads the column through all turns so far: what is left of it is written
            at = settled(at, "between")
    for part, intervals in parts:
        for r in part.collect():
            t = intervals[r["_i"]]
            found[t.key[0], names[t.key[1]]].update(zip(t.ranks, r["v"], strict=True))
    return {key: [_between(p * (sizes[key] - 1), found[key]) for p in ps] for key, ps in shares.items()}


def _open(intervals: list[Interval], names: list[str], found: dict) -> list[Interval]:
    """Intervals of one value answer their ranks; the others stay, if a rank is wanted of them."""
    out = []
    for t in intervals:
        if t.low == t.high:
            found[t.key[0], names[t.key[1]]].update(dict.fromkeys(t.ranks, t.low))
        elif t.ranks:
            out.append(t)
    return out


def _looked_up(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    table = df.sparkSession.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= LOOKED_UP else table


def _sorted_ranks(df: DataFrame, at: DataFrame, intervals: list[tuple[int, Interval]]) -> tuple[DataFrame, dict[int, Interval]]:
    """(interval, its wanted values): each interval's values are sorted together."""
    ranks = _looked_up(df, [(i, [k - t.first for k in t.ranks]) for i, t in intervals], "_i int, ranks array<int>")
    v = at.join(ranks, "_i").groupBy("_i").agg(F.sort_array(F.collect_list("x")).alias("v"), F.first("ranks").alias("ranks"))
    return v.select("_i", F.transform("ranks", lambda k: F.element_at("v", k + 1)).alias("v")), dict(intervals)


def _between(at: float, values: dict[int, float]) -> float:
    lo, hi = math.floor(at), math.ceil(at)
    return values[lo] if lo == hi else (hi - at) * values[lo] + (at - lo) * values[hi]


def quantiles(df: DataFrame, columns: dict[str, Column] | list[str], shares: list[float], **sizes) -> dict[str, list[float] | None]:
    """{column: values at the shares}; None for a column without values."""
    names = list(columns)
    got = grouped(df.withColumn("_all", F.lit(0)), "_all", columns, lambda g, c, n: shares, **sizes)
    return {c: got.get((0, c)) for c in names}
