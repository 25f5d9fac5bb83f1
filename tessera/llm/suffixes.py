"""Distributed suffix sorting by the difference-cover method.

Strings are rows (s, c): an id and an array of symbols. At each level the suffixes that begin at positions not divisible by three are
sorted by their first three symbols and named by rank; the names, taken at positions 1 and 2 modulo three, are two shorter strings for
the next level, until names are unique. The other suffixes are sorted by first symbol and the rank of what follows, and merged with the
named ones by two more sorts in which both kinds have comparable keys. All sorts are Spark range sorts with the position as last key,
so that any number of equal keys spreads over tasks; only a few numbers for each partition go to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free, local_rows, written

END = -(1 << 63)  # the symbol after a string's last: less than all others


def flat(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and bounds of a list column."""
    o = a.offsets.to_numpy()
    return a.values.to_numpy(zero_copy_only=False)[o[0] : o[-1]], (o - o[0]).astype(np.int64)


def gather(rows: DataFrame, *values: str) -> DataFrame:
    """Rows (s, i, values) to one row for each s: arrays i and values, by i."""
    got = rows.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("i", *values))).alias("a"))
    return got.select("s", F.col("a.i").alias("i"), *[F.col(f"a.{v}").alias(v) for v in values])


def sorted_groups(rows: DataFrame, keys: list[str], name: str, payload: tuple[str, ...] = ("s", "i"), carry: str | None = None) -> DataFrame:
    """Rows in the order of the keys with g, the dense rank of their keys (from 1), and z and e.

    Where rows have a column `kind`, rows of kind 0 come first among equals; e is 0 if a row's group has one, else 1; z is how many
    groups up to the row's have one or, given a column to carry, the largest value so far of rows of kind 0. Written to the shared
    folder, since the offsets of later partitions come from a second look.
    """
    has_kind = "kind" in rows.columns
    cols = [*keys, *(["kind"] if has_kind else []), *payload]
    types = dict(rows.dtypes)

    names = ["g", "z", "e", "pid", "end"]

    def number(batches):
        """A batch at a time; only the last row's key and counts are carried to the next."""
        pid, held, last, g, z, zero = TaskContext.get().partitionId(), None, None, 0, 0, False
        for b in batches:
            if not b.num_rows:
                continue
            k = [b.column(c).to_numpy() for c in keys]
            new = np.ones(b.num_rows, bool)
            new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in k])
            new[0] = last is None or any(x[0] != y for x, y in zip(k, last, strict=True))
            kind = b.column("kind").to_numpy() if has_kind else np.ones(b.num_rows, np.int32)
            group = np.cumsum(new)
            zeros = np.r_[zero, (kind == 0)[new]]
            if carry:
                zs = np.maximum.accumulate(np.r_[z, np.where(kind == 0, b.column(carry).to_numpy(), 0)])[1:]
            else:
                zs = z + np.cumsum((kind == 0) & new)
            end = np.zeros(b.num_rows, np.int32)
            end[0] = last is None
            if held is not None:
                yield held
            held = pa.RecordBatch.from_arrays([*b.columns, pa.array(g + group), pa.array(zs.astype(np.int64)), pa.array(1 - zeros[group].astype(np.int32)), pa.array(np.full(b.num_rows, pid, np.int32)), pa.array(end)], [*b.schema.names, *names])
            last, g, z, zero = [x[-1] for x in k], int(g + group[-1]), int(zs[-1]), bool(zeros[-1])
        if held is not None:
            end[-1] += 2
            yield held.set_column(held.num_columns - 1, "end", pa.array(end))

    done = written(rows.select(*cols).orderBy(*cols).mapInArrow(number, ", ".join(f"{c} {types[c]}" for c in cols) + ", g long, z long, e int, pid int, end int"), name)
    # the first and the last row of each partition go to the driver
    ends: dict[int, dict] = {}
    for r in done.filter("end > 0").collect():
        of = ends.setdefault(r["pid"], {"pid": r["pid"]})
        if r["end"] & 1:
            of["a"] = r
        if r["end"] & 2:
            of |= {"b": r, "z": r["z"]}
    add, g, z, last, last_e = [], 0, 0, None, 1
    for r in sorted(ends.values(), key=lambda r: r["pid"]):
        same = tuple(r["a"][k] for k in keys) == last
        dz = int(same and last_e == 0 and r["a"]["e"] == 0)  # its group was counted in the partition before
        add.append((r["pid"], g - int(same), z - dz, same and last_e == 0))
        one = r["b"]["g"] == 1
        last_e = 0 if one and same and last_e == 0 else r["b"]["e"]
        g, z, last = g - int(same) + r["b"]["g"], max(z, r["z"]) if carry else z - dz + r["z"], tuple(r["b"][k] for k in keys)
    schema = pa.schema({"pid": pa.int32(), "dg": pa.int64(), "dz": pa.int64(), "zero": pa.bool_()})
    offsets = local_rows(done.sparkSession, add, schema)
    out = done.join(F.broadcast(offsets), "pid")  # a row for each partition
    z = F.greatest("z", "dz") if carry else F.col("z") + F.col("dz")
    return out.select(*cols, (F.col("g") + F.col("dg")).alias("g"), z.alias("z"), F.when(F.col("zero") & (F.col("g") == 1), 0).otherwise(F.col("e")).alias("e"))


def _shifted(v: np.ndarray, bounds: np.ndarray, by: int, fill: int) -> np.ndarray:
    """Each position's value some places on in its own string."""
    out = np.full(len(v), fill, np.int64)
    end = np.repeat(bounds[1:], np.diff(bounds))
    at = np.arange(len(v)) + by
    ok = at < end
    out[ok] = v[at[ok]]
    return out


def _positions(strings: DataFrame, wanted: tuple[int, ...], make, schema: str) -> DataFrame:
    """A row (s, i, ...) for each position of one of the classes modulo three."""

    def rows(batches):
        for b in batches:
            s = b.column(0).to_numpy()
            c, bounds = flat(b.column(1))
            size = np.diff(bounds)
            i = np.arange(len(c)) - np.repeat(bounds[:-1], size)
            keep = np.isin(i % 3, wanted)
            cols = {"s": np.repeat(s, size), "i": i.astype(np.int32)} | make(c, bounds, i, *(flat(b.column(k))[0] for k in range(2, b.num_columns)))
            t = pa.RecordBatch.from_pydict({k: pa.array(v[keep]) for k, v in cols.items()})
            for lo in range(0, t.num_rows, 1 << 16):
                yield t.slice(lo, 1 << 16)

    return strings.mapInArrow(rows, "s long, i int, " + schema)


def merge_keys(strings: DataFrame, most_levels: int = 40) -> DataFrame:
    """(s, i, z, e, r) of every position of strings (s, c): sorting by z, e, r sorts the suffixes, and equal keys are equal suffixes.

    With fewer levels than it takes the names to be unique, suffixes are sorted by their first 3 ** (levels + 1) symbols at least, and
    those that share so many come together in any order.
    """
    triples = _positions(strings, (1, 2), lambda c, b, i: {"c0": c, "c1": _shifted(c, b, 1, END), "c2": _shifted(c, b, 2, END)}, "c0 long, c1 long, c2 long")
    named = sorted_groups(triples, ["c0", "c1", "c2"], "triples")
    names = written(named.select("s", "i", "g"), "names")
    free(named)
    n, distinct, longest = names.agg(F.count("*"), F.max("g"), F.max("i")).first()
    if n == (distinct or 0) or longest is None or longest <= 2 or most_levels == 0:
        ranks = names.select("s", "i", F.col("g").alias("r"))
        spare = []
    else:
        shorter = names.select((2 * F.col("s") + F.col("i") % 3 - 1).alias("s"), F.floor(F.col("i") / 3).cast("int").alias("i"), "g")
        shorter = written(gather(shorter, "g").select("s", F.col("g").alias("c")), "shorter")
        deep = final_ranks(shorter, most_levels - 1)
        ranks = deep.select(F.floor(F.col("s") / 2).alias("s"), (3 * F.col("i") + 1 + F.pmod("s", F.lit(2))).cast("int").alias("i"), "r")
        spare = [shorter, deep]
    got = gather(ranks, "r").withColumnRenamed("i", "at")
    both = strings.join(got, "s", "left").select("s", "c", F.coalesce("at", F.array().cast("array<int>")).alias("at"), F.coalesce("r", F.array().cast("array<long>")).alias("r"))
    both = written(_with_ranks(both), "ranked")
    free(names, *spare)
    shift = lambda c, b, i, r: {"kind": (i % 3).astype(np.int32), "c0": c, "c1": _shifted(c, b, 1, END), "r1": _shifted(r, b, 1, 0), "r2": _shifted(r, b, 2, 0), "r": r}
    schema = "kind int, c0 long, c1 long, r1 long, r2 long, r long"
    one = sorted_groups(_positions(both, (0, 1), shift, schema), ["c0", "r1"], "merge1", ("s", "i", "r", "c1", "r2"))
    # suffixes of the first kind take their rank along, so that both sorts place the others between the same ones
    ranked = one.filter("kind = 0").select("kind", "c0", "c1", "r2", "s", "i", "r", F.col("z").alias("d"))
    two = _positions(both, (2,), shift, schema).select("kind", "c0", "c1", "r2", "s", "i", "r", F.lit(0).cast("long").alias("d"))
    two = sorted_groups(ranked.unionByName(two), ["c0", "c1", "r2"], "merge2", ("s", "i", "r", "d"), carry="d").filter("kind <> 0")
    free(both)
    pick = lambda d: d.select("s", "i", "z", "e", F.when(F.col("e") == 0, F.lit(0)).otherwise(F.col("r")).alias("r"))
    return pick(one).unionByName(pick(two))


def _with_ranks(both: DataFrame) -> DataFrame:
    """(s, c, r): r has the rank at sampled positions, else 0."""

    def rows(batches):
        for b in batches:
            c, bounds = flat(b.column(1))
            at, ab = flat(b.column(2))
            r = np.zeros(len(c), np.int64)
            r[np.repeat(bounds[:-1], np.diff(ab)) + at] = flat(b.column(3))[0]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(r))], ["s", "c", "r"])

    return both.mapInArrow(rows, "s long, c array<long>, r array<long>")


def final_ranks(strings: DataFrame, most_levels: int = 40) -> DataFrame:
    """(s, i, r): the dense rank of every suffix of strings (s, c), from 1; equal suffixes alike."""
    keys = merge_keys(strings, most_levels).select("s", "i", F.col("z").alias("k0"), F.col("e").alias("k1"), F.col("r").alias("k2"))
    ranks = sorted_groups(keys, ["k0", "k1", "k2"], "ranks").select("s", "i", F.col("g").alias("r"))
    free(keys)
    return ranks
