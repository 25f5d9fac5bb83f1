"""Joins of related tables: context, degrees, expansion, keys, splits and overlaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.rng import order_key, uniform


def first_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row for each key, the first by an order; an aggregate, so a frequent key is no burden."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_r")).select(*keys, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def parent_context(child: DataFrame, parent: DataFrame, keys: list[str], columns: list[str], prefix: str = "__ctx__", order: list[str] | None = None) -> DataFrame:
    """Child rows with columns of their parent (one row for each key); all child rows stay. Spark broadcasts a small parent."""
    p = first_by(parent.select(*keys, *columns), keys, *(order or columns)).select(*keys, *[F.col(c).alias(prefix + c) for c in columns])
    return child.join(p, keys, "left")


def child_counts(parent: DataFrame, child: DataFrame, keys: list[str], name: str = "degree") -> DataFrame:
    """Parent rows with how many children each has, zero included; children are counted before the join."""
    n = child.groupBy(*keys).agg(F.count("*").alias(name))
    return parent.join(n, keys, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def expand(parent: DataFrame, degree: str, index: str = "child_index") -> DataFrame:
    """Each parent row as many times as its degree says, numbered from 1; none for zero, null and negative degrees."""
    return parent.filter(F.col(degree) > 0).withColumn(index, F.explode(F.sequence(F.lit(1).cast("long"), F.col(degree).cast("long"))))


def bridged(child: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Foreign keys that the parent row already carries are copied: {child column: parent column}."""
    return child.withColumns({c: F.col(p) for c, p in mapping.items()})


def dense_index(df: DataFrame, keys: list[str], name: str = "idx") -> DataFrame:
    """Rows numbered from 0 by the order of their keys, without bringing them to one task: range-sorted parts, counted first.

    The counts of the parts (one small row each) are summed up and joined back.
    """
    spark = df.sparkSession
    parts = df.orderBy(*keys).withColumn("_pid", F.spark_partition_id())
    parts = parts.persist()
    n = sorted((r["_pid"], r["n"]) for r in parts.groupBy("_pid").agg(F.count("*").alias("n")).collect())
    start, rows = 0, []
    for pid, k in n:
        rows.append((pid, start))
        start += k
    offsets = spark.createDataFrame(rows, "_pid int, _off long")
    w = Window.partitionBy("_pid").orderBy(*keys)
    return parts.join(F.broadcast(offsets), "_pid").withColumn(name, F.row_number().over(w) - 1 + F.col("_off")).drop("_pid", "_off")


def random_parent(child: DataFrame, rid: Column, parent: DataFrame, key: str, seed: int, stream: str, name: str) -> DataFrame:
    """A uniformly random parent key for each child row, by an equi-join on the parents' dense index."""
    p = dense_index(parent.select(F.col(key).alias(name)).distinct(), [name], "_i")
    total = p.agg(F.count("*").alias("_n"))
    c = child.withColumn("_u", uniform(seed, stream, rid)).crossJoin(F.broadcast(total))
    return c.withColumn("_i", F.floor(F.col("_u") * F.col("_n"))).join(p, "_i", "left").drop("_i", "_u", "_n")


def path_agreement(child: DataFrame, bridge: DataFrame, direct: str, other: str) -> DataFrame:
    """One row: n_joined, mismatch and status of whether child and bridge rows of a direct key agree on another key."""
    b = bridge.select(direct, F.col(other).alias("_other")).dropDuplicates([direct])
    got = child.select(direct, other).join(b, direct).agg(F.count("*").alias("n_joined"), F.coalesce(F.avg((~F.col(other).eqNullSafe(F.col("_other"))).cast("double")), F.lit(0.0)).alias("mismatch"))
    return got.withColumn("status", F.when(F.col("mismatch") <= 0.01, "PASS").otherwise("WARN"))


def holdout(tables: dict[str, DataFrame], roots: dict[str, str], children: list[tuple[str, str, str, str]], fraction: float = 0.25, seed: int = 13) -> dict[str, tuple[DataFrame, DataFrame]]:
    """(train, test) of each table: roots by a hash of their key, children (child, column, parent, column) as their parent."""
    out = {}
    for t, key in roots.items():
        in_test = uniform(seed, f"holdout:{t}", F.col(key)) < fraction
        out[t] = (tables[t].filter(~in_test), tables[t].filter(in_test))
    for child, col, parent, pcol in children:
        keys = out[parent][1].select(F.col(pcol).alias(col)).distinct()
        out[child] = (tables[child].join(keys, col, "left_anti"), tables[child].join(keys, col, "left_semi"))
    return out


def value_overlap(real: DataFrame, synth: DataFrame, column: str) -> DataFrame:
    """One row: n_real, n_synth distinct values, n_shared, and leak, the share of the synthetic rows whose value is real."""
    r = real.select(F.col(column).cast("string").alias("v")).dropna().distinct().withColumn("r", F.lit(1))
    s = synth.select(F.col(column).cast("string").alias("v")).dropna().groupBy("v").agg(F.count("*").alias("n"))
    both = s.join(r, "v", "full")
    return both.agg(F.count("r").alias("n_real"), F.count("n").alias("n_synth"), F.count_if(F.col("r").isNotNull() & F.col("n").isNotNull()).alias("n_shared"), F.coalesce(F.sum(F.when(F.col("r").isNotNull(), F.col("n"))) / F.sum("n"), F.lit(0.0)).alias("leak"))


def row_copies(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """One row: n_rows, n_copied, copied: synthetic rows that equal a real one in all columns as text, nulls alike."""
    names = [f"c{i}" for i in range(len(columns))]
    text = lambda d: d.select(*[F.col(c).cast("string").alias(n) for c, n in zip(columns, names, strict=True)])
    s = text(synth).groupBy(*names).agg(F.count("*").alias("n"))
    r = text(real).distinct().select(*[F.col(n).alias("r" + n) for n in names])
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col("r" + n)) for n in names])
    hit = s.join(r, same, "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n_copied"))
    return synth.agg(F.count("*").alias("n_rows")).crossJoin(F.broadcast(hit)).withColumn("copied", F.when(F.col("n_rows") > 0, F.col("n_copied") / F.col("n_rows")).otherwise(0.0))


def aligned_shares(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """(value, p, q): shares of each value on both sides, zero where it is missing; nulls left out."""
    def share(d, name):
        n = d.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
        return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).select("value", (F.col("n") / F.col("t")).alias(name))

    return share(a, "p").join(share(b, "q"), "value", "full").na.fill(0.0, ["p", "q"])


def hash_sample(df: DataFrame, n: int, seed: int, *ids: str) -> DataFrame:
    """N rows in random order, alike every time."""
    return df.orderBy(order_key(seed, "sample", *[F.col(i) for i in ids]), *ids).limit(n)


def running_total(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """The sum of a value over the rows of smaller key (keys are distinct): range-sorted parts, their sums added up and joined back."""
    parts = df.orderBy(key).withColumn("_pid", F.spark_partition_id()).persist()
    sums = sorted((r["_pid"], r["s"]) for r in parts.groupBy("_pid").agg(F.sum(value).alias("s")).collect())
    start, rows = 0.0, []
    for pid, s in sums:
        rows.append((pid, start))
        start += float(s or 0)
    w = Window.partitionBy("_pid").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.sparkSession.createDataFrame(rows, "_pid int, _off double")
    return parts.join(F.broadcast(offsets), "_pid").withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0.0)) + F.col("_off")).drop("_pid", "_off")


def stratified_split(df: DataFrame, label: str, fraction: float, seed: int, *ids: str) -> DataFrame:
    """A column `part`, train or test, with the fraction of each label in train.

    A row's rank within its label is its dense index less its label's first, so that a frequent label is not one task.
    """
    drawn = df.withColumn("_u", uniform(seed, "split", *[F.col(i) for i in ids]))
    ranked = dense_index(drawn, [label, "_u", *ids], "_i")
    first = ranked.groupBy(F.col(label).alias("_l")).agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    both = ranked.join(first, F.col(label).eqNullSafe(F.col("_l")))
    rank = F.when(F.col("_n") > 1, (F.col("_i") - F.col("_first")) / (F.col("_n") - 1)).otherwise(0.0)
    return both.withColumn("part", F.when(rank < fraction, "train").otherwise("test")).select(*df.columns, "part")


def bootstrap(df: DataFrame, columns: list[str], seed: int, rid: str, number: str | None = None) -> DataFrame:
    """Every column resampled on its own with replacement: a row for each row, columns independent of each other.

    number: a column for the new rows' numbers, from 0, which are the same every time.
    """
    base = dense_index(df.select(rid, *columns), [rid], "_i")
    n = df.count()
    # one join: a row asks for a (column, index) pair for each column, and the values come back together
    asked = base.select(F.col("_i").alias("_row"), F.explode(F.array(*[F.struct(F.lit(k).alias("_c"), F.floor(uniform(seed, f"boot:{c}", F.col("_i")) * n).alias("_j")) for k, c in enumerate(columns)])).alias("_x"))
    got = asked.select("_row", "_x._c", "_x._j").join(base.select(F.col("_i").alias("_j"), *columns), "_j")
    return got.groupBy("_row").agg(*[F.max_by(c, (F.col("_c") == k).cast("int")).alias(c) for k, c in enumerate(columns)]).select(*([F.col("_row").alias(number)] if number else []), *columns)


def sort_series(df: DataFrame, keys: list[str], sortby: list[str]) -> DataFrame:
    """Rows of a key together and in order within each part, without a global sort."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *sortby)


def labelled_union(real: DataFrame, synth: DataFrame, name: str = "label") -> DataFrame:
    """Real rows (0) and synthetic rows (1), columns by name."""
    return real.withColumn(name, F.lit(0)).unionByName(synth.withColumn(name, F.lit(1)))
