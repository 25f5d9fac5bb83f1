"""Profiling and type inference: a table's statistics come from one aggregate over all its columns."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalar import epoch_seconds, parse_date, to_number
from tessera.operators import quantiles
from tessera.types import CATEGORICAL, DATETIME, NON_STD, NUMERICAL, OTHER, TIMEDELTA

GRIDS = (86400, 3600, 60, 1)


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_date(t: T.DataType) -> bool:
    return isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType))


def as_number(df: DataFrame, c: str) -> Column:
    """A column in model space: epoch seconds of dates, else a double."""
    t = df.schema[c].dataType
    if is_date(t):
        return epoch_seconds(F.col(c))
    if isinstance(t, T.DayTimeIntervalType):
        return F.extract(F.lit("DAY"), F.col(c)) * 86400.0 + F.extract(F.lit("HOUR"), F.col(c)) * 3600.0 + F.extract(F.lit("MINUTE"), F.col(c)) * 60.0 + F.extract(F.lit("SECOND"), F.col(c)).cast("double")
    return to_number(F.col(c))


def unpivot_stats(row, columns: list[str], stats: list[str]) -> DataFrame:
    """A one-row frame of <column>__<stat> as a row for each column."""
    each = [F.struct(F.lit(c).alias("column_name"), *[F.col(f"`{c}__{s}`").alias(s) for s in stats]) for c in columns]
    return row.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def null_and_distinct(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """IO2, T2: (column_name, n_rows, n_nulls, null_ratio, n_distinct) of each column, exact."""
    cols = columns or df.columns
    aggs = []
    for c in cols:
        x = F.col(f"`{c}`")
        aggs += [F.count("*").alias(f"{c}__n_rows"), F.count_if(x.isNull()).alias(f"{c}__n_nulls"), F.coalesce(F.avg(x.isNull().cast("double")), F.lit(0.0)).alias(f"{c}__null_ratio"), F.count_distinct(x).alias(f"{c}__n_distinct")]
    return unpivot_stats(df.agg(*aggs), cols, ["n_rows", "n_nulls", "null_ratio", "n_distinct"])


def kind_stats(df: DataFrame) -> dict[str, dict]:
    """The figures that column kinds are inferred from, for all columns in one pass."""
    aggs = []
    for f in df.schema.fields:
        x = F.col(f"`{f.name}`")
        aggs += [F.count(x).alias(f"{f.name}__n"), F.count_distinct(x).alias(f"{f.name}__u")]
        if isinstance(f.dataType, T.StringType):
            aggs += [F.avg(x.rlike(r"^\d+$").cast("double")).alias(f"{f.name}__digits"), F.avg(parse_date(x).isNotNull().cast("double")).alias(f"{f.name}__dates")]
    r = df.agg(*aggs).first().asDict()
    return {f.name: {k: r.get(f"{f.name}__{k}") for k in ("n", "u", "digits", "dates")} for f in df.schema.fields}


def kind_of(t: T.DataType, n: int, u: int, digits: float | None, dates: float | None, most_categories: int = 50, least_unique: int = 2, unique_ratio: float = 0.05) -> str:
    """The kind of a column by its type, non-null rows, distinct values and how its texts look."""
    if not n:
        return CATEGORICAL
    if is_date(t):
        return DATETIME
    if isinstance(t, (T.DayTimeIntervalType, T.YearMonthIntervalType)):
        return TIMEDELTA
    if isinstance(t, T.BooleanType):
        return CATEGORICAL
    if is_numeric(t):
        return CATEGORICAL if u <= max(least_unique, min(most_categories, 20)) and (u / n < unique_ratio or u <= 10) else NUMERICAL
    if isinstance(t, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
        raise TypeError(f"nested or binary columns have no kind: {t.simpleString()}")
    if (digits or 0) < 1 and (dates or 0) > 0.95:
        return DATETIME
    return NON_STD if u > most_categories and u / n > 0.5 else CATEGORICAL


def infer_kinds(df: DataFrame, overrides: dict[str, str] | None = None, **limits) -> dict[str, str]:
    """Kinds of all columns; overrides win."""
    stats = kind_stats(df)
    out = {f.name: kind_of(f.dataType, **{k: stats[f.name][k] for k in ("n", "u", "digits", "dates")}, **limits) for f in df.schema.fields}
    return out | {c: k for c, k in (overrides or {}).items() if c in out}


def categories(df: DataFrame, column: str, most: int = 50) -> DataFrame:
    """(value, n, rank, category): values by frequency (ties: value); all if at most `most`, else the others count as __other__."""
    from tessera.operators.joins import dense_index

    n = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    ranked = dense_index(n.withColumn("_less", -F.col("n")), ["_less", "value"], "_i").withColumn("rank", (F.col("_i") + 1).cast("int")).drop("_i", "_less")
    total = n.agg(F.count("*").alias("total"))
    keep = F.when(F.col("total") <= most, F.col("rank") <= most).otherwise(F.col("rank") < most)
    return ranked.crossJoin(F.broadcast(total)).withColumn("category", F.when(keep, F.col("value")).otherwise(F.lit(OTHER))).drop("total")


def domain_bounds(df: DataFrame, columns: list[str]) -> DataFrame:
    """T4: (column_name, low, high) in model space; equal bounds are set a billionth apart."""
    aggs = []
    for c in columns:
        x = as_number(df, c)
        low, high = F.min(x), F.max(x)
        aggs += [low.alias(f"{c}__low"), F.when(high <= low, low + 1e-9).otherwise(high).alias(f"{c}__high")]
    return unpivot_stats(df.agg(*aggs), columns, ["low", "high"])


def granularity(df: DataFrame, columns: list[str]) -> DataFrame:
    """T5: (column_name, granularity): the coarsest of day, hour, minute and second on which all values lie, else 0."""
    aggs = []
    for c in columns:
        x = as_number(df, c)
        out = F.lit(0)
        for g in reversed(GRIDS):
            off = F.max(F.least(F.pmod(x, F.lit(float(g))), g - F.pmod(x, F.lit(float(g)))))
            out = F.when(off <= 1e-6, F.lit(g)).otherwise(out)
        aggs.append(out.cast("long").alias(f"{c}__granularity"))
    return unpivot_stats(df.agg(*aggs), columns, ["granularity"])


def decimal_places(df: DataFrame, columns: list[str], most: int = 6) -> DataFrame:
    """(column_name, decimals): the fewest places that hold every value; null beyond `most`."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        out = F.lit(None).cast("int")
        for k in range(most, -1, -1):
            out = F.when(F.max(F.abs(x - F.bround(x, k))) <= 1e-9, F.lit(k)).otherwise(out)
        aggs.append(out.cast("long").alias(f"{c}__decimals"))
    return unpivot_stats(df.agg(*aggs), columns, ["decimals"])


def fingerprints(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """A number for each column, from one aggregate: the sum of its values' hashes, each salted by a hash of the whole row.

    Equal columns have equal numbers; others have not, but for chance: the salt ties a value to its row, so an order does not matter and a
    permutation of the same values is told apart. Numbers of parts of a table add up. An empty table gives none.
    """
    row = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in columns])
    salted = df.withColumn("_row", row)
    one = lambda c: F.xxhash64(F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")), F.col("_row")).cast("decimal(20,0)")
    got = salted.agg(*[F.sum(one(c)).alias(f"f{i}") for i, c in enumerate(columns)]).first()
    return {c: int(got[f"f{i}"]) for i, c in enumerate(columns) if got[f"f{i}"] is not None}


def duplicate_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(source, duplicate) of columns alike in every row, nulls included; the source is the first such column. Exact.

    Columns of one fingerprint are compared with the first of them, all in one aggregate: as many comparisons as there are duplicates.
    """
    cols = columns or df.columns
    groups: dict[int, list[str]] = {}
    for c, f in fingerprints(df, cols).items():
        groups.setdefault(f, []).append(c)
    todo, found = [g for g in groups.values() if len(g) > 1], []
    text = lambda c: F.col(f"`{c}`").cast("string")
    while todo:
        pairs = [(g[0], c) for g in todo for c in g[1:]]
        same = df.agg(*[F.bool_and(text(a).eqNullSafe(text(b))).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
        found += [p for i, p in enumerate(pairs) if same[f"p{i}"]]
        other = {b for i, (_, b) in enumerate(pairs) if not same[f"p{i}"]}  # of one fingerprint by chance
        todo = [g for g in ([c for c in g if c in other] for g in todo) if len(g) > 1]
    return df.sparkSession.createDataFrame(found, "source string, duplicate string")


def mirrors(df: DataFrame, columns: list[str] | None = None) -> dict[str, str]:
    """Duplicate to source."""
    if len(columns or df.columns) < 2:
        return {}
    return {r["duplicate"]: r["source"] for r in duplicate_columns(df, columns).collect()}


def near_duplicates(df: DataFrame, pairs: list[tuple[str, str]], least: float = 0.9) -> DataFrame:
    """(left_column, right_column, exact, relaxed): shares of rows equal as they are, and without case and outer spaces."""
    aggs = []
    for i, (a, b) in enumerate(pairs):
        x, y = F.col(a).cast("string"), F.col(b).cast("string")
        aggs += [F.avg((x == y).cast("double")).alias(f"e{i}"), F.avg((F.upper(F.trim(x)) == F.upper(F.trim(y))).cast("double")).alias(f"r{i}")]
    row = df.agg(*aggs)
    each = F.array(*[F.struct(F.lit(a).alias("left_column"), F.lit(b).alias("right_column"), F.col(f"e{i}").alias("exact"), F.col(f"r{i}").alias("relaxed")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(each).alias("x")).select("x.*").filter(F.col("relaxed") > least)


def derive_domains(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, low, high, log): bounds with room to spare, and whether the column asks for a logarithm."""
    cuts = quantiles.quantiles(df, {c: as_number(df, c) for c in columns if not is_date(df.schema[c].dataType)}, [0.5, 0.99])
    aggs = []
    for c in columns:
        x = as_number(df, c)
        low, high = F.min(x), F.max(x)
        span = high - low
        if is_date(df.schema[c].dataType):
            pad = F.when(span > 0, 0.05 * span).otherwise(86400.0)
            aggs += [(low - pad).alias(f"{c}__low"), (high + pad).alias(f"{c}__high"), F.lit(False).alias(f"{c}__log")]
            continue
        lo = F.when(low > 0, 0.95 * low).when(low == 0, F.lit(0.0)).otherwise(low - 0.1 * span)
        mid, top = (F.lit(v).cast("double") for v in cuts[c] or (None, None))
        aggs += [lo.alias(f"{c}__low"), (high + 0.05 * span).alias(f"{c}__high"), F.coalesce((lo >= 0) & (mid > 0) & (top / F.nullif(mid, F.lit(0.0)) > 8), F.lit(False)).alias(f"{c}__log")]
    return unpivot_stats(df.agg(*aggs), columns, ["low", "high", "log"])


def max_degree(child: DataFrame, keys: list[str], least: int = 4, most: int = 2000) -> DataFrame:
    """One row, max_degree: a quarter more than the largest number of children, within bounds."""
    n = child.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("n"))
    return n.select(F.least(F.greatest(F.bround(1.25 * F.coalesce("n", F.lit(0))).cast("long"), F.lit(least).cast("long")), F.lit(most).cast("long")).alias("max_degree"))
