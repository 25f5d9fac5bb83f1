"""The encoder: tables to columns of doubles and back, all as Spark expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.rng import uniform
from tessera.functions.scalar import from_epoch, inverse_log, log_transform, placeholder, placeholder_style
from tessera.operators import quantiles
from tessera.operators.profile import as_number, granularity, infer_kinds, is_date, is_numeric, mirrors
from tessera.types import CATEGORICAL, DATETIME, NON_STD, NUMERICAL, OTHER, TIMEDELTA, ColumnSpec

NULL_CODE = -1.0


#: Values of a column that its spec lists; more are a table.
LISTED = 1000
#: Types of identifiers that are made from formats, as texts of no other style are. Of style "fixed" they are all as long as the longest.
WHOLE = ("tinyint", "smallint", "int", "bigint")


def fit(df: DataFrame, overrides: dict[str, str] | None = None, domain: dict[str, dict] | None = None, styles: dict[str, str] | None = None, most_categories: int = 50, find_mirrors: bool = True) -> list[ColumnSpec]:
    """Specs of all columns: kinds, categories (T3), bounds (T4, declared ones win), grids (T5), decimals (T6), mirrors.

    One aggregate for figures, one more for the categories of all categorical columns together.
    """
    kinds = infer_kinds(df, overrides)
    domain, styles = domain or {}, styles or {}
    specs = []
    numeric = [c for c, k in kinds.items() if k in (NUMERICAL, DATETIME, TIMEDELTA)]
    aggs = [F.count("*").alias("n")]
    for c in df.columns:
        aggs.append(F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(f"{c}__null"))
    for c in numeric:
        x = as_number(df, c)
        aggs += [F.min(x).alias(f"{c}__lo"), F.max(x).alias(f"{c}__hi"), F.stddev_pop(x).alias(f"{c}__std")]
        for k in range(7):
            aggs.append(F.max(F.abs(x - F.bround(x, k))).alias(f"{c}__d{k}"))
    r = df.agg(*aggs).first().asDict()
    mid = quantiles.quantiles(df, {c: as_number(df, c) for c in numeric}, [0.5])
    dates = [c for c in numeric if kinds[c] == DATETIME]
    grids = {g["column_name"]: g["granularity"] for g in granularity(df, dates).collect()} if dates else {}
    cats = [c for c, k in kinds.items() if k == CATEGORICAL]
    values: dict[str, list[tuple[str, int]]] = {c: [] for c in cats}
    long: dict[str, tuple[str, int]] = {}
    if cats:
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in cats]))
        counted = df.select(pairs.alias("x")).select("x.*").filter("v is not null").groupBy("c", "v").agg(F.count("*").alias("n"))
        from pyspark.sql import Window

        counted = counted.persist()
        top = counted.withColumn("k", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("n"), "v")))
        for row in top.filter(F.col("k") <= LISTED).orderBy("c", "k").collect():
            values[row["c"]].append((row["v"], row["n"]))
        # a longer tail is a table of its own, since decoding draws from all of it
        for c in [r["c"] for r in counted.groupBy("c").count().filter(F.col("count") > LISTED).collect()]:
            long[c] = _tail_table(counted.filter(F.col("c") == c), most_categories - 1)
        counted.unpersist()
    same = mirrors(df) if find_mirrors else {}
    for f in df.schema.fields:
        c, k, d = f.name, kinds[f.name], domain.get(f.name, {})
        s = ColumnSpec(c, k, f.dataType.simpleString(), null_ratio=r[f"{c}__null"] or 0.0, mirror_of=same.get(c), style=styles.get(c) or placeholder_style(c))
        if k == CATEGORICAL:
            v = [x for x, _ in values[c]]
            s.categories, s.tail = (v, []) if len(v) <= most_categories else ([*v[: most_categories - 1], OTHER], v[most_categories - 1 :])
            if c in long:
                s.tail, (s.tail_table, s.tail_size) = [], long[c]
            if d.get("force_categories"):
                s.tail_table, s.tail_size = None, 0
                s.categories, s.tail, s.domain_source = [str(x) for x in d["force_categories"]], [], "declared"
        elif k == NON_STD and (s.style == "token" and s.dtype == "string" or s.dtype in WHOLE):
            from tessera.operators.identifiers import learn

            fixed = s.style == "fixed" and s.dtype in WHOLE
            s.style, s.salt = "mask", uuid.uuid4().hex
            s.formats_table, s.known_table = (_path(x) for x in learn(df, c, s.salt, fixed))
        elif c in numeric:
            lo, hi = d.get("min_val", r[f"{c}__lo"]), d.get("max_val", r[f"{c}__hi"])
            s.domain_source = "declared" if "min_val" in d or "max_val" in d else "data"
            s.low, s.high = float(lo if lo is not None else 0), float(hi if hi is not None else 1)
            if s.high <= s.low:
                s.high = s.low + 1e-9
            s.median, s.std = (mid[c] or [0.0])[0], float(r[f"{c}__std"] or 0)
            s.granularity = float(grids.get(c, 0))
            s.integral = isinstance(f.dataType, T.IntegralType)
            s.decimals = next((k for k in range(7) if (r[f"{c}__d{k}"] or 0) <= 1e-9), None)
            s.transform = d.get("transform")
        specs.append(s)
    return specs


def _path(table: DataFrame) -> str:
    """The folder of a table that was written as one."""
    return table.inputFiles()[0].rsplit("/", 1)[0]


def _tail_table(counted: DataFrame, skip: int) -> tuple[str, int]:
    """The values (k from 0, v) of a column beyond the most frequent ones, written to the shared folder; where it is and how many it has."""
    from tessera.operators.joins import dense_index
    from tessera.sources.tables import shared_dir

    spark = counted.sparkSession
    path = f"{shared_dir(spark)}/tail-{uuid.uuid4().hex}"
    ranked = dense_index(counted.select("v", (-F.col("n")).alias("less")), ["less", "v"], "i").filter(F.col("i") >= skip)
    ranked.select((F.col("i") - skip).cast("long").alias("k"), "v").write.parquet(path)
    return path, spark.read.parquet(path).count()


def code(c: Column, categories: list[str]) -> Column:
    """Place of a value in the dictionary; -1 for null; unknown values as __other__ if it has one, else -1."""
    if not categories:
        return F.lit(NULL_CODE)
    at = F.array_position(F.array(*[F.lit(x) for x in categories]), c.cast("string")).cast("double") - 1
    unknown = float(categories.index(OTHER)) if OTHER in categories else NULL_CODE
    return F.when(c.isNull(), F.lit(NULL_CODE)).when(at < 0, F.lit(unknown)).otherwise(at)


def transform(df: DataFrame, specs: list[ColumnSpec], keep: list[str] | None = None) -> DataFrame:
    """One select: codes of categories, numbers (P10 where asked for), 0 for identifiers; null stays null but for categories."""
    out = []
    for s in specs:
        if s.kind == CATEGORICAL:
            e = code(F.col(f"`{s.name}`"), s.categories)
        elif s.kind == NON_STD:
            e = F.lit(0.0)
        else:
            e = log_transform(as_number(df, s.name)) if s.transform == "log" else as_number(df, s.name)
        out.append(e.alias(s.name))
    return df.select(*[c for c in keep or [] if c not in {s.name for s in specs}], *out)


def decode_category(c: Column, s: ColumnSpec, u: Column) -> Column:
    """The value of a code; __other__ becomes one of the tail, uniformly; codes outside become null."""
    if not s.categories:
        return F.lit(None).cast("string")
    v = F.try_element_at(F.array(*[F.lit(x) for x in s.categories]), (F.when((c >= 0) & (c < len(s.categories)), c).cast("int") + 1))
    if s.tail_table:
        return F.when(v == OTHER, F.col(f"`_tail_{s.name}`")).otherwise(v)
    if not s.tail:
        return F.when(v != OTHER, v)
    other = F.element_at(F.array(*[F.lit(x) for x in s.tail]), (F.floor(u * len(s.tail)) + 1).cast("int"))
    return F.when(v == OTHER, other).otherwise(v)


def decode_number(x: Column, s: ColumnSpec) -> Column:
    """Clipped in model space, inverse transform, then rounded to whole numbers, places or the grid (halves to even)."""
    lo, hi = (F.log1p(F.greatest(F.lit(v), F.lit(0.0))) if s.transform == "log" else F.lit(v) for v in (s.low, s.high))
    y = F.greatest(F.least(x, hi), lo)
    y = F.when(x.isNull() | F.isnan(x), F.lit(None)).otherwise(inverse_log(y) if s.transform == "log" else y)
    if s.kind == DATETIME:
        return from_epoch(F.bround(y / s.granularity) * s.granularity if s.granularity else y)
    if s.integral:
        return F.bround(y).cast("long")
    return F.bround(y, s.decimals) if s.decimals is not None else y


def inverse_transform(df: DataFrame, specs: list[ColumnSpec], rid: str, seed: int, namespace: str = "") -> DataFrame:
    """One select back to values: numbers, categories, placeholders for identifiers, and copies of mirrored columns.

    Surrogates are keyed by namespace, column and row, so tables and runs do not share them (Q8). Identifiers of a format are all different
    and none is a value that the data hold; they depend on which rows are decoded together.
    """
    out: dict[str, Column] = {}
    made = [s for s in specs if s.formats_table and s.mirror_of not in {x.name for x in specs}]
    if made:
        from tessera.operators.identifiers import generate

        read = df.sparkSession.read.parquet
        ids = generate(df, rid, {s.name: (read(s.formats_table), read(s.known_table), s.salt, s.dtype) for s in made}, f"{seed}:{namespace}")
        df = df.join(ids.select(F.col(rid), *[F.col(f"`{s.name}`").alias(f"_id_{s.name}") for s in made]), rid)
    for s in (s for s in specs if s.tail_table):
        drawn = F.floor(uniform(seed, f"{namespace}:{s.name}:tail", F.col(rid)) * s.tail_size).cast("long")
        other = df.sparkSession.read.parquet(s.tail_table).select(F.col("k").alias(f"_k_{s.name}"), F.col("v").alias(f"_tail_{s.name}"))
        df = df.join(other, F.when(F.col(f"`{s.name}`") == s.categories.index(OTHER), drawn) == F.col(f"`_k_{s.name}`"), "left")
    for s in specs:
        c = F.col(f"`{s.name}`")
        if s.kind == CATEGORICAL:
            v = decode_category(c, s, uniform(seed, f"{namespace}:{s.name}:tail", F.col(rid)))
            out[s.name] = v.try_cast(s.dtype) if s.dtype not in ("string",) else v
        elif s.kind == NON_STD:
            v = F.col(f"`_id_{s.name}`") if s in made else placeholder(s.style, f"{seed}:{namespace}", s.name, F.col(rid))
            u = uniform(seed, f"{namespace}:{s.name}:null", F.col(rid))
            out[s.name] = F.when(u >= s.null_ratio, v)
        elif s.kind == TIMEDELTA:
            out[s.name] = F.make_dt_interval(secs=decode_number(c, s).cast("decimal(18,6)"))
        else:
            v = decode_number(c, s)
            out[s.name] = v.cast(s.dtype) if s.dtype in ("int", "bigint", "smallint", "tinyint", "float", "double", "date", "timestamp", "timestamp_ntz") or s.dtype.startswith("decimal") else v
    for s in specs:
        if s.mirror_of in out:
            out[s.name] = out[s.mirror_of]
    return df.select(rid, *[e.alias(n) for n, e in out.items() if n != rid])


def domain_summary(specs: list[ColumnSpec]) -> dict[str, list[str]]:
    """Which columns' domains were declared and which measured."""
    out: dict[str, list[str]] = {"declared": [], "data": []}
    for s in specs:
        if s.kind != NON_STD:
            out[s.domain_source].append(s.name)
    return out


def zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """Median-filled z-scores of numbers (population deviation; 0 where that is 0)."""
    mid = quantiles.quantiles(df, columns, [0.5])
    stats = df.agg(*[f for c in columns for f in (F.lit((mid[c] or [None])[0]).cast("double").alias(f"_m_{c}"), F.avg(c).alias(f"_a_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    out = df.crossJoin(F.broadcast(stats))
    for c in columns:
        x = F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}"))
        out = out.withColumn(c, F.when(F.col(f"_s_{c}") > 0, (x - F.col(f"_a_{c}")) / F.col(f"_s_{c}")).otherwise(0.0))
    return out.drop(*[f"_{k}_{c}" for k in "mas" for c in columns])


def mint_keys(df: DataFrame, rid: str, table: str, namespace: str, column: str, initials: str | None = None) -> DataFrame:
    """Fresh keys: an offset in [1e8, 9e8) and a random permutation, both set by table and namespace; strings get initials."""
    import zlib

    from tessera.functions.rng import order_key
    from tessera.operators.joins import dense_index

    offset = 100_000_000 + zlib.crc32(f"{table}␟{namespace}".encode()) % 800_000_000
    ordered = dense_index(df.withColumn("_o", order_key(namespace, f"key:{table}", F.col(rid))), ["_o", rid], "_i")
    n = F.col("_i") + offset
    key = F.format_string(f"{initials}%09d", n) if initials else n.cast("long")
    return ordered.withColumn(column, key).drop("_o", "_i").select(column, *[c for c in df.columns if c != column])


__all__ = ["ColumnSpec", "fit", "transform", "inverse_transform", "is_numeric", "is_date"]
