"""Children summarised onto their parents: 25 statistics, one aggregate for each table.

Statistics that need no order are plain partial aggregates. Those of time series come from one segmented scan, in which a frequent key is
spread over tasks; places and values before stand in the rows then, and the rest is a partial aggregate again.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalar import pearson
from tessera.operators.profile import as_number, is_date, is_numeric
from tessera.sources.tables import settled


@dataclass(frozen=True)
class AggregationConfig:
    enabled: bool = False
    mean: bool = True
    std: bool = True
    sum: bool = True
    log_mean: bool = False
    log_std: bool = False
    skew: bool = False
    kurt: bool = False
    quantiles: tuple[float, ...] = ()
    end_start_diff: bool = True
    increase_ratio: bool = True
    decrease_ratio: bool = False
    is_increasing: bool = False
    is_decreasing: bool = False
    first_max_pos: bool = False
    last_max_pos: bool = False
    first_min_pos: bool = False
    last_min_pos: bool = False
    autocorr_lags: tuple[int, ...] = ()
    k_first: int = 1
    k_last: int = 1
    n_unique: bool = False
    k_top: int = 0
    proportions_of: tuple[str, ...] = ()
    na_ratio: bool = True
    unique_ratio: bool = False
    most_columns: int = 24

    @classmethod
    def from_config(cls, *sections: dict) -> AggregationConfig:
        """Later sections win; a switch may be written `x`, `agg_x`, `include_x` or `agg_include_x`, and truth as text."""
        names = {f.name: f for f in fields(cls)}
        out = {}
        for s in sections:
            for k, v in (s or {}).items():
                n = k.removeprefix("agg_").removeprefix("include_").removeprefix("check_")
                n = {"first_max_position": "first_max_pos", "last_max_position": "last_max_pos", "first_min_position": "first_min_pos", "last_min_position": "last_min_pos", "increasing": "is_increasing", "decreasing": "is_decreasing"}.get(n, n)
                if n in names and v is not None:
                    kind = str(names[n].type)
                    if kind == "bool":
                        out[n] = v if isinstance(v, bool) else str(v).strip().lower() in ("1", "yes", "on", "true", "tue", "ture")
                    elif kind == "int":
                        out[n] = int(v)
                    else:
                        many = [x for x in (v.replace(",", " ").split() if isinstance(v, str) else v if isinstance(v, (list, tuple)) else [v])]
                        cast = float if "float" in kind else int if "int" in kind else str
                        out[n] = tuple(cast(x) for x in many)
        return replace(cls(), **out)


def sample_skew(x: Column) -> Column:
    """Bias-corrected skewness of more than two values."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis of more than three values."""
    n = F.count(x).cast("double")
    return F.when(n > 3, ((n + 1) * F.kurtosis(x) + 6) * (n - 1) / ((n - 2) * (n - 3)))


def _unordered(c: str, x: Column, numeric: bool, o: AggregationConfig) -> dict[str, Column]:
    out: dict[str, Column] = {}
    if numeric:
        log = F.log1p(F.greatest(x, F.lit(0.0)))
        for on, name, e in ((o.mean, "mean", F.avg(x)), (o.std, "std", F.stddev_pop(x)), (o.sum, "sum", F.sum(x)), (o.log_mean, "log_mean", F.avg(log)), (o.log_std, "log_std", F.stddev_pop(log)), (o.skew, "skew", sample_skew(x)), (o.kurt, "kurt", sample_kurtosis(x))):
            if on:
                out[name] = e
        for q in o.quantiles:
            out[f"q{round(q * 100):02d}"] = F.percentile(x, q)
    else:
        if o.n_unique:
            out["n_unique"] = F.count_distinct(x)
        for v in o.proportions_of:
            out[f"prop_{v}"] = F.avg((x == v).cast("double"))
    if o.na_ratio:
        out["na_ratio"] = F.avg(x.isNull().cast("double"))
    if o.unique_ratio:
        out["unique_ratio"] = F.count_distinct(x) / F.count("*")
    return out


def _ordered(c: str, numeric: bool, o: AggregationConfig) -> dict[str, Column]:
    """Over the columns c__x (value), c__i and c__j (places among values from the start and the end), c__p (value before), c__l<k>."""
    x, i, j, p = (F.col(f"`{c}{s}`") for s in ("__x", "__i", "__j", "__p"))
    out: dict[str, Column] = {}
    if numeric:
        step = x - p
        if o.end_start_diff:
            out["end_start_diff"] = F.when(F.count(x) >= 2, F.max_by(x, i) - F.min_by(x, i))
        if o.increase_ratio:
            out["increase_ratio"] = F.avg((step > 0).cast("double"))
        if o.decrease_ratio:
            out["decrease_ratio"] = F.avg((step < 0).cast("double"))
        if o.is_increasing:
            out["is_increasing"] = F.min((step >= 0).cast("double"))
        if o.is_decreasing:
            out["is_decreasing"] = F.min((step <= 0).cast("double"))
        width = F.greatest(F.count(x) - 1, F.lit(1))
        at = lambda f, v, k: f(F.when(x.isNotNull(), F.struct(v.alias("v"), k.alias("k"))))["k"] / width
        for on, name, place in (
            (o.first_max_pos, "first_max_pos", lambda: at(F.min, -x, i)),
            (o.last_max_pos, "last_max_pos", lambda: at(F.max, x, i)),
            (o.first_min_pos, "first_min_pos", lambda: at(F.min, x, i)),
            (o.last_min_pos, "last_min_pos", lambda: at(F.max, -x, i)),
        ):
            if on:
                out[name] = place()
        for k in o.autocorr_lags:
            out[f"autocorr{k}"] = F.when(F.count(x) > k, F.coalesce(pearson(x, F.col(f"`{c}__l{k}`")), F.lit(0.0)))
    for k in range(o.k_first):
        out[f"first{k + 1}"] = F.max(F.when(i == k, x))
    for k in range(o.k_last):
        out[f"last{k + 1}"] = F.max(F.when(j == k, x))
    return out


def placed(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[bool, list[int]]]) -> DataFrame:
    """Rows with, for each column c of values, c__i and c__j (its place among the key's values, from either end), c__p (the value
    before, if asked for) and c__l<k> (the value k places before, for each lag); null where the value is.

    A segmented scan: rows are range-sorted by key and order, so that a frequent key is spread over parts; each part is scanned on its
    own; and what parts of one key hand on (counts, and the last few values) comes from one small row for each part and key that meet a
    border. Rows of equal order go by a hash of the row.
    """
    tied = rows.withColumn("_tie", F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]))
    parts = settled(tied.orderBy(*keys, *order, "_tie").withColumn("_pid", F.spark_partition_id()), "series")
    own = Window.partitionBy("_pid", *keys)
    w = own.orderBy(*order, "_tie")
    run, before = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.unboundedPreceding, -1)
    extra = {}
    for c, (step, lags) in values.items():
        x = F.col(f"`{c}`")
        extra[f"{c}__i"] = F.when(x.isNotNull(), F.count(x).over(run) - 1)
        extra[f"{c}__j"] = F.when(x.isNotNull(), F.count(x).over(own) - F.count(x).over(run))
        if step:
            extra[f"{c}__p"] = F.when(x.isNotNull(), F.last(x, ignorenulls=True).over(before))
        for k in lags:
            extra[f"{c}__l{k}"] = F.when(x.isNotNull(), F.lag(x, k).over(Window.partitionBy("_pid", *keys, x.isNull()).orderBy(*order, "_tie")))
    local = parts.withColumns(extra)
    deepest = {c: max([int(step), *lags]) for c, (step, lags) in values.items()}
    same = lambda a, b: reduce(lambda p, q: p & q, [a[k].eqNullSafe(b[f"_k{n}"]) for n, k in enumerate(keys)])
    key_names = [F.col(f"`{k}`").alias(f"_k{n}") for n, k in enumerate(keys)]
    each = parts.groupBy(F.col("_pid").alias("_at"), *key_names).agg(*[F.count(F.col(f"`{c}`")).alias(f"{c}__n") for c in values])
    again = each.groupBy(*[f"_k{n}" for n in range(len(keys))]).agg(F.count("*").alias("_parts")).filter("_parts > 1")
    met = reduce(lambda p, q: p & q, [F.col(f"e._k{n}").eqNullSafe(F.col(f"g._k{n}")) for n in range(len(keys))])
    # at most two keys of a part reach beyond it
    span = each.alias("e").join(again.alias("g"), met).select("e.*")
    rows_ = span.collect()
    if not rows_:
        return local.drop("_tie", "_pid")
    ends = local.join(F.broadcast(span), (F.col("_pid") == F.col("_at")) & same(local, span))
    tails: dict[tuple, list] = {}
    for c in values:
        if deepest[c]:
            last = ends.filter(F.col(f"`{c}__j`") < deepest[c]).select("_at", *[f"_k{n}" for n in range(len(keys))], F.col(f"`{c}__i`").alias("i"), F.col(f"`{c}`").alias("x"))
            for r in last.collect():
                tails.setdefault((c, r["_at"], *[r[f"_k{n}"] for n in range(len(keys))]), []).append((r["i"], r["x"]))
    chains: dict[tuple, list] = {}
    for r in sorted(rows_, key=lambda r: r["_at"]):
        chains.setdefault(tuple(r[f"_k{n}"] for n in range(len(keys))), []).append(r)
    carried = []
    for key, chain in chains.items():
        total = {c: sum(r[f"{c}__n"] for r in chain) for c in values}
        seen, held = dict.fromkeys(values, 0), {c: [] for c in values}
        for r in chain:
            row = [r["_at"], *key]
            for c in values:
                row += [seen[c], total[c] - seen[c] - r[f"{c}__n"], list(held[c])]
                seen[c] += r[f"{c}__n"]
                held[c] = [*held[c], *(x for _, x in sorted(tails.get((c, r["_at"], *key), []), key=lambda v: v[0]))][-max(deepest[c], 1) :]
            carried.append(tuple(row))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    fields = [T.StructField("_at", T.IntegerType()), *[T.StructField(f"_k{n}", kinds[k]) for n, k in enumerate(keys)]]
    for c in values:
        fields += [T.StructField(f"{c}__off", T.LongType()), T.StructField(f"{c}__after", T.LongType()), T.StructField(f"{c}__held", T.ArrayType(kinds[c]))]
    carry = rows.sparkSession.createDataFrame(carried, T.StructType(fields))
    out = local.join(F.broadcast(carry), (F.col("_pid") == F.col("_at")) & same(local, carry), "left")
    late = {}
    for c, (step, lags) in values.items():
        x, i = F.col(f"`{c}`"), F.col(f"`{c}__i`")
        held = lambda back, c=c: F.try_element_at(F.col(f"`{c}__held`"), back.cast("int"))
        late[f"{c}__i"] = i + F.coalesce(F.col(f"`{c}__off`"), F.lit(0))
        late[f"{c}__j"] = F.col(f"`{c}__j`") + F.coalesce(F.col(f"`{c}__after`"), F.lit(0))
        if step:
            late[f"{c}__p"] = F.when(i == 0, held(F.lit(-1))).otherwise(F.col(f"`{c}__p`"))
        for k in lags:
            late[f"{c}__l{k}"] = F.when(i < k, held(i - k)).otherwise(F.col(f"`{c}__l{k}`"))
    return out.withColumns(late).select(*rows.columns, *[f"`{c}`" for c in extra])


def numeric_kind(t: T.DataType) -> bool:
    """Numbers (not booleans), dates as epoch seconds; all others are categories."""
    return is_numeric(t) or is_date(t)


def plan_columns(df: DataFrame, columns: list[str], config: AggregationConfig, ordered: bool) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(column, statistic) pairs taken in turns over the columns until the cap (the count takes one place), and those dropped."""
    per = []
    for c in columns:
        num = numeric_kind(df.schema[c].dataType)
        names = [*_unordered(c, F.col(c), num, config), *(_ordered(c, num, config) if ordered else {})]
        names += [f"top{k + 1}" for k in range(config.k_top)] if not num else []
        per.append([(c, s) for s in names])
    turns = [p[i] for i in range(max(map(len, per), default=0)) for p in per if i < len(p)]
    room = max(config.most_columns - 1, 0)
    return turns[:room], turns[room:]


def aggregate(df: DataFrame, keys: list[str], columns: list[str] | None = None, config: AggregationConfig | None = None, sortby: list[str] | None = None, tiebreak: list[str] | None = None) -> DataFrame:
    """Keys, count and <column>__<statistic>, one row for each key. With sortby also the statistics of order.

    Nulls are ignored, as in A1-A25; rows with a null key form a group of their own. Only statistics within the cap are computed.
    """
    config = config or AggregationConfig()
    columns = columns if columns is not None else [c for c in df.columns if c not in keys and c not in (sortby or [])]
    taken, _ = plan_columns(df, columns, config, bool(sortby))
    want = lambda c: {s for k, s in taken if k == c}
    rows = df.select(*keys, *{c: None for c in [*(sortby or []), *(tiebreak or [])] if c not in keys}, *[as_number(df, c).alias(f"{c}__x") if numeric_kind(df.schema[c].dataType) else F.col(c).cast("string").alias(f"{c}__x") for c in columns])
    if sortby:
        stepwise = {"increase_ratio", "decrease_ratio", "is_increasing", "is_decreasing"}
        numeric = {c: numeric_kind(df.schema[c].dataType) for c in columns}
        look = {f"{c}__x": (numeric[c] and bool(want(c) & stepwise), list(config.autocorr_lags) if numeric[c] else []) for c in columns}
        rows = placed(rows, keys, [*sortby, *(tiebreak or [])], look)
        rows = rows.withColumnsRenamed({f"{c}__x{s}": f"{c}{s}" for c in columns for s in ("__i", "__j", "__p", *[f"__l{k}" for k in config.autocorr_lags])})
        rows = rows.withColumns({f"{c}__p": F.lit(None).cast("double") for c in columns if not look[f"{c}__x"][0]})
    aggs = [F.count("*").alias("count")]
    for c, s in taken:
        num = numeric_kind(df.schema[c].dataType)
        e = _unordered(c, F.col(f"`{c}__x`"), num, config)
        if s not in e and sortby:
            e |= _ordered(c, num, config)
        if s in e:
            aggs.append(e[s].alias(f"{c}__{s}"))
    out = rows.groupBy(*keys).agg(*aggs)
    for c in dict.fromkeys(c for c, s in taken if s.startswith("top") and not numeric_kind(df.schema[c].dataType)):
        out = out.join(top_values(df, keys, c, config.k_top), keys, "left")
    return out




def top_values(df: DataFrame, keys: list[str], column: str, k: int) -> DataFrame:
    """Keys and <column>__top1..k, the most frequent values (ties: smaller value first)."""
    n = df.filter(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("string").alias("v")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "v")
    ranked = n.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= k)
    return ranked.groupBy(*keys).agg(*[F.max(F.when(F.col("k") == j + 1, F.col("v"))).alias(f"{column}__top{j + 1}") for j in range(k)])


def align(parent: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Every parent row with its children's summary by the whole key; a parent without children has count 0 and nulls."""
    return parent.join(summary, keys, "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))


def median_ranks(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median, rank): average ranks of the groups' medians."""
    m = df.groupBy(group).agg(F.percentile(value, 0.5).alias("median"))
    w = Window.orderBy("median")
    return m.withColumn("rank", F.rank().over(w) + (F.count("*").over(Window.partitionBy("median")) - 1) / 2.0)


def cumulative(df: DataFrame, weight: str, order: str, name: str = "cumulative") -> DataFrame:
    """Running shares of a small outcome table, for inverse-CDF draws."""
    w = Window.orderBy(order)
    total = F.sum(weight).over(Window.partitionBy())
    return df.withColumn(name, F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) / total)
