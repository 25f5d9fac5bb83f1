"""A configuration of related tables from what their rows show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.keys import infer_schema
from tessera.operators.profile import derive_domains, infer_kinds, max_degree
from tessera.types import CATEGORICAL, DATETIME, NUMERICAL, TableSpec

MOST_CATEGORIES = 60


def domain_categories(df: DataFrame, columns: list[str], most: int = MOST_CATEGORIES) -> dict[str, list[str]]:
    """The values of columns that have 1 to `most` of them, in order; others are left out."""
    if not columns:
        return {}
    n = df.agg(*[F.count_distinct(F.col(c).cast("string")).alias(c) for c in columns]).first().asDict()
    few = [c for c in columns if 1 <= n[c] <= most]
    return {c: list(v) for c, v in df.agg(*[F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(c) for c in few]).first().asDict().items()} if few else {}


def autoconfigure(spark: SparkSession, tables: dict[str, DataFrame]) -> tuple[dict[str, TableSpec], int]:
    """A spec of each table (kinds, keys, domains, degrees, order in time) and beta, the least rows of a cluster.

    A table with a foreign key and a date is a time series, ordered by its first date. beta is a twentieth of the smallest table's rows,
    within 50 and 100,000.
    """
    schema, specs, least = infer_schema(tables), {}, None
    for t, df in tables.items():
        kinds, fks = infer_kinds(df), schema.of(t)
        keys = {schema.primary_keys.get(t)} | {c for f in fks for c in f.columns}
        free = [c for c in df.columns if c not in keys]
        numbers = [c for c in free if kinds[c] in (NUMERICAL, DATETIME)]
        domain: dict[str, dict] = {}
        for r in derive_domains(df, numbers).collect() if numbers else []:
            domain[r["column_name"]] = {"min_val": r["low"], "max_val": r["high"]} | ({"transform": "log"} if r["log"] else {})
        for c, v in domain_categories(df, [c for c in free if kinds[c] == CATEGORICAL]).items():
            domain[c] = {"force_categories": v}
        degree = max([max_degree(df, f.columns).first()["max_degree"] for f in fks], default=200)
        dates = [c for c in df.columns if kinds[c] == DATETIME]
        series = bool(fks and dates)
        specs[t] = TableSpec(t, schema.primary_keys.get(t), fks, series, sortby=dates[:1] if series else [], kinds={c: kinds[c] for c in free}, domain=domain, max_degree=degree)
        n = df.count()
        least = n if least is None else min(least, n)
    return specs, min(max((least or 0) // 20, 50), 100_000)


def as_rows(spark: SparkSession, specs: dict[str, TableSpec]) -> DataFrame:
    """(table_name, column_name, kind, key, low, high, n_categories, transform) of every column with a kind or a key."""
    rows = []
    for t, s in specs.items():
        for c in [*sorted(s.keys()), *s.kinds]:
            d = s.domain.get(c, {})
            key = "primary" if c == s.primary_key else "foreign" if c in s.keys() else None
            rows.append((t, c, s.kinds.get(c), key, d.get("min_val"), d.get("max_val"), len(d["force_categories"]) if "force_categories" in d else None, d.get("transform")))
    return spark.createDataFrame(rows, "table_name string, column_name string, kind string, key string, low double, high double, n_categories int, transform string")
