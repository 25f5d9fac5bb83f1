"""Fidelity, integrity and disclosure of synthetic tables against real ones."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalar import pearson
from tessera.operators import quantiles
from tessera.operators.joins import aligned_shares, path_agreement, row_copies, value_overlap
from tessera.operators.keys import ValueIndex
from tessera.operators.profile import as_number, is_date, is_numeric
from tessera.types import TableSpec

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def tvd(real: DataFrame, synth: DataFrame, column: str) -> DataFrame:
    """V8: one row, tvd: half the summed difference of the values' shares."""
    return aligned_shares(real, synth, column).agg(F.coalesce(0.5 * F.sum(F.abs(F.col("p") - F.col("q"))), F.lit(0.0)).alias("tvd"))


def quantile_divergence(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """V9: (column_name, divergence, score): mean difference of five quantiles by the real sample deviation; 1 for a column without values on a side."""
    q = [quantiles.quantiles(d, {c: as_number(d, c) for c in columns}, list(QUANTILES)) for d in (real, synth)]
    std = real.agg(*[F.stddev_samp(as_number(real, c)).alias(c) for c in columns]).first()
    out = []
    for c in columns:
        a, b = q[0][c], q[1][c]
        gap = sum(abs(x - y) for x, y in zip(a, b, strict=True)) / len(QUANTILES) if a and b else None
        far = 1.0 if gap is None else gap / std[c] if std[c] and std[c] > 0 else float(gap > 0)
        out.append((c, far, max(0.0, 1 - far)))
    return real.sparkSession.createDataFrame(out, "column_name string, divergence double, score double")


def correlations(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """(left_column, right_column, r) of all pairs in one aggregate, each over the rows where both have a value."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[pearson(as_number(df, a), as_number(df, b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    each = F.array(*[F.struct(F.lit(a).alias("left_column"), F.lit(b).alias("right_column"), F.col(f"p{i}").alias(name)) for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(each).alias("x")).select("x.*")


def correlation_delta(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """One row: delta over the whole matrix with its diagonal of zeros (Q20), and over distinct pairs."""
    both = correlations(real, columns, "r").join(correlations(synth, columns, "s"), ["left_column", "right_column"])
    d = F.abs(F.col("r") - F.col("s"))  # null where a column of the pair does not vary
    k = len(columns)
    return both.agg((2 * F.sum(d) / (2 * F.count(d) + k)).alias("delta"), F.avg(d).alias("off_diagonal"))


def column_report(real: DataFrame, synth: DataFrame, protected: set[str] = frozenset()) -> DataFrame:
    """(column_name, kind, score): leak of protected columns, divergence of numbers and dates, variation of categories.

    Columns of mostly distinct texts are listed without a score.
    """
    numbers = [c for c in real.columns if c not in protected and (is_numeric(real.schema[c].dataType) or is_date(real.schema[c].dataType))]
    out = quantile_divergence(real, synth, numbers).select("column_name", F.lit("numerical").alias("kind"), "score") if numbers else None
    others = [c for c in real.columns if c not in numbers]
    distinct = real.agg(*[(F.count_distinct(c) / F.greatest(F.count(c), F.lit(1))).alias(c) for c in others]).first() if others else {}
    for c in others:
        if c in protected:
            one = value_overlap(real, synth, c).select(F.lit(c).alias("column_name"), F.lit("protected").alias("kind"), (1 - F.col("leak")).alias("score"))
        elif distinct[c] > 0.5:
            one = real.sparkSession.range(1).select(F.lit(c).alias("column_name"), F.lit("high_cardinality").alias("kind"), F.lit(None).cast("double").alias("score"))
        else:
            one = tvd(real, synth, c).select(F.lit(c).alias("column_name"), F.lit("categorical").alias("kind"), (1 - F.col("tvd")).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


def build_report(real: dict[str, DataFrame], synth: dict[str, DataFrame], protected: dict[str, set[str]] | None = None) -> DataFrame:
    """(table_name, column_name, kind, score) of all tables; averages over columns, then tables, are the fidelity."""
    out = None
    for t in real:
        one = column_report(real[t], synth[t], (protected or {}).get(t, set())).withColumn("table_name", F.lit(t))
        out = one if out is None else out.unionByName(one)
    return out.select("table_name", "column_name", "kind", "score")


def fidelity(report: DataFrame) -> DataFrame:
    per = report.filter("score is not null").groupBy("table_name").agg(F.avg("score").alias("score"))
    return per.agg(F.avg("score").alias("fidelity"))


def exact_matches(real: DataFrame, synth: DataFrame, most: int = 8) -> DataFrame:
    """Copies of whole rows over the first columns that are no dates."""
    cols = [f.name for f in real.schema.fields if not is_date(f.dataType) and f.name in synth.columns][:most]
    return row_copies(real, synth, cols)


def children_ratio(real: DataFrame, synth: DataFrame, keys: list[str]) -> DataFrame:
    """V3: one row: real_mean and synth_mean children of parents that have any, their ratio and the status."""
    mean = lambda d, n: d.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n")).agg(F.avg("n").alias(n))
    both = mean(real, "real_mean").crossJoin(mean(synth, "synth_mean")).withColumn("ratio", F.col("synth_mean") / F.col("real_mean"))
    return both.withColumn("status", F.when(F.col("ratio").between(0.75, 1.25), "PASS").otherwise("WARN"))


def check_integrity(spark: SparkSession, real: dict[str, DataFrame], synth: dict[str, DataFrame], specs: dict[str, TableSpec], protected: dict[str, set[str]] | None = None) -> DataFrame:
    """V1-V7: (check_name, table_name, detail, value, status); the worst status is the whole's. All keys are looked up together."""
    rows = []
    held = {(t, s.primary_key): (synth[t], [s.primary_key]) for t, s in specs.items() if s.primary_key}
    held |= {(t, *f.columns): (synth[t], f.columns) for t, s in specs.items() for f in s.foreign_keys}
    held |= {(f.parent, *f.parent_columns): (synth[f.parent], f.parent_columns) for s in specs.values() for f in s.foreign_keys}
    index = ValueIndex(held)
    for t, s in specs.items():
        df = synth[t]
        if s.primary_key:
            n, _, different = index.of((t, s.primary_key))
            rows.append(("pk_unique", t, s.primary_key, float(n - different), "PASS" if n == different else "FAIL"))
        for f in s.foreign_keys:
            _, orphans = index.contained((t, *f.columns), (f.parent, *f.parent_columns))
            rows.append(("fk_resolves", t, f.parent, float(orphans), "PASS" if orphans == 0 else "FAIL"))
            k = children_ratio(real[t], df, f.columns).first()
            rows.append(("children_per_parent", t, f.parent, float(k["ratio"] or 0), k["status"]))
        for f in s.foreign_keys[1:]:
            b = specs[s.foreign_keys[0].parent]
            if any(x.parent == f.parent for x in b.foreign_keys):
                p = path_agreement(df, synth[b.name], s.foreign_keys[0].columns[0], f.columns[0]).first()
                rows.append(("path_agreement", t, f.parent, float(p["mismatch"]), p["status"]))
        for c in sorted((protected or {}).get(t, ())):
            r = real[t].agg((F.count_distinct(c) / F.greatest(F.count(c), F.lit(1))).alias("u")).first()["u"]
            leak = value_overlap(real[t], df, c).first()["leak"]
            rows.append(("protected_leak", t, c, float(leak), "PASS" if leak <= (0.01 if r > 0.9 else 0.4) else "FAIL" if r > 0.9 else "WARN"))
        cols = [c for c in real[t].columns if c in df.columns and c not in s.keys()]
        if cols:
            x = row_copies(real[t], df, cols).first()["copied"]
            rows.append(("row_copies", t, "", float(x), "PASS" if x <= 0.01 else "WARN"))
    return spark.createDataFrame(rows, "check_name string, table_name string, detail string, value double, status string")


def overall(checks: DataFrame) -> DataFrame:
    """V7: the worst status."""
    worst = F.max(F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0))
    return checks.agg(F.element_at(F.array(F.lit("PASS"), F.lit("WARN"), F.lit("FAIL")), (F.coalesce(worst, F.lit(0)) + 1).cast("int")).alias("status"))


def cardinality_warnings(spark: SparkSession, actual: dict[str, float], learned: dict[str, float]) -> DataFrame:
    """(edge, actual, learned, ratio, warns) where children per parent stray from what was learned."""
    rows = [(e, float(actual[e]), float(learned[e]), float(actual[e]) / learned[e] if learned[e] else None) for e in learned if e in actual]
    d = spark.createDataFrame(rows, "edge string, actual double, learned double, ratio double")
    return d.withColumn("warns", ~F.coalesce(F.col("ratio").between(0.67, 1.5), F.lit(False)))
