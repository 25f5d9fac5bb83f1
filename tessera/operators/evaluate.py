"""Utility and detection: what models trained on synthetic rows are worth on real ones, and whether one can tell the two apart."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.rng import uniform
from tessera.operators.joins import running_total
from tessera.operators.profile import as_number, is_date, is_numeric

LEAST_ROWS = 100  # of a table that is evaluated


def targets(df: DataFrame, most: int | None = 4) -> list[tuple[str, str]]:
    """(column, classification or regression): 2 to 20 classes none above 98 %, or numbers of more than 50 values; `most` None: all."""
    r = df.agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(c) for c in df.columns]).first().asDict()
    out = []
    for f in df.schema.fields:
        u = r[f.name]
        if is_numeric(f.dataType) and u > 50:
            out.append((f.name, "regression"))
        elif not is_date(f.dataType) and 2 <= u <= 20:
            top = df.groupBy(f.name).count().agg(F.max("count")).first()[0]
            if top <= 0.98 * r["n"]:
                out.append((f.name, "classification"))
    return out[:most]


def features(df: DataFrame, reference: DataFrame, columns: list[str], most: int = 50) -> tuple[DataFrame, list[str]]:
    """Columns as doubles by the reference's types: numbers and dates as they are, categories by frequency rank; -1 unknown, -999 null."""
    out = df
    for c in columns:
        if is_numeric(reference.schema[c].dataType) or is_date(reference.schema[c].dataType):
            e: Column = as_number(df, c)
        else:
            top = [r[0] for r in reference.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("string")).count().orderBy(F.desc("count"), c).limit(most).collect()]
            at = F.array_position(F.array(*[F.lit(v) for v in top]), F.col(c).cast("string")).cast("double") - 1 if top else F.lit(-1.0)
            e = at
        out = out.withColumn(f"_x_{c}", F.when(F.col(c).isNull(), -999.0).otherwise(F.coalesce(e, F.lit(-999.0))))
    cols = [f"_x_{c}" for c in columns]
    return VectorAssembler(inputCols=cols, outputCol="_v").transform(out), cols


def auc(scored: DataFrame, score: str, label: str, weight: str | None = None) -> float:
    """Area under the curve by average ranks of distinct scores: counts (or weights) by score first, then running totals."""
    n = F.col(weight).cast("double") if weight else F.lit(1.0)
    g = scored.groupBy(F.round(score, 9).alias("s")).agg(F.sum(n * F.col(label)).alias("p"), F.sum(n * (1 - F.col(label))).alias("q"))
    r = running_total(g, "s", "q", "below").agg(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("u"), F.sum("p").alias("p"), F.sum("q").alias("q")).first()
    return float(r["u"] / (r["p"] * r["q"])) if r["p"] and r["q"] else 0.5


def macro_auc(scored: DataFrame, classes: int) -> float:
    """The mean over classes of each against the rest."""
    per = [auc(scored.select(F.col("_prob")[k].alias("s"), (F.col("_y") == k).cast("double").alias("y")), "s", "y") for k in range(classes)]
    return sum(per) / len(per)


def tstr(spark: SparkSession, synth: DataFrame, train: DataFrame, test: DataFrame, keys: set[str] = frozenset(), trees: int = 60, seed: int = 0) -> DataFrame:
    """(target, task, real_score, synth_score, ratio): forests trained on real and on synthetic rows, tested on real ones.

    Targets that real rows hardly predict (AUC below 0.55, R2 below 0.05) are skipped; the ratio is of the skill above chance, 0 to 2.
    """
    use = [c for c in train.columns if c not in keys and c in synth.columns]
    rows = []
    for target, task in targets(train.select(*use)):
        cols = [c for c in use if c != target]
        if not cols:
            continue
        scores = []
        if task == "classification":
            classes = [r[0] for r in train.filter(F.col(target).isNotNull()).select(F.col(target).cast("string")).distinct().orderBy(target).collect()]
            y = F.array_position(F.array(*[F.lit(v) for v in classes]), F.col(target).cast("string")).cast("double") - 1
        else:
            y = as_number(train, target)
        for source in (train, synth):
            a, _ = features(source.withColumn("_y", y), train, cols)
            b, _ = features(test.withColumn("_y", y), train, cols)
            a, b = (x.filter("_y is not null and _y >= 0" if task == "classification" else "_y is not null").select("_v", "_y") for x in (a, b))
            if task == "classification":
                if a.select("_y").distinct().count() < 2:
                    scores.append(0.5)
                    continue
                m = RandomForestClassifier(numTrees=trees, maxDepth=8, seed=seed, featuresCol="_v", labelCol="_y", probabilityCol="_p").fit(a)
                got = m.transform(b).withColumn("_prob", vector_to_array("_p"))
                k = got.select(F.size("_prob")).first()[0]
                scores.append(macro_auc(got, k))
            else:
                m = RandomForestRegressor(numTrees=trees, maxDepth=10, seed=seed, featuresCol="_v", labelCol="_y").fit(a)
                scores.append(RegressionEvaluator(labelCol="_y", metricName="r2").evaluate(m.transform(b)))
        base, least = (0.5, 0.55) if task == "classification" else (0.0, 0.05)
        if scores[0] >= least:
            rows.append((target, task, float(scores[0]), float(scores[1]), float(min(max((scores[1] - base) / (scores[0] - base), 0.0), 2.0))))
    return spark.createDataFrame(rows, "target string, task string, real_score double, synth_score double, ratio double")


def evaluate_tables(spark: SparkSession, train: dict[str, DataFrame], test: dict[str, DataFrame], synth: dict[str, DataFrame], protected: dict[str, set[str]] | None = None, trees: int = 60) -> DataFrame:
    """(table_name, measure, target, value) of every table that all three sides have: the utility ratio of each target, the detection
    AUC, and their means over all tables (table_name null). Protected columns and those that are unique are left out; a table of fewer
    than LEAST_ROWS rows gives one row `skipped`.
    """
    rows: list[tuple] = []
    for t in [t for t in train if t in test and t in synth]:
        n = {c: r for c, r in train[t].agg(F.count("*").alias("_n"), *[F.count_distinct(c).alias(c) for c in train[t].columns]).first().asDict().items()}
        total = n.pop("_n")
        if min(total, synth[t].count()) < LEAST_ROWS:
            rows.append((t, "skipped", None, float(total)))
            continue
        out = set((protected or {}).get(t, set())) | {c for c, u in n.items() if u == total}
        cols = [c for c in train[t].columns if c not in out and c in synth[t].columns]
        rows += [(t, "utility_ratio", r["target"], r["ratio"]) for r in tstr(spark, synth[t], train[t], test[t], out, trees).collect()]
        if cols:
            a, _, _ = detection(test[t], synth[t], cols, trees=trees)
            rows.append((t, "detection_auc", None, a))
    for measure in ("utility_ratio", "detection_auc"):
        if got := [r[3] for r in rows if r[1] == measure]:
            rows.append((None, f"mean_{measure}", None, sum(got) / len(got)))
    return spark.createDataFrame(rows, "table_name string, measure string, target string, value double")


def detection(real: DataFrame, synth: DataFrame, columns: list[str], most: int = 20_000, trees: int = 80, seed: int = 0) -> tuple[float, float, list[tuple[str, float]]]:
    """AUC of a forest that tells real rows from synthetic ones, how alike they are, and the five columns that give them away.

    Equal rows are one row with a count. By a hash of its values 70 % of each row's copies are for training (rounded at random, so a
    single row is in or out) and all others are scored. The forest is fitted on about `most` of a side's training rows, each tuple by
    its share of them, the documented bound of a classifier's training set; nothing bounds the evaluation.
    """
    def side(d: DataFrame, y: float) -> DataFrame:
        n, h = F.col("_n"), F.xxhash64(*columns, F.lit(seed))
        g = d.groupBy(*columns).agg(F.count("*").alias("_n")).withColumn("_t", F.floor(0.7 * n + uniform(seed, f"detect{y:.0f}", h)))
        x, _ = features(g, real, columns)
        return x.select("_v", F.lit(y).alias("_y"), "_t", (n - F.col("_t")).alias("_e"), uniform(seed, f"fit{y:.0f}", h).alias("_u"))

    both = side(real, 0.0).unionByName(side(synth, 1.0)).persist()
    total = {r["_y"]: r["t"] for r in both.groupBy("_y").agg(F.sum("_t").alias("t")).collect()}
    share = F.when(F.col("_y") == 0, F.lit(min(1.0, most / max(total.get(0.0) or 1, 1)))).otherwise(F.lit(min(1.0, most / max(total.get(1.0) or 1, 1))))
    sample = both.withColumn("_w", F.floor(F.col("_t") * share + F.when(share < 1, F.col("_u")).otherwise(0.0)).cast("double")).filter("_w > 0")
    m = RandomForestClassifier(numTrees=trees, maxDepth=10, seed=seed, featuresCol="_v", labelCol="_y", weightCol="_w", probabilityCol="_p").fit(sample)
    a = auc(m.transform(both.filter("_e > 0")).select(vector_to_array("_p")[1].alias("s"), F.col("_y").alias("y"), F.col("_e").alias("n")), "s", "y", "n")
    top = sorted(zip(columns, m.featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1])[:5]
    both.unpersist()
    return a, max(0.0, 1 - 2 * abs(a - 0.5)), top
