"""Training and generation end to end, and the engines by name."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import encode, evaluate, policy, report
from tessera.operators.aggregate import AggregationConfig
from tessera.operators.arf import ARF, ARFParams
from tessera.operators.joins import holdout
from tessera.operators.keys import InferredSchema, infer_schema, topological_order, validate_schema
from tessera.operators.relational import RelationalModel
from tessera.operators.spn import SPN, SPNParams
from tessera.sources.tables import settled, write_tables
from tessera.types import TableSpec

#: Engines by name, and whether they can be private.
ENGINES: dict[str, tuple[type, type, bool]] = {"SPN": (SPN, SPNParams, True), "ARF": (ARF, ARFParams, False), "ARF2": (ARF, ARFParams, False)}


def engine(name: str, private: bool = False) -> tuple[type, type]:
    """The engine's model and parameters; an engine without a privacy mechanism refuses to be private."""
    if name.upper() not in ENGINES:
        raise ValueError(f"no engine {name}; there are {', '.join(ENGINES)}")
    model, params, can = ENGINES[name.upper()]
    if private and not can:
        raise ValueError(f"{name} has no differential privacy")
    return model, params


@dataclass
class Trained:
    model: RelationalModel
    schema: InferredSchema
    decisions: DataFrame
    issues: DataFrame
    notes: list[str] = field(default_factory=list)


def protect(tables: dict[str, DataFrame], decisions: DataFrame, specs: dict[str, TableSpec]) -> tuple[dict[str, DataFrame], dict[str, TableSpec]]:
    """What the decisions say, done: suppressed columns go, quasi identifiers coarsen, identifiers become placeholders when generated."""
    rows = decisions.collect()
    styles = policy.styles(decisions)
    out, new = {}, {}
    for t, df in tables.items():
        mine = [r for r in rows if r["table_name"] == t]
        gone = [r["column_name"] for r in mine if r["strategy"] == "SUPPRESS"]
        coarse = [r["column_name"] for r in mine if r["strategy"] == "GENERALISE"]
        out[t] = policy.generalise(policy.suppress(df, gone), coarse)
        s = specs[t]
        kinds = s.kinds | {r["column_name"]: r["kind"] for r in mine if r["kind"] and r["column_name"] not in s.keys() and r["column_name"] not in gone}
        new[t] = TableSpec(**vars(s) | {"kinds": kinds, "styles": s.styles | {c: v for (x, c), v in styles.items() if x == t}})
    return out, new


def train(spark: SparkSession, tables: dict[str, DataFrame], specs: dict[str, TableSpec] | None = None, catalog: DataFrame | None = None, params: SPNParams | ARFParams | None = None, mode: str = "balanced", enforce: bool = True, aggregation: AggregationConfig | None = None, test_fraction: float = 0.0) -> Trained:
    """Analyse, validate (errors raise), decide, protect, force privacy where a column asks for it (G6), split and fit."""
    schema = infer_schema(tables)
    if specs is None:
        specs = {t: TableSpec(t, schema.primary_keys.get(t), schema.of(t)) for t in tables}
    issues = validate_schema(spark, tables, specs, schema)
    errors = [r for r in issues.collect() if r["severity"] == "error"]
    if errors:
        raise ValueError("; ".join(f"{r['table_name']}: {r['code']} {r['detail']}" for r in errors))
    if catalog is None:
        catalog = spark.createDataFrame([], "table string, column string, tags array<string>")
    decisions = policy.build_policy(spark, tables, specs, catalog, mode)
    notes, params = [], params or SPNParams()
    if enforce:
        tables, specs = protect(tables, decisions, specs)
        if decisions.filter("strategy = 'MODEL_DP'").count() and not getattr(params, "private", False):
            engine("ARF" if isinstance(params, ARFParams) else "SPN", private=True)  # a forest refuses
            params = SPNParams(**vars(params) | {"private": True})
            notes.append("private: a sensitive column asks for it")
    else:
        notes.append("WARNING: the policy was decided but not enforced")
    if test_fraction:
        roots = {t: s.primary_key for t, s in specs.items() if s.primary_key and not s.foreign_keys}
        kids = [(t, s.foreign_keys[0].columns[0], s.foreign_keys[0].parent, s.foreign_keys[0].parent_columns[0]) for t in topological_order({t: [f.parent for f in s.foreign_keys] for t, s in specs.items()}) if (s := specs[t]).foreign_keys]
        tables = {t: a for t, (a, _) in holdout(tables, roots, kids, test_fraction).items()}
    return Trained(RelationalModel(specs, params, aggregation).fit(tables), schema, decisions, issues, notes)


def generate(spark: SparkSession, trained: Trained, counts: dict[str, int] | None = None, seed: int = 1, namespace: str = "synthetic") -> dict[str, DataFrame]:
    """By default as many root rows as were learnt from."""
    m = trained.model
    roots = {t: x.rows for t, x in m.models.items() if not x.spec.foreign_keys}
    return m.sample(spark, roots | (counts or {}), seed, namespace)


def score(spark: SparkSession, real: dict[str, DataFrame], synth: dict[str, DataFrame], specs: dict[str, TableSpec]) -> tuple[DataFrame, DataFrame]:
    """The fidelity report and the integrity checks of a generation."""
    plain = {t: df.drop(*specs[t].keys()) for t, df in real.items()}
    return report.build_report(plain, {t: synth[t] for t in plain}), report.check_integrity(spark, real, synth, specs)


def run_training(spark: SparkSession, tables: dict[str, DataFrame], folder: str, specs: dict[str, TableSpec] | None = None, seed: int = 1, test_fraction: float = 0.25, trees: int = 20, **how) -> dict:
    """C1 in one call: train, save the model, generate, and write fidelity, integrity and utility beside it; their summary.

    folder gets model, report, checks, utility and decisions. how: what train() takes. Utility and detection are judged on rows held out.
    """
    t = train(spark, tables, specs, test_fraction=test_fraction, **how)
    t.model.save(spark, f"{folder}/model")
    used = t.model.specs
    synth = {k: settled(df, "synthetic") for k, df in generate(spark, t, seed=seed).items()}
    known = {k: df.select(*synth[k].columns) for k, df in tables.items()}
    fidelity, checks = score(spark, known, synth, used)
    roots = {k: s.primary_key for k, s in used.items() if s.primary_key and not s.foreign_keys}
    kids = [(k, f.columns[0], f.parent, f.parent_columns[0]) for k in t.model.order for f in used[k].foreign_keys[:1]]
    parts = holdout(known, roots, kids, test_fraction) if test_fraction else {}
    utility = evaluate.evaluate_tables(spark, {k: a for k, (a, _) in parts.items()}, {k: b for k, (_, b) in parts.items()}, synth, {k: s.keys() for k, s in used.items()}, trees=trees) if parts else None
    for name, df in (("report", fidelity), ("checks", checks), ("utility", utility), ("decisions", t.decisions)):
        if df is not None:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spent = {k: m.engine.ledger.report()["spent"] for k, m in t.model.models.items() if getattr(m.engine, "ledger", None)}
    back = spark.read.parquet
    return {"fidelity": report.fidelity(back(f"{folder}/report")).first()[0], "status": report.overall(back(f"{folder}/checks")).first()[0], "spent": spent, "notes": t.notes}


def run_generation(spark: SparkSession, model_folder: str, folder: str, counts: dict[str, int] | None = None, seed: int = 1, namespace: str = "synthetic", kind: str = "parquet") -> tuple[list[dict], DataFrame]:
    """C2 in one call: a saved model's tables written to a folder; (manifest, warnings of children a parent that stray from what was learnt)."""
    m = RelationalModel.load(spark, model_folder)
    roots = {t: x.rows for t, x in m.models.items() if not x.spec.foreign_keys}
    out = write_tables(m.sample(spark, roots | (counts or {}), seed, namespace), folder, kind)
    rows = {x["table"]: x["rows"] for x in out}
    actual = {f"{p} to {c}": rows[c] / rows[p] for p, c in m.degrees if rows.get(p)}
    learnt = {f"{p} to {c}": sum(v * q for v, q in zip(d.values, d.probs, strict=True)) for (p, c), d in m.degrees.items()}
    return out, report.cardinality_warnings(spark, actual, learnt)


def compare_engines(spark: SparkSession, df: DataFrame, rid: str, names: list[str], test_fraction: float = 0.25, seed: int = 13, trees: int = 60) -> DataFrame:
    """(engine, utility, detection_auc, seconds) of each engine, fitted on the same training rows and judged on the same others.

    utility is the mean ratio over the targets that real rows predict, null where there are none; seconds are of fitting alone.
    """
    import time

    from tessera.functions.rng import uniform

    u = uniform(seed, "compare", F.col(rid))
    train, test = df.filter(u >= test_fraction), df.filter(u < test_fraction)
    plain = [c for c in df.columns if c != rid]
    specs, n, rows = encode.fit(train.select(*plain)), train.count(), []
    enc = encode.transform(train, specs, keep=[rid]).persist()
    for name in names:
        model, params = engine(name)
        began = time.time()
        fitted = model(params(), specs).fit(enc, rid) if model is ARF else model(params(beta=max(n // 20, 50)), specs).fit(enc.drop(rid))
        took = time.time() - began
        drawn = fitted.sample(spark.range(n).withColumnRenamed("id", "_rid"), "_rid", seed, name)
        synth = encode.inverse_transform(drawn, specs, "_rid", seed, name).drop("_rid").persist()
        ratios = [r["ratio"] for r in evaluate.tstr(spark, synth, train.select(*plain), test.select(*plain), trees=trees).collect()]
        a, _, _ = evaluate.detection(test.select(*plain), synth, plain, trees=trees)
        rows.append((name, sum(ratios) / len(ratios) if ratios else None, a, took))
        synth.unpersist()
    enc.unpersist()
    return spark.createDataFrame(rows, "engine string, utility double, detection_auc double, seconds double")
