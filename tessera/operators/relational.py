"""Related tables: learnt parents first with their children's degrees, sampled parents first with their children conditioned on them."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.rng import order_key, uniform
from tessera.operators import aggregate as agg
from tessera.operators import encode
from tessera.operators.dp import PrivacyLedger, degree_histogram
from tessera.operators.joins import child_counts, dense_index, expand, parent_context, random_parent
from tessera.operators.keys import topological_order
from tessera.operators.profile import kind_stats, is_numeric
from tessera.operators.arf import ARF, ARFParams
from tessera.operators.spn import SPN, SPNParams
from tessera.types import CATEGORICAL, NON_STD, OTHER, ColumnSpec, ForeignKey, TableSpec

#: Fields of a column's spec that name a table.
TABLES = ("tail_table", "formats_table", "known_table")
DEG, CTX, AGG = "__deg__", "__ctx__", "__agg__"
DEGREE_SHARE = 0.10  # D8: of epsilon, for degrees


@dataclass
class DegreeModel:
    """Children per parent."""

    values: list[int]
    probs: list[float]

    @classmethod
    def fit(cls, parent: DataFrame, child: DataFrame, parent_keys: list[str], child_keys: list[str], cap: int = 200, epsilon: float | None = None, ledger: PrivacyLedger | None = None) -> DegreeModel:
        renamed = child.select(*[F.col(c).alias(p) for c, p in zip(child_keys, parent_keys, strict=True)])
        counted = child_counts(parent.select(*parent_keys), renamed, parent_keys, "d")
        got = {int(r["d"]): int(r["n"]) for r in counted.groupBy(F.least("d", F.lit(cap)).alias("d")).agg(F.count("*").alias("n")).collect()}
        if epsilon and ledger:
            noisy = degree_histogram(got, epsilon, cap, ledger)
            return cls(sorted(noisy), [noisy[d] for d in sorted(noisy)])
        total = sum(got.values()) or 1
        return cls(sorted(got) or [0], [got[d] / total for d in sorted(got)] or [1.0])

    def draw(self, u: Column) -> Column:
        cum, c = [], 0.0
        for p in self.probs:
            c += p
            cum.append(c)
        k = F.least(F.size(F.filter(F.array(*[F.lit(x) for x in cum]), lambda x: x <= u)), F.lit(len(cum) - 1))
        return F.element_at(F.array(*[F.lit(v) for v in self.values]), k + 1).cast("long")

    @property
    def mean(self) -> float:
        return sum(v * p for v, p in zip(self.values, self.probs, strict=True))


def rank_context(df: DataFrame, skip: set[str], kinds: dict[str, str], most: int = 6) -> list[str]:
    """Parent columns to condition children on: numbers first, by how distinct they are, then categories of few values (Q12)."""
    stats = kind_stats(df)
    scored = []
    for f in df.schema.fields:
        n, u = stats[f.name]["n"] or 0, stats[f.name]["u"] or 0
        if f.name in skip or kinds.get(f.name) == NON_STD or u < 2:
            continue
        ratio = u / max(n, 1)
        if is_numeric(f.dataType):
            scored.append((-ratio, f.name))
        elif ratio <= 0.5:
            scored.append((ratio, f.name))
    return [c for _, c in sorted(scored)[:most]]


def pin_degrees(parents: DataFrame, degree: str, target: int, rid: str, seed: int) -> DataFrame:
    """Degrees scaled to an exact total: whole parts first, the rest one each to the largest remainders (ties at random)."""
    total = parents.agg(F.coalesce(F.sum(degree), F.lit(0))).first()[0]
    if not total:
        base = parents.withColumn("_x", F.lit(0.0))
        n = parents.count()
        base = base.withColumn("_x", F.lit(target / max(n, 1)))
    else:
        base = parents.withColumn("_x", F.col(degree) * (target / total))
    base = base.withColumn("_b", F.floor("_x").cast("long"))
    rest = target - (base.agg(F.sum("_b")).first()[0] or 0)
    ranked = dense_index(base.withColumn("_f", F.col("_b") - F.col("_x")).withColumn("_o", order_key(seed, "pin", F.col(rid))), ["_f", "_o", rid], "_i")
    return ranked.withColumn(degree, F.col("_b") + F.when(F.col("_i") < rest, 1).otherwise(0)).drop("_x", "_b", "_f", "_o", "_i")


def recode(c: Column, source: ColumnSpec, target: ColumnSpec) -> Column:
    """A parent's code as the child's encoder has it: each orders categories by frequency among its own rows."""
    if source.kind != CATEGORICAL or target.kind != CATEGORICAL or not source.categories:
        return c
    to = {v: float(i) for i, v in enumerate(target.categories)}
    codes = F.array(*[F.lit(to.get(v, to.get(OTHER, -1.0))) for v in source.categories])
    return F.when((c >= 0) & (c < len(source.categories)), F.element_at(codes, F.greatest(c, F.lit(0.0)).cast("int") + 1)).otherwise(F.lit(-1.0))


@dataclass
class TableModel:
    spec: TableSpec
    columns: list[ColumnSpec]
    engine: SPN | ARF
    context: list[str] = field(default_factory=list)
    order: list[str] = field(default_factory=list)
    key_is_text: bool = False
    rows: int = 0


class RelationalModel:
    """One density model for each table; `__ctx__` parent columns and `__deg__` child degrees are modelled along and never come out."""

    def __init__(self, specs: dict[str, TableSpec], params: SPNParams | ARFParams | None = None, aggregation: agg.AggregationConfig | None = None):
        """The engine follows from the parameters: a network, or a forest, which has no privacy."""
        self.specs, self.params, self.aggregation = specs, params or SPNParams(), aggregation
        self.models: dict[str, TableModel] = {}
        self.degrees: dict[tuple[str, str], DegreeModel] = {}
        self.order = topological_order({t: [f.parent for f in s.foreign_keys] for t, s in specs.items()})

    def children(self, table: str) -> list[tuple[str, ForeignKey]]:
        """Tables whose first foreign key, the immediate parent, is this one."""
        return [(t, s.foreign_keys[0]) for t, s in self.specs.items() if s.foreign_keys and s.foreign_keys[0].parent == table and t != table]

    def fit(self, tables: dict[str, DataFrame]) -> RelationalModel:
        forest = isinstance(self.params, ARFParams)
        p = SPNParams(private=False) if forest else self.params
        eps = p.epsilon
        for t in self.order:
            s, df = self.specs[t], tables[t]
            kids = self.children(t)
            for c, f in kids:
                ledger = PrivacyLedger(eps * DEGREE_SHARE, 1) if p.private else None
                self.degrees[t, c] = DegreeModel.fit(df, tables[c], f.parent_columns, f.columns, s.max_degree, eps * DEGREE_SHARE / max(len(kids), 1) if p.private else None, ledger)
            wide = df
            for c, f in kids if not p.private else []:
                renamed = tables[c].select(*[F.col(a).alias(b) for a, b in zip(f.columns, f.parent_columns, strict=True)])
                wide = child_counts(wide, renamed, f.parent_columns, DEG + c)
                if self.aggregation and self.aggregation.enabled:
                    cols = [x for x in tables[c].columns if x not in self.specs[c].keys()]
                    src = tables[c].withColumnsRenamed(dict(zip(f.columns, f.parent_columns, strict=True)))
                    summary = agg.aggregate(src, f.parent_columns, [x for x in cols if x not in self.specs[c].sortby], self.aggregation, self.specs[c].sortby or None)
                    summary = summary.drop("count").withColumnsRenamed({x: f"{AGG}{c}__{x}" for x in summary.columns if x not in (*f.parent_columns, "count")})
                    wide = agg.align(wide.withColumn("count", F.lit(None).cast("long")).drop("count"), summary.withColumn("count", F.lit(0).cast("long")), f.parent_columns).drop("count")
            context: list[str] = []
            if s.foreign_keys and s.foreign_keys[0].parent in self.models:
                f = s.foreign_keys[0]
                up = self.models[f.parent]
                context = rank_context(tables[f.parent], self.specs[f.parent].keys(), {c.name: c.kind for c in up.columns})
                parent = tables[f.parent].withColumnsRenamed(dict(zip(f.parent_columns, f.columns, strict=True)))
                wide = parent_context(wide, parent, f.columns, context)
            model_cols = [c for c in wide.columns if c not in s.keys()]
            train = wide.select(*model_cols).persist()
            table_params = SPNParams(**asdict(p) | {"epsilon": eps * (1 - DEGREE_SHARE if kids else 1)})
            kinds = s.kinds | {c: "numerical" for c in model_cols if c.startswith(DEG)}
            columns = encode.fit(train, kinds, s.domain, s.styles)
            if forest:
                numbered = dense_index(encode.transform(train, columns), [c.name for c in columns], "_row")
                engine = ARF(self.params, columns).fit(numbered.withColumn("_row", F.col("_row").cast("long")), "_row")
            else:
                engine = SPN(table_params, columns).fit(encode.transform(train, columns))
            key_text = bool(s.primary_key) and df.schema[s.primary_key].dataType.typeName() == "string"
            self.models[t] = TableModel(s, columns, engine, context, [c for c in df.columns], key_text, train.count())
            train.unpersist()
        return self

    def sample(self, spark: SparkSession, counts: dict[str, int] | None = None, seed: int = 1, namespace: str = "synthetic") -> dict[str, DataFrame]:
        """All tables, keys intact. counts pins a table's rows exactly; roots default to 1,000, children follow their parents.

        Every draw depends on the row's id alone, so the plan can be evaluated again, on any partitioning, with the same result.
        """
        counts = counts or {}
        encoded: dict[str, DataFrame] = {}  # row id, key columns and model space of generated parents
        out: dict[str, DataFrame] = {}
        for t in self.order:
            m = self.models[t]
            s = m.spec
            own = [c.name for c in m.columns if not c.name.startswith((DEG, CTX, AGG))]
            evidence: dict[str, Column] = {}
            fk = s.foreign_keys[0] if s.foreign_keys and s.foreign_keys[0].parent in encoded else None
            if fk is None:
                rows = spark.range(counts.get(t, 1000)).select(F.col("id").cast("string").alias("_rid"))
            else:
                up = encoded[fk.parent]
                deg = DEG + t
                if deg in up.columns:
                    d = F.greatest(F.bround(F.coalesce(F.col(deg), F.lit(0.0))), F.lit(0.0)).cast("long")
                elif (fk.parent, t) in self.degrees:
                    d = self.degrees[fk.parent, t].draw(uniform(seed, f"{t}:degree", F.col("_rid")))
                else:
                    d = F.lit(1).cast("long")
                carried = {c: f"_p_{c}" for c in m.context}
                bridge = [(g, x) for g in s.foreign_keys[1:] for x in zip(g.columns, g.parent_columns, strict=True) if all(y in up.columns for y in g.parent_columns)]
                parents = up.select("_rid", *[F.col(b).alias(f"_k_{a}") for a, b in zip(fk.columns, fk.parent_columns, strict=True)], *[F.col(c).alias(n) for c, n in carried.items()], *[F.col(b).alias(f"_k_{a}") for _, (a, b) in bridge], F.least(d, F.lit(self.specs[fk.parent].max_degree).cast("long")).alias("_d"))
                if t in counts:
                    parents = pin_degrees(parents, "_d", counts[t], "_rid", seed)
                rows = expand(parents, "_d", "_i").withColumn("_rid", F.concat_ws(".", "_rid", "_i")).drop("_d", "_i")
                theirs = {c.name: c for c in self.models[fk.parent].columns}
                mine = {c.name: c for c in m.columns}
                evidence = {CTX + c: recode(F.col(n), theirs[c], mine[CTX + c]) for c, n in carried.items()}
            if s.primary_key and s.primary_key not in s.keys() - {s.primary_key}:
                # keys follow from row ids alone, so they are made before values, which a sort would draw twice
                initials = "".join(w[0] for w in t.split("_") if w).upper() if m.key_is_text else None
                rows = encode.mint_keys(rows, "_rid", t, f"{namespace}:{seed}", "_pk", initials)
            drawn = m.engine.sample(rows, "_rid", seed, t, evidence)
            keys = {c: F.col(f"_k_{c}") for f in s.foreign_keys for c in f.columns if f"_k_{c}" in drawn.columns}
            keyed = drawn.withColumns(keys)
            for f in s.foreign_keys:
                if f.parent in encoded and len(f.columns) == 1 and f.columns[0] not in keyed.columns:
                    keyed = random_parent(keyed, F.col("_rid"), encoded[f.parent].select(f.parent_columns[0]), f.parent_columns[0], seed, f"{t}:{f.parent}", f.columns[0])
            if "_pk" in rows.columns:
                keyed = keyed.withColumn(s.primary_key, F.col("_pk"))
            key_cols = [c for c in s.keys() if c in keyed.columns]
            # a table written to the shared folder would end the lineage here; the library keeps it lazy and caches once a table
            state = keyed.select("_rid", *key_cols, *[c.name for c in m.columns]).persist()
            encoded[t] = state
            plain = [c for c in m.columns if c.name in own]
            values = encode.inverse_transform(state, plain, "_rid", seed, f"{namespace}:{t}")
            table = values.join(state.select("_rid", *key_cols), "_rid").drop("_rid") if key_cols else values.drop("_rid")
            out[t] = table.select(*[c for c in m.order if c in table.columns])
        return out

    def to_json(self) -> dict:
        """IO9: all that sampling needs; one entry a table."""
        return {
            "engine": "ARF" if isinstance(self.params, ARFParams) else "SPN",
            "params": asdict(self.params),
            "order": self.order,
            "specs": {t: asdict(s) for t, s in self.specs.items()},
            "degrees": [[p, c, d.values, d.probs] for (p, c), d in self.degrees.items()],
            "tables": {t: {"context": m.context, "order": m.order, "key_is_text": m.key_is_text, "rows": m.rows, "engine": m.engine.to_json()} for t, m in self.models.items()},
        }

    @classmethod
    def from_json(cls, d: dict) -> RelationalModel:
        specs = {t: TableSpec(**s | {"foreign_keys": [ForeignKey(**f) for f in s["foreign_keys"]]}) for t, s in d["specs"].items()}
        out = cls(specs, (ARFParams if d["engine"] == "ARF" else SPNParams)(**d["params"]))
        out.degrees = {(p, c): DegreeModel(v, q) for p, c, v, q in d["degrees"]}
        for t, m in d["tables"].items():
            engine = (ARF if m["engine"]["engine"] == "ARF" else SPN).from_json(m["engine"])
            columns = [ColumnSpec(**s) for s in m["engine"]["specs"]]
            out.models[t] = TableModel(specs[t], columns, engine, m["context"], m["order"], m["key_is_text"], m["rows"])
        return out

    def save(self, spark: SparkSession, folder: str) -> None:
        """IO9: model and tables in a folder that holds all that sampling needs: long lists of the encoders are tables beside the model."""
        d = self.to_json()
        for t, m in d["tables"].items():
            held = [(m["engine"], "leaves_table", "leaves"), *((s, k, hashlib.md5(s["name"].encode()).hexdigest()) for s in m["engine"]["specs"] for k in TABLES)]
            for entry, k, name in held:
                if entry.get(k):
                    at = f"tables/{t}-{k}-{name}"
                    spark.read.parquet(entry[k]).write.mode("overwrite").parquet(f"{folder}/{at}")
                    entry[k] = at
        manifest = {"engine": d["engine"], "version": 1, "model": d}
        spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/model")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> RelationalModel:
        """A saved model; its tables are read from where they were saved."""
        d = json.loads(spark.read.text(f"{folder}/model").first()[0])["model"]
        for m in d["tables"].values():
            for entry in (m["engine"], *m["engine"]["specs"]):
                entry.update({k: f"{folder}/{entry[k]}" for k in (*TABLES, "leaves_table") if entry.get(k)})
        return cls.from_json(d)
