"""Adversarial random forests for single wide tables, on MLlib's forests and their leaf columns."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.rng import uniform
from tessera.functions.scalar import truncated_normal
from tessera.operators import quantiles
from tessera.operators.joins import bootstrap
from tessera.operators.leaves import LeafIndex, densities
from tessera.sources.tables import settled
from tessera.types import CATEGORICAL, NON_STD, ColumnSpec

#: The trees are grown in so many parts; a row is hidden from one of them, which alone votes on it.
PARTS = 3


@dataclass
class ARFParams:
    trees: int = 60
    min_node_size: int = 20
    max_depth: int = 10
    delta: float = 0.05
    rounds: int = 5
    alpha: float = 0.5
    seed: int = 0


def _first_above(d: Column, u: Column) -> Column:
    """The first of the cumulative shares above u, counted from 1."""
    return F.least(F.size(F.filter(d, lambda x: x["cum"] <= u)) + 1, F.size(d))


@dataclass
class ARF:
    params: ARFParams
    specs: list[ColumnSpec]
    leaves: DataFrame | None = None
    history: list[float] = field(default_factory=list)

    @property
    def columns(self) -> list[ColumnSpec]:
        return [s for s in self.specs if s.kind != NON_STD]

    @property
    def converged(self) -> bool:
        """The last round could not tell real rows from synthetic ones."""
        return bool(self.history) and self.history[-1] <= 0.5 + self.params.delta

    @property
    def index(self) -> LeafIndex:
        if getattr(self, "_index", None) is None or self._index.leaves is not self.leaves:
            self._index = LeafIndex(self.leaves, self.columns)
        return self._index

    def fit(self, encoded: DataFrame, rid: str) -> ARF:
        """Rounds of real against synthetic rows, then densities of the last forest's leaves."""
        p, cols = self.params, [s.name for s in self.columns]
        med = {c: float((v or [0.0])[0] or 0.0) for c, v in quantiles.quantiles(encoded, cols, [0.5]).items()}
        real = encoded.select(rid, *cols).persist()
        n = real.count()
        fake = bootstrap(real, cols, p.seed, rid, number=rid)
        for k in range(p.rounds):
            both = real.select(*cols, F.col(rid).cast("string").alias("_id"), F.lit(1.0).alias("y")).unionByName(fake.select(*cols, F.col(rid).cast("string").alias("_id"), F.lit(0.0).alias("y")))
            vec = _vectors(both, cols, med, "y", "_id").persist()
            models, score = discriminator(vec, p, k)
            self.history.append(score)
            last = self.converged or k == p.rounds - 1
            self.leaves = settled(densities(_placed(models, real, cols, med), self.columns, p.alpha), "leaves")
            vec.unpersist()
            if last:
                break
            fake = self.sample(real.sparkSession.range(n).withColumnRenamed("id", rid), rid, p.seed + 1000 + k, "arf-round").select(rid, *cols)
        real.unpersist()
        return self

    def sample(self, rows: DataFrame, rid: str, seed: int, stream: str, evidence: dict[str, Column] | None = None) -> DataFrame:
        """A leaf for each row by weight (and, with evidence, by how well the evidence fits it), then its columns.

        rows: rid is unique. A missing evidence value is a null, which leaves can fit too.
        """
        out = rows.withColumn("_u", uniform(seed, f"{stream}:leaf", F.col(rid)))
        if evidence:
            out = out.withColumns({f"_e_{c}": e for c, e in evidence.items()})
            given = out.select(rid, *[F.col(f"_e_{c}").alias(c) for c in evidence])
            out = out.join(self.index.best(given, rid, list(evidence), seed, stream).drop("n_scored"), rid)
        else:
            out = self.index.drawn(out, "_u")
        out = out.join(self.index.near(self.leaves.drop("cum", "weight", "n", "tree", "node")), "leaf")
        names = [s.name for s in self.columns]
        out = out.withColumns({f"_d_{c}": uniform(seed, f"{stream}:{c}", F.col(rid)) for c in names} | {f"_n_{c}": uniform(seed, f"{stream}:{c}:null", F.col(rid)) for c in names})
        values = {}
        for s in self.columns:
            c, d = s.name, F.col(f"`{s.name}`")
            if evidence and c in evidence:
                values[c] = F.col(f"_e_{c}")
            elif s.kind == CATEGORICAL:  # nulls are a code of their own, so no second null rate (Q2)
                k = _first_above(d, F.col(f"_d_{c}"))
                values[c] = F.element_at(d, k)["v"]
            else:
                values[c] = F.when(F.col(f"_n_{c}") >= d["nul"], truncated_normal(F.col(f"_d_{c}"), d["mean"], d["std"], d["low"], d["high"]))
        keep = [c for c in rows.columns if c not in names]
        out = out.select(*keep, *[v.alias(c) for c, v in values.items()])
        return out.withColumns({s.name: F.lit(0.0) for s in self.specs if s.kind == NON_STD})

    def diagnostics(self) -> dict:
        return {"engine": "ARF", "params": asdict(self.params), "rounds": len(self.history), "history": self.history, "converged": self.converged, "leaves": self.leaves.count()}

    def to_json(self) -> dict:
        """All that sampling needs; the leaves are a table."""
        return {"engine": "ARF", "params": asdict(self.params), "specs": [s.to_json() for s in self.specs], "history": self.history, "leaves_table": self.leaves.inputFiles()[0].rsplit("/", 1)[0]}

    @classmethod
    def from_json(cls, d: dict) -> ARF:
        leaves = SparkSession.active().read.parquet(d["leaves_table"])
        return cls(ARFParams(**d["params"]), [ColumnSpec(**s) for s in d["specs"]], leaves, d["history"])


def _vectors(df: DataFrame, cols: list[str], med: dict[str, float], *keep: str) -> DataFrame:
    """R2: nulls become the column's median."""
    filled = df.select(*keep, *[F.coalesce(c, F.lit(med[c])).alias(f"_f_{c}") for c in cols])
    return VectorAssembler(inputCols=[f"_f_{c}" for c in cols], outputCol="_v").transform(filled).select(*keep, "_v")


def part_of(p: ARFParams, k: int, rid: Column, y: Column) -> Column:
    """The part of the trees that does not see a row in round k."""
    return F.floor(uniform(p.seed, f"arf:{k}", rid, y) * parts(p)).cast("int")


def parts(p: ARFParams) -> int:
    return max(2, min(PARTS, p.trees))


def discriminator(vec: DataFrame, p: ARFParams, k: int) -> tuple[list[RandomForestClassificationModel], float]:
    """The forest of round k over (_id, y, _v), and its out-of-bag accuracy over all rows.

    MLlib tells no one which rows a tree has drawn. So the trees grow in parts at once, each blind to the rows that a hash gives to it, and
    a row is judged by those trees alone that never saw it: a third of them, about as many as miss a row of a bootstrap.
    """
    m = parts(p)
    vec = vec.withColumn("_part", part_of(p, k, F.col("_id"), F.col("y")))

    def grow(i: int) -> RandomForestClassificationModel:
        trees = max(1, p.trees // m + (i < p.trees % m))
        forest = RandomForestClassifier(numTrees=trees, minInstancesPerNode=p.min_node_size, maxDepth=p.max_depth, seed=p.seed + PARTS * k + i, featuresCol="_v", labelCol="y", leafCol="_leaf")
        return forest.fit(vec.filter(F.col("_part") != i))

    jobs = [inheritable_thread_target(vec.sparkSession)(lambda i=i: grow(i)) for i in range(m)]
    with ThreadPool(m) as pool:
        models = pool.map(lambda job: job(), jobs)
    judged = [model.transform(vec.filter(F.col("_part") == i)).select((F.col("prediction") == F.col("y")).cast("int").alias("hit")) for i, model in enumerate(models)]
    row = judged[0]
    for j in judged[1:]:
        row = row.unionByName(j)
    hits, n = row.agg(F.sum("hit"), F.count("*")).first()
    return models, hits / n if n else 0.5


def _placed(models: list[RandomForestClassificationModel], real: DataFrame, cols: list[str], med: dict[str, float]) -> DataFrame:
    """(columns, tree, node): every real row once for each tree, with the leaf it falls into."""
    out = _vectors(real, cols, med, *cols)
    for i, m in enumerate(models):
        out = m.transform(out).drop("prediction", "rawPrediction", "probability").withColumn(f"_l{i}", vector_to_array("_leaf")).drop("_leaf")
    return out.select(*cols, F.posexplode(F.concat(*[f"_l{i}" for i in range(len(models))])).alias("tree", "node"))
