"""Registered queries: pieces of the models, samplers, privacy, and whole models. Where there is no SQL, tests look at properties of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import rng
from tessera.operators import arf, autoconfigure, descent, dp, encode, evaluate, joins, leaves, relational, spn, structure
from tessera.operators.keys import ValueIndex, infer_schema, looks_like_key, singular
from tessera.plans import pipeline
from tessera.plans.registry import query
from tessera.plans.tables import VIEWS, customers, load, rounded, sql
from tessera.sources.tables import settled
from tessera.types import ColumnSpec, ForeignKey, TableSpec

S = SparkSession
O, L, E = sql("orders"), sql("lineitem"), sql("events")


def _cells(df: DataFrame, a: str, b: str) -> tuple[dict, list]:
    """The table of two columns' codes as learning counts it, and their specs."""
    specs = encode.fit(df.select(a, b), {a: "categorical", b: "categorical"}, find_mirrors=False)
    rows = encode.transform(df, specs).withColumn("_node", F.lit(0))
    return structure.tables(rows, {0: structure.Open(0, [a, b])}, {s.name: s for s in specs}, {0: {}})[0, 0, 1], specs


@query("contingency", f"SELECT status, priority, count(*) AS n FROM {O} GROUP BY 1, 2")
def contingency(spark: S, d: str) -> DataFrame:
    cells, (x, y) = _cells(load(spark, d, "orders"), "status", "priority")
    return spark.createDataFrame([(x.categories[int(a)], y.categories[int(b)], int(n)) for (a, b), n in cells.items()], "status string, priority string, n long")


@query(
    "chi2_stat",
    f"""WITH c AS (SELECT returnflag AS a, linestatus AS b, count(*) AS n FROM {L} GROUP BY 1, 2), r AS (SELECT a, sum(n) AS n FROM c GROUP BY 1), k AS (SELECT b, sum(n) AS n FROM c GROUP BY 1), t AS (SELECT sum(n) AS n FROM c),
f AS (SELECT coalesce(c.n, 0) AS o, CAST(r.n AS DOUBLE) * k.n / t.n AS e FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c ON c.a = r.a AND c.b = k.b)
SELECT round(sum((o - e) * (o - e) / e), 4) AS statistic, CAST((SELECT (count(*) - 1) FROM r) * (SELECT count(*) - 1 FROM k) AS BIGINT) AS degrees FROM f""",
)
def chi2_stat(spark: S, d: str) -> DataFrame:
    cells, _ = _cells(load(spark, d, "lineitem"), "returnflag", "linestatus")
    stat, df = spn.chi_square(cells)
    return rounded(spark.createDataFrame([(stat, df)], "statistic double, degrees long"), 4)


_EDGES = f"(SELECT list_sort(list_distinct(quantile_cont(totalprice, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0]))) AS e FROM {O})"


@query("quantile_bins", f"SELECT order_id, CAST(len(list_filter(e[2:8], lambda x: x <= totalprice)) AS DOUBLE) AS bin FROM {O}, {_EDGES}")
def quantile_bins(spark: S, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    specs = {s.name: s for s in encode.fit(o.select("totalprice"))}
    edges, _ = structure.edges_of(o.withColumn("_node", F.lit(0)), {0: structure.Open(0, ["totalprice"])}, specs, False)
    inner = F.array(*[F.lit(e) for e in edges[0]["totalprice"]])
    return o.select("order_id", F.size(F.filter(inner, lambda e: e <= F.col("totalprice"))).cast("double").alias("bin"))


@query(
    "histogram_leaf",
    f"""WITH q AS (SELECT list_sort(list_distinct(quantile_cont(quantity, [i / 32.0 for i in range(0, 33)]))) AS e FROM {L}), b AS (SELECT least(greatest(len(list_filter(e, lambda x: x <= quantity)) - 1, 0), len(e) - 2) AS bin FROM {L}, q)
SELECT CAST(bin AS BIGINT) AS bin, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS prob FROM b GROUP BY 1""",
)
def histogram_leaf(spark: S, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").select("quantity")
    specs = encode.fit(li, {"quantity": "numerical"})
    leaf = spn.make_leaves(encode.transform(li, specs).withColumn("_node", F.lit(0)), {0: specs})[0][0]
    return rounded(spark.createDataFrame([(i, p) for i, p in enumerate(leaf.probs) if p], "bin long, prob double"))


@query("categorical_leaf", f"WITH n AS (SELECT priority, count(*) AS n FROM {O} GROUP BY 1) SELECT priority, round(n / CAST(sum(n) OVER () AS DOUBLE), 6) AS prob FROM n")
def categorical_leaf(spark: S, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("priority")
    specs = encode.fit(o)
    leaf = spn.make_leaves(encode.transform(o, specs).withColumn("_node", F.lit(0)), {0: specs})[0][0]
    return rounded(spark.createDataFrame([(specs[0].categories[int(c)], p) for c, p in zip(leaf.codes, leaf.probs, strict=True)], "priority string, prob double"))


_DEG = f"(SELECT least(coalesce(n, 0), 200) AS d FROM {sql('customer')} LEFT JOIN (SELECT customer_id, count(*) AS n FROM {O} GROUP BY 1) USING (customer_id))"


def _degrees(spark: S, d: str) -> relational.DegreeModel:
    return relational.DegreeModel.fit(load(spark, d, "customer"), load(spark, d, "orders"), ["customer_id"], ["customer_id"])


@query("degree_hist", f"SELECT CAST(d AS BIGINT) AS degree, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS prob FROM {_DEG} GROUP BY 1")
def degree_hist(spark: S, d: str) -> DataFrame:
    m = _degrees(spark, d)
    return rounded(spark.createDataFrame(list(zip(m.values, m.probs, strict=True)), "degree long, prob double"))


@query(
    "sample_degree",
    f"""WITH h AS (SELECT CAST(d AS BIGINT) AS d, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM {_DEG} GROUP BY 1), c AS (SELECT d, sum(p) OVER (ORDER BY d) AS hi, row_number() OVER (ORDER BY d) - 1 AS k FROM h),
u AS (SELECT customer_id, {rng.uniform_sql(11, 'deg', 'customer_id')} AS u FROM {sql('customer')}), n AS (SELECT u.customer_id, count(*) FILTER (WHERE c.hi <= u.u) AS k, (SELECT max(k) FROM c) AS m FROM u CROSS JOIN c GROUP BY 1)
SELECT customer_id, c.d AS degree FROM n JOIN c ON c.k = least(n.k, m)""",
)
def sample_degree(spark: S, d: str) -> DataFrame:
    c = load(spark, d, "customer").select("customer_id").withColumn("u", rng.uniform(11, "deg", F.col("customer_id")))
    return c.select("customer_id", _degrees(spark, d).draw(F.col("u")).alias("degree"))


@query(
    "sample_categorical",
    f"""WITH h AS (SELECT priority, count(*) AS n FROM {O} GROUP BY 1), c AS (SELECT priority, sum(n) OVER (ORDER BY priority) / CAST(sum(n) OVER () AS DOUBLE) AS hi, row_number() OVER (ORDER BY priority) - 1 AS k FROM h),
u AS (SELECT order_id, {rng.uniform_sql(5, 'cat', 'order_id')} AS u FROM {O}), n AS (SELECT u.order_id, count(*) FILTER (WHERE c.hi <= u.u) AS k FROM u CROSS JOIN c GROUP BY 1) SELECT order_id, c.priority AS drawn FROM n JOIN c ON c.k = least(n.k, (SELECT max(k) FROM c))""",
)
def sample_categorical(spark: S, d: str) -> DataFrame:
    """The outcome table (one row a category, collected) as cumulative shares, one uniform for each row."""
    from tessera.operators.aggregate import cumulative

    o = load(spark, d, "orders")
    table = [(r["priority"], r["cumulative"]) for r in cumulative(o.groupBy("priority").count(), "count", "priority").orderBy("priority").collect()]
    u = o.select("order_id").withColumn("u", rng.uniform(5, "cat", F.col("order_id")))
    k = rng.pick(F.col("u"), F.array(*[F.lit(float(c)) for _, c in table]))
    return u.select("order_id", F.element_at(F.array(*[F.lit(v) for v, _ in table]), k + 1).alias("drawn"))


_H = f"(SELECT min(acctbal) AS lo, (max(acctbal) - min(acctbal)) / 2 + min(acctbal) AS mid, max(acctbal) AS hi, avg(CAST(acctbal < (max_a + min_a) / 2 AS INT)) AS p FROM {sql('customer')}, (SELECT max(c_acctbal) AS max_a, min(c_acctbal) AS min_a FROM customer))"


@query("sample_histogram", f"WITH u AS (SELECT customer_id, {rng.uniform_sql(9, 'h', 'customer_id')} AS u FROM {sql('customer')}) SELECT customer_id, round(CASE WHEN u < p THEN lo + u / p * (mid - lo) ELSE mid + (u - p) / (1 - p) * (hi - mid) END, 4) AS drawn FROM u, {_H}")
def sample_histogram(spark: S, d: str) -> DataFrame:
    c = load(spark, d, "customer")
    r = c.agg(F.min("acctbal").alias("lo"), F.max("acctbal").alias("hi")).first()
    mid = (r["hi"] - r["lo"]) / 2 + r["lo"]
    p = c.agg(F.avg((F.col("acctbal") < (r["hi"] + r["lo"]) / 2).cast("double"))).first()[0]
    leaf = spn.Node("histogram", ["x"], probs=[p, 1 - p], edges=[r["lo"], mid, r["hi"]])
    u = c.select("customer_id").withColumn("u", rng.uniform(9, "h", F.col("customer_id")))
    return rounded(u.select("customer_id", descent.draw_leaf(F.col("u"), F.element_at(descent.Layout(leaf, ["x"]).leaf(0), 1)).alias("drawn")), 4)


@query(
    "laplace_counts",
    f"""WITH n AS (SELECT event_type, count(*) AS n FROM {E} GROUP BY 1), u AS (SELECT *, {rng.uniform_sql(17, 'lap', 'event_type')} - 0.5 AS x FROM n)
SELECT event_type, round(greatest(n - 2.0 * sign(x) * ln(greatest(1 - 2 * abs(x), 1e-300)), 0), 6) AS noisy FROM u""",
)
def laplace_counts(spark: S, d: str) -> DataFrame:
    """The mechanism's formula under a test seed; production noise comes from the operating system."""
    n = load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("u", rng.uniform(17, "lap", F.col("event_type")))
    return rounded(n.select("event_type", F.greatest(F.col("n") + rng.laplace(F.col("u"), 2.0), F.lit(0.0)).alias("noisy")))


_POST = "CASE status WHEN 'F' THEN {0} WHEN 'O' THEN {1} WHEN 'P' THEN {2} ELSE 1e-12 END"


@query("spn_posterior", f"WITH s AS (SELECT order_id, 0.3 * {_POST.format(0.7, 0.2, 0.1)} AS a, 0.7 * {_POST.format(0.1, 0.6, 0.3)} AS b FROM {O}) SELECT order_id, round(a / (a + b), 6) AS first, round(b / (a + b), 6) AS second FROM s")
def spn_posterior(spark: S, d: str) -> DataFrame:
    """M1: a mixture's posterior given one column, as sampling draws from it."""
    code = F.array_position(F.array(F.lit("F"), F.lit("O"), F.lit("P")), F.col("status")).cast("double") - 1
    leaves = [spn.Node("categorical", ["status"], codes=[0.0, 1.0, 2.0], probs=p) for p in ([0.7, 0.2, 0.1], [0.1, 0.6, 0.3])]
    o = descent.posterior(load(spark, d, "orders"), spn.Node("sum", ["status"], [0.3, 0.7], leaves), ["status"], {"status": code})
    return rounded(o.select("order_id", F.element_at("posterior", 1).alias("first"), (F.element_at("posterior", 2) - F.element_at("posterior", 1)).alias("second")))


def _network() -> spn.Node:
    """Two mixtures beside each other: a and b depend on each other, c does not depend on them."""
    leaf = lambda c, *p: spn.Node("categorical", [c], codes=[float(i) for i in range(len(p))], probs=list(p))
    one = spn.Node("sum", ["a", "b"], [0.25, 0.75], [spn.Node("product", ["a", "b"], children=[leaf("a", 0.9, 0.1), leaf("b", 0.2, 0.8)]), spn.Node("product", ["a", "b"], children=[leaf("a", 0.4, 0.6), leaf("b", 0.5, 0.5)])])
    two = spn.Node("sum", ["c"], [0.5, 0.5], [leaf("c", 1.0), spn.Node("histogram", ["c"], probs=[0.5, 0.5], edges=[1.0, 2.0, 4.0])])
    return spn.Node("product", ["a", "b", "c"], children=[one, two])


def _u(stream: str, *ids: str) -> str:
    return rng.uniform_sql(21, stream, *ids)


_K = "CASE WHEN {u} >= {p} THEN 1 ELSE 0 END"
_PLACE = _K.format(u=_u("net:1", "0", "order_id"), p="0.25"), _K.format(u=_u("net:1", "1", "order_id"), p="0.5")
_C = f"CASE WHEN j = 0 THEN 0.0 WHEN {_u('net:c', 'order_id')} < 0.5 THEN 1 + {_u('net:c', 'order_id')} / 0.5 ELSE 2 + ({_u('net:c', 'order_id')} - 0.5) / 0.5 * 2 END"


def _drawn(c: str, p: float, q: float) -> str:
    return f"CAST(CASE WHEN {_u('net:' + c, 'order_id')} >= CASE WHEN i = 0 THEN {p} ELSE {q} END THEN 1 ELSE 0 END AS DOUBLE) AS {c}"


@query("spn_descent", f"SELECT order_id, {_drawn('a', 0.9, 0.4)}, {_drawn('b', 0.2, 0.5)}, round({_C}, 6) AS c FROM (SELECT order_id, {_PLACE[0]} AS i, {_PLACE[1]} AS j FROM {O})")
def spn_descent(spark: S, d: str) -> DataFrame:
    """A row for each order drawn from a given network of two mixtures beside each other."""
    rows = load(spark, d, "orders").select("order_id")
    return rounded(descent.sample(rows, _network(), ["a", "b", "c"], "order_id", 21, "net"))


@query(
    "spn_given",
    f"""WITH e AS (SELECT order_id, CASE status WHEN 'F' THEN 0 ELSE 1 END AS b FROM {O}), p AS (SELECT *, 0.25 * CASE b WHEN 0 THEN 0.2 ELSE 0.8 END AS x, 0.75 * 0.5 AS y FROM e),
k AS (SELECT order_id, b, CASE WHEN {_u('net:1', '0', 'order_id')} >= x / (x + y) THEN 1 ELSE 0 END AS i FROM p) SELECT order_id, {_drawn('a', 0.9, 0.4)}, CAST(b AS DOUBLE) AS b FROM k""",
)
def spn_given(spark: S, d: str) -> DataFrame:
    """The same network where the orders' status gives b: it is copied, and shapes what is drawn of a."""
    rows = load(spark, d, "orders").select("order_id", F.when(F.col("status") == "F", 0.0).otherwise(1.0).alias("given"))
    return descent.sample(rows, _network(), ["a", "b", "c"], "order_id", 21, "net", {"b": F.col("given")}).select("order_id", "a", "b")


@query("leaf_density", f"WITH l AS (SELECT returnflag AS leaf, avg(extendedprice) AS m, stddev_pop(extendedprice) AS s, min(extendedprice) AS lo, max(extendedprice) AS hi, count(*) AS n FROM {L} GROUP BY 1) SELECT leaf, round(m, 4) AS mean, round(s, 4) AS std, round(lo, 4) AS low, round(hi, 4) AS high, round(n / CAST(sum(n) OVER () AS DOUBLE), 6) AS weight FROM l")
def leaf_density(spark: S, d: str) -> DataFrame:
    """R4 with a given assignment of rows to leaves: the forest's own densities."""
    placed = load(spark, d, "lineitem").select("extendedprice", F.lit(0).alias("tree"), F.ascii("returnflag").alias("node"))
    out = leaves.densities(placed, [ColumnSpec("extendedprice", "numerical")], 0.5)
    x = F.col("extendedprice")
    return rounded(out.select(F.char("node").alias("leaf"), *[F.round(x[c], 4).alias(c) for c in ("mean", "std", "low", "high")], F.round("weight", 6).alias("weight")))


_SEED, _STEP = 17, 4000
_GIVEN = f"""WITH o AS (SELECT order_id, CAST(totalprice AS DOUBLE) AS x, ascii(status) AS c, floor(totalprice / {_STEP}) AS node FROM {O}),
g AS (SELECT node, count(*) AS n, avg(x) AS m, stddev_pop(x) AS s, min(x) AS lo, max(x) AS hi FROM o GROUP BY 1),
w AS (SELECT avg(x) AS m, stddev_pop(x) AS s, min(x) AS lo, max(x) AS hi FROM o),
l AS (SELECT node, n, n / CAST(sum(n) OVER () AS DOUBLE) AS weight, row_number() OVER (ORDER BY node) - 1 AS leaf, CASE WHEN n < 5 THEN w.m ELSE g.m END AS m, CASE WHEN n < 5 THEN w.s ELSE g.s END AS s, CASE WHEN n < 5 THEN w.lo ELSE g.lo END AS lo, CASE WHEN n < 5 THEN w.hi ELSE g.hi END AS hi FROM g CROSS JOIN w),
p AS (SELECT l.leaf, o.c, (count(*) + 0.5) / sum(count(*) + 0.5) OVER (PARTITION BY l.leaf) AS p FROM l JOIN o ON l.n < 5 OR o.node = l.node GROUP BY 1, 2),
t AS (SELECT CAST(ceil(sqrt(sqrt(count(*)))) AS BIGINT) AS t FROM l),
t0 AS (SELECT leaf, ntile((SELECT t FROM t)) OVER (ORDER BY m, leaf) AS t0 FROM l),
main AS (SELECT leaf, arg_max(c, p * 1000000 + c / 1000000.0) AS c FROM p GROUP BY 1),
t1 AS (SELECT leaf, t0, ntile((SELECT t FROM t)) OVER (PARTITION BY t0 ORDER BY c, leaf) AS t1 FROM t0 JOIN main USING (leaf)),
b AS (SELECT leaf, dense_rank() OVER (ORDER BY t0, t1) AS block FROM t1),
f AS (SELECT l.*, block, row_number() OVER (PARTITION BY block ORDER BY leaf) - 1 AS place, count(*) OVER (PARTITION BY block) AS size FROM l JOIN b USING (leaf)),
q AS (SELECT order_id, x + {_STEP} / 2 AS x, c FROM o),
u AS (SELECT order_id, block, size, -ln({rng.uniform_sql(_SEED, "given:block", "order_id", "block")}) / size AS first, floor({rng.uniform_sql(_SEED, "given:place", "order_id", "block")} * size) AS place FROM q CROSS JOIN (SELECT DISTINCT block, size FROM f)),
r AS (SELECT q.order_id, f.node, ln(f.weight) + ln(greatest(coalesce(p.p, 1e-12), 1e-12)) + CASE WHEN s > 1e-9 THEN -((x - m) / s) * ((x - m) / s) / 2 - ln(s) WHEN abs(x - m) <= 1e-6 THEN 0 ELSE -30 END - CASE WHEN x < lo OR x > hi THEN 10 ELSE 0 END
  - ln(u.first + CASE WHEN u.place = f.place THEN 0 ELSE -ln({rng.uniform_sql(_SEED, "given:race", "q.order_id", "f.leaf")}) END) AS score FROM q JOIN u USING (order_id) JOIN f ON f.block = u.block LEFT JOIN p ON p.leaf = f.leaf AND p.c = q.c)
SELECT order_id, arg_max(node, score) AS node FROM r GROUP BY 1"""


@query("leaf_given", _GIVEN)
def leaf_given(spark: S, d: str) -> DataFrame:
    """For each order a leaf drawn by weight and by how well a price and a status fit it; SQL races every row against every leaf."""
    o = load(spark, d, "orders")
    code = F.ascii("status").cast("double")
    placed = o.select(F.lit(0).alias("tree"), F.floor(F.col("totalprice") / _STEP).alias("node"), F.col("totalprice").cast("double").alias("x"), code.alias("c"))
    specs = [ColumnSpec("x", "numerical"), ColumnSpec("c", "categorical")]
    found = settled(leaves.densities(placed, specs, 0.5), "leaves")
    index = leaves.LeafIndex(found, specs)
    best = index.best(o.select("order_id", (F.col("totalprice").cast("double") + _STEP / 2).alias("x"), code.alias("c")), "order_id", ["x", "c"], _SEED, "given")
    return best.join(index.near(found.select("leaf", "node")), "leaf").select("order_id", "node")


# Whole models


def _beta(n: int) -> spn.SPNParams:
    return spn.SPNParams(beta=max(n // 4, 100), max_depth=2)


_CENTRES = [[0.1, 0.2], [0.5, 0.9], [0.9, 0.4]]


def _lloyd_sql(rounds: int) -> str:
    out = f"WITH l AS (SELECT quantity / 50 AS a, discount * 10 AS b FROM {L}), c0 AS (SELECT " + ", ".join(f"{x} AS a{k}, {y} AS b{k}" for k, (x, y) in enumerate(_CENTRES)) + ")"
    for i in range(rounds + 1):
        far = ", ".join(f"(a - a{k}) * (a - a{k}) + (b - b{k}) * (b - b{k}) AS d{k}" for k in range(3))
        out += f", k{i} AS (SELECT a, b, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS k FROM (SELECT a, b, {far} FROM l, c{i}))"
        out += f", c{i + 1} AS (SELECT " + ", ".join(f"avg(a) FILTER (k = {k}) AS a{k}, avg(b) FILTER (k = {k}) AS b{k}" for k in range(3)) + f" FROM k{i})"
    return out + f" SELECT k AS cluster, count(*) AS n, round(avg(a), 6) AS a, round(avg(b), 6) AS b FROM k{rounds} GROUP BY 1"


@query("kmeans_split", _lloyd_sql(3))
def kmeans_split(spark: S, d: str) -> DataFrame:
    """Three rounds over the line items from given centres, then the clusters' sizes and means."""
    li = load(spark, d, "lineitem").select(F.lit(0).alias("_node"), F.array(F.col("quantity") / 50, F.col("discount") * 10).alias("x"))
    _, step = structure.lloyd(li, {(0, 0): _CENTRES}, rounds=3)
    n, sums, _ = step[0, 0]
    return rounded(spark.createDataFrame([(k, int(n[k]), float(sums[k][0] / n[k]), float(sums[k][1] / n[k])) for k in range(3) if n[k]], "cluster int, n long, a double, b double"))


@query("dp_kmeans")
def dp_kmeans(spark: S, d: str) -> DataFrame:
    """D5 under a test seed: noisy centres of two scaled columns."""
    li = load(spark, d, "lineitem").select(F.lit(0).alias("_node"), F.array(F.col("quantity") / 25 - 1, F.col("discount") * 20 - 1).alias("x"))
    centres = structure.private_centres(li, {0: 3}, {0: 1.0}, {0: 2}, dp.PrivacyLedger(8.0, 2, seed=1), 0)[0]
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(centres)], "cluster int, a double, b double")


@query("spn_fit_sample")
def spn_fit_sample(spark: S, d: str) -> DataFrame:
    """A network learnt from all orders, and as many rows drawn from it."""
    o = load(spark, d, "orders").select("status", "priority", "totalprice", "order_date")
    n = o.count()
    specs = encode.fit(o)
    m = spn.SPN(_beta(n), specs).fit(encode.transform(o, specs))
    return encode.inverse_transform(m.sample(spark.range(n).withColumnRenamed("id", "rid"), "rid", 1, "orders"), specs, "rid", 1, "orders")


@query("arf_fit_sample")
def arf_fit_sample(spark: S, d: str) -> DataFrame:
    """A forest learnt from all customers, and as many rows drawn from it."""
    c = load(spark, d, "customer").select("customer_id", "nation_id", "acctbal", "mktsegment")
    specs = encode.fit(c.drop("customer_id"))
    enc = encode.transform(c, specs, keep=["customer_id"])
    m = arf.ARF(arf.ARFParams(trees=10, max_depth=6, rounds=2), specs).fit(enc, "customer_id")
    n = c.count()
    return encode.inverse_transform(m.sample(spark.range(n).withColumnRenamed("id", "rid"), "rid", 1, "customer"), specs, "rid", 1, "customer")


def _specs() -> dict[str, TableSpec]:
    return {"customer": TableSpec("customer", "customer_id", kinds={"name": "non_std"}), "orders": TableSpec("orders", "order_id", [ForeignKey("orders", ["customer_id"], "customer", ["customer_id"])], sortby=["order_date"])}


def _generated(spark: S, d: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    tables = {"customer": load(spark, d, "customer"), "orders": load(spark, d, "orders")}
    n = tables["customer"].count()
    t = pipeline.train(spark, tables, _specs(), params=_beta(n), enforce=False)
    return tables, pipeline.generate(spark, t)


@query("relational_generate")
def relational_generate(spark: S, d: str) -> DataFrame:
    """Customers and orders generated together: the orders with their customers."""
    _, synth = _generated(spark, d)
    return synth["orders"].join(synth["customer"].select("customer_id", "mktsegment"), "customer_id")


@query("integrity_of_generation")
def integrity_of_generation(spark: S, d: str) -> DataFrame:
    from tessera.operators.report import check_integrity

    real, synth = _generated(spark, d)
    # several checks read each table: what is lazy would be decoded anew for each
    return check_integrity(spark, real, {t: settled(df, "synthetic") for t, df in synth.items()}, _specs())


@query(
    "generated_keys",
    f"SELECT v.*, CAST(count(*) - count(DISTINCT c.customer_id) AS BIGINT) AS faults FROM (VALUES ('customer', 'customer_id', 'repeated'), ('orders', 'order_id', 'repeated'), ('orders', 'customer_id', 'orphans')) v(table_name, column_name, fault) CROSS JOIN {sql('customer')} c GROUP BY ALL",
)
def generated_keys(spark: S, d: str) -> DataFrame:
    """V1, V2: keys of customers and orders generated together are as sound as the real ones: none repeats, none has no parent."""
    _, synth = _generated(spark, d)
    c, o = synth["customer"], synth["orders"]
    index = ValueIndex({("c",): (c, ["customer_id"]), ("o",): (o, ["order_id"]), ("f",): (o, ["customer_id"])})
    repeated = [(t, k, "repeated", index.of((x,))[0] - index.of((x,))[2]) for t, k, x in (("customer", "customer_id", "c"), ("orders", "order_id", "o"))]
    return spark.createDataFrame([*repeated, ("orders", "customer_id", "orphans", index.contained(("f",), ("c",))[1])], "table_name string, column_name string, fault string, faults long")


@query("generation_quality")
def generation_quality(spark: S, d: str) -> DataFrame:
    """(measure, value) of generated customers and orders: fidelity, orphans, children a parent against the real ones, detection of orders."""
    from tessera.operators import report

    real, synth = _generated(spark, d)
    synth = {t: df.persist() for t, df in synth.items()}
    fidelity, checks = pipeline.score(spark, real, synth, _specs())
    auc, _, _ = evaluate.detection(real["orders"], synth["orders"], ["status", "priority", "totalprice"], trees=20)
    rows = [("fidelity", float(report.fidelity(fidelity).first()[0])), ("detection_auc", float(auc))]
    rows += [(f"{r['check_name']} {r['table_name']}", float(r["value"])) for r in checks.collect()]
    for df in synth.values():
        df.unpersist()
    return spark.createDataFrame(rows, "measure string, value double")


def _thirds(spark: S, d: str) -> list[DataFrame]:
    """Customers in three parts by a hash: synthetic stand-in, training and test rows. Copies with gaps and errors predict each other."""
    c = customers(spark, d).select("customer_id", "acctbal", "balance", "mktsegment", "segment_alt")
    u = rng.uniform(4, "tstr", F.col("customer_id"))
    return [c.filter(u < 1 / 3), c.filter((u >= 1 / 3) & (u < 2 / 3)), c.filter(u >= 2 / 3)]


@query("tstr")
def tstr(spark: S, d: str) -> DataFrame:
    """V16 with a third of the customers standing for synthetic rows."""
    return evaluate.tstr(spark, *_thirds(spark, d), keys={"customer_id"}, trees=10)


@query("evaluate_tables")
def evaluate_tables(spark: S, d: str) -> DataFrame:
    """V18 over customers in thirds and orders resampled column by column."""
    fake, train, test = _thirds(spark, d)
    o = load(spark, d, "orders").select("order_id", "status", "totalprice")
    u = rng.uniform(5, "tstr", F.col("order_id"))
    boot = joins.bootstrap(o, ["status", "totalprice"], 3, "order_id")
    return evaluate.evaluate_tables(spark, {"customer": train, "orders": o.filter(u < 0.5)}, {"customer": test, "orders": o.filter(u >= 0.5)}, {"customer": fake, "orders": boot}, {"customer": {"customer_id"}}, trees=10)


@query("autoconfigure")
def autoconfigured(spark: S, d: str) -> DataFrame:
    """T21 over customers, orders and suppliers."""
    specs, _ = autoconfigure.autoconfigure(spark, {t: load(spark, d, t) for t in ("nation", "customer", "orders", "supplier")})
    return autoconfigure.as_rows(spark, specs)


@query("detection")
def detection(spark: S, d: str) -> DataFrame:
    """V17 of orders resampled column by column."""
    o = load(spark, d, "orders").select("order_id", "status", "priority", "totalprice")
    fake = joins.bootstrap(o, ["status", "priority", "totalprice"], 3, "order_id")
    a, alike, top = evaluate.detection(o, fake, ["status", "priority", "totalprice"], trees=20)
    return spark.createDataFrame([(a, alike, [c for c, _ in top])], "auc double, indistinguishability double, columns array<string>")


_RELATED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _schema_sql() -> str:
    """Every column that looks like a key is tried as one, and every column of a key's name as a reference to it."""
    tried = [(t, c, int(c != singular(t) + "_id"), i) for t in _RELATED for i, c in enumerate(VIEWS[t]) if looks_like_key(c)]
    one = " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, {far} AS far, {i} AS i, count(*) > 0 AND count(*) = count(DISTINCT {c}) AS ok FROM {sql(t)}" for t, c, far, i in tried)
    pairs = [(x, y, c) for x, c, _, _ in tried for y, d, _, _ in tried if x != y and c == d]
    held = " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, '{c}' AS c, avg(CAST({c} IN (SELECT {c} FROM {sql(y)}) AS INT)) AS share FROM {sql(x)} WHERE {c} IS NOT NULL" for x, y, c in pairs)
    return f"""WITH u AS (SELECT * FROM ({one}) WHERE ok), own AS (SELECT c FROM u WHERE far = 0),
k AS (SELECT t, c FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY far, c IN (SELECT c FROM own), i) AS r FROM u) WHERE r = 1)
SELECT t AS table_name, 'primary' AS kind, c AS column_name, NULL AS parent, CAST(NULL AS DOUBLE) AS containment FROM k
UNION ALL SELECT x, 'foreign', h.c, y, share FROM ({held}) h JOIN k ON k.t = h.y AND k.c = h.c LEFT JOIN k o ON o.t = h.x WHERE share >= 0.9 AND o.c IS DISTINCT FROM h.c"""


@query("schema_inference", _schema_sql())
def schema_inference(spark: S, d: str) -> DataFrame:
    """T13-T15 over all related tables."""
    tables = {t: load(spark, d, t) for t in _RELATED}
    s = infer_schema(tables)
    rows = [(t, "primary", k, None, None) for t, k in s.primary_keys.items()] + [(f.table, "foreign", f.columns[0], f.parent, f.containment) for f in s.foreign_keys]
    return spark.createDataFrame(rows, "table_name string, kind string, column_name string, parent string, containment double")
