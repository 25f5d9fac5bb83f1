"""Registered queries: profiling, keys, policy, joins, aggregates, windows, encoding, model pieces and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import rng, scalar
from tessera.operators import aggregate as agg, masks
from tessera.operators import encode, joins, keys, policy, profile, report
from tessera.plans.registry import query
from tessera.plans.tables import CUSTOMERS_SQL, customers, load, rounded, sql
from tessera.types import ForeignKey, TableSpec

S = SparkSession
O, L, E, C = sql("orders"), sql("lineitem"), sql("events"), CUSTOMERS_SQL


def _rows(columns: list[str], one: str) -> str:
    """One SELECT for each column."""
    return " UNION ALL ".join(one.replace("{c}", c) for c in columns)


def epoch(c: str) -> str:
    return f"epoch_us({c}) / 1e6"


# Flagship: the minimum slice

_FLAG = agg.AggregationConfig(k_first=0, k_last=0, na_ratio=False)


@query(
    "entity_aggregates",
    f"""WITH o AS (SELECT *, lag(totalprice) OVER (PARTITION BY customer_id ORDER BY order_date, order_id) AS p,
  row_number() OVER (PARTITION BY customer_id ORDER BY order_date, order_id) AS i FROM {O}),
a AS (SELECT customer_id, count(*) AS n, avg(totalprice) AS m, stddev_pop(totalprice) AS s, sum(totalprice) AS t,
  CASE WHEN count(*) >= 2 THEN arg_max(totalprice, i) - arg_min(totalprice, i) END AS d, avg(CASE WHEN p IS NOT NULL THEN CAST(totalprice > p AS INT) END) AS u FROM o GROUP BY 1)
SELECT c.customer_id, c.mktsegment, coalesce(n, 0) AS "count", round(m, 6) AS totalprice__mean, round(s, 6) AS totalprice__std, round(t, 4) AS totalprice__sum,
  round(d, 6) AS totalprice__end_start_diff, round(u, 6) AS totalprice__increase_ratio FROM {sql("customer")} c LEFT JOIN a USING (customer_id)""",
)
def entity_aggregates(spark: S, d: str) -> DataFrame:
    """Infer keys, summarise orders per customer in time order, align with every customer."""
    tables = {t: load(spark, d, t) for t in ("customer", "orders")}
    schema = keys.infer_schema(tables)
    fk = schema.of("orders")[0]
    o = agg.aggregate(tables["orders"], fk.columns, ["totalprice"], _FLAG, ["order_date"], ["order_id"])
    out = agg.align(tables[fk.parent].select(*fk.parent_columns, "mktsegment"), o, fk.columns)
    out = out.withColumn("totalprice__sum", F.round("totalprice__sum", 4))
    return rounded(out)


# Profiling

_P = ["name", "acctbal", "balance", "email", "born", "segment"]


@query("profile_nulls_distinct", _rows(_P, f"SELECT '{{c}}' AS column_name, count(*) AS n_rows, count(*) - count({{c}}) AS n_nulls, round(avg(CASE WHEN {{c}} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_ratio, count(DISTINCT {{c}}) AS n_distinct FROM {C}"))
def profile_nulls_distinct(spark: S, d: str) -> DataFrame:
    return rounded(profile.null_and_distinct(customers(spark, d), _P))


@query("infer_kind_stats", _rows(["email", "born", "contact", "segment"], f"SELECT '{{c}}' AS column_name, count({{c}}) AS n, count(DISTINCT {{c}}) AS n_distinct, round(avg(CAST(regexp_full_match({{c}}, '[0-9]+') AS INT)), 6) AS digits, round(avg(CASE WHEN {{c}} IS NULL THEN NULL WHEN try_strptime({{c}}, '%Y-%m-%d') IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS dates, CASE WHEN '{{c}}' = 'born' THEN 'datetime' WHEN count(DISTINCT {{c}}) > 50 AND count(DISTINCT {{c}}) > 0.5 * count({{c}}) THEN 'non_std' ELSE 'categorical' END AS kind FROM {C}"))
def infer_kind_stats(spark: S, d: str) -> DataFrame:
    df = customers(spark, d).select("email", "born", "contact", "segment")
    stats, kinds = profile.kind_stats(df), profile.infer_kinds(df)
    rows = [(c, s["n"], s["u"], float(s["digits"] or 0), float(s["dates"] or 0), kinds[c]) for c, s in stats.items()]
    return rounded(spark.createDataFrame(rows, "column_name string, n long, n_distinct long, digits double, dates double, kind string"))


@query("datetime_granularity", " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(CASE WHEN max({epoch(c)} % 86400) = 0 THEN 86400 WHEN max({epoch(c)} % 3600) = 0 THEN 3600 WHEN max({epoch(c)} % 60) = 0 THEN 60 WHEN max(epoch_us({c}) % 1000000) = 0 THEN 1 ELSE 0 END AS BIGINT) AS granularity FROM {t}" for c, t in (("order_date", O), ("ts", E))))
def datetime_granularity(spark: S, d: str) -> DataFrame:
    return profile.granularity(load(spark, d, "orders"), ["order_date"]).unionByName(profile.granularity(load(spark, d, "events"), ["ts"]))


@query("decimal_places", _rows(["totalprice", "order_id"], "SELECT '{c}' AS column_name, CAST(CASE " + " ".join(f"WHEN max(abs({{c}} - round({{c}}, {k}))) <= 1e-9 THEN {k}" for k in range(7)) + f" END AS BIGINT) AS decimals FROM {O}"))
def decimal_places(spark: S, d: str) -> DataFrame:
    return profile.decimal_places(load(spark, d, "orders"), ["totalprice", "order_id"])


_B = ["quantity", "extendedprice", "discount"]


@query("domain_bounds", _rows(_B, f"SELECT '{{c}}' AS column_name, round(min({{c}}), 6) AS low, round(max({{c}}), 6) AS high FROM {L}") + f" UNION ALL SELECT 'ship_date', round(min({epoch('ship_date')}), 6), round(max({epoch('ship_date')}), 6) FROM {L}")
def domain_bounds(spark: S, d: str) -> DataFrame:
    return rounded(profile.domain_bounds(load(spark, d, "lineitem"), [*_B, "ship_date"]))


@query(
    "derive_domains",
    "SELECT column_name, round(CASE WHEN lo > 0 THEN 0.95 * lo WHEN lo = 0 THEN 0 ELSE lo - 0.1 * (hi - lo) END, 6) AS low, round(hi + 0.05 * (hi - lo), 6) AS high, CASE WHEN lo >= 0 AND mid > 0 AND top / mid > 8 THEN TRUE ELSE FALSE END AS log FROM ("
    + _rows(_B, f"SELECT '{{c}}' AS column_name, min({{c}}) AS lo, max({{c}}) AS hi, quantile_cont({{c}}, 0.5) AS mid, quantile_cont({{c}}, 0.99) AS top FROM {L}")
    + ")",
)
def derive_domains(spark: S, d: str) -> DataFrame:
    return rounded(profile.derive_domains(load(spark, d, "lineitem"), _B))


@query("category_top_other", f"WITH n AS (SELECT p_type AS value, count(*) AS n FROM part WHERE p_type IS NOT NULL GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS rank, count(*) OVER () AS t FROM n) SELECT value, n, CAST(rank AS INT) AS rank, CASE WHEN t <= 4 OR rank < 4 THEN value ELSE '__other__' END AS category FROM r")
def category_top_other(spark: S, d: str) -> DataFrame:
    return profile.categories(load(spark, d, "part"), "type", most=4)


_ALIKE = ["name", "mktsegment", "segment", "segment_alt", "born"]
_ALIKE_SQL = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {i} AS place, bool_and({a} IS NOT DISTINCT FROM {b}) AS same FROM {C}" for i, a in enumerate(_ALIKE) for b in _ALIKE[i + 1 :])


@query("duplicate_columns", f"SELECT arg_min(a, place) AS source, b AS duplicate FROM ({_ALIKE_SQL}) WHERE same GROUP BY b")
def duplicate_columns(spark: S, d: str) -> DataFrame:
    return profile.duplicate_columns(customers(spark, d), _ALIKE)


@query("near_duplicates", f"SELECT 'segment' AS left_column, 'segment_alt' AS right_column, round(avg(CAST(segment = segment_alt AS INT)), 6) AS exact, round(avg(CAST(upper(trim(segment)) = upper(trim(segment_alt)) AS INT)), 6) AS relaxed FROM {C} HAVING avg(CAST(upper(trim(segment)) = upper(trim(segment_alt)) AS INT)) > 0.9")
def near_duplicates(spark: S, d: str) -> DataFrame:
    return rounded(profile.near_duplicates(customers(spark, d), [("segment", "segment_alt"), ("name", "email")]))


# Keys


@query("pk_uniqueness", " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count(DISTINCT {c}) AS n_distinct, count(*) = count(DISTINCT {c}) AND count({c}) = count(*) AS is_unique FROM {sql(t)}" for t, c in (("customer", "customer_id"), ("orders", "order_id"), ("orders", "customer_id"), ("lineitem", "order_id"))))
def pk_uniqueness(spark: S, d: str) -> DataFrame:
    out = None
    for t, cs in {"customer": ["customer_id"], "orders": ["order_id", "customer_id"], "lineitem": ["order_id"]}.items():
        one = keys.uniqueness(load(spark, d, t), cs).withColumn("table_name", F.lit(t))
        out = one if out is None else out.unionByName(one)
    return out


_FKS = (("orders", "customer_id", "customer"), ("lineitem", "order_id", "orders"), ("lineitem", "part_id", "part"), ("customer", "nation_id", "nation"))


def _contained(t: str, c: str, p: str, where: str = "") -> str:
    return f"SELECT '{t}.{c}' AS edge, count(*) AS n_keys, count(p.k) AS n_matched, round(count(p.k) / CAST(count(*) AS DOUBLE), 6) AS containment, count(*) - count(p.k) AS n_orphans FROM {sql(t)} x LEFT JOIN (SELECT DISTINCT {c} AS k FROM {sql(p)} {where}) p ON x.{c} = p.k WHERE x.{c} IS NOT NULL"


@query("fk_containment", " UNION ALL ".join(_contained(*x) for x in _FKS))
def fk_containment(spark: S, d: str) -> DataFrame:
    out = None
    for t, c, p in _FKS:
        one = keys.containment(load(spark, d, t), [c], load(spark, d, p), [c]).withColumn("edge", F.lit(f"{t}.{c}"))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query("fk_orphans", _contained("orders", "customer_id", "customer", "WHERE customer_id % 9 <> 0"))
def fk_orphans(spark: S, d: str) -> DataFrame:
    parents = load(spark, d, "customer").filter("customer_id % 9 <> 0")
    return rounded(keys.containment(load(spark, d, "orders"), ["customer_id"], parents, ["customer_id"]).withColumn("edge", F.lit("orders.customer_id")))


_DEPTH = ["region", "nation", "customer", "orders", "supplier"]


@query(
    "key_depth",
    """WITH RECURSIVE f(child, parent) AS (SELECT * FROM (VALUES ('nation', 'region'), ('customer', 'nation'), ('supplier', 'nation'), ('orders', 'customer')) v(c, p)
  WHERE EXISTS (SELECT 1 FROM nation) AND EXISTS (SELECT 1 FROM orders)),
d(t, depth) AS (SELECT 'region', 0 UNION ALL SELECT f.child, d.depth + 1 FROM f JOIN d ON f.parent = d.t)
SELECT t AS table_name, CAST(max(depth) AS BIGINT) AS depth FROM d GROUP BY 1""",
)
def key_depth(spark: S, d: str) -> DataFrame:
    schema = keys.infer_schema({t: load(spark, d, t) for t in _DEPTH})
    return spark.createDataFrame(list(keys.depths(schema.foreign_keys, _DEPTH).items()), "table_name string, depth long")


@query("max_degree", f"SELECT CAST(least(greatest(round_even(1.25 * max(n), 0), 4), 2000) AS BIGINT) AS max_degree FROM (SELECT count(*) AS n FROM {O} GROUP BY customer_id)")
def max_degree(spark: S, d: str) -> DataFrame:
    return profile.max_degree(load(spark, d, "orders"), ["customer_id"])


@query(
    "schema_issues",
    f"""SELECT * FROM (SELECT 'orders' AS table_name, 'error' AS severity, 'key_not_unique' AS code, 'customer_id' AS detail WHERE (SELECT count(*) <> count(DISTINCT customer_id) FROM {O})
UNION ALL SELECT 'lineitem', 'warning', 'no_key', 'nothing can be joined to it' UNION ALL SELECT 'lineitem', 'error', 'child_column_missing', 'nothing_id'
UNION ALL SELECT 'customer,orders', 'error', 'key_shared', 'customer_id')""",
)
def schema_issues(spark: S, d: str) -> DataFrame:
    tables = {t: load(spark, d, t) for t in ("customer", "orders", "lineitem")}
    specs = {
        "customer": TableSpec("customer", "customer_id"),
        "orders": TableSpec("orders", "customer_id", [ForeignKey("orders", ["customer_id"], "customer", ["customer_id"])]),
        "lineitem": TableSpec("lineitem", None, [ForeignKey("lineitem", ["nothing_id"], "orders", ["order_id"])]),
    }
    return keys.validate_schema(spark, tables, specs)


# Policy


_TAGS = "CASE column_name WHEN 'name' THEN ['NAME'] WHEN 'acctbal' THEN ['FINANCIAL'] WHEN 'born' THEN ['DOB'] WHEN 'contact' THEN ['CARD_NUMBER'] WHEN 'mktsegment' THEN ['INTERNAL'] ELSE [] END"


def _decisions(spark: S, d: str) -> DataFrame:
    df = customers(spark, d)
    tags = {"name": ["NAME"], "acctbal": ["FINANCIAL"], "born": ["DOB"], "contact": ["CARD_NUMBER"], "mktsegment": ["INTERNAL"]}
    catalog = spark.createDataFrame([("customer", c, t) for c, t in tags.items()], "table string, column string, tags array<string>")
    return policy.build_policy(spark, {"customer": df}, {"customer": TableSpec("customer", "customer_id")}, catalog)


# the rules in order, over the columns of the view, their tags, and what an untagged column's name gives away
_DECIDE = f"""WITH c AS (SELECT column_name, {_TAGS} AS tags FROM (DESCRIBE SELECT * FROM {C})),
r AS (SELECT column_name, CASE WHEN column_name = 'customer_id' THEN 'key' WHEN len(tags) = 0 AND regexp_matches(column_name, '(^|_)(email|e_mail|mail_address)($|_)|(^|_)(phone|mobile|tel)') THEN 'inferred'
  WHEN len(tags) = 0 THEN 'unclassified' WHEN list_has_any(tags, {policy.PCI}) THEN 'card data' WHEN list_has_any(tags, {policy.DIRECT}) THEN 'direct identifier'
  WHEN list_has_any(tags, {policy.QUASI}) THEN 'quasi identifier' WHEN list_has_any(tags, {policy.SENSITIVE}) THEN 'sensitive' ELSE 'other tags' END AS reason FROM c)
SELECT column_name, CASE reason WHEN 'card data' THEN 'SUPPRESS' WHEN 'quasi identifier' THEN 'GENERALISE' WHEN 'sensitive' THEN 'MODEL_DP' WHEN 'unclassified' THEN 'MODEL' WHEN 'other tags' THEN 'MODEL' ELSE 'PSEUDONYM' END AS strategy,
  CASE WHEN reason IN ('key', 'inferred', 'direct identifier') THEN 'non_std' WHEN reason = 'quasi identifier' THEN 'categorical' END AS kind, reason = 'inferred' AS inferred, reason FROM r"""


@query("decide_column", _DECIDE)
def decide_column(spark: S, d: str) -> DataFrame:
    return _decisions(spark, d).select("column_name", "strategy", "kind", "inferred", "reason")


@query("policy_summary", f"SELECT strategy, count(*) AS n_columns, count(*) FILTER (WHERE inferred) AS n_inferred FROM ({_DECIDE}) GROUP BY 1")
def policy_summary(spark: S, d: str) -> DataFrame:
    return policy.summary(_decisions(spark, d))


@query("suppress", f"SELECT customer_id, name, nation_id, acctbal, mktsegment, balance, email, born, segment, segment_alt FROM {C}")
def suppress(spark: S, d: str) -> DataFrame:
    return policy.suppress(customers(spark, d), ["contact"])


@query("generalise_year", f"SELECT order_id, CAST(year(order_date) AS VARCHAR) AS order_date FROM {O}")
def generalise_year(spark: S, d: str) -> DataFrame:
    return policy.generalise(load(spark, d, "orders").select("order_id", "order_date"), ["order_date"])


@query("generalise_bins", f"WITH b AS (SELECT min(balance) AS lo, max(balance) AS hi FROM {C}) SELECT customer_id, CAST(CASE WHEN balance IS NULL THEN NULL ELSE least(greatest(ceil((balance - lo) / ((hi - lo) / 10)), 1), 10) END AS BIGINT) AS bin FROM {C}, b")
def generalise_bins(spark: S, d: str) -> DataFrame:
    df = customers(spark, d).select("customer_id", "balance")
    b = df.agg(F.min("balance").alias("lo"), F.max("balance").alias("hi"))
    return df.crossJoin(F.broadcast(b)).select("customer_id", policy.bin_of(F.col("balance"), F.col("lo"), F.col("hi")).alias("bin"))


@query("infer_pii_values", f"""SELECT * FROM (SELECT 'email' AS column_name, round(avg(CAST(regexp_full_match(email, '[^@ ]+@[^@ ]+[.][^@ ]+') AS INT)), 6) AS share, 'INFERRED:EMAIL' AS tag FROM {C} WHERE email IS NOT NULL
UNION ALL SELECT 'contact', round(avg(CAST(regexp_full_match(contact, '[+]?[0-9]{{7,19}}') AS INT)), 6), 'INFERRED:PHONE' FROM {C} UNION ALL SELECT 'born', round(avg(CAST(try_strptime(born, '%Y-%m-%d') IS NOT NULL AS INT)), 6), NULL FROM {C})""")
def infer_pii_values(spark: S, d: str) -> DataFrame:
    v = policy.value_signals(customers(spark, d), ["email", "contact", "born"])
    share = F.when(F.col("column_name") == "email", F.col("emails")).when(F.col("column_name") == "contact", F.col("phones")).otherwise(F.col("dates"))
    return rounded(v.select("column_name", share.alias("share"), "tag"))


# Joins


@query("parent_context", f"SELECT o.order_id, o.customer_id, c.mktsegment AS __ctx__mktsegment, c.acctbal AS __ctx__acctbal FROM {O} o LEFT JOIN {sql('customer')} c USING (customer_id)")
def parent_context(spark: S, d: str) -> DataFrame:
    return joins.parent_context(load(spark, d, "orders").select("order_id", "customer_id"), load(spark, d, "customer"), ["customer_id"], ["mktsegment", "acctbal"])


@query("child_counts_zero_filled", f"SELECT c.customer_id, coalesce(n, 0) AS degree FROM {sql('customer')} c LEFT JOIN (SELECT customer_id, count(*) AS n FROM {O} GROUP BY 1) USING (customer_id)")
def child_counts_zero_filled(spark: S, d: str) -> DataFrame:
    return joins.child_counts(load(spark, d, "customer").select("customer_id"), load(spark, d, "orders"), ["customer_id"])


@query("composite_counts", f"SELECT part_id, supplier_id, count(*) AS n, coalesce(any_value(m), 0) AS degree FROM {L} LEFT JOIN (SELECT part_id, supplier_id, count(*) AS m FROM {L} WHERE returnflag = 'R' GROUP BY 1, 2) USING (part_id, supplier_id) GROUP BY 1, 2")
def composite_counts(spark: S, d: str) -> DataFrame:
    li = load(spark, d, "lineitem")
    k = ["part_id", "supplier_id"]
    return joins.child_counts(li.groupBy(*k).agg(F.count("*").alias("n")), li.filter("returnflag = 'R'"), k)


@query("degree_expand", f"SELECT customer_id, n AS degree, unnest(range(1, n + 1)) AS child_index FROM (SELECT customer_id, count(*) AS n FROM {O} GROUP BY 1)")
def degree_expand(spark: S, d: str) -> DataFrame:
    return joins.expand(joins.child_counts(load(spark, d, "customer").select("customer_id"), load(spark, d, "orders"), ["customer_id"]), "degree")


@query("bridged_fk", f"SELECT l.order_id, l.linenumber, o.customer_id FROM {L} l JOIN {O} o USING (order_id)")
def bridged_fk(spark: S, d: str) -> DataFrame:
    child = load(spark, d, "lineitem").select("order_id", "linenumber").join(load(spark, d, "orders").select("order_id", F.col("customer_id").alias("__parent_customer")), "order_id")
    return joins.bridged(child, {"customer_id": "__parent_customer"}).drop("__parent_customer")


@query("independent_fk", f"WITH p AS (SELECT customer_id, row_number() OVER (ORDER BY customer_id) - 1 AS i, count(*) OVER () AS n FROM {sql('customer')}), o AS (SELECT order_id, {rng.uniform_sql(7, 'fk', 'order_id')} AS u FROM {O}) SELECT o.order_id, p.customer_id AS random_customer FROM o JOIN p ON p.i = CAST(floor(o.u * p.n) AS BIGINT)")
def independent_fk(spark: S, d: str) -> DataFrame:
    return joins.random_parent(load(spark, d, "orders").select("order_id"), F.col("order_id"), load(spark, d, "customer"), "customer_id", 7, "fk", "random_customer")


@query("path_agreement", f"SELECT count(*) AS n_joined, round(avg(CAST(CASE WHEN o.order_id % 200 = 0 THEN o.customer_id + 1 ELSE o.customer_id END <> o.customer_id AS INT)), 6) AS mismatch, CASE WHEN avg(CAST(o.order_id % 200 = 0 AS INT)) <= 0.01 THEN 'PASS' ELSE 'WARN' END AS status FROM {L} l JOIN {O} o USING (order_id)")
def path_agreement(spark: S, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("order_id", "customer_id")
    child = load(spark, d, "lineitem").select("order_id").join(o, "order_id").withColumn("customer_id", F.when(F.col("order_id") % 200 == 0, F.col("customer_id") + 1).otherwise(F.col("customer_id")))
    return rounded(joins.path_agreement(child, o, "order_id", "customer_id"))


@query("holdout_split", f"WITH c AS (SELECT customer_id, {rng.uniform_sql(13, 'holdout:customer', 'customer_id')} < 0.25 AS t FROM {sql('customer')}) SELECT o.order_id, CASE WHEN c.t THEN 'test' ELSE 'train' END AS part FROM {O} o JOIN c USING (customer_id)")
def holdout_split(spark: S, d: str) -> DataFrame:
    t = {n: load(spark, d, n) for n in ("customer", "orders")}
    s = joins.holdout(t, {"customer": "customer_id"}, [("orders", "customer_id", "customer", "customer_id")])["orders"]
    return s[0].select("order_id", F.lit("train").alias("part")).unionByName(s[1].select("order_id", F.lit("test").alias("part")))


@query("row_overlap", f"WITH r AS (SELECT DISTINCT status, priority FROM {O} WHERE order_id % 2 = 0 AND priority <> '1-URGENT'), s AS (SELECT status, priority FROM {O} WHERE order_id % 2 = 1) SELECT count(*) AS n_rows, count(r.status) AS n_copied, round(count(r.status) / CAST(count(*) AS DOUBLE), 6) AS copied FROM s LEFT JOIN r ON s.status = r.status AND s.priority = r.priority")
def row_overlap(spark: S, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    return rounded(joins.row_copies(o.filter("order_id % 2 = 0 and priority <> '1-URGENT'"), o.filter("order_id % 2 = 1"), ["status", "priority"]))


@query("value_leak", f"WITH r AS (SELECT DISTINCT customer_id AS v FROM {O} WHERE order_id % 2 = 0), s AS (SELECT customer_id AS v, count(*) AS n FROM {O} WHERE order_id % 2 = 1 GROUP BY 1) SELECT count(r.v) AS n_real, count(s.v) AS n_synth, count(*) FILTER (WHERE r.v IS NOT NULL AND s.v IS NOT NULL) AS n_shared, round(sum(CASE WHEN r.v IS NOT NULL THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 6) AS leak FROM r FULL JOIN s ON r.v = s.v")
def value_leak(spark: S, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    return rounded(joins.value_overlap(o.filter("order_id % 2 = 0"), o.filter("order_id % 2 = 1"), "customer_id"))


@query("context_ranking", f"SELECT mktsegment, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0 AS rank, round(m, 6) AS median FROM (SELECT mktsegment, quantile_cont(acctbal, 0.5) AS m FROM {sql('customer')} GROUP BY 1)")
def context_ranking(spark: S, d: str) -> DataFrame:
    return rounded(agg.median_ranks(load(spark, d, "customer"), "mktsegment", "acctbal"))


@query("cross_table_profile", f"SELECT c.mktsegment, round(quantile_cont(o.totalprice, 0.5), 6) AS median, count(*) AS n FROM {O} o JOIN {sql('customer')} c USING (customer_id) GROUP BY 1")
def cross_table_profile(spark: S, d: str) -> DataFrame:
    j = load(spark, d, "orders").join(load(spark, d, "customer").select("customer_id", "mktsegment"), "customer_id")
    return rounded(j.groupBy("mktsegment").agg(F.percentile("totalprice", 0.5).alias("median"), F.count("*").alias("n")))


_URGENT = f"(SELECT customer_id FROM {O} WHERE priority = '1-URGENT')"


@query("set_difference", f"SELECT DISTINCT customer_id FROM {sql('customer')} WHERE customer_id NOT IN {_URGENT}")
def set_difference(spark: S, d: str) -> DataFrame:
    """Customers without urgent orders."""
    urgent = load(spark, d, "orders").filter("priority = '1-URGENT'")
    return load(spark, d, "customer").select("customer_id").distinct().join(urgent, "customer_id", "left_anti")


@query("set_intersection", f"SELECT customer_id FROM {sql('customer')} INTERSECT SELECT * FROM {_URGENT}")
def set_intersection(spark: S, d: str) -> DataFrame:
    """Customers with urgent orders."""
    urgent = load(spark, d, "orders").filter("priority = '1-URGENT'")
    return load(spark, d, "customer").select("customer_id").intersect(urgent.select("customer_id"))


@query("tables_round_trip", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n, sum({k}) AS keys FROM {sql(t)}" for t, k in (("customer", "customer_id"), ("orders", "order_id"), ("nation", "nation_id"))))
def tables_round_trip(spark: S, d: str) -> DataFrame:
    """IO1, IO3, IO4: tables written as Parquet and CSV, read back by their suffixes, and counted."""
    import uuid

    from tessera.sources import tables as io

    at, keys_of = f"{io.shared_dir(spark)}/tables-{uuid.uuid4().hex}", {"customer": "customer_id", "orders": "order_id", "nation": "nation_id"}
    io.write_tables({t: load(spark, d, t) for t in ("customer", "orders")}, at)
    io.write_tables({"nation": load(spark, d, "nation")}, at, "csv")
    back = io.load_tables(spark, at, list(keys_of))
    rows = [back[t].agg(F.lit(t).alias("table_name"), F.count("*").alias("n"), F.sum(k).alias("keys")) for t, k in keys_of.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("hash_sample", f"SELECT order_id FROM {O} ORDER BY md5(concat_ws('|', '5', 'sample', CAST(order_id AS VARCHAR))), order_id LIMIT 500")
def hash_sample(spark: S, d: str) -> DataFrame:
    """A sampling operator: the 500 rows are its feature."""
    return joins.hash_sample(load(spark, d, "orders"), 500, 5, "order_id").select("order_id")


@query("stratified_split", f"SELECT order_id, CASE WHEN percent_rank() OVER (PARTITION BY status ORDER BY {rng.uniform_sql(3, 'split', 'order_id')}, order_id) < 0.7 THEN 'train' ELSE 'test' END AS part FROM {O}")
def stratified_split(spark: S, d: str) -> DataFrame:
    return joins.stratified_split(load(spark, d, "orders"), "status", 0.7, 3, "order_id").select("order_id", "part")


# Aggregates


def _agg(spark: S, d: str, columns: list[str], **on) -> DataFrame:
    off = {"mean": False, "std": False, "sum": False, "na_ratio": False, "k_first": 0, "k_last": 0, "end_start_diff": False, "increase_ratio": False, "most_columns": 100}
    return rounded(agg.aggregate(load(spark, d, "events").withColumn("value", F.when(F.col("event_id") % 10 != 0, F.col("value"))), ["user_id"], columns, agg.AggregationConfig(**(off | on))))


_EV = f"(SELECT * REPLACE (CASE WHEN event_id % 10 <> 0 THEN value END AS value) FROM {E})"
_N = 'count(*) AS "count"'


@query("agg_mean_std_sum", f"SELECT user_id, {_N}, round(avg(value), 6) AS value__mean, round(stddev_pop(value), 6) AS value__std, round(sum(value), 6) AS value__sum FROM {_EV} GROUP BY 1")
def agg_mean_std_sum(spark: S, d: str) -> DataFrame:
    return _agg(spark, d, ["value"], mean=True, std=True, sum=True)


@query("agg_log", f"SELECT user_id, {_N}, round(avg(ln(1 + greatest(value, 0))), 6) AS value__log_mean, round(stddev_pop(ln(1 + greatest(value, 0))), 6) AS value__log_std FROM {_EV} GROUP BY 1")
def agg_log(spark: S, d: str) -> DataFrame:
    return _agg(spark, d, ["value"], log_mean=True, log_std=True)


@query("agg_skew_kurt", f"SELECT event_type, {_N}, round(skewness(value), 5) AS value__skew, round(kurtosis(value), 5) AS value__kurt FROM {_EV} GROUP BY 1")
def agg_skew_kurt(spark: S, d: str) -> DataFrame:
    df = load(spark, d, "events").withColumn("value", F.when(F.col("event_id") % 10 != 0, F.col("value")))
    c = agg.AggregationConfig(mean=False, std=False, sum=False, na_ratio=False, k_first=0, k_last=0, skew=True, kurt=True)
    return rounded(agg.aggregate(df, ["event_type"], ["value"], c), 5)


@query("agg_quantiles", f"SELECT user_id, {_N}, round(quantile_cont(value, 0.25), 6) AS value__q25, round(quantile_cont(value, 0.9), 6) AS value__q90 FROM {_EV} GROUP BY 1")
def agg_quantiles(spark: S, d: str) -> DataFrame:
    return _agg(spark, d, ["value"], quantiles=(0.25, 0.9))


@query("agg_na_unique", f"SELECT user_id, {_N}, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 6) AS value__na_ratio, round(count(DISTINCT value) / CAST(count(*) AS DOUBLE), 6) AS value__unique_ratio FROM {_EV} GROUP BY 1")
def agg_na_unique(spark: S, d: str) -> DataFrame:
    return _agg(spark, d, ["value"], na_ratio=True, unique_ratio=True)


@query("agg_proportions", f"SELECT user_id, {_N}, round(avg(CAST(event_type = 'click' AS INT)), 6) AS event_type__prop_click, round(avg(CAST(event_type = 'view' AS INT)), 6) AS event_type__prop_view FROM {E} GROUP BY 1")
def agg_proportions(spark: S, d: str) -> DataFrame:
    return _agg(spark, d, ["event_type"], proportions_of=("click", "view"))


@query("agg_n_unique", f"SELECT user_id, {_N}, count(DISTINCT event_type) AS event_type__n_unique FROM {E} GROUP BY 1")
def agg_n_unique(spark: S, d: str) -> DataFrame:
    return _agg(spark, d, ["event_type"], n_unique=True)


@query("agg_topk", f"WITH n AS (SELECT user_id, event_type AS v, count(*) AS n FROM {E} GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, v) AS k FROM n), t AS (SELECT user_id, count(*) AS c FROM {E} GROUP BY 1) SELECT user_id, any_value(c) AS \"count\", max(v) FILTER (WHERE k = 1) AS event_type__top1, max(v) FILTER (WHERE k = 2) AS event_type__top2 FROM r JOIN t USING (user_id) GROUP BY 1")
def agg_topk(spark: S, d: str) -> DataFrame:
    return _agg(spark, d, ["event_type"], k_top=2)


@query("agg_column_cap", f"SELECT user_id, {_N}, round(avg(value), 6) AS value__mean, count(DISTINCT event_type) AS event_type__n_unique, round(stddev_pop(value), 6) AS value__std FROM {_EV} GROUP BY 1")
def agg_column_cap(spark: S, d: str) -> DataFrame:
    return _agg(spark, d, ["value", "event_type"], mean=True, std=True, sum=True, n_unique=True, unique_ratio=False, most_columns=4)


# Windows


_TS = f"""WITH x AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY customer_id) AS n, lag(totalprice) OVER w AS p, lag(totalprice, 2) OVER w AS p2,
  max(totalprice) OVER (PARTITION BY customer_id) AS hi, min(totalprice) OVER (PARTITION BY customer_id) AS lo FROM {O} WINDOW w AS (PARTITION BY customer_id ORDER BY order_date, order_id))
SELECT customer_id, {_N}, """


def _series(spark: S, d: str, columns: list[str], places: int = 6, **on) -> DataFrame:
    off = {"mean": False, "std": False, "sum": False, "na_ratio": False, "k_first": 0, "k_last": 0, "end_start_diff": False, "increase_ratio": False, "most_columns": 100}
    return rounded(agg.aggregate(load(spark, d, "orders"), ["customer_id"], columns, agg.AggregationConfig(**(off | on)), ["order_date"], ["order_id"]), places)


@query("agg_first_last", _TS + "max(totalprice) FILTER (WHERE i = 0) AS totalprice__first1, max(totalprice) FILTER (WHERE i = 1) AS totalprice__first2, max(totalprice) FILTER (WHERE i = n - 1) AS totalprice__last1, max(status) FILTER (WHERE i = 0) AS status__first1, max(status) FILTER (WHERE i = 1) AS status__first2, max(status) FILTER (WHERE i = n - 1) AS status__last1 FROM x GROUP BY 1")
def agg_first_last(spark: S, d: str) -> DataFrame:
    return _series(spark, d, ["totalprice", "status"], k_first=2, k_last=1)


@query("agg_end_start", _TS + "round(CASE WHEN count(*) >= 2 THEN arg_max(totalprice, i) - arg_min(totalprice, i) END, 6) AS totalprice__end_start_diff FROM x GROUP BY 1")
def agg_end_start(spark: S, d: str) -> DataFrame:
    return _series(spark, d, ["totalprice"], end_start_diff=True)


@query("agg_step_ratios", _TS + "round(avg(CAST(totalprice > p AS INT)), 6) AS totalprice__increase_ratio, round(avg(CAST(totalprice < p AS INT)), 6) AS totalprice__decrease_ratio FROM x GROUP BY 1")
def agg_step_ratios(spark: S, d: str) -> DataFrame:
    return _series(spark, d, ["totalprice"], increase_ratio=True, decrease_ratio=True)


@query("agg_monotone", _TS + "min(CAST(totalprice >= p AS DOUBLE)) AS totalprice__is_increasing, min(CAST(totalprice <= p AS DOUBLE)) AS totalprice__is_decreasing FROM x GROUP BY 1")
def agg_monotone(spark: S, d: str) -> DataFrame:
    return _series(spark, d, ["totalprice"], is_increasing=True, is_decreasing=True)


@query("agg_arg_positions", _TS + ", ".join(f"round({f}(CASE WHEN totalprice = {m} THEN i END) / CAST(greatest(max(n) - 1, 1) AS DOUBLE), 6) AS totalprice__{a}_{b}_pos" for a, f in (("first", "min"), ("last", "max")) for b, m in (("max", "hi"), ("min", "lo"))) + " FROM x GROUP BY 1")
def agg_arg_positions(spark: S, d: str) -> DataFrame:
    return _series(spark, d, ["totalprice"], first_max_pos=True, last_max_pos=True, first_min_pos=True, last_min_pos=True)


def _corr_sql(lag: int, p: str) -> str:
    """Zero where the pairs are too few or do not vary."""
    return f"round(CASE WHEN count(*) > {lag} THEN CASE WHEN count({p}) >= 2 AND var_pop(totalprice) FILTER ({p} IS NOT NULL) > 0 AND var_pop({p}) > 0 THEN corr(totalprice, {p}) ELSE 0 END END, 4) AS totalprice__autocorr{lag}"


@query("agg_autocorr", _TS + f"{_corr_sql(1, 'p')}, {_corr_sql(2, 'p2')} FROM x GROUP BY 1")
def agg_autocorr(spark: S, d: str) -> DataFrame:
    return _series(spark, d, ["totalprice"], 4, autocorr_lags=(1, 2))


@query("ts_sort", f"SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM {E}")
def ts_sort(spark: S, d: str) -> DataFrame:
    from pyspark.sql import Window

    df = joins.sort_series(load(spark, d, "events"), ["user_id"], ["ts", "event_id"])
    # the place by where the operator has put each row, not by its columns
    return df.withColumn("at", F.monotonically_increasing_id()).select("event_id", "user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("at")).cast("long").alias("place"))


# Encoding


@query("encode_dictionary", f"WITH n AS (SELECT p_brand AS v, count(*) AS n FROM part GROUP BY 1), r AS (SELECT v, row_number() OVER (ORDER BY n DESC, v) - 1 AS k, count(*) OVER () AS t FROM n) SELECT p_partkey AS part_id, CAST(CASE WHEN t <= 5 OR k < 4 THEN k ELSE 4 END AS DOUBLE) AS brand FROM part JOIN r ON p_brand = v")
def encode_dictionary(spark: S, d: str) -> DataFrame:
    df = load(spark, d, "part")
    return encode.transform(df, encode.fit(df.select("brand"), {"brand": "categorical"}, most_categories=5), keep=["part_id"])


@query("encode_log", f"SELECT order_id, round(ln(1 + greatest(totalprice, 0)), 6) AS totalprice FROM {O}")
def encode_log(spark: S, d: str) -> DataFrame:
    df = load(spark, d, "orders")
    return rounded(df.select("order_id", scalar.log_transform(F.col("totalprice")).alias("totalprice")))


@query("encode_zscore", f"WITH s AS (SELECT quantile_cont(balance, 0.5) AS m, avg(balance) AS a, stddev_pop(balance) AS s FROM {C}) SELECT customer_id, round((coalesce(balance, m) - a) / s.s, 6) AS balance FROM {C}, s")
def encode_zscore(spark: S, d: str) -> DataFrame:
    return rounded(encode.zscore(customers(spark, d).select("customer_id", "balance"), ["balance"]))


@query("decode_round_trip", f"SELECT order_id, status, totalprice, order_date, priority FROM {O}")
def decode_round_trip(spark: S, d: str) -> DataFrame:
    df = load(spark, d, "orders").drop("customer_id")
    specs = [s for s in encode.fit(df) if s.name != "order_id"]
    return encode.inverse_transform(encode.transform(df, specs, keep=["order_id"]), specs, "order_id", 1)


@query("mask_learn", f"WITH v AS (SELECT contact AS v, regexp_replace(contact, '[0-9]', 'D', 'g') AS mask FROM {C}), p AS (SELECT mask, CAST(unnest(range(0, length(v))) AS INT) AS pos, v FROM v) SELECT mask, pos, count(*) AS n, array_to_string(list_sort(list_distinct(list(v[pos + 1]))), '') AS chars FROM p GROUP BY 1, 2")
def mask_learn(spark: S, d: str) -> DataFrame:
    return masks.learn_masks(customers(spark, d), "contact")


@query("placeholder_phone", "SELECT c_custkey AS customer_id, '+60' || lpad(CAST(CAST(floor(" + rng.uniform_sql("s", "contact:n", "c_custkey") + " * 1000000000) AS BIGINT) AS VARCHAR), 9, '0') AS contact FROM customer")
def placeholder_phone(spark: S, d: str) -> DataFrame:
    df = load(spark, d, "customer")
    return df.select("customer_id", scalar.placeholder("phone", "s", "contact", F.col("customer_id")).alias("contact"))


def _offset(table: str, namespace: str) -> int:
    import zlib

    return 100_000_000 + zlib.crc32(f"{table}␟{namespace}".encode()) % 800_000_000


@query("mint_keys", f"SELECT {_offset('orders', 'run1')} + row_number() OVER (ORDER BY md5(concat_ws('|', 'run1', 'key:orders', CAST(order_id AS VARCHAR))), order_id) - 1 AS new_key, order_id FROM {O}")
def mint_keys(spark: S, d: str) -> DataFrame:
    return encode.mint_keys(load(spark, d, "orders").select("order_id"), "order_id", "orders", "run1", "new_key")


# Reports

_EVEN, _ODD = f"(SELECT * FROM {O} WHERE order_id % 2 = 0)", f"(SELECT * FROM {O} WHERE order_id % 3 = 0)"


def _sides(spark: S, d: str) -> tuple[DataFrame, DataFrame]:
    o = load(spark, d, "orders")
    return o.filter("order_id % 2 = 0"), o.filter("order_id % 3 = 0")


def _tvd_sql(c: str) -> str:
    return f"(SELECT 0.5 * sum(abs(coalesce(p, 0) - coalesce(q, 0))) FROM (SELECT {c} AS v, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM {_EVEN} GROUP BY 1) a FULL JOIN (SELECT {c} AS v, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS q FROM {_ODD} GROUP BY 1) b ON a.v = b.v)"


def _qd_sql(c: str) -> str:
    q = "[0.05, 0.25, 0.5, 0.75, 0.95]"
    return f"(SELECT list_avg(list_transform(range(1, 6), lambda i: abs(a.q[i] - b.q[i]))) / a.s FROM (SELECT quantile_cont({c}, {q}) AS q, stddev_samp({c}) AS s FROM {_EVEN}) a, (SELECT quantile_cont({c}, {q}) AS q FROM {_ODD}) b)"


@query("tvd", f"SELECT round({_tvd_sql('priority')}, 6) AS tvd")
def tvd(spark: S, d: str) -> DataFrame:
    return rounded(report.tvd(*_sides(spark, d), "priority"))


@query("quantile_divergence", f"SELECT 'totalprice' AS column_name, round({_qd_sql('totalprice')}, 6) AS divergence, round(greatest(0, 1 - {_qd_sql('totalprice')}), 6) AS score")
def quantile_divergence(spark: S, d: str) -> DataFrame:
    return rounded(report.quantile_divergence(*_sides(spark, d), ["totalprice"]))


_LC = ["quantity", "extendedprice", "discount", "tax"]
_PAIRS = [(a, b) for i, a in enumerate(_LC) for b in _LC[i + 1 :]]


@query("corr_delta", "SELECT round(2 * s / 16, 6) AS delta, round(s / 6, 6) AS off_diagonal FROM (SELECT " + " + ".join(f"abs((SELECT corr({a}, {b}) FROM {L} WHERE order_id % 2 = 0) - (SELECT corr({a}, {b}) FROM {L} WHERE order_id % 3 = 0))" for a, b in _PAIRS) + " AS s)")
def corr_delta(spark: S, d: str) -> DataFrame:
    li = load(spark, d, "lineitem")
    return rounded(report.correlation_delta(li.filter("order_id % 2 = 0"), li.filter("order_id % 3 = 0"), _LC))


@query("cardinality_ratio", "WITH r AS (SELECT avg(n) AS m FROM (SELECT count(*) AS n FROM " + O + " GROUP BY customer_id)), s AS (SELECT avg(n) AS m FROM (SELECT count(*) AS n FROM " + O + " WHERE order_id % 3 <> 0 GROUP BY customer_id)) SELECT round(r.m, 6) AS real_mean, round(s.m, 6) AS synth_mean, round(s.m / r.m, 6) AS ratio, CASE WHEN s.m / r.m BETWEEN 0.75 AND 1.25 THEN 'PASS' ELSE 'WARN' END AS status FROM r, s")
def cardinality_ratio(spark: S, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    return rounded(report.children_ratio(o, o.filter("order_id % 3 <> 0"), ["customer_id"]))


@query("row_copy_rate", f"WITH s AS (SELECT * FROM {L} WHERE order_id % 3 = 0), r AS (SELECT DISTINCT quantity, discount, tax, returnflag, linestatus FROM {L} WHERE order_id % 2 = 0) SELECT count(*) AS n_rows, count(r.quantity) AS n_copied, round(count(r.quantity) / CAST(count(*) AS DOUBLE), 6) AS copied FROM s LEFT JOIN r USING (quantity, discount, tax, returnflag, linestatus)")
def row_copy_rate(spark: S, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").select("order_id", "quantity", "discount", "tax", "returnflag", "linestatus")
    return rounded(report.exact_matches(li.filter("order_id % 2 = 0").drop("order_id"), li.filter("order_id % 3 = 0").drop("order_id")))


@query("fidelity_score", f"SELECT round(((1 - {_tvd_sql('priority')}) + (1 - {_tvd_sql('status')}) + greatest(0, 1 - {_qd_sql('totalprice')})) / 3, 6) AS fidelity")
def fidelity_score(spark: S, d: str) -> DataFrame:
    real, synth = (x.select("status", "priority", "totalprice") for x in _sides(spark, d))
    return rounded(report.fidelity(report.build_report({"orders": real}, {"orders": synth})))
