"""The relational tables under names that key discovery understands, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Table: {column: source column}.
VIEWS = {
    "region": {"region_id": "r_regionkey", "name": "r_name"},
    "nation": {"nation_id": "n_nationkey", "name": "n_name", "region_id": "n_regionkey"},
    "customer": {"customer_id": "c_custkey", "name": "c_name", "nation_id": "c_nationkey", "acctbal": "c_acctbal", "mktsegment": "c_mktsegment"},
    "supplier": {"supplier_id": "s_suppkey", "name": "s_name", "nation_id": "s_nationkey", "acctbal": "s_acctbal"},
    "part": {"part_id": "p_partkey", "name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size", "retailprice": "p_retailprice"},
    "orders": {"order_id": "o_orderkey", "customer_id": "o_custkey", "status": "o_orderstatus", "totalprice": "o_totalprice", "order_date": "o_orderdate", "priority": "o_orderpriority"},
    "lineitem": {"order_id": "l_orderkey", "part_id": "l_partkey", "supplier_id": "l_suppkey", "linenumber": "l_linenumber", "quantity": "l_quantity", "extendedprice": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "returnflag": "l_returnflag", "linestatus": "l_linestatus", "ship_date": "l_shipdate"},
    "events": {"event_id": "event_id", "ts": "ts", "user_id": "user_id", "event_type": "event_type", "value": "value", "props": "props"},
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return raw.select(*[F.col(s).alias(c) for c, s in VIEWS[name].items()])


def sql(name: str) -> str:
    """The view as a subquery."""
    return "(SELECT " + ", ".join(f"{s} AS {c}" for c, s in VIEWS[name].items()) + f" FROM {name})"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the columns that protection and profiling need: nulls, contacts, a copy and a near copy."""
    c = load(spark, sf_dir, "customer")
    k = F.col("customer_id")
    return c.withColumns(
        {
            "balance": F.when(k % 7 != 0, F.col("acctbal")),
            "email": F.when(k % 11 != 0, F.concat(F.lit("user"), k.cast("string"), F.lit("@example.com"))),
            "contact": F.concat(F.lit("+60"), F.lpad((k * 7919 % 1000000000).cast("string"), 9, "0")),
            "born": F.concat((1950 + k % 50).cast("string"), F.lit("-"), F.lpad((1 + k % 12).cast("string"), 2, "0"), F.lit("-"), F.lpad((1 + k % 28).cast("string"), 2, "0")),
            "segment": F.col("mktsegment"),
            "segment_alt": F.when(k % 50 == 0, F.lit("?")).otherwise(F.lower("mktsegment")),
        }
    )


CUSTOMERS_SQL = f"""(SELECT *, CASE WHEN customer_id % 7 <> 0 THEN acctbal END AS balance,
  CASE WHEN customer_id % 11 <> 0 THEN 'user' || CAST(customer_id AS VARCHAR) || '@example.com' END AS email,
  '+60' || lpad(CAST(customer_id * 7919 % 1000000000 AS VARCHAR), 9, '0') AS contact,
  CAST(1950 + customer_id % 50 AS VARCHAR) || '-' || lpad(CAST(1 + customer_id % 12 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + customer_id % 28 AS VARCHAR), 2, '0') AS born,
  mktsegment AS segment, CASE WHEN customer_id % 50 = 0 THEN '?' ELSE lower(mktsegment) END AS segment_alt
  FROM {sql('customer')})"""


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to some places, so that the last bits of sums do not show; -0 as 0."""
    return df.select(*[(F.round(F.col(f"`{c}`"), places) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])
