"""Scans and sinks of related tables."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Reader options that a configuration may name, and Spark's own names.
CSV_OPTIONS = {"delimiter": "sep", "na_values": "nullValue", "quotechar": "quote", "escapechar": "escape", "comment": "comment", "encoding": "encoding", "lineterminator": "lineSep", "skipinitialspace": "ignoreLeadingWhiteSpace", "header": "header", "date_format": "dateFormat"}
_BAD_LINES = {"error": "FAILFAST", "skip": "DROPMALFORMED", "warn": "PERMISSIVE"}


def csv_options(config: dict) -> dict[str, str]:
    """IO12: the reader options of a configuration; what Spark has no word for is left out."""
    out = {CSV_OPTIONS[k]: str(v) for k, v in config.items() if k in CSV_OPTIONS and v is not None}
    if config.get("on_bad_lines"):
        out["mode"] = _BAD_LINES[config["on_bad_lines"]]
    return out


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a temporary folder only where it is unset and all is one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir is unset: executors and driver need a folder that they share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def settled(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: later steps read it, and lost executors cost no more than the task at hand."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_table(spark: SparkSession, path: str, options: dict | None = None) -> DataFrame | None:
    """IO3: a Parquet or CSV file by its suffix; None for any other or a missing one."""
    if not exists(spark, path):
        return None
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".csv"):
        return spark.read.options(**{"header": "true", "inferSchema": "true"} | csv_options(options or {})).csv(path)
    return None


def load_tables(spark: SparkSession, folder: str, names: list[str], options: dict | None = None) -> dict[str, DataFrame]:
    """IO1: each table from <name>.parquet, else <name>.csv; FileNotFoundError where there is neither."""
    out = {}
    for n in names:
        df = read_table(spark, f"{folder}/{n}.parquet")
        out[n] = df if df is not None else read_table(spark, f"{folder}/{n}.csv", options)
        if out[n] is None:
            raise FileNotFoundError(f"{folder}/{n}.parquet or .csv")
    return out


def write_tables(tables: dict[str, DataFrame], folder: str, kind: str = "parquet") -> list[dict]:
    """IO4: each table as a folder of Parquet or CSV parts, and a manifest of rows, columns and bytes.

    Rows are counted in what was written: a Parquet table's from its footers, a CSV table's by a scan. An observation would count them on
    the way, but it leaves a manager in the session that forest models then drag into their closures, which cannot be serialised.
    """
    out = []
    for name, df in tables.items():
        path = f"{folder}/{name}.{kind}"
        w, spark = df.write.mode("overwrite"), df.sparkSession
        w.option("header", "true").csv(path) if kind == "csv" else w.parquet(path)
        back = spark.read.schema(df.schema)
        rows = back.options(header="true", multiLine="true").csv(path).count() if kind == "csv" else back.parquet(path).count()
        out.append({"table": name, "path": path, "rows": rows, "columns": len(df.columns), "bytes": size_of(spark, path)})
    return out


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def export_one(df: DataFrame, path: str) -> int:
    """IO5: one CSV file with a header, for tables meant to be downloaded; returns its bytes.

    All tasks write parts without a header, and the file system appends them to one file, in order of their names.
    """
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    parts = path + ".parts"
    df.write.mode("overwrite").option("header", "false").csv(parts)
    folder, target = hadoop.fs.Path(parts), hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    out = fs.create(target, True)
    try:
        out.write(bytearray((",".join('"' + c.replace('"', '""') + '"' for c in df.columns) + "\n").encode()))
        for f in sorted(str(s.getPath().getName()) for s in fs.listStatus(folder) if str(s.getPath().getName()).startswith("part-")):
            part = fs.open(hadoop.fs.Path(folder, f))
            hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            part.close()
    finally:
        out.close()
    fs.delete(folder, True)
    return size_of(spark, path)


def preview(df: DataFrame, limit: int, *order: str) -> DataFrame:
    """IO6: the first rows of an order, with how many there are in all."""
    total = df.agg(F.count("*").alias("total_rows"))
    return df.orderBy(*order).limit(limit).crossJoin(F.broadcast(total))


def split_tags(c) -> F.Column:
    """tags of a text, split at the first of ; | , that it has, upper-cased, empty ones left out."""
    by = lambda s: F.split(c, s)
    parts = F.when(c.contains(";"), by(";")).when(c.contains("|"), by("\\|")).otherwise(by(","))
    return F.filter(F.transform(parts, lambda t: F.upper(F.trim(t))), lambda t: t != "")


def catalog_from_csv(spark: SparkSession, path: str) -> DataFrame:
    """IO7: (table, column, tags, terms, description) of a classification file."""
    d = spark.read.option("header", "true").csv(path)
    none = F.array().cast("array<string>")
    return d.select("table", "column", F.coalesce(split_tags(F.col("classifications")), none).alias("tags"), F.coalesce(split_tags(F.col("terms")), none).alias("terms"), "description")


def catalog_from_json(spark: SparkSession, text: str) -> DataFrame:
    """IO7: the same from JSON: nested entities with typeName and attributes, or {table: {column: {classifications}}}."""
    rows = []

    def tags(x) -> list[str]:
        return [str(c.get("typeName", "") if isinstance(c, dict) else c).upper() for c in x or []]

    def walk(v) -> None:
        if isinstance(v, list):
            for x in v:
                walk(x)
        elif isinstance(v, dict):
            if "column" in str(v.get("typeName", "")).lower() and isinstance(v.get("attributes"), dict):
                parts = str(v["attributes"].get("qualifiedName", "")).split("@")[0].split(".")
                rows.append((parts[-2] if len(parts) > 1 else "", v["attributes"].get("name", parts[-1]), tags(v.get("classifications")), [], v["attributes"].get("description")))
            for x in v.values():
                walk(x)

    data = json.loads(text)
    walk(data)
    if not rows:
        for t, cols in (data.get("tables", data) if isinstance(data, dict) else {}).items():
            cols = cols.get("columns", cols) if isinstance(cols, dict) else {}
            for c, x in cols.items() if isinstance(cols, dict) else ((y.get("name"), y) for y in cols):
                rows.append((t, c, tags(x.get("classifications") if isinstance(x, dict) else x), [], x.get("description") if isinstance(x, dict) else None))
    return spark.createDataFrame(rows, "table string, column string, tags array<string>, terms array<string>, description string")
