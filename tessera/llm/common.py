"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# freed batches go back to the system, also those that a worker reads before the first call of a function
pa.set_memory_pool(pa.system_memory_pool())

ROOT = Path(__file__).resolve().parents[2]
#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
SPACES = " \t\n\x0b\x0c\r"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers of executors, whose machines need not have what the driver's folder holds."""
    sc = spark.sparkContext
    if sc.master == "local" or sc.master.startswith("local[") or getattr(sc, "_tessera_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(), "tessera.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in (ROOT / "tessera").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(path)
    sc._tessera_shipped = True


def small_batches(spark: SparkSession, most: str = "4m") -> None:
    """From now on a batch for a Python worker ends at some bytes, and not only at 10,000 rows, unless the session already has a bound.

    A batch of whole texts else takes tens of MB, in the JVM and twice in the worker. Only a session's setting reaches a plan that runs later.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, most)


@contextmanager
def large_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of so many rows, whatever their bytes, for what runs inside."""
    records = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = {k: spark.conf.get(k, None) for k in (records, BATCH_BYTES)}
    spark.conf.set(records, str(rows))
    spark.conf.set(BATCH_BYTES, str(2**31 - 1))
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one where that is unset and all is one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir is unset: executors and driver need a folder that they share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage, and lost executors cost nothing but the task at hand."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # what the write has shuffled is of no use after it
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def free(*frames: DataFrame) -> None:
    """Delete tables made by written() that nothing needs any more."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def local_rows(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """A few rows of the driver as a table, by Arrow: from a plain list each executor would start Python workers, of another daemon, and keep them."""
    return spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df lacks."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learnable(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(False))


def hash_sample(df: DataFrame, id_col: str, per_group: int, *groups: str, slots: int = 16) -> DataFrame:
    """At most about per_group rows of each group, those of smallest id hash in each of some slots.

    The rank filter becomes a per-task group limit before the shuffle, and the slots keep a frequent group off one task.
    """
    from pyspark.sql import Window

    slots = min(slots, per_group)
    h, s = unused(df, "_h"), unused(df, "_s")
    r = unused(df, "_r")
    out = df.withColumn(h, F.xxhash64(F.col(id_col).cast("string"))).withColumn(s, F.pmod(F.col(h), F.lit(slots)))
    w = Window.partitionBy(*groups, s).orderBy(h, id_col)
    return out.withColumn(r, F.row_number().over(w)).filter(F.col(r) <= -(-per_group // slots)).drop(h, s, r)


def map_rows(df: DataFrame, fn: Callable[[dict[str, pa.Array]], pa.RecordBatch | None], schema: str, rows: int = 512, release: bool = False) -> DataFrame:
    """fn over Arrow batches of at most some rows. release: a worker gives up its held() tables after each task, not when others are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean(release):
            for b in batches:
                for lo in range(0, b.num_rows, rows):
                    part = b.slice(lo, rows)
                    if (out := fn({n: part.column(i) for i, n in enumerate(part.schema.names)})) is not None:
                        yield out
            b = part = out = None  # else the last batch outlives the trim

    return df.mapInArrow(run, schema)


@contextmanager
def lean(release: bool = False) -> Iterator[None]:
    """Around a task's work in a Python worker: what it frees goes back to the system, since workers stay for the tasks of later stages.

    release: held() tables go too. Spark takes its idle workers in turn, so in time each of them would hold a copy.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        yield
    finally:
        if release:
            _held.clear()
        _trim()


def _trim() -> None:
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_held: dict = {}


def held(make: Callable, *args):
    """make(*args), kept in this process until another operator's tables are asked for: a worker holds those of one at a time."""
    key = (make, *args)
    if key not in _held:
        _held.clear()
        _trim()
        _held[key] = make(*args)
    return _held[key]


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def batch(**cols) -> pa.RecordBatch:
    arrays = {k: v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for k, v in cols.items()}
    return pa.RecordBatch.from_pydict(arrays)


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and each row's bounds in them; nulls are empty."""
    text = text.fill_null("").cast(pa.large_binary()) if text.null_count else text.cast(pa.large_binary())
    _, off, data = text.buffers()
    o = np.frombuffer(off, np.int64)[text.offset : text.offset + len(text) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), o


def by_bytes(b: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most some bytes in a column; a longer value is a slice of its own."""
    sizes = pa.compute.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    lo = 0
    while lo < b.num_rows:
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + most, "right")) - 1)
        yield b.slice(lo, hi - lo)
        lo = hi


def strings(values: list[bytes | None]) -> pa.Array:
    """A string column of bytes that are taken for UTF-8 as they are."""
    _, off, data = pa.array(values, pa.binary()).buffers()[:3]
    valid = None if None not in values else pa.array([v is not None for v in values]).buffers()[1]
    return pa.StringArray.from_buffers(len(values), off, data, valid)


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """A public vocabulary file; folder is a parameter and the files are never copied."""
    folder = folder or os.environ.get("TOKENIZERS_DIR")
    if folder:
        return os.path.join(folder, name)
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


assert sys.version_info >= (3, 9)
