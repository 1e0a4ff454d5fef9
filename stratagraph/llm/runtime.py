"""What the operators share: written tables, size-checked broadcasts and Arrow text batches."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table of narrow rows that may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 200_000
#: Bytes of an Arrow batch on its way to a Python worker, and of a row group that a task holds while it writes a table.
BATCH_BYTES, GROUP_BYTES = 4 << 20, 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; only a local session without one gets its own."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    context = spark.sparkContext
    if not hasattr(context, "_stratagraph_folder"):
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context._stratagraph_folder = "file://" + tempfile.mkdtemp(prefix="strata-shared-")
    return context._stratagraph_folder


def ship(df: DataFrame) -> None:
    """Lets Python workers import the package: Spark's file server hands them an archive of it, once for a context.

    From then on the session's Arrow batches have about BATCH_BYTES, whatever the length of the texts.
    """
    tidy_driver(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = df.sparkSession.sparkContext
    if getattr(context, "_stratagraph_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="strata-package-"), f"{top.name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(top.rglob("*.py")):
            archive.write(source, str(source.relative_to(top.parent)))
    context.addPyFile(path)
    context._stratagraph_shipped = True


def tidy() -> None:
    """Gives freed memory of a Python worker back to the system; workers stay for later stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy_driver(spark: SparkSession) -> bool:
    """Gives freed memory of the driver's Python and JVM back to the system; whether the JVM could.

    Planning and compiling hundreds of small jobs leaves some 200 MB of freed pieces in the JVM's native
    memory, outside its heap, which the allocator keeps. JVMs without the command go on as they are.
    """
    tidy()
    context = spark.sparkContext
    if getattr(context, "_stratagraph_untrimmed", False):
        return False
    try:
        jvm, new = spark._jvm, context._gateway.new_array
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # through the interface, since the server's own class isn't open to reflection
        kinds = [jvm.java.lang.Class.forName(c) for c in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        types, args = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
        for k, kind in enumerate(kinds):
            types[k] = kind
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", types).invoke(server, args)
    except (Py4JError, TypeError):
        context._stratagraph_untrimmed = True
        return False
    return True


def made(spark: SparkSession) -> list[str]:
    """The folders of the session's intermediate tables, in the order in which they came."""
    return spark.sparkContext.__dict__.setdefault("_stratagraph_cuts", [])


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession, since: int = 0) -> None:
    """Deletes the intermediate tables made since so many of them; nothing that reads them may be used any more."""
    paths = made(spark)
    for path in paths[since:]:
        delete(spark, path)
    del paths[since:]


def cut(df: DataFrame) -> DataFrame:
    """The rows from a table in the shared folder: the lineage ends there, and lost executors lose nothing.

    A table rather than checkpoint(), whose result keeps the constraints of the plan that made it;
    in loops these multiply until planning takes minutes and all of the driver's memory.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/strata/{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", str(GROUP_BYTES)).parquet(path)
    made(spark).append(path)
    tidy_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def cut_few(df: DataFrame, rows: int, rows_each: int = 100_000) -> DataFrame:
    """cut() of a table of at most so many narrow rows, in as many tasks and files as they need."""
    tasks = max(1, -(-rows // rows_each)) * 6
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.coalesce(tasks) if tasks < wanted else df)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if a count shows the (already cut) table to be small; else the table, to be shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_batches(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20):
    """Yields (first row, UTF-8 bytes, row offsets) of runs of rows, each of about max_bytes; null is empty.

    A row longer than max_bytes is a run of its own.
    """
    col = batch.column(batch.schema.get_field_index(column))
    col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.large_binary() if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else pa.large_string()
    col = col.cast(wide)
    n = len(col)
    if not n:
        return
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, side="right")) - 1)
        j = min(j, n)
        yield i, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
