"""Tables in the folder that a session shares with its executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only a local session without one gets its own."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    context = spark.sparkContext
    if not hasattr(context, "_stratagraph_tables"):
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context._stratagraph_tables = "file://" + tempfile.mkdtemp(prefix="strata-tables-")
    return context._stratagraph_tables


def ship(spark: SparkSession) -> None:
    """Lets Python workers import the package: Spark's file server hands them an archive of it, once for a context."""
    context = spark.sparkContext
    if getattr(context, "_stratagraph_core_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="strata-package-")) / f"{top.name}_core.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(top.rglob("*.py")):
            archive.write(source, str(source.relative_to(top.parent)))
    context.addPyFile(str(path))
    context._stratagraph_core_shipped = True


def made(spark: SparkSession) -> list[str]:
    """The folders of the session's intermediate tables, in the order in which they came."""
    return spark.sparkContext.__dict__.setdefault("_stratagraph_made", [])


def release(spark: SparkSession, since: int = 0) -> None:
    """Deletes the intermediate tables made since so many of them; nothing that reads them may be used any more."""
    paths = made(spark)
    for path in paths[since:]:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    del paths[since:]


def settle(df: DataFrame) -> DataFrame:
    """The rows from a written table, which ends the lineage of an iteration and outlives executors."""
    path = f"{shared_folder(df.sparkSession)}/strata-tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    made(df.sparkSession).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table that may pass through the driver on its way to the next hop of an iteration.
HELD_ROWS = 10_000


def held(df: DataFrame, rows: int = HELD_ROWS) -> DataFrame:
    """The rows without their lineage: of at most so many narrow rows as a local table, or else settled."""
    some = df.limit(rows + 1).toArrow()
    return df.sparkSession.createDataFrame(some, df.schema) if some.num_rows <= rows else settle(df)


def settled_small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """A settled table with a broadcast hint if a count shows it to be small; else it joins by shuffling."""
    out = settle(df)
    return F.broadcast(out) if out.limit(rows + 1).count() <= rows else out
