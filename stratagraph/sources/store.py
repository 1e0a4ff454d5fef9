"""Snapshots as Parquet, published by a manifest.

A snapshot's tables are written first and its manifest row last: readers take only ids whose newest
row says `ready`, so a half-written snapshot is never seen. Manifest rows are small appended files,
whose numbers, like the snapshots', are claimed by creating a file of that name: of two writers one
gets the next number.

A snapshot is a version and the deltas after it. A delta has the files that changed and the rows that
are read from them again; it costs what has changed, not what the snapshot holds. Readers put both
together: a row is gone if a later delta changed the file of its node (an edge's is that of its source),
and of rows with one key the latest counts. compact() writes a version without deltas.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph import model
from stratagraph.plans.graph import Graph, graph_of


MANIFEST = f"seq long, version long, deltas string, {model.SNAPSHOTS}"
KEYS = {"nodes": "node_id", "edges": "edge_id", "evidence": "evidence_id", "observations": "observation_id"}


def merged_layers(layers: dict[str, DataFrame], changed: DataFrame) -> dict[str, DataFrame]:
    """Tables of rows with a layer, without what later layers changed; changed: (__f, gone), the last layer in which a file changed."""
    nodes = layers["nodes"].join(changed, F.col("file_path") == F.col("__f"), "left").drop("__f")
    old = F.col("layer") < F.coalesce("gone", F.lit(0))
    lost = nodes.filter(old).groupBy(F.col("node_id").alias("__n")).agg(F.max("gone").alias("gone"))

    def latest(df: DataFrame, key: str) -> DataFrame:
        rest = [c for c in df.columns if c not in (key, "layer", "gone")]
        return df.groupBy(key).agg(F.max_by(F.struct(*rest), "layer").alias("r")).select(key, "r.*")

    def kept(name: str, end: str) -> DataFrame:
        return layers[name].join(lost, F.col(end) == F.col("__n"), "left").filter(~old).drop("__n", "gone")

    edges = kept("edges", "src_node_id")
    # evidence goes with its edge, if that is known, or its node
    gone = layers["edges"].join(lost, F.col("src_node_id") == F.col("__n"), "left").filter(old).groupBy(F.col("edge_id").alias("__e")).agg(F.max("gone").alias("gone"))
    evidence = kept("evidence", "node_id").join(gone, F.col("edge_id") == F.col("__e"), "left").filter(~old).drop("__e", "gone")
    out = {"nodes": nodes.filter(~old).drop("gone"), "edges": edges, "evidence": evidence, "observations": kept("observations", "node_id")}
    return {name: latest(df, KEYS[name]) for name, df in out.items()}


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, table: str, snapshot_id: int, version: int | str) -> str:
        return f"{self.root}/{table}/snapshot_id={snapshot_id}/version={version}"

    def _claim(self, kind: str, least: int) -> int:
        """The first number from `least` on that nobody has claimed."""
        jvm = self.spark._jvm
        while True:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/claims/{kind}-{least}")
            if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).createNewFile(path):
                return least
            least += 1

    def manifest(self) -> DataFrame:
        """All manifest rows, oldest first in `seq`."""
        schema = MANIFEST
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/manifest")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def current(self) -> DataFrame:
        """The newest row of each snapshot."""
        m = self.manifest()
        return m.groupBy("snapshot_id").agg(F.max_by(F.struct(*(c for c in m.columns if c != "snapshot_id")), "seq").alias("r")).select("snapshot_id", "r.*")

    def _append(self, row: dict) -> None:
        seq = self._claim("row", (self.manifest().agg(F.max("seq")).first()[0] or 0) + 1)
        schema = MANIFEST
        values = {"seq": seq} | row
        self.spark.createDataFrame([tuple(values.get(n) for n in model.names_of(schema))], schema).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def begin(self, workspace_root: str, compile_db_hash: str, parser_version: str, **more: str) -> int:
        snapshot_id = self._claim("snapshot", (self.manifest().agg(F.max("snapshot_id")).first()[0] or 0) + 1)
        self._append({"version": 0, "snapshot_id": snapshot_id, "workspace_root": workspace_root, "compile_db_hash": compile_db_hash, "parser_version": parser_version, "status": "building", "created_at": datetime.now(UTC), "fingerprint": f"{workspace_root}:{compile_db_hash}:{parser_version}"} | more)
        return snapshot_id

    def _row(self, snapshot_id: int) -> dict:
        row = self.current().filter(F.col("snapshot_id") == snapshot_id).first()
        if row is None:
            raise KeyError(f"no snapshot {snapshot_id}")
        return {k: v for k, v in row.asDict().items() if k != "seq"}

    def commit(self, snapshot_id: int, version: int | None = None, deltas: list[str] | None = None) -> None:
        """Shows a version of the snapshot, with the deltas after it."""
        row = self._row(snapshot_id)
        self._append(row | {"status": "ready", "ready_at": datetime.now(UTC), "version": row["version"] if version is None else version, "deltas": ",".join(deltas) if deltas else None})

    def fail(self, snapshot_id: int, reason: str) -> None:
        self._append(self._row(snapshot_id) | {"status": "failed", "failed_at": datetime.now(UTC), "fail_reason": reason})

    def latest_ready(self, workspace_root: str) -> int | None:
        return self.current().filter((F.col("status") == "ready") & (F.col("workspace_root") == workspace_root)).agg(F.max("snapshot_id")).first()[0]

    def _put(self, name: str, df: DataFrame | None, path: str) -> None:
        ddl = model.TABLES[name]
        df = self.spark.createDataFrame([], ddl) if df is None else df
        have = {f.name for f in df.schema}
        typed = [(F.col(f"`{part.split()[0]}`") if part.split()[0] in have else F.lit(None)).cast(part.split(None, 1)[1]).alias(part.split()[0]) for part in ddl.split(", ") if not part.startswith("snapshot_id ")]
        df.select(*typed).write.mode("overwrite").parquet(path)

    def write(self, snapshot_id: int, tables: dict[str, DataFrame]) -> int:
        """Writes a new version of the snapshot's tables; commit() shows it."""
        version = self._row(snapshot_id)["version"] + 1
        for name in model.TABLES:
            self._put(name, tables.get(name), self._path(name, snapshot_id, version))
        return version

    def add_delta(self, snapshot_id: int, batch: str, changed: DataFrame, tables: dict[str, DataFrame]) -> bool:
        """Writes a delta and shows it: the changed files (file_path) and the rows that are now theirs. A batch that the snapshot has is left alone: False."""
        row = self._row(snapshot_id)
        before = (row["deltas"] or "").split(",") if row["deltas"] else []
        if batch in before:
            return False
        changed.select("file_path").distinct().write.mode("overwrite").parquet(self._path("changed", snapshot_id, f"{row['version']}-{batch}"))
        for name in model.TABLES:
            self._put(name, tables.get(name), self._path(name, snapshot_id, f"{row['version']}-{batch}"))
        self.commit(snapshot_id, deltas=[*before, batch])
        return True

    def compact(self, snapshot_id: int) -> int:
        """The snapshot as a version without deltas."""
        version = self.write(snapshot_id, self.tables(snapshot_id))
        self.commit(snapshot_id, version)
        return version

    def tables(self, snapshot_id: int) -> dict[str, DataFrame]:
        """The snapshot's tables as last committed; empty ones for a snapshot that isn't ready."""
        row = self.current().filter(F.col("snapshot_id") == snapshot_id).first()
        if row is None or row["status"] != "ready" or not row["version"]:
            return {name: self.spark.createDataFrame([], ddl) for name, ddl in model.TABLES.items()}
        deltas = row["deltas"].split(",") if row["deltas"] else []
        read = lambda name, version: self.spark.read.schema(", ".join(p for p in model.TABLES[name].split(", ") if not p.startswith("snapshot_id "))).parquet(self._path(name, snapshot_id, version))
        if not deltas:
            out = {name: read(name, row["version"]) for name in model.TABLES}
        else:
            layers = {name: self._layers([read(name, v) for v in (row["version"], *(f"{row['version']}-{d}" for d in deltas))]) for name in model.TABLES}
            changed = self._layers([self.spark.read.schema("file_path string").parquet(self._path("changed", snapshot_id, f"{row['version']}-{d}")) for d in deltas], 1).groupBy(F.col("file_path").alias("__f")).agg(F.max("layer").alias("gone"))
            out = merged_layers(layers, changed)
        return {name: df.withColumn("snapshot_id", F.lit(snapshot_id).cast("long")) for name, df in out.items()}

    @staticmethod
    def _layers(frames: list[DataFrame], first: int = 0) -> DataFrame:
        out = None
        for k, df in enumerate(frames, first):
            df = df.withColumn("layer", F.lit(k))
            out = df if out is None else out.unionByName(df)
        return out

    def graph(self, snapshot_id: int) -> Graph:
        t = self.tables(snapshot_id)
        return graph_of(t["nodes"].drop("snapshot_id"), t["edges"].drop("snapshot_id"), t["observations"].drop("snapshot_id"))
