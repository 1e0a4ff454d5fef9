"""Incremental ingest: file changes and facts as streams.

Changes are debounced per file by an event-time session, whose gap is the debounce; when a session
closes, the file is purged and its new facts are put in. Facts pass a watermark within which repeats
of a canonical key are dropped. Each micro-batch adds a delta to the snapshot, which costs what has
changed; the delta is named by the batch id, so a batch that runs again changes nothing. After many
deltas the snapshot is written whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.operators import ingest
from stratagraph.sources.store import SnapshotStore


def debounced(changes: DataFrame, gap: str = "300 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Changes (file_path, ts) as one row for each burst of a file: file_path, changed (its last change), n."""
    by = changes.withWatermark("ts", late).groupBy("file_path", F.session_window("ts", gap).alias("w"))
    return by.agg(F.max("ts").alias("changed"), F.count(F.lit(1)).alias("n")).select("file_path", "changed", "n")


def unique_facts(facts: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Facts without repeats of a canonical key inside the watermark."""
    return facts.withColumn("fact_key", ingest.canonical_key()).withWatermark(ts, late).dropDuplicatesWithinWatermark(["fact_key"])


def event_counts(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events (ts, event_type, value) by tumbling or sliding window and type; batch or stream."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", window, slide).alias("w"), "event_type")
    return by.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


#: Deltas after which a snapshot is written whole.
MANY_DELTAS = 20


def apply_batch(store: SnapshotStore, snapshot_id: int, changed: DataFrame, facts: DataFrame, batch: str | None = None) -> bool:
    """Purges the changed files (file_path) and puts in the facts' rows, unless the snapshot has the batch already: whether it did."""
    good, _ = ingest.validate(facts)
    return store.add_delta(snapshot_id, batch or uuid.uuid4().hex, changed, ingest.to_rows(ingest.merge(good), snapshot_id))


def sink(store: SnapshotStore, snapshot_id: int, extract: Callable[[DataFrame], DataFrame], query: str = "changes", many: int = MANY_DELTAS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over changes: extract() gives the facts of the changed files. `query` tells streams into one snapshot apart."""

    def write(batch: DataFrame, batch_id: int) -> None:
        changed = batch.select("file_path").distinct()
        if changed.isEmpty() or not apply_batch(store, snapshot_id, changed, extract(changed), f"{query}-{batch_id}"):
            return
        if batch_id and batch_id % many == 0:
            store.compact(snapshot_id)

    return write
