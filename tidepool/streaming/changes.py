"""T2 apply_changes: fold a change feed into a file table, batch and streaming.

Each change "touches" paths: CREATED/MODIFIED upsert ``path``; DELETED
tombstones ``path``; RENAMED tombstones ``old_path`` and upserts ``path``.
Per path the result is the latest upsert's metadata, with ``deleted`` set
when a tombstone came after it; paths that were only ever deleted have no
row (tombstoning a missing file changes nothing).

The fold is associative per path (latest upsert by seq, max upsert seq,
max tombstone seq): the batch job is one aggregate, and the streaming job
keeps the same aggregate in the state store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.schemas import FILE_COLS, FILES
from tidepool.streaming.snapshots import SnapshotLog

META_COLS = [c for c in FILE_COLS if c not in ("client_id", "path")]


def touches(changes: DataFrame) -> DataFrame:
    """One row per (path touched, seq): ``is_upsert`` with metadata, or a tombstone.

    Both touches of a rename come out of one pass over the feed.
    """
    nothing = F.lit(None).cast(changes.schema["metadata"].dataType)
    touch = lambda path, up, meta: F.struct(path.alias("path"), F.lit(up).alias("is_upsert"), meta.alias("metadata"))
    kind = F.col("type")
    upsert = touch(F.col("path"), True, F.col("metadata"))
    rows = (
        F.when(kind.isin("CREATED", "MODIFIED"), F.array(upsert))
        .when(kind == "DELETED", F.array(touch(F.col("path"), False, nothing)))
        .when((kind == "RENAMED") & F.col("old_path").isNotNull(), F.array(upsert, touch(F.col("old_path"), False, nothing)))
        .when(kind == "RENAMED", F.array(upsert))
    )
    return changes.where(rows.isNotNull()).select("client_id", "seq", F.inline(rows)).select("client_id", "path", "seq", "is_upsert", "metadata")


def fold_state(t: DataFrame) -> DataFrame:
    """Per path: last upsert metadata and seq, last tombstone seq."""
    return t.groupBy("client_id", "path").agg(
        F.max_by("metadata", F.when(F.col("is_upsert"), F.col("seq"))).alias("metadata"),
        F.max(F.when(F.col("is_upsert"), F.col("seq"))).alias("up_seq"),
        F.max(F.when(~F.col("is_upsert"), F.col("seq"))).alias("del_seq"),
    )


def state_to_files(state: DataFrame) -> DataFrame:
    live = state.where(F.col("up_seq").isNotNull())
    deleted = F.coalesce(F.col("del_seq") > F.col("up_seq"), F.lit(False))
    cols = [F.col("metadata." + c).alias(c) if c != "deleted" else deleted.alias("deleted") for c in META_COLS]
    return live.select("client_id", "path", *cols)


def apply_changes(changes: DataFrame) -> DataFrame:
    """Batch T2: the file table after applying the whole feed.

    One pass over the feed and one aggregate per path (partial before the
    shuffle, so a path with most of the feed reduces map-side).
    """
    return state_to_files(fold_state(touches(changes)))


def apply_changes_stream(spark: SparkSession, stream: DataFrame, work: str) -> DataFrame:
    """Streaming T2: the same fold as a stateful streaming aggregate.

    Output mode ``update`` emits the changed per-path states of each micro-batch;
    they go to a ``SnapshotLog`` under the batch's number, so a replayed batch
    replaces its own rows, and reading the table costs a snapshot and a few batches.
    """
    log = state_log(spark, work)
    agg = fold_state(touches(stream))

    def sink(df: DataFrame, batch_id: int) -> None:
        log.append(batch_id, df)

    q = (
        agg.writeStream.outputMode("update")
        .option("checkpointLocation", f"{work}/checkpoint")
        .foreachBatch(sink)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return state_to_files(log.read())


def state_log(spark: SparkSession, work: str) -> SnapshotLog:
    meta = T.StructType([f for f in FILES.fields if f.name in META_COLS])
    schema = T.StructType([
        T.StructField("client_id", T.StringType()), T.StructField("path", T.StringType()), T.StructField("metadata", meta),
        T.StructField("up_seq", T.LongType()), T.StructField("del_seq", T.LongType()),
    ])
    return SnapshotLog(spark, f"{work}/states", schema, ["client_id", "path"])
