"""T3 as a stream: each client is sent the file rows newer than its position, once.

A micro-batch of file rows is a sync round.  Rows with ``modified_time`` above the client's
position (its ``last_sync_time``; absent: 0) are sent, tombstones included, and the position
moves to the newest row sent.  The positions before a batch are those as of the batch before
it; what is sent and the new positions are written under the batch's number, so a replayed batch
decides the same again and replaces its own output: nothing is sent twice or lost.

Positions are a ``SnapshotLog``: a batch reads and writes those of its own clients.  The new
position is a maximum with a partial aggregate, and the join to positions brings one row per
client, so a client with most of the feed is not one task.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.operators import sync
from tidepool.streaming.snapshots import SnapshotLog

POSITIONS = "client_id string, last_sync_time long"


def positions(spark: SparkSession, work: str) -> SnapshotLog:
    return SnapshotLog(spark, f"{work}/positions", POSITIONS, ["client_id"])


def process_batch(spark: SparkSession, batch: DataFrame, batch_id: int, work: str, first: DataFrame | None) -> None:
    log = positions(spark, work)
    clients = batch.select("client_id").where("client_id is not null").distinct()
    known = log.read(batch_id - 1, clients).select("client_id", "last_sync_time")
    if first is not None:  # positions from before the stream, where it has none yet
        older = first.select("client_id", "last_sync_time").join(clients, "client_id", "left_semi")
        known = older.join(known, "client_id", "left_anti").unionByName(known)
    sent = sync.incremental_sync(batch, known)
    sent.write.mode("overwrite").parquet(f"{work}/sent/batch_id={batch_id}")
    # read back: positions follow what was sent
    done = spark.read.schema(sent.schema).parquet(f"{work}/sent/batch_id={batch_id}")
    moved = done.groupBy("client_id").agg(F.max("modified_time").alias("sync_time")).where("client_id is not null")
    log.append(batch_id, sync.advance_sync_state(known, moved))


def sync_stream(spark: SparkSession, stream: DataFrame, work: str, first: DataFrame | None = None) -> DataFrame:
    """Run the stream of file rows to its end; all rows sent so far, with their ``batch_id``."""
    q = (
        stream.writeStream.option("checkpointLocation", f"{work}/checkpoint")
        .foreachBatch(lambda df, i: process_batch(df.sparkSession, df, i, work, first))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.IntegerType())])
    try:
        return spark.read.schema(schema).parquet(f"{work}/sent")
    except AnalysisException as e:  # a stream without a batch
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def current_positions(spark: SparkSession, work: str) -> DataFrame:
    return positions(spark, work).read().select("client_id", "last_sync_time")
