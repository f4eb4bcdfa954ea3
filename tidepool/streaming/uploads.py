"""T1 ingest_uploads: a stream of uploaded chunks into the chunk store, the manifest
and the files table.

Per micro-batch (``foreachBatch``):

1. S7: client, path and announced total of an upload are those of its first message,
   whichever batch brought it.  The first messages of the batch are logged
   (``uploads_log``); of several entries of an upload the earliest batch and message
   hold.
2. S4: the first writer of each hash not yet stored is appended to the store, so a
   replayed batch writes nothing twice.  Membership comes from the store's index
   (``membership``): hashes read follow the batch, not the store.
3. S11: manifest rows are appended to a log with the batch id; the manifest is the
   latest row per ``(client, file, index)`` (W2), read for the batch's files only.
4. S6: files whose manifest count over all batches reached the total (A6) are rebuilt
   (J6) and appended to the files log.  "The stream ends" becomes "the count is
   complete".

Each micro-batch appends a file per written range; with tiny batches that is many
small files, so a deployment sizes triggers for large batches.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators import membership, storage
from tidepool.operators.files import latest_per_key
from tidepool.schemas import CHUNK_STORE, FILE_COLS, FILES, UPLOAD

FILE_KEYS = ["client_id", "file_path"]
UPLOADS_LOG = "upload_id string, client_id string, file_path string, total_chunks int, seq long, batch_id long"
MANIFEST_LOG = "client_id string, file_path string, chunk_index int, hash string, offset long, size int, seq long, batch_id long"
RESPONSES_LOG = "client_id string, file_path string, batch_id long, success boolean, chunks_received int, reason string"
FILES_LOG = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FILES.fields) + ", batch_id long"

NOT_COMPLETE = "INCOMPLETE_OR_BROKEN"


def _log(spark: SparkSession, path: str, schema) -> DataFrame:
    """A log table; empty before its first append.  Any other failure to read is an error."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _manifest(spark: SparkSession, work: str, touched: DataFrame) -> DataFrame:
    log = _log(spark, f"{work}/manifest_log", MANIFEST_LOG).join(touched, FILE_KEYS, "left_semi")
    # last write wins: later batch, then later message within the batch
    return latest_per_key(log, ["client_id", "file_path", "chunk_index"], ["batch_id", "seq"])


def _headers(spark: SparkSession, work: str, batch: DataFrame) -> DataFrame:
    """(upload_id, client_id, file_path, total_chunks) of the batch's uploads."""
    log = _log(spark, f"{work}/uploads_log", UPLOADS_LOG).join(batch.select("upload_id").distinct(), "upload_id", "left_semi")
    return latest_per_key(log, ["upload_id"], ["batch_id", "seq"], first=True).drop("seq", "batch_id")


def _store_index(spark: SparkSession, path: str, store: DataFrame) -> DataFrame | None:
    """The store's membership index; a store from before it had one is indexed whole, once."""
    index = membership.read_index(spark, path)
    if index is None and not store.isEmpty():
        membership.write_index(store, path)
        index = membership.read_index(spark, path)
    return index


def process_batch(spark: SparkSession, batch: DataFrame, batch_id: int, work: str, finalized_at: int) -> None:
    store_path = f"{work}/chunk_store"
    batch = batch.persist()
    first = latest_per_key(
        batch.select("upload_id", "client_id", "file_path", "total_chunks", "seq"), ["upload_id"], ["seq"], first=True
    )
    first.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("append").parquet(f"{work}/uploads_log")
    headers = _headers(spark, work, batch).persist()
    rows = batch.select(
        "upload_id", "seq", F.col("chunk.index").alias("chunk_index"), F.col("chunk.hash").alias("hash"), F.col("chunk.data").alias("data")
    )
    store = _log(spark, store_path, CHUNK_STORE)
    index = _store_index(spark, f"{work}/chunk_index", store)
    known = membership.stored_hashes(rows, store, index).persist()
    fresh = storage.new_store_rows(rows.select("hash", "data", "seq", "upload_id"), store, ["seq", "upload_id"], known)
    membership.write_index(fresh, f"{work}/chunk_index")
    storage.write_store(fresh, store_path)
    known.unpersist()

    meta = rows.select("upload_id", "seq", "chunk_index", "hash", F.length("data").cast("int").alias("size")).join(headers, "upload_id")
    (
        meta.select(*FILE_KEYS, "chunk_index", "hash", F.lit(0).cast("long").alias("offset"), "size", "seq",
                    F.lit(batch_id).cast("long").alias("batch_id"))
        .write.mode("append").parquet(f"{work}/manifest_log")
    )
    # of several uploads of a file in the batch, the first message's total holds
    announced = latest_per_key(meta.select(*FILE_KEYS, "total_chunks", "seq"), FILE_KEYS, ["seq"], first=True).drop("seq")
    manifest = _manifest(spark, work, announced.select(*FILE_KEYS))
    complete = storage.upload_complete(manifest, announced, FILE_KEYS).persist()
    ready = manifest.join(complete.where("complete").select(*FILE_KEYS), FILE_KEYS, "left_semi")
    rebuilt = storage.reassemble(ready, _log(spark, store_path, CHUNK_STORE), FILE_KEYS)
    done = storage.finalize_files(rebuilt, complete, FILE_KEYS, finalized_at).persist()
    (
        done.withColumnRenamed("file_path", "path").select(*FILE_COLS).withColumn("batch_id", F.lit(batch_id).cast("long"))
        .write.mode("append").parquet(f"{work}/files_log")
    )
    # the upload's answer so far: success and the chunks received once it is finalised
    ok = F.col("__fin").isNotNull()
    (
        complete.join(done.select(*FILE_KEYS, F.lit(True).alias("__fin")), FILE_KEYS, "left")
        .select(*FILE_KEYS, F.lit(batch_id).cast("long").alias("batch_id"), ok.alias("success"),
                F.when(ok, F.col("received_chunks")).alias("chunks_received"), F.when(~ok, F.lit(NOT_COMPLETE)).alias("reason"))
        .write.mode("append").parquet(f"{work}/responses_log")
    )
    for df in (done, complete, headers, batch):
        df.unpersist()


def run_uploads(spark: SparkSession, feed_dir: str, work: str, finalized_at: int, files_per_trigger: int = 1000) -> None:
    """Run the upload stream over what ``feed_dir`` holds by now; later calls go on where it stopped."""
    stream = spark.readStream.schema(UPLOAD).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").parquet(feed_dir)
    q = (
        stream.writeStream.option("checkpointLocation", f"{work}/checkpoint")
        .foreachBatch(lambda df, i: process_batch(df.sparkSession, df, i, work, finalized_at))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


def uploaded_files(spark: SparkSession, work: str) -> DataFrame:
    """The files table: the latest finalised state per path."""
    return latest_per_key(_log(spark, f"{work}/files_log", FILES_LOG), ["client_id", "path"], ["batch_id"]).select(*FILE_COLS)


def upload_responses(spark: SparkSession, work: str) -> DataFrame:
    """The latest answer per file and batch; a replayed batch doesn't answer twice."""
    log = _log(spark, f"{work}/responses_log", RESPONSES_LOG)
    return log.groupBy(*FILE_KEYS, "batch_id").agg(
        F.max("success").alias("success"), F.max("chunks_received").alias("chunks_received"),
        F.when(~F.max("success"), F.lit(NOT_COMPLETE)).alias("reason"),
    )


def upload_feed(conv: DataFrame, announced: DataFrame) -> DataFrame:
    """Upload messages derived from chunk rows; only an upload's first message (index 0) names
    client, path and total (``announced``), as a client may do."""
    head = F.col("chunk_index") == 0
    return conv.join(announced, ["client_id", "file_path"]).select(
        F.concat_ws(":", "client_id", "file_path").alias("upload_id"),
        F.when(head, F.col("client_id")).otherwise(F.lit("")).alias("client_id"),
        F.when(head, F.col("file_path")).otherwise(F.lit("")).alias("file_path"),
        (F.col("conv_id") * 100000 + F.col("chunk_index")).cast("long").alias("seq"),
        F.struct(
            F.col("chunk_index").alias("index"),
            F.lit(0).cast("long").alias("offset"),
            F.col("size"),
            F.col("hash"),
            F.col("data"),
        ).alias("chunk"),
        F.when(head, F.col("total_chunks")).otherwise(F.lit(0)).alias("total_chunks"),
    )
