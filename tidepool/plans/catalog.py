"""Registered queries: one Spark job per operator of the inventory.

Each entry takes ``(spark, sf_dir)``, reads the driver tables (through the
views in ``tidepool.sources.tables``) and returns a DataFrame whose columns
match the oracle SQL of the same name in ``tidepool.plans.oracle``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import paths
from tidepool.functions.timeutil import utc_wall_clock
from tidepool.operators import bytesjobs, chunking, delta, files, membership, metrics, ratelimit, sketches, storage, sync
from tidepool.plans import params as P
from tidepool.schemas import CHUNK_STORE, FILE_COLS
from tidepool.session import work_dir
from tidepool.sources import files as file_source
from tidepool.sources import tables as V
from tidepool.streaming import admission as T4
from tidepool.streaming import changes as T2
from tidepool.streaming import sync_feed as T3
from tidepool.streaming import uploads as T1

DOC_KEYS = ["client_id", "path"]
CONV_KEYS = ["client_id", "file_path"]
CHUNK_COLS = ["client_id", "path", "chunk_index", "offset", "size", "hash"]


# ---------------------------------------------------------------- inputs
def _doc_chunks(spark, sf, small: bool) -> DataFrame:
    src = V.src_files(spark, sf)
    kw = P.SMALL if small else {}
    return chunking.cdc_chunks(src, DOC_KEYS, "content", **kw)


def _version_chunks(spark, sf):
    old, new = V.version_pair(spark, sf)
    return (
        chunking.cdc_chunks(old, ["path"], "content", **P.SMALL),
        chunking.cdc_chunks(new, ["path"], "content", **P.SMALL),
    )


def _manifest(spark, sf) -> DataFrame:
    return files.upsert_manifest(V.manifest_log(spark, sf), ["l_shipdate", "l_partkey", "l_suppkey"])


def _conv_store(spark, sf) -> DataFrame:
    """The chunk store after storing every conversation chunk (first writer per hash)."""
    conv = V.conv_chunks(spark, sf)
    return storage.new_store_rows(conv, storage.empty_store(spark), ["conv_id", "chunk_index"]).select(
        "hash_prefix", "hash", "size", "data"
    )


def _probe_hashes(spark, sf) -> DataFrame:
    parts = V.table(spark, sf, "part").select(F.sha2(F.col("p_partkey").cast("string"), 256).alias("hash"))
    return parts.unionByName(V.conv_chunks(spark, sf).select("hash"))


# ---------------------------------------------------------------- chunking
def q_cdc_chunks(spark, sf):
    return _doc_chunks(spark, sf, small=False).select(*CHUNK_COLS)


def q_cdc_chunks_small(spark, sf):
    return _doc_chunks(spark, sf, small=True).select(*CHUNK_COLS)


def q_cdc_chunks_segmented(spark, sf):
    """C1 over documents delivered as 1,000-byte segments (Spark splits them);
    chunks straddle segment borders and must equal whole-document chunking."""
    src = V.src_files(spark, sf).select(*DOC_KEYS, "content").where(F.length("content") > 0)
    seg = 1000
    last = F.floor((F.length("content") - 1) / seg).cast("int")
    # one array of segment structs per document, then one row per segment
    # (no row ever carries the whole document next to its segment)
    pieces = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(i.cast("long").alias("seg"), F.substring("content", i * seg + 1, F.lit(seg)).alias("content")),
    )
    segments = src.select(*DOC_KEYS, F.inline(pieces))
    return chunking.cdc_chunks_segmented(segments, DOC_KEYS, "seg", "content", **P.SMALL).select(*CHUNK_COLS)


def q_chunk_stats(spark, sf):
    return chunking.chunk_stats(V.src_files(spark, sf), DOC_KEYS, "content", **P.SMALL)


def q_cdc_chunks_switch(spark, sf):
    """The variant whose switch point is a parameter."""
    src = V.src_files(spark, sf)
    return chunking.cdc_chunks(src, DOC_KEYS, "content", **P.SMALL, switch=P.SWITCH).select(*CHUNK_COLS)


def q_dedup_report(spark, sf):
    return delta.dedup_report(_doc_chunks(spark, sf, small=True))


def q_distinct_hashes(spark, sf):
    return delta.distinct_hashes(_doc_chunks(spark, sf, small=True))


def q_distinct_hashes_estimate(spark, sf):
    """A12 by sketches: one per client and day, stored, united per client and year, beside the exact count."""
    log = V.manifest_log(spark, sf)
    root = work_dir(spark, "hash-sketches")
    by_day = sketches.hash_sketches(log.withColumn("day", F.to_date("l_shipdate")), ["client_id", "day"])
    sketches.write_sketches(by_day, root, 0)
    year = F.year("day").alias("year")
    found = sketches.estimates(sketches.read_sketches(spark, root), ["client_id", year])
    exact = log.groupBy("client_id", F.year("l_shipdate").alias("year")).agg(F.count_distinct("hash").alias("distinct_hashes"), F.count("hash").alias("n_hashes"))
    close = F.abs(F.col("estimate") - F.col("distinct_hashes")) <= 0.03 * F.col("distinct_hashes")
    return found.withColumnRenamed("n_hashes", "n").join(exact, ["client_id", "year"]).select(
        "client_id", "year", F.col("n").alias("n_hashes"), "distinct_hashes", close.alias("within_3_percent")
    )


# ---------------------------------------------------------------- delta
def q_delta_new(spark, sf):
    old, new = _version_chunks(spark, sf)
    return delta.delta_new(new, old, ["path"]).select("path", "chunk_index", "offset", "size", "hash")


def q_delta_existing(spark, sf):
    old, new = _version_chunks(spark, sf)
    return delta.delta_existing(new, old, ["path"]).select("path", "chunk_index", "offset", "size", "hash")


def q_delta_summary(spark, sf):
    old, new = _version_chunks(spark, sf)
    return delta.delta_summary(old, new, ["path"], V.version_pair(spark, sf)[1].select("path"))


def q_bandwidth_reduction(spark, sf):
    old, new = _version_chunks(spark, sf)
    return delta.bandwidth_reduction(old, new, ["path"], V.version_pair(spark, sf)[1].select("path"))


def q_chunk_exists(spark, sf):
    return delta.chunk_exists(_probe_hashes(spark, sf), _manifest(spark, sf), _conv_store(spark, sf))


def q_identical_files(spark, sf):
    return delta.identical_files(V.src_files(spark, sf), DOC_KEYS)


# ---------------------------------------------------------------- file tables
def q_live_files(spark, sf):
    return files.live_files(V.server_files(spark, sf))


def q_file_chunks(spark, sf):
    return files.file_chunks(_manifest(spark, sf))


def q_file_metadata(spark, sf):
    return files.file_metadata(V.server_copy(spark, sf), V.local_files(spark, sf))


def q_scan_files(spark, sf):
    """The table folder's own Parquet files as scanned binary files."""
    f = file_source.scan(file_source.list_files(spark, f"{sf}/documents.parquet"))
    name = F.element_at(F.split("path", "/"), -1)
    return f.select(name.alias("name"), "size", "hash", "version", "deleted", F.col("size").alias("n_bytes"))


def q_file_hashes(spark, sf):
    """F3 for requested paths: some files are empty, some requests have no file."""
    new = V.version_pair(spark, sf)[1].select(F.lit("c0").alias("client_id"), "path", "content")
    asked = V.server_files(spark, sf).select(F.lit("c0").alias("client_id"), "path")
    absent = asked.select("client_id", F.concat("path", F.lit(".bak")).alias("path"))
    return files.file_hashes(new, asked.unionByName(absent))


def q_modified_since(spark, sf):
    return files.modified_since(V.server_files(spark, sf), P.MODIFIED_SINCE)


def q_tombstone(spark, sf):
    req = V.src_files(spark, sf).where(F.col("path").contains(f"/{P.TOMBSTONE_LANG}/"))
    return files.tombstone(V.server_copy(spark, sf), req)


def q_upsert_files(spark, sf):
    return files.upsert_files(V.server_copy(spark, sf), V.local_files(spark, sf), "list_pos")


def q_upsert_manifest(spark, sf):
    return _manifest(spark, sf)


def q_chunk_offsets(spark, sf):
    return files.chunk_offsets(_manifest(spark, sf))


def q_chunk_address(spark, sf):
    h = V.conv_chunks(spark, sf).select("hash").distinct()
    return h.select("hash", paths.hash_prefix("hash").alias("hash_prefix"), paths.chunk_address("hash").alias("address"))


def q_client_namespace(spark, sf):
    s = V.server_files(spark, sf)
    return s.select(
        "client_id", "path",
        paths.client_path("client_id", "path").alias("target_path"),
        F.concat(F.lit("clients/"), F.col("client_id"), F.lit("/metadata.db")).alias("metadata_db"),
    )


# ---------------------------------------------------------------- sync and conflicts
def q_sync_changes(spark, sf):
    return sync.sync_changes(V.server_copy(spark, sf), V.local_files(spark, sf), P.LAST_SYNC_TIME, "list_pos")


def q_sync_response(spark, sf):
    """The whole answer to a sync request: changes, conflicts and the server's time."""
    return sync.sync_response(V.server_copy(spark, sf), V.local_files(spark, sf), P.LAST_SYNC_TIME, P.SERVER_TIME, "list_pos")


def q_incremental_sync(spark, sf):
    return sync.incremental_sync(V.server_files(spark, sf), _sync_state(spark, sf))


def _sync_state(spark, sf):
    return V.local_files(spark, sf).groupBy("client_id").agg(F.max("modified_time").alias("last_sync_time"))


def q_advance_sync_state(spark, sf):
    """T3 write side: every client moves on to the newest row it was sent."""
    sent = sync.incremental_sync(V.server_files(spark, sf), _sync_state(spark, sf))
    return sync.advance_sync_state(
        _sync_state(spark, sf), sent.groupBy("client_id").agg(F.max("modified_time").alias("sync_time"))
    )


def q_incremental_sync_stream(spark, sf):
    """T3 as a stream of two deliveries, the second of which repeats the first: every row is
    sent once, so that the whole equals the batch rows."""
    work = work_dir(spark, "sync-feed")
    server = V.server_files(spark, sf)
    before = V.local_files(spark, sf).groupBy("client_id").agg((F.min("modified_time") + 100).alias("last_sync_time"))
    for k, rows in enumerate((server.where(F.col("modified_time") <= P.MODIFIED_SINCE), server)):
        rows.write.parquet(f"{work}/feed/delivery={k}")
        feed = spark.readStream.schema(server.schema).parquet(f"{work}/feed/delivery=[0-9]")
        sent = T3.sync_stream(spark, feed, work, before)
    return sent.select(*FILE_COLS)


def _conflicts(spark, sf):
    return sync.conflicts(sync.first_local(V.local_files(spark, sf), "list_pos"), V.server_copy(spark, sf))


def q_conflicts(spark, sf):
    return _conflicts(spark, sf)


def q_auto_resolve(spark, sf):
    return _conflicts(spark, sf).withColumn("strategy", sync.auto_strategy())


def q_resolve_conflicts(spark, sf):
    return sync.resolve_conflicts(_conflicts(spark, sf), P.RESOLVED_AT)


def q_conflict_name(spark, sf):
    pg = V.page_files(spark, sf)
    at = utc_wall_clock(P.RESOLVED_AT)
    return pg.select(
        "page_id", "path",
        paths.stem("path").alias("stem"),
        paths.extension("path").alias("extension"),
        paths.conflict_name("path", F.lit("local"), at).alias("conflict_name"),
    )


# ---------------------------------------------------------------- store, upload, reassembly
def q_store_chunks(spark, sf):
    conv = V.conv_chunks(spark, sf)
    existing = storage.new_store_rows(conv.where(F.col("chunk_index") == 0), storage.empty_store(spark),
                                      ["conv_id", "chunk_index"])
    fresh = storage.new_store_rows(conv, existing, ["conv_id", "chunk_index"])
    return fresh.select("hash_prefix", "hash", "size", "first_conv_id", "first_chunk_index", "hash_ok")


def q_store_chunks_indexed(spark, sf):
    """S4 against a written store with its membership index."""
    conv = V.conv_chunks(spark, sf)
    order = ["conv_id", "chunk_index"]
    root = work_dir(spark, "indexed-store")
    existing = storage.new_store_rows(conv.where(F.col("chunk_index") == 0), storage.empty_store(spark), order)
    membership.write_index(existing, f"{root}/index")
    storage.write_store(existing, f"{root}/store")
    store = spark.read.schema(CHUNK_STORE).parquet(f"{root}/store")
    known = membership.stored_hashes(conv, store, membership.read_index(spark, f"{root}/index"))
    fresh = storage.new_store_rows(conv, store, order, known)
    return fresh.select("hash_prefix", "hash", "size", "first_conv_id", "first_chunk_index", "hash_ok")


def q_fetch_chunks(spark, sf):
    got = storage.fetch_chunks(_probe_hashes(spark, sf), _conv_store(spark, sf))
    return got.select("hash", "found", F.length("data").cast("int").alias("n_bytes"),
                      F.sha2("data", 256).alias("data_hash"))


def q_upload_complete(spark, sf):
    conv = V.conv_chunks(spark, sf)
    return storage.upload_complete(conv, V.announced(conv), CONV_KEYS)


def _kept_store(spark, sf) -> DataFrame:
    """A chunk store that has lost the blobs only some conversations' first turns held."""
    conv = V.conv_chunks(spark, sf).where((F.col("conv_id") % 17 != 3) | (F.col("chunk_index") != 0))
    return storage.new_store_rows(conv, storage.empty_store(spark), ["conv_id", "chunk_index"]).select(
        "hash_prefix", "hash", "size", "data"
    )


def q_reassemble(spark, sf):
    """J6 with the rebuilt bytes (here text, so they are shown decoded)."""
    rebuilt = storage.reassemble(V.conv_chunks(spark, sf), _kept_store(spark, sf), CONV_KEYS, with_content=True)
    return rebuilt.withColumn("content", F.decode("content", "UTF-8"))


def q_finalize_files(spark, sf):
    conv = V.conv_chunks(spark, sf)
    complete = storage.upload_complete(conv, V.announced(conv), CONV_KEYS)
    rebuilt = storage.reassemble(conv, _kept_store(spark, sf), CONV_KEYS)
    done = storage.finalize_files(rebuilt, complete, CONV_KEYS, P.FINALIZED_AT)
    return done.withColumnRenamed("file_path", "path").select(*FILE_COLS)


def _bucketed(spark, rows, body) -> DataFrame:
    """``body(store)`` over ``rows`` as a bucketed store table, its result written out."""
    work, name = work_dir(spark, "bucketed-store"), f"tidepool_store_{uuid.uuid4().hex[:12]}"
    storage.write_bucketed_store(rows, name, f"{work}/store", int(spark.conf.get("spark.sql.shuffle.partitions")))
    try:
        done = body(spark.table(name))
        done.write.parquet(f"{work}/result")
        return spark.read.schema(done.schema).parquet(f"{work}/result")
    finally:
        spark.sql(f"DROP TABLE {name}")  # the entry; the files stay


def q_reassemble_bucketed(spark, sf):
    """J6 over the store bucketed by hash: no exchange of bytes but the one by file."""
    conv = V.conv_chunks(spark, sf)
    return _bucketed(spark, _kept_store(spark, sf), lambda store: storage.reassemble(conv, store, CONV_KEYS))


def q_fetch_chunks_bucketed(spark, sf):
    """S5 over the bucketed store: requests go to the buckets."""
    wanted = _probe_hashes(spark, sf)
    got = _bucketed(spark, _conv_store(spark, sf), lambda store: storage.fetch_chunks(wanted, store, bucketed=True))
    return got.select("hash", "found", F.length("data").cast("int").alias("n_bytes"), F.sha2("data", 256).alias("data_hash"))


def q_write_client_files(spark, sf):
    """Complete uploads written as files, then the tree listed and read back."""
    conv = V.conv_chunks(spark, sf)
    complete = storage.upload_complete(conv, V.announced(conv), CONV_KEYS)
    root = work_dir(spark, "client-files")
    storage.write_client_files(conv, _kept_store(spark, sf), complete, root)
    found = file_source.scan(file_source.list_files(spark, f"{root}/clients", hidden=True), "c0")
    name = F.regexp_extract("path", r"/clients/([^/]+)/(.*)$", 2)
    return found.select(F.regexp_extract("path", r"/clients/([^/]+)/", 1).alias("client_id"), name.alias("path"), "size", "hash")


def q_cdc_file_chunks(spark, sf):
    """S1 and C1 over files of any size: complete uploads written as files, then chunked as streams."""
    conv = V.conv_chunks(spark, sf)
    complete = storage.upload_complete(conv, V.announced(conv), CONV_KEYS)
    root = work_dir(spark, "client-files")
    storage.write_client_files(conv, _kept_store(spark, sf), complete, root)
    chunks = chunking.cdc_file_chunks(file_source.list_files(spark, f"{root}/clients", hidden=True), **P.SMALL)
    return chunks.select(F.regexp_extract("path", r"/clients/[^/]+/(.*)$", 1).alias("path"), "chunk_index", "offset", "size", "hash")


def _held(conv: DataFrame) -> DataFrame:
    return conv.where(F.col("role") == "user").select(*CONV_KEYS, "hash")


def q_download_plan(spark, sf):
    conv = V.conv_chunks(spark, sf)
    return delta.download_plan(conv.select(*CONV_KEYS, "chunk_index", "hash", "size"), _held(conv), CONV_KEYS)


def q_download_response(spark, sf):
    """J7 as one answer: requests for every file and for some that don't exist."""
    conv = V.conv_chunks(spark, sf)
    known = conv.select("client_id", F.col("file_path").alias("path")).distinct()
    asked = known.unionByName(known.select("client_id", F.concat("path", F.lit(".bak")).alias("path")))
    return delta.download_response(asked, known, conv.select(*CONV_KEYS, "chunk_index", "hash", "size"), _held(conv), CONV_KEYS)


def q_apply_delta(spark, sf):
    """The new version's chunk list applied to the old version's bytes: unedited
    files rebuild exactly, cut ones to their new length, emptied ones to nothing,
    and grown ones overrun and fail."""
    old, new = V.version_pair(spark, sf)
    chunks = chunking.cdc_chunks(new, ["path"], "content", **P.SMALL)
    done = storage.apply_delta(chunks.select("path", "chunk_index", "size"),
                               old.withColumnRenamed("content", "payload"), ["path"])
    return done.withColumn("content", F.hex("content"))


def q_storage_stats(spark, sf):
    return storage.storage_stats(_conv_store(spark, sf), V.conv_chunks(spark, sf), V.server_files(spark, sf))


# ---------------------------------------------------------------- metrics
def q_counter(spark, sf):
    return metrics.counter(V.metrics_log(spark, sf))


def q_gauge(spark, sf):
    return metrics.gauge(V.metrics_log(spark, sf))


def q_latency(spark, sf):
    return metrics.latency(V.metrics_log(spark, sf))


def q_throughput(spark, sf):
    return metrics.throughput(V.metrics_log(spark, sf), P.AS_OF)


def q_metrics_report(spark, sf):
    return metrics.metrics_report(V.metrics_log(spark, sf), P.AS_OF)


# ---------------------------------------------------------------- byte jobs
def q_window_fingerprints(spark, sf):
    return bytesjobs.shared_passages(V.src_files(spark, sf), "content", P.FP_WINDOW)


# ---------------------------------------------------------------- token buckets
def q_token_bucket_admit(spark, sf):
    return ratelimit.admit(V.transfer_log(spark, sf), P.TOKEN_RATE, P.TOKEN_BURST)


def _events_stream(spark, sf) -> DataFrame:
    """The events table itself as a stream (a micro-batch per arriving set of files)."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    # as a pattern: a stream takes a single file only by one
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")


def q_token_bucket_admit_stream(spark, sf):
    """T4 as a stateful stream over the events table."""
    log = V.transfer_log_of(_events_stream(spark, sf)).select("key", "ts", "event_id", "bytes")
    return T4.admission_stream(spark, log, work_dir(spark, "admit-stream"), P.TOKEN_RATE, P.TOKEN_BURST)


# ---------------------------------------------------------------- change feed and uploads (streaming)
def q_apply_changes(spark, sf):
    return T2.apply_changes(V.change_log(spark, sf))


def q_apply_changes_stream(spark, sf):
    """T2 as a Structured Streaming job over the events table, same result as the batch fold."""
    return T2.apply_changes_stream(spark, V.change_log_of(_events_stream(spark, sf)), work_dir(spark, "apply-changes"))


def _ingested(spark, sf) -> str:
    """T1 over two deliveries: every upload's messages are split between them, and only
    first messages name client, path and total."""
    work = work_dir(spark, "ingest-uploads")
    conv = V.conv_chunks(spark, sf)
    feed = T1.upload_feed(conv, V.announced(conv))
    for part in (0, 1):
        feed.where(F.col("chunk.index") % 2 == part).write.mode("append").parquet(f"{work}/feed/delivery={part}")
        T1.run_uploads(spark, f"{work}/feed", work, P.FINALIZED_AT)
    return work


def q_ingest_uploads(spark, sf):
    return T1.uploaded_files(spark, _ingested(spark, sf))


def q_upload_responses(spark, sf):
    """T1's answers per file and delivery."""
    return T1.upload_responses(spark, _ingested(spark, sf))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_") and callable(fn)
}
