"""Content-addressed chunk store and file reassembly: S4, S5, S6, A5, A6, J6, W3.

The store is parquet partitioned by ``hash_prefix`` (256 folders ``<2 hex>``),
each file sorted by hash, or a table bucketed by hash.  New blobs are chosen on
``hash`` and order columns alone (S4); bytes are fetched for the chosen rows.  A lookup
by hash (S5, J6) in the bucketed store leaves the bytes where they are; J6 and S6 move
them once, to the file.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions.paths import hash_prefix
from tidepool.operators.chunking import _binary_parts
from tidepool.operators.files import latest_per_key
from tidepool.schemas import CHUNK_STORE
from tidepool.sources import client_files


def empty_store(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CHUNK_STORE)


def new_store_rows(incoming: DataFrame, store: DataFrame, order: list[str], known: DataFrame | None = None) -> DataFrame:
    """Chunks to append to the store, each hash once, first writer wins.

    ``incoming`` has ``hash, data`` plus the ``order`` columns, which tell its rows
    apart; hashes already in ``store`` are dropped (existing blobs are never
    rewritten).  The given hash is not verified; ``hash_ok`` reports it.

    First writers are a top-1 per hash with a map-side partial limit, and the
    anti-join reads hashes only: bytes move once, for the winners, by (hash, order),
    which no hash makes hot.

    ``known`` has the hashes of ``incoming`` that are in the store, where an index gave them
    (``membership.stored_hashes``); then the store itself is not read.
    """
    first = latest_per_key(incoming.select("hash", *order), ["hash"], order, first=True)
    fresh = first.join(store.select("hash").distinct() if known is None else known, "hash", "left_anti")
    blobs = incoming.select("hash", *order, "data").join(fresh, ["hash", *order], "left_semi")
    return blobs.select(
        hash_prefix("hash").alias("hash_prefix"),
        "hash",
        F.length("data").cast("int").alias("size"),
        F.col("data"),
        *[F.col(c).alias("first_" + c) for c in order],
        (F.sha2("data", 256) == F.col("hash")).alias("hash_ok"),
    )


def write_store(rows: DataFrame, path: str) -> None:
    """Append new blobs to the prefix-partitioned store.

    Range partitioning on ``hash`` gives every task one contiguous hash
    range: it writes into one or two ``hash_prefix`` folders only, files
    come out evenly sized, and the task count follows the data (shuffle
    partitions / AQE) instead of being capped at 256 prefixes.  Files are
    sorted by ``hash``, so row-group statistics let lookups by hash skip
    the blobs of other row groups.
    """
    (
        rows.select("hash_prefix", "hash", "size", "data")
        .repartitionByRange("hash")
        .sortWithinPartitions("hash")
        .write.mode("append")
        .partitionBy("hash_prefix")
        .parquet(path)
    )


def write_bucketed_store(rows: DataFrame, name: str, path: str, buckets: int) -> None:
    """Append new blobs to the store table ``name`` at ``path``, bucketed and sorted by ``hash``.

    Lookups by hash (``fetch_chunks``, ``reassemble``) over ``spark.table(name)`` move the request to
    the buckets, never the bytes to the request: the scan already is hash-partitioned.  Choose
    ``buckets`` once, for buckets of a few GB and no fewer than the shuffle partitions
    of the jobs that read it.
    """
    (
        rows.select("hash_prefix", "hash", "size", "data")
        .repartition(buckets, "hash")
        .sortWithinPartitions("hash")
        .write.mode("append")
        .bucketBy(buckets, "hash")
        .sortBy("hash")
        .option("path", path)
        .saveAsTable(name)
    )


def attach_store(spark: SparkSession, name: str, path: str, buckets: int) -> DataFrame:
    """The bucketed store at ``path`` as table ``name`` in a session that doesn't know it yet."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (hash_prefix STRING, hash STRING, size INT, data BINARY) USING parquet "
        f"CLUSTERED BY (hash) SORTED BY (hash) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)


def fetch_chunks(wanted: DataFrame, store: DataFrame, bucketed: bool = False) -> DataFrame:
    """Bytes per requested hash; a missing hash gives empty bytes and ``found = false``.

    With ``bucketed`` the join is by the bucket column alone, so the bytes stay in their buckets.
    """
    keys = ["hash"] if bucketed else ["hash_prefix", "hash"]
    req = wanted.select("hash").distinct().withColumn("hash_prefix", hash_prefix("hash")).select(*keys)
    got = store.select(*keys, "data")
    return req.join(got, keys, "left").select(
        "hash",
        F.col("data").isNotNull().alias("found"),
        F.coalesce("data", F.lit(b"").cast("binary")).alias("data"),
    )


def upload_complete(manifest: DataFrame, announced: DataFrame, file_keys: list[str]) -> DataFrame:
    """Manifest row count equals the announced ``total_chunks`` (no gap check)."""
    got = manifest.groupBy(*file_keys).agg(F.count(F.lit(1)).cast("int").alias("received_chunks"))
    return (
        announced.select(*file_keys, "total_chunks")
        .join(got, file_keys, "left")
        .select(
            *file_keys,
            "total_chunks",
            F.coalesce("received_chunks", F.lit(0)).alias("received_chunks"),
        )
        .withColumn("complete", F.col("received_chunks") == F.col("total_chunks"))
    )


def reassemble(manifest: DataFrame, store: DataFrame, file_keys: list[str], with_content: bool = False) -> DataFrame:
    """Manifest joined to the store, each file's bytes put together in
    ``chunk_index`` order.

    Rows are hash-partitioned by file and sorted by index; one Arrow pass feeds
    the chunks of each file into an incremental SHA-256 (memory: one chunk; one
    file with ``with_content``, which adds the bytes as ``content``).  A hash
    chains, so one file's chunks pass through one task.  A missing or empty chunk
    fails the file (``ok = false``, size, hash and content NULL).
    Output: ``file_keys..., chunks, ok, size, hash[, content]``.
    """
    blobs = store.select("hash", "data")
    joined = manifest.select(*file_keys, "chunk_index", "hash").join(blobs, "hash", "left")
    ordered = (
        joined.select(*file_keys, "chunk_index", "data")
        .repartition(*file_keys)
        .sortWithinPartitions(*file_keys, "chunk_index")
    )
    out_schema = T.StructType(
        [ordered.schema[k] for k in file_keys]
        + [
            T.StructField("chunks", T.IntegerType(), False),
            T.StructField("ok", T.BooleanType(), False),
            T.StructField("size", T.LongType(), True),
            T.StructField("hash", T.StringType(), True),
        ]
        + ([T.StructField("content", T.BinaryType(), True)] if with_content else [])
    )
    n_keys = len(file_keys)
    data_pos = n_keys + 1

    def run(batches):
        cur, digest, size, count, bad = None, None, 0, 0, False
        pieces = []
        out = {f.name: [] for f in out_schema.fields}

        def emit():
            for i, k in enumerate(file_keys):
                out[k].append(cur[i])
            out["chunks"].append(count)
            out["ok"].append(not bad)
            out["size"].append(None if bad else size)
            out["hash"].append(None if bad else digest.hexdigest())
            if with_content:
                out["content"].append(None if bad else b"".join(pieces))
            pieces.clear()

        def flush():
            cols = [pa.array(out[f.name], type=types[f.name]) for f in out_schema.fields]
            for v in out.values():
                v.clear()
            return pa.RecordBatch.from_arrays(cols, names=[f.name for f in out_schema.fields])

        types = {"chunks": pa.int32(), "ok": pa.bool_(), "size": pa.int64(), "hash": pa.string(), "content": pa.binary()}
        for rb in batches:
            for i, k in enumerate(file_keys):
                types[k] = rb.schema.field(i).type
            keys = list(zip(*[rb.column(i).to_pylist() for i in range(n_keys)]))
            offsets, data, nulls = _binary_parts(rb.column(data_pos))
            nulls = nulls.to_numpy(zero_copy_only=False)
            for r, key in enumerate(keys):
                if key != cur:
                    if cur is not None:
                        emit()
                    cur, digest, size, count, bad = key, hashlib.sha256(), 0, 0, False
                count += 1
                a, b = int(offsets[r]), int(offsets[r + 1])
                if nulls[r] or b == a:
                    bad = True
                elif not bad:
                    digest.update(data[a:b])
                    size += b - a
                    if with_content:
                        pieces.append(data[a:b].tobytes())
            if len(out["chunks"]):
                yield flush()
        if cur is not None:
            emit()
            yield flush()

    return ordered.mapInArrow(run, out_schema)


def finalize_files(
    reassembled: DataFrame, complete: DataFrame, file_keys: list[str], finalized_at: int | None = None
) -> DataFrame:
    """Files rows for uploads that are complete and rebuilt (``reassemble`` output).

    size and whole-file SHA-256 of the rebuilt bytes, ``version = 1``,
    ``deleted = false``, mtime = ``finalized_at`` (F9: pass it in; only when it
    is omitted the query's start time is used).  An announced total of 0
    finalises to the empty file.
    """
    mtime = F.unix_timestamp() if finalized_at is None else F.lit(finalized_at)
    done = complete.where("complete").select(*file_keys, "total_chunks")
    j = done.join(reassembled, file_keys, "left")
    empty = F.col("total_chunks") == 0
    good = j.where(empty | F.col("ok"))
    return good.select(
        *file_keys,
        F.when(empty, F.lit(0)).otherwise(F.col("size")).cast("long").alias("size"),
        mtime.cast("long").alias("modified_time"),
        F.when(empty, F.sha2(F.lit(b"").cast("binary"), 256)).otherwise(F.col("hash")).alias("hash"),
        F.lit(1).alias("version"),
        F.lit(False).alias("is_directory"),
        F.lit(False).alias("deleted"),
        F.lit(0).cast("long").alias("last_sync_time"),
    )


def write_client_files(
    manifest: DataFrame, store: DataFrame, complete: DataFrame, root: str, file_keys: tuple[str, str] = ("client_id", "file_path")
) -> DataFrame:
    """Write the files of complete uploads below ``root/clients/<id>/<path>``.

    The chunks of each file stream from the store into it, in order of their index; a file with
    a missing or empty chunk isn't written, one announced with 0 chunks is written empty.
    Returns ``(client_id, path, size, hash)`` of the files written (two phases, see
    ``sources.client_files``); with a bucketed store the bytes move once, to their file.
    """
    client, path = file_keys
    done = complete.where("complete").select(*file_keys, "total_chunks")
    chunks = manifest.select(*file_keys, "chunk_index", "hash").join(done.where("total_chunks > 0").select(*file_keys), list(file_keys), "left_semi")
    with_data = chunks.join(store.select("hash", "data"), "hash", "left").select(*file_keys, "chunk_index", "data")
    empty = done.where("total_chunks = 0").select(*file_keys, F.lit(None).cast("int").alias("chunk_index"), F.lit(None).cast("binary").alias("data"))
    rows = with_data.unionByName(empty).select(F.col(client).alias("client_id"), F.col(path).alias("file_path"), "chunk_index", "data")
    return client_files.publish(manifest.sparkSession, root, client_files.write_files(rows, root))


def storage_stats(store: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """A5: stored chunks and bytes; plus the two fields the reference leaves at 0:
    live file count and bytes saved by dedup (manifest bytes - stored bytes).

    The three inputs are tagged and unioned into one global aggregate.
    """
    rows = (
        store.select(F.lit(1).alias("__k"), F.col("size").cast("long").alias("__v"))
        .unionByName(manifest.select(F.lit(2).alias("__k"), F.col("size").cast("long").alias("__v")))
        .unionByName(files.where(~F.col("deleted")).select(F.lit(3).alias("__k"), F.lit(1).cast("long").alias("__v")))
    )
    g = rows.agg(
        F.count_if(F.col("__k") == 1).cast("long").alias("total_chunks"),
        F.coalesce(F.sum(F.when(F.col("__k") == 1, F.col("__v"))), F.lit(0)).cast("long").alias("total_bytes"),
        F.count_if(F.col("__k") == 3).cast("long").alias("total_files"),
        F.coalesce(F.sum(F.when(F.col("__k") == 2, F.col("__v"))), F.lit(0)).cast("long").alias("__referenced"),
    )
    return g.select(
        "total_chunks", "total_bytes", "total_files",
        (F.col("__referenced") - F.col("total_bytes")).alias("deduplicated_bytes"),
    )


def apply_delta(chunk_lists: DataFrame, payloads: DataFrame, file_keys: list[str]) -> DataFrame:
    """Cut each file's payload by its chunk sizes in list order.

    Offsets are the running sum of sizes (own offsets ignored), so the
    pieces tile the payload from byte 0 and their concatenation is the
    payload's first ``sum(size)`` bytes: one partial aggregate per file and
    one join to the payload, never a copy of the payload per chunk (``content`` is
    NULL-free where ``ok``).  The
    file fails when the sizes overrun the payload; trailing bytes are ignored.
    """
    need = chunk_lists.groupBy(*file_keys).agg(
        F.count(F.lit(1)).cast("int").alias("__chunks"),
        F.sum("size").cast("long").alias("__need"),
    )
    # every payload has a result: an empty chunk list writes an empty file
    j = payloads.select(*file_keys, "payload").join(need, file_keys, "left")
    needed = F.coalesce("__need", F.lit(0))
    ok = needed <= F.length("payload")
    written = F.substring("payload", 1, needed.cast("int"))
    return j.select(
        *file_keys,
        F.coalesce("__chunks", F.lit(0)).alias("chunks"),
        F.length("payload").cast("long").alias("payload_size"),
        ok.alias("ok"),
        F.when(ok, needed).alias("written_bytes"),
        F.when(ok, F.sha2(written, 256)).alias("hash"),
        F.when(ok, written).alias("content"),
    )
