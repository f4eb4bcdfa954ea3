"""Delta and dedup over chunk tables: J1, J2, J5, J7, J8, A2, A3, A4, A12.

All membership tests are hash equi-joins on ``hash`` (semi/anti/marker joins);
Catalyst/AQE choose broadcast or shuffled joins from runtime sizes.  Chunk
bytes never ride through these shuffles: only ``hash`` and ``size`` do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_hashes(chunks: DataFrame) -> DataFrame:
    """The set of chunk hashes (partial distinct before the shuffle)."""
    return chunks.select("hash").distinct()


def mark_new(local: DataFrame, server_hashes: DataFrame, keys: list[str] = ()) -> DataFrame:
    """J1+J2 in one pass: every local chunk with ``is_new`` = hash not on the server.

    Multiset semantics: a new hash occurring twice in a file stays twice.
    The server side is reduced to distinct hashes first, so the left join
    cannot multiply local rows.
    """
    on = [*keys, "hash"]
    known = server_hashes.select(*on).distinct().withColumn("__known", F.lit(True))
    return local.join(known, on, "left").withColumn("is_new", F.col("__known").isNull()).drop("__known")


def delta_new(local: DataFrame, server_hashes: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Local chunks whose hash the server lacks (duplicates kept).

    ``keys`` scopes the server set (e.g. per file path); empty = one global set.
    """
    on = [*keys, "hash"]
    return local.join(server_hashes.select(*on).distinct(), on, "left_anti")


def delta_existing(local: DataFrame, server_hashes: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Local chunks whose hash the server already has."""
    on = [*keys, "hash"]
    return local.join(server_hashes.select(*on).distinct(), on, "left_semi")


def _both_sides(old_chunks: DataFrame, new_chunks: DataFrame, keys: list[str], files: DataFrame | None) -> DataFrame:
    """Per (file, hash): counts, bytes and size on each side, from one tagged union.

    One shuffle with partial aggregation, no join: a hash is new if the old side
    counts none.  ``files`` (optional) adds a row per file, so files without chunks
    on either side are reported, too.
    """
    side = lambda df, old: df.select(*keys, "hash", F.lit(old).alias("__old"), F.lit(1).alias("__c"), F.col("size").cast("long").alias("__s"))
    rows = side(old_chunks, True).unionByName(side(new_chunks, False))
    if files is not None:
        rows = rows.unionByName(files.select(
            *keys, F.lit(None).cast("string").alias("hash"), F.lit(True).alias("__old"), F.lit(0).alias("__c"), F.lit(0).cast("long").alias("__s")
        ))
    old = F.col("__old")
    return rows.groupBy(*keys, "hash").agg(
        F.sum(F.when(old, F.col("__c")).otherwise(0)).alias("old_n"),
        F.sum(F.when(old, F.col("__s")).otherwise(0)).alias("old_bytes"),
        F.sum(F.when(~old, F.col("__c")).otherwise(0)).alias("new_n"),
        F.sum(F.when(~old, F.col("__s")).otherwise(0)).alias("new_bytes"),
        F.max("__s").alias("size"),
    )


def delta_summary(old_chunks: DataFrame, new_chunks: DataFrame, keys: list[str], files: DataFrame | None = None) -> DataFrame:
    """A3: per file new/existing counts and ``bytes_to_transfer`` (duplicates charged).

    ``distinct_new_bytes`` counts each new hash once per file (an extra column).
    A file of ``files`` without new chunks (emptied by the edit) reports zeros.
    """
    is_new = F.col("old_n") == 0
    pick = lambda when, col: F.sum(F.when(when, F.col(col)).otherwise(0)).cast("long")
    return _both_sides(old_chunks, new_chunks, keys, files).groupBy(*keys).agg(
        pick(is_new, "new_n").alias("new_chunks"),
        pick(~is_new, "new_n").alias("existing_chunks"),
        pick(is_new, "new_bytes").alias("bytes_to_transfer"),
        pick(is_new & (F.col("new_n") > 0), "size").alias("distinct_new_bytes"),
    )


def bandwidth_reduction(old_chunks: DataFrame, new_chunks: DataFrame, keys: list[str], files: DataFrame | None = None) -> DataFrame:
    """A4: per file ``100 * (1 - new_bytes / original_bytes)`` of a version change.

    The server set is the old version's hashes of the same file; files with
    a zero-byte original give NULL (``try_divide``).
    """
    is_new = F.col("old_n") == 0
    total = lambda col: F.sum(col).cast("long")
    g = _both_sides(old_chunks, new_chunks, keys, files).groupBy(*keys).agg(
        total("old_n").alias("original_chunks"),
        total("new_n").alias("modified_chunks"),
        total(F.when(is_new, F.col("new_n")).otherwise(0)).alias("new_chunks"),
        total("old_bytes").alias("original_bytes"),
        total(F.when(is_new, F.col("new_bytes")).otherwise(0)).alias("new_bytes"),
    )
    share = F.try_divide(F.col("new_bytes").cast("double"), F.col("original_bytes").cast("double"))
    return g.withColumn("bandwidth_reduction", F.lit(100.0) * (F.lit(1.0) - share))


def dedup_report(chunks: DataFrame) -> DataFrame:
    """A2: total/unique chunks and bytes, ratio = saving = 100 * (1 - unique/total).

    Two-stage: a partial+final aggregate by hash (hot hashes such as zero
    blocks collapse map-side), then one global sum over distinct hashes.
    """
    per_hash = chunks.groupBy("hash").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("size").alias("bytes"),
        F.min("size").alias("first_size"),
    )
    g = per_hash.agg(
        F.sum("n").cast("long").alias("total_chunks"),
        F.count(F.lit(1)).cast("long").alias("unique_chunks"),
        F.sum("bytes").cast("long").alias("total_bytes"),
        F.sum("first_size").cast("long").alias("unique_bytes"),
    )
    ratio = F.lit(100.0) * (F.lit(1.0) - F.try_divide(F.col("unique_bytes").cast("double"), F.col("total_bytes").cast("double")))
    return g.select(
        F.coalesce("total_chunks", F.lit(0)).alias("total_chunks"),
        F.coalesce("unique_chunks", F.lit(0)).alias("unique_chunks"),
        F.coalesce("total_bytes", F.lit(0)).alias("total_bytes"),
        F.coalesce("unique_bytes", F.lit(0)).alias("unique_bytes"),
        ratio.alias("dedup_ratio"),
        ratio.alias("storage_saving"),
    )


def chunk_exists(probe: DataFrame, manifest: DataFrame, store: DataFrame) -> DataFrame:
    """Per probed hash, presence in the manifest (a) and in the chunk store (b).

    Two marker joins against distinct hash sets; (a) and (b) can disagree.
    """
    in_manifest = manifest.select("hash").distinct().withColumn("in_manifest", F.lit(True))
    in_store = store.select("hash").distinct().withColumn("in_store", F.lit(True))
    return (
        probe.select("hash").distinct()
        .join(in_manifest, "hash", "left")
        .join(in_store, "hash", "left")
        .select(
            "hash",
            F.coalesce("in_manifest", F.lit(False)).alias("in_manifest"),
            F.coalesce("in_store", F.lit(False)).alias("in_store"),
        )
    )


def identical_files(files: DataFrame, keys: list[str]) -> DataFrame:
    """J8 set form: files sharing a whole-file SHA-256 with another file.

    One row per such file with its group size; pairs are never emitted.
    The "missing" hash ``""`` never matches.  The group count is a hash
    aggregate (partial before the shuffle), so a hash shared by a third of
    all files reduces map-side; the join back is skew-split by AQE.
    """
    valid = files.where(F.col("hash") != "")
    groups = valid.groupBy("hash").agg(F.count(F.lit(1)).cast("long").alias("copies")).where(F.col("copies") > 1)
    return valid.select(*keys, "hash").join(groups, "hash", "inner")


def download_status(requests: DataFrame, files: DataFrame) -> DataFrame:
    """J7 status per requested ``(client_id, path)``: ``OK`` when a files row
    exists (tombstoned files included, as the metadata lookup returns them),
    ``NOT_FOUND`` otherwise."""
    known = files.select("client_id", "path").distinct().withColumn("__k", F.lit(True))
    return (
        requests.select("client_id", "path").distinct()
        .join(known, ["client_id", "path"], "left")
        .select("client_id", "path", F.when(F.col("__k"), "OK").otherwise("NOT_FOUND").alias("status"))
    )


def download_response(requests: DataFrame, files: DataFrame, manifest: DataFrame, client_hashes: DataFrame,
                      file_keys: list[str]) -> DataFrame:
    """J7 as one result: the status of every requested file with its remaining chunks.

    A known file without anything left has one row with NULL chunk columns, and so
    does a file that isn't found.  ``is_last`` marks
    the highest remaining index of a file.
    """
    status = download_status(requests, files).withColumnsRenamed({"client_id": file_keys[0], "path": file_keys[1]})
    return status.join(download_plan(manifest, client_hashes, file_keys), file_keys, "left")


def download_plan(manifest: DataFrame, client_hashes: DataFrame, file_keys: list[str]) -> DataFrame:
    """The chunks of each file that the client does not hold yet.

    ``client_hashes`` carries the file keys and the hashes the client has;
    ``is_last`` marks the highest remaining index per file.
    """
    need = manifest.join(client_hashes.select(*file_keys, "hash").distinct(), [*file_keys, "hash"], "left_anti")
    # both readers of ``need`` share the exchanges below its join; a file's maximum needs no window over the file
    last = need.groupBy(*file_keys).agg(F.max("chunk_index").alias("__last"))
    return need.join(last, file_keys).select(
        *file_keys, "chunk_index", "hash", "size", (F.col("chunk_index") == F.col("__last")).alias("is_last")
    )
