"""File and manifest tables: S2, S3, S10, S11, S12, P1, P2, W1, W2.

Upserts are "latest row per key" over a log, a top-1 per key that Spark
plans with a partial limit before the shuffle, so a hot key (one path
written a million times) collapses map-side instead of landing whole in
one task.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.schemas import FILE_COLS


def latest_per_key(log: DataFrame, keys: list[str], order: list[str], first: bool = False) -> DataFrame:
    """INSERT OR REPLACE over a log; the row with the greatest ``order`` wins
    (the smallest with ``first=True``).

    ``row_number() = 1`` is planned with a partial ``WindowGroupLimit`` before
    the shuffle: every map task keeps only its top row per key, so a key that
    holds a third of the log still reduces map-side, and no struct-typed
    sort aggregate is needed.
    """
    direction = F.asc if first else F.desc
    w = Window.partitionBy(*keys).orderBy(*[direction(c) for c in order])
    return log.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def upsert_files(base: DataFrame, updates: DataFrame, order: str) -> DataFrame:
    """Whole-row replace by ``(client_id, path)``; updates win over the base,
    and of several updates of a path the one with the greatest ``order`` does."""
    log = base.select(*FILE_COLS, F.lit(None).cast(updates.schema[order].dataType).alias("__seq")).unionByName(
        updates.select(*FILE_COLS, F.col(order).alias("__seq"))
    )
    return latest_per_key(log, ["client_id", "path"], ["__seq"]).drop("__seq")


def upsert_manifest(log: DataFrame, order: list[str]) -> DataFrame:
    """Whole-row replace by ``(client_id, file_path, chunk_index)``.

    The stored offset stays as written (the server writes 0); W1 recomputes it.
    """
    cols = ["client_id", "file_path", "chunk_index", "hash", "offset", "size"]
    latest = latest_per_key(log.select(*cols, *order), ["client_id", "file_path", "chunk_index"], order)
    return latest.select(*cols)


def _blocked_prefix(manifest: DataFrame, keys: list[str], value, out: str, block: int) -> DataFrame:
    """Exclusive running sum of ``value`` in ``chunk_index`` order per file,
    computed in two levels so no window partition exceeds ``block`` rows:
    totals per (file, index block) -> running sum over blocks -> running sum
    inside each (file, block).  A file holding a third of all chunks is
    split into many small window partitions instead of one huge one."""
    b = F.floor(F.col("chunk_index") / F.lit(block)).cast("long")
    # rows without a file or an index have no place; the join would infer this for one of its sides only
    placed = reduce(and_, [F.col(c).isNotNull() for c in (*keys, "__b")])
    rows = manifest.withColumn("__b", b).withColumn("__v", value).where(placed).repartition(*keys, "__b")
    # totals and rows read this one exchange by (file, block): the checksum refers to every column, else the
    # totals would ask for a narrower exchange of their own and everything below would run twice
    per_block = rows.groupBy(*keys, "__b").agg(F.sum("__v").alias("__bt"), F.bit_xor(F.xxhash64(*rows.columns)).alias("__sum"))
    per_block = per_block.where(F.col("__sum").isNotNull())
    over_blocks = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_block.select(*keys, "__b", F.coalesce(F.sum("__bt").over(over_blocks), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*keys, "__b").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(starts, [*keys, "__b"])
        .withColumn(out, (F.col("__base") + F.coalesce(F.sum("__v").over(inside), F.lit(0))).cast("long"))
        .drop("__b", "__v", "__base")
    )


def chunk_offsets(manifest: DataFrame, block: int = 4096) -> DataFrame:
    """Running byte offset in index order, per file (exclusive prefix sum of sizes)."""
    cols = manifest.columns
    out = _blocked_prefix(manifest.drop("offset"), ["client_id", "file_path"], F.col("size"), "offset", block)
    return out.select(*cols)


def live_files(files: DataFrame, client_id: str | None = None) -> DataFrame:
    """Files that are not tombstoned, optionally of one client (partition pruning)."""
    out = files.where(~F.col("deleted"))
    return out if client_id is None else out.where(F.col("client_id") == client_id)


def file_chunks(manifest: DataFrame, block: int = 4096) -> DataFrame:
    """S3/O1: each file's chunk hashes in index order, as ranked rows
    (``position`` 1..n), with the same two-level split as W1."""
    base = manifest.select("client_id", "file_path", "chunk_index", "hash")
    out = _blocked_prefix(base, ["client_id", "file_path"], F.lit(1), "__before", block)
    return out.select("client_id", "file_path", "chunk_index", "hash", (F.col("__before") + 1).cast("int").alias("position"))


def file_metadata(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records for the requested ``(client_id, path)`` set; tombstones included."""
    return files.join(wanted.select("client_id", "path").distinct(), ["client_id", "path"], "left_semi")


def modified_since(files: DataFrame, since: int | Column) -> DataFrame:
    """``modified_time > since`` (strict); tombstones included."""
    return files.where(F.col("modified_time") > since)


def tombstone(files: DataFrame, paths: DataFrame) -> DataFrame:
    """Set ``deleted`` for the requested paths; other columns untouched.

    Paths without a file change nothing.  The request side is reduced to
    distinct keys before the marker join so it cannot duplicate rows.
    """
    hit = paths.select("client_id", "path").distinct().withColumn("__hit", F.lit(True))
    return (
        files.join(hit, ["client_id", "path"], "left")
        .withColumn("deleted", F.col("deleted") | F.coalesce("__hit", F.lit(False)))
        .select(*FILE_COLS)
    )


def file_hashes(files: DataFrame, requested: DataFrame) -> DataFrame:
    """F3 for a set of paths: whole-file SHA-256 per requested ``(client_id, path)``.

    An empty file has the hash of zero bytes; only a path without a file gets ``""``.
    """
    have = files.select("client_id", "path", F.sha2(F.coalesce("content", F.lit(b"").cast("binary")), 256).alias("__h"))
    return (
        requested.select("client_id", "path").distinct()
        .join(have, ["client_id", "path"], "left")
        .select("client_id", "path", F.coalesce("__h", F.lit("")).alias("hash"))
    )


def write_client_tables(files: DataFrame, root: str, mode: str = "append") -> None:
    """The per-client metadata tables as one parquet table partitioned
    by ``client_id`` (``root/client_id=<id>/``); readers filtering one client
    prune to its folder."""
    files.repartition("client_id", "path").write.mode(mode).partitionBy("client_id").parquet(root)
