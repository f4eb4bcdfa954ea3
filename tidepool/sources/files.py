"""Files of any size, listed and read in tasks.

``binaryFile`` lists on the driver and holds each file as one value of 2 GB at most.  Here
folders are listed level by level in tasks, and a file is read as a stream: hashes
(``scan``) and chunks (``operators.chunking.cdc_file_chunks``) hold ``READ_BYTES`` of it,
``segments`` gives ordered byte ranges as rows, each range read by itself.

Tasks open files with ``pyarrow.fs`` (local, HDFS, S3, GCS, Azure); mount points such as
``viewfs`` are resolved to the store behind them first.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.session import work_dir

READ_BYTES = 8 << 20
LISTING = "path string, is_dir boolean, size long, modified_us long"
TASK_BYTES = 256 << 20  # bytes that one task reads, files permitting


def resolved(spark: SparkSession, path: str) -> str:
    """The path behind mount points, with its scheme; a missing path is only qualified."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return (fs.resolvePath(p) if fs.exists(p) else fs.makeQualified(p)).toString()


def store_of(uri: str):
    """(pyarrow file system, path in it) of a URI or local path, taken literally (nothing is unescaped)."""
    from pyarrow import fs

    if uri.startswith(("file:", "/")):
        return fs.LocalFileSystem(), "/" + re.sub(r"^file:", "", uri).lstrip("/")
    scheme, rest = uri.split("://", 1)
    authority, _, path = rest.partition("/")
    store, base = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return store, f"{base.rstrip('/')}/{path}"


def _listed(batches, hidden: bool):
    from pyarrow import fs

    for rb in batches:
        rows = []
        for uri in rb.column(0).to_pylist():
            store, path = store_of(uri)
            info = store.get_file_info(path)
            if info.type == fs.FileType.NotFound:
                continue
            inside = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path))
            root = uri if info.type == fs.FileType.File else uri.rstrip("/") + "/"
            for f in inside:
                if hidden or not f.base_name.startswith(("_", ".")):
                    is_dir = f.type == fs.FileType.Directory
                    name = root if f is info else root + f.base_name
                    rows.append((name, is_dir, 0 if is_dir else f.size, (f.mtime_ns or 0) // 1000))
        cols = list(zip(*rows)) or [()] * 4
        types = (pa.string(), pa.bool_(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["path", "is_dir", "size", "modified_us"])


def list_files(spark: SparkSession, root: str, hidden: bool = False) -> DataFrame:
    """(path, size, modified_us) of all files below ``root``, at any depth, empty ones included.

    A round per level of folders, its folders dealt out to tasks; the driver sees only
    whether there is a next level.  A missing root has no files.  Names that start
    with ``_`` or ``.`` are left out unless ``hidden``.
    """
    work, level = work_dir(spark, "listing"), 0
    folders = spark.createDataFrame([(resolved(spark, root),)], "path string")
    tasks = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    while True:
        found = folders.mapInArrow(lambda b: _listed(b, hidden), LISTING)
        found.write.parquet(f"{work}/level={level}")
        below = spark.read.schema(LISTING).parquet(f"{work}/level={level}").where("is_dir").select("path")
        if below.isEmpty():
            break
        folders, level = below.repartition(tasks), level + 1
    return spark.read.schema(LISTING).parquet(*[f"{work}/level={k}" for k in range(level + 1)]).where("not is_dir").select("path", "size", "modified_us")


def dealt(listing: DataFrame) -> DataFrame:
    """The listing in so many partitions that each has about ``TASK_BYTES``; a larger file is one task's."""
    total = listing.agg(F.coalesce(F.sum("size"), F.lit(0))).collect()[0][0]
    tasks = max(int(listing.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    return listing.repartition(tasks, "path")


def pieces(uri: str, start: int = 0, size: int | None = None):
    """The bytes of a file from ``start`` on, ``READ_BYTES`` at a time, to ``size`` bytes or its end."""
    store, path = store_of(uri)
    with store.open_input_file(path) as f:
        f.seek(start)
        left = f.size() - start if size is None else size
        while left > 0:
            data = f.read(min(READ_BYTES, left))
            if not data:
                return
            left -= len(data)
            yield data


def scan(listing: DataFrame, client_id: str = "local") -> DataFrame:
    """A ``files`` row per listed file, its SHA-256 chained over the stream."""

    def run(batches):
        for rb in batches:
            sizes, hashes = [], []
            for path in rb.column(0).to_pylist():
                digest, size = hashlib.sha256(), 0
                for data in pieces(path):
                    digest.update(data)
                    size += len(data)
                sizes.append(size)
                hashes.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), pa.array(sizes, pa.int64()), rb.column(1), pa.array(hashes, pa.string())], names=["path", "size", "modified_us", "hash"]
            )

    rows = dealt(listing).select("path", "modified_us").mapInArrow(run, "path string, size long, modified_us long, hash string")
    return rows.select(
        F.lit(client_id).alias("client_id"), "path", "size", F.floor(F.col("modified_us") / 1_000_000).alias("modified_time"), "hash",
        F.lit(1).alias("version"), F.lit(False).alias("is_directory"), F.lit(False).alias("deleted"), F.lit(0).cast("long").alias("last_sync_time"),
    )


def segments(listing: DataFrame, segment_bytes: int = READ_BYTES) -> DataFrame:
    """(path, seg, offset, content): the files as ordered byte ranges, each read by itself in any task.

    An empty file has no range.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(segment_bytes).cast("long"))
    ranges = listing.where("size > 0").select("path", F.posexplode(starts).alias("seg", "offset"))
    total = listing.agg(F.coalesce(F.sum("size"), F.lit(0))).collect()[0][0]
    tasks = max(int(listing.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))

    def run(batches):
        for rb in batches:
            for r, (path, offset) in enumerate(zip(rb.column(0).to_pylist(), rb.column(2).to_pylist())):
                data = b"".join(pieces(path, offset, segment_bytes))
                yield pa.RecordBatch.from_arrays([*[c.slice(r, 1) for c in rb.columns], pa.array([data], pa.binary())], names=[*rb.schema.names, "content"])

    return ranges.repartition(tasks, "path", "seg").mapInArrow(run, "path string, seg int, offset long, content binary")
