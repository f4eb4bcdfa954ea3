"""Sources: driver parquet tables, binary files, and the file-sync views built on them.

Every view is a declarative projection over the parquet scan, so Catalyst
prunes columns and pushes filters into the reader; nothing is materialised.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions.timeutil import ntz_to_instant


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _empty_files(spark: SparkSession, path_glob: str) -> DataFrame:
    """(path, modificationTime) of zero-length files, which Spark's file scan leaves out."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path_glob)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = []
    for status in fs.globStatus(root) or []:
        listing = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        rows += [
            (f.getPath().toString(), f.getModificationTime()) for f in listing
            if f.isFile() and f.getLen() == 0 and not f.getPath().getName().startswith(("_", "."))
        ]
    return spark.createDataFrame(rows, "path string, ms long").select("path", F.timestamp_millis("ms").alias("modificationTime"))


def binary_files(spark: SparkSession, path_glob: str, client_id: str = "local") -> DataFrame:
    """Whole files as bytes (``binaryFile``) in the ``files`` shape plus ``content``.

    ``modificationTime`` becomes unix seconds; the hash is ``sha2`` on the bytes
    (F3).  Empty files are rows with empty content; missing paths give no rows.
    """
    empty = _empty_files(spark, path_glob).withColumns({"length": F.lit(0).cast("long"), "content": F.lit(b"").cast("binary")})
    try:
        raw = spark.read.format("binaryFile").load(path_glob).unionByName(empty)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raw = empty
    return raw.select(
        F.lit(client_id).alias("client_id"),
        F.col("path"),
        F.col("length").alias("size"),
        F.unix_timestamp("modificationTime").alias("modified_time"),
        F.sha2("content", 256).alias("hash"),
        F.lit(1).alias("version"),
        F.lit(False).alias("is_directory"),
        F.lit(False).alias("deleted"),
        F.lit(0).cast("long").alias("last_sync_time"),
        F.col("content"),
    )


def _doc_path() -> Column:
    return F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def _file_row(content: Column, version: Column, deleted: Column, modified_time: Column | None = None) -> list[Column]:
    return [
        F.col("source").alias("client_id"),
        _doc_path().alias("path"),
        F.length(content).cast("long").alias("size"),
        (F.col("doc_id") if modified_time is None else modified_time).alias("modified_time"),
        F.sha2(content, 256).alias("hash"),
        version.cast("int").alias("version"),
        F.lit(False).alias("is_directory"),
        deleted.alias("deleted"),
        F.lit(0).cast("long").alias("last_sync_time"),
    ]


def src_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as client files: path ``source/lang/doc_id.txt``, client = source."""
    d = table(spark, sf_dir, "documents")
    content = F.encode("text", "UTF-8")
    return d.select(F.col("doc_id"), *_file_row(content, F.lit(1), F.lit(False)), content.alias("content"))


def server_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The server's file table: all documents, some edited, some tombstoned, with times
    before, at and after the client's."""
    d = table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    mtime = F.col("doc_id") + (F.floor(F.col("doc_id") / 7) % 5 - 2) * 10
    return d.select(*_file_row(F.encode(text, "UTF-8"), F.lit(1), F.col("doc_id") % 11 == 0, mtime))


def server_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The server table for comparisons: every tenth document is the client's alone."""
    return server_files(spark, sf_dir).where(~F.col("path").rlike(r"/[0-9]*0[.]txt$"))


def local_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The client's list: 2 of 3 documents, version = doc_id mod 4; of some, a later entry
    repeats the path with other content.  ``list_pos`` is the position in the list."""
    d = table(spark, sf_dir, "documents").where(F.col("doc_id") % 3 != 0)
    entries = F.when(F.col("doc_id") % 15 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    d = d.withColumn("entry", F.explode(entries))
    text = F.when(F.col("entry") == 1, F.concat("text", F.lit(" later"))).otherwise(F.col("text"))
    return d.select(
        *_file_row(F.encode(text, "UTF-8"), F.col("doc_id") % 4, F.lit(False)), (F.col("doc_id") * 2 + F.col("entry")).alias("list_pos")
    )


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("page_id"), F.col("url").alias("path"), F.encode("html", "UTF-8").alias("content"))


def version_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """old_files / new_files: the same documents before and after an edit (some grow,
    some are cut to their first half, some are emptied)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    old = d.select(_doc_path().alias("path"), F.encode("text", "UTF-8").alias("content"))
    edited = (
        F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" edited")))
        .when(F.col("doc_id") % 7 == 3, F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int")))
        .when(F.col("doc_id") % 31 == 5, F.lit(""))
        .otherwise(F.col("text"))
    )
    new = d.select(_doc_path().alias("path"), F.encode(edited, "UTF-8").alias("content"))
    return old, new


def manifest_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a manifest change log; the key repeats, order columns break ties."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.lit("c0").alias("client_id"),
        F.col("l_orderkey").cast("string").alias("file_path"),
        F.col("l_linenumber").cast("int").alias("chunk_index"),
        F.sha2(F.col("l_partkey").cast("string"), 256).alias("hash"),
        F.lit(0).cast("long").alias("offset"),
        (F.lit(1) + F.col("l_partkey") % 1000).cast("int").alias("size"),
        F.col("l_shipdate"),
        F.col("l_partkey"),
        F.col("l_suppkey"),
    )


def conv_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as uploaded chunks: file = conv_id, index = turn, data = text bytes;
    some chunks come under a hash that isn't theirs."""
    c = table(spark, sf_dir, "conversations")
    data = F.encode("text", "UTF-8")
    wrong = (F.col("conv_id") % 13 == 5) & (F.col("turn") == 1)
    return c.select(
        F.lit("c0").alias("client_id"),
        F.col("conv_id").cast("string").alias("file_path"),
        F.col("turn").cast("int").alias("chunk_index"),
        F.col("conv_id"),
        F.col("role"),
        data.alias("data"),
        F.length(data).cast("int").alias("size"),
        F.sha2(F.when(wrong, F.encode(F.concat("text", F.lit("!")), "UTF-8")).otherwise(data), 256).alias("hash"),
    )


def announced(conv: DataFrame) -> DataFrame:
    """Announced totals of the uploads; some announce one chunk more than they send."""
    more = F.when(F.col("file_path").cast("long") % 9 == 4, 1).otherwise(0)
    return conv.groupBy("client_id", "file_path").agg((F.max("chunk_index") + 1).cast("int").alias("__n")).select(
        "client_id", "file_path", (F.col("__n") + more).cast("int").alias("total_chunks")
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", ntz_to_instant("ts"))


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a change feed: signup=CREATED, view/click=MODIFIED, purchase=RENAMED, error=DELETED."""
    return change_log_of(table(spark, sf_dir, "events"))


def change_log_of(events: DataFrame) -> DataFrame:
    """The change-feed projection of an events DataFrame (batch or streaming)."""
    e = events.withColumn("ts", ntz_to_instant("ts"))
    base = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/k"),
                    F.get_json_object("props", "$.k"))
    kind = (
        F.when(F.col("event_type") == "signup", "CREATED")
        .when(F.col("event_type").isin("view", "click"), "MODIFIED")
        .when(F.col("event_type") == "purchase", "RENAMED")
        .when(F.col("event_type") == "error", "DELETED")
    )
    renamed = F.col("event_type") == "purchase"
    return e.select(
        F.lit("c0").alias("client_id"),
        F.when(renamed, F.concat(base, F.lit(".r"))).otherwise(base).alias("path"),
        kind.alias("type"),
        F.when(renamed, base).alias("old_path"),
        F.struct(
            F.round(F.col("value") * 1000).cast("long").alias("size"),
            F.unix_timestamp("ts").alias("modified_time"),
            F.sha2(F.col("event_id").cast("string"), 256).alias("hash"),
            F.lit(1).alias("version"),
            F.lit(False).alias("is_directory"),
            F.lit(False).alias("deleted"),
            F.lit(0).cast("long").alias("last_sync_time"),
        ).alias("metadata"),
        F.col("event_id").alias("seq"),
    )


def transfer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfer_log_of(table(spark, sf_dir, "events"))


def transfer_log_of(events: DataFrame) -> DataFrame:
    """The transfer-log projection of an events DataFrame (batch or streaming)."""
    e = events.withColumn("ts", ntz_to_instant("ts"))
    return e.select(
        F.col("user_id").cast("string").alias("key"),
        F.col("ts"),
        F.col("event_id"),
        F.col("event_type"),
        F.round(F.col("value") * 1000).cast("long").alias("bytes"),
    )


def metrics_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.select(
        F.col("event_type").alias("name"),
        F.col("ts"),
        F.col("event_id"),
        F.round(F.col("value") * 100).cast("long").alias("value"),
    )
