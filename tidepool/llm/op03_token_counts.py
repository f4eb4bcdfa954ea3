"""Token counts through a digest cache.

Every text is named by the SHA-256 of its content and the tokenizer by the SHA-256
of its file and library version.  Both digests are joined to the counts stored so
far; of the texts without one, each distinct text is encoded once (under null ids
once a row), and its count is appended to the cache (a Parquet table in a folder the caller names).  Later runs,
with the same or with overlapping texts, encode only what is new; another tokenizer
never meets this one's counts.

Content is normalised only so far as counts allow: null is empty, text is UTF-8.

Texts travel once, by (id, digest), so copies of one text never meet in a task;
digests alone meet for the cache.  Appends are whole Parquet commits and reads take
one count per digest, so a repeated append does no harm.

Cases: null and empty texts have 0 tokens; repeated rows are counted alike; null
ids are kept; an empty table gives no rows and leaves the cache as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidepool.llm.common import shared_dir, slices, stored, table, text_of
from tidepool.llm.tokens import file_digest, pieces

LIMIT = 1024
ROWS = 256
CACHE = "tokenizer string, digest binary, n_tokens long"


def _cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) stored for one tokenizer; empty before the first append."""
    try:
        rows = spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE)
    return rows.filter(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in slices(batches, ROWS):
            counts = [p.count(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return count


def counted(docs: DataFrame, tokenizer_file: str, cache: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens), one row per document row; misses are appended to ``cache``."""
    spark = docs.sparkSession
    version = file_digest(tokenizer_file)
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    names = rows.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    known = _cache(spark, cache, version)
    misses = names.groupBy("digest").agg(F.min("id").alias("rep")).join(known, "digest", "left_anti")
    first = misses.select(F.col("digest").alias("d"), "rep")
    todo = rows.join(first, (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("rep")), "left_semi").select("digest", "text")
    # copies under one id are still there; they meet as digests only
    new = todo.mapInArrow(_counter(tokenizer_file), "digest binary, n_tokens long").groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    new.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    # written out, so that the join meets a plain exchange: copies of one text are many rows of one digest,
    # which Spark deals out to several tasks only then
    counts = stored(_cache(spark, cache, version), "counts")
    return names.join(counts, "digest", "left").select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = counted(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), shared_dir(spark, "token-counts"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
