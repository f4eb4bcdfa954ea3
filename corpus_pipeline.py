"""Corpus pipeline: quality rules, near-dedup, decontamination, mixing, token files.

Every stage takes all rows that the one before it kept, and its decisions take
effect in what it returns; results are written as Parquet between stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import op05_decontaminate, op06_minhash, op07_quality, op09_token_files, op10_mixing
from tidepool.llm.common import shared_dir, stored, table, text_of, unused

TOKENIZER = "word_bpe_49k.json"
NEAR_PERCENT = 80  # similarity of five-word shingle sets from which documents are near copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines."""
    out = unused(docs, "quality")
    q = F.col(out)
    judged = op07_quality.judged(docs, out=out).filter(q["kept"])
    changed = q["n_bad_lines"] > 0
    return judged.withColumns({
        "text": F.when(changed, q["cleaned"]).otherwise(F.col("text")),
        "n_chars": F.when(changed, F.length(q["cleaned"])).otherwise(F.col("n_chars")),
    }).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; rows are told apart by id and text, so
    that texts under a shared id, or under none, are documents of their own."""
    first = op06_minhash.judged(docs, percent=NEAR_PERCENT).filter("first").select("doc_id", "text_key")
    first = stored(first, "groups")
    own_id, key = unused(docs, "kept_id"), unused(docs, "kept_key")
    # as many rows as documents: not to be sent to every task, whatever a small run's estimate says
    kept = first.select(F.col("doc_id").alias(own_id), F.col("text_key").alias(key)).distinct().hint("merge")
    text_key = F.unhex(F.sha2(text_of("text"), 256))
    left = docs.join(kept, F.col("doc_id").eqNullSafe(F.col(own_id)) & (text_key == F.col(key)), "left_semi")
    if first.groupBy("doc_id", "text_key").count().filter("count > 1").isEmpty():
        return left
    return left.withColumn(key, text_key).dropDuplicates(["doc_id", key]).drop(key)  # repeated rows


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that hold benchmark windows."""
    clean = op05_decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows that share an id share its copies."""
    own_id, total, rows, copies, copy = (unused(docs, n) for n in ("mix_id", "mix_total", "mix_rows", "mix_copies", "mix_copy"))
    mixed = op10_mixing.mixed(docs).groupBy("doc_id").agg(F.sum("copies").alias(total), F.count(F.lit(1)).alias(rows)).withColumnRenamed("doc_id", own_id)
    share = F.floor(F.col(total) / F.col(rows)) + (F.pmod(F.xxhash64("text"), F.col(rows)) < F.col(total) % F.col(rows)).cast("long")
    taken = docs.join(mixed, F.col("doc_id").eqNullSafe(F.col(own_id))).withColumn(copies, share.cast("int")).filter(F.col(copies) > 0)
    return taken.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), F.col(copies))).alias(copy)).drop(copy)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; one row per document as read back from them."""
    import public_tokenizers

    path = shared_dir(spark, "token-files")
    op09_token_files.write_files(docs, path, public_tokenizers.path(TOKENIZER))
    return op09_token_files.read_documents(spark, path)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("token_files", token_files),
]

# token ids come from a library and files: not in SQL's reach; tests hold run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
