"""A12 by sketches: distinct chunk hashes from HyperLogLog states that are stored and united.

Exact distinct counts (``delta.distinct_hashes``) read every hash again for every question.  A sketch
per group (say client and day) is built once, takes at most 2^``LG_K`` bytes however many hashes
it has seen, and the sketches of any groups unite to that of all their hashes: a count over a client,
a month or the whole store reads sketches only.  The standard error of a united sketch is 1.04 / sqrt(2^LG_K),
0.6 % with the default; few hashes are counted exactly.

Nulls are no hashes; a group without any has the estimate 0.  Repeated rows and repeated
delivery of a batch change nothing (``write_sketches`` replaces the batch).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LG_K = 15


def hash_sketches(chunks: DataFrame, groups: list[str | Column], hash_col: str = "hash", lg_k: int = LG_K) -> DataFrame:
    """``(groups..., n_hashes, sketch)``: one sketch per group, combined map-side."""
    return chunks.groupBy(*groups).agg(F.count(hash_col).alias("n_hashes"), F.hll_sketch_agg(hash_col, F.lit(lg_k)).alias("sketch"))


def unite(sketches: DataFrame, groups: list[str | Column]) -> DataFrame:
    """``(groups..., n_hashes, sketch)`` of coarser groups, or of the same over several batches."""
    return sketches.groupBy(*groups).agg(F.sum("n_hashes").alias("n_hashes"), F.hll_union_agg("sketch").alias("sketch"))


def estimates(sketches: DataFrame, groups: list[str | Column]) -> DataFrame:
    """``(groups..., n_hashes, estimate)``: distinct hashes over all sketches of each group."""
    united = unite(sketches, groups)
    return united.select(*[c for c in united.columns if c != "sketch"], F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).alias("estimate"))


def write_sketches(sketches: DataFrame, path: str, batch: int) -> None:
    """Store a batch's sketches; the same batch again replaces them."""
    sketches.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
