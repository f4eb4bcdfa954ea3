"""A12 by sketches: error, union, replayed batches, nulls and empty groups."""

from pyspark.sql import functions as F

from tidepool.operators import sketches


def test_estimates_of_united_sketches(spark, tmp_path):
    # days overlap: each has 20,000 hashes, neighbours share half of them
    rows = spark.range(10 * 20000).select(
        F.lit("c").alias("client"), F.floor(F.col("id") / 20000).alias("day"),
        F.sha2((F.floor(F.col("id") / 20000) * 10000 + F.col("id") % 20000).cast("string"), 256).alias("hash"),
    )
    for day in range(10):
        for _ in range(2):  # a replayed batch replaces itself
            sketches.write_sketches(sketches.hash_sketches(rows.where(F.col("day") == day), ["client", "day"]), str(tmp_path), day)
    stored = sketches.read_sketches(spark, str(tmp_path))
    for r in sketches.estimates(stored, ["day"]).collect():
        assert r["n_hashes"] == 20000 and abs(r["estimate"] - 20000) <= 0.03 * 20000
    (whole,) = sketches.estimates(stored, ["client"]).collect()
    exact = rows.select("hash").distinct().count()
    assert whole["n_hashes"] == 200000 and exact == 110000 and abs(whole["estimate"] - exact) <= 0.03 * exact


def test_incremental_union_equals_the_rebuild(spark):
    rows = spark.range(60000).select((F.col("id") % 6).alias("day"), F.sha2((F.col("id") % 41000).cast("string"), 256).alias("hash"))
    by_day = sketches.hash_sketches(rows, ["day"])
    so_far = sketches.unite(by_day.where("day = 0"), [])
    for day in range(1, 6):
        so_far = sketches.unite(so_far.unionByName(by_day.where(F.col("day") == day).drop("day")), [])
    assert sketches.estimates(so_far, []).collect() == sketches.estimates(by_day, []).collect()


def test_nulls_repeats_and_no_rows(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", None), ("b", None), (None, "y")], "client string, hash string")
    got = {r["client"]: (r["n_hashes"], r["estimate"]) for r in sketches.estimates(sketches.hash_sketches(rows, ["client"]), ["client"]).collect()}
    assert got == {"a": (2, 1), "b": (0, 0), None: (1, 1)}
    assert sketches.estimates(sketches.hash_sketches(rows.limit(0), ["client"]), ["client"]).collect() == []
