"""S4's membership index: exact, at any state of index and store, and reads that follow the batch."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.operators import membership, storage
from tidepool.schemas import CHUNK_STORE
from tidepool.streaming import uploads


def sha(i):
    return hashlib.sha256(str(i).encode()).hexdigest()


def frame(spark, hashes):
    return spark.createDataFrame([(h,) for h in hashes], "hash string")


def found(spark, wanted, stored, indexed, tmp_path):
    if indexed:
        membership.write_index(frame(spark, indexed), f"{tmp_path}/index")
    known = membership.stored_hashes(frame(spark, wanted), frame(spark, stored), membership.read_index(spark, f"{tmp_path}/index"))
    return sorted(r[0] for r in known.collect())


def test_hits_are_exactly_the_stored_hashes(spark, tmp_path):
    stored = [sha(i) for i in range(3000)]
    wanted = [sha(i) for i in range(2000, 9000)] * 2
    assert found(spark, wanted, stored, stored, tmp_path) == sorted(sha(i) for i in range(2000, 3000))


def test_index_ahead_of_the_store_is_settled_by_the_lookup(spark, tmp_path):
    # a crash after the index was written: hashes 50 to 99 are not stored
    assert found(spark, [sha(i) for i in range(100)], [sha(i) for i in range(50)], [sha(i) for i in range(100)], tmp_path) == sorted(sha(i) for i in range(50))


def test_nulls_other_forms_repeats_and_empty_sides(spark, tmp_path):
    odd = ["", "ab", "XYZ1", "ABCDEF", "é" * 5]
    assert found(spark, [None, *odd, *odd, "unseen"], [*odd, sha(1)], [None, *odd, sha(1)], tmp_path) == sorted(odd)
    assert found(spark, [], [sha(1)], [], tmp_path) == []
    assert found(spark, [sha(1)], [], [], tmp_path / "none") == []


def test_several_filters_of_a_cell(spark, tmp_path):
    for part in range(4):
        membership.write_index(frame(spark, [sha(i) for i in range(part, 400, 4)]), f"{tmp_path}/index")
    assert found(spark, [sha(i) for i in range(500)], [sha(i) for i in range(400)], [], tmp_path) == sorted(sha(i) for i in range(400))


def test_few_false_positives():
    rng = np.random.default_rng(3)
    keys = rng.integers(-(1 << 63), 1 << 63, 40000)
    bits = np.frombuffer(membership._filter(keys[:20000]), np.uint8)
    assert membership._may_hold(bits, keys[:20000]).all()
    assert membership._may_hold(bits, keys[20000:]).mean() < 0.015


def test_covering_holds_in_every_cell_with_bounded_ranges(spark):
    rng = np.random.default_rng(5)
    for n in (1, 5, 64, 65, 900, 4096):
        cells = [f"{c:03x}" for c in rng.choice(4096, n, replace=False)]
        condition = membership.covering("hash", cells)
        inside = frame(spark, [c + d for c in cells for d in ("", "0", "ffff")])
        assert inside.where(~condition).count() == 0
        assert condition._jc.toString().count(">=") <= membership.RANGES
    assert frame(spark, ["abc", "abcf", "abd", "abb"]).where(membership.covering("hash", ["abc"])).count() == 2
    assert frame(spark, ["abc"]).where(membership.covering("hash", [])).count() == 0


def _rows_read(df):
    """Rows that come out of the file scans of an executed query."""
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    todo, total = [plan], 0
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "FileSourceScanExec":
            total += p.metrics().apply("numOutputRows").value()
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
        if name.endswith("QueryStageExec"):
            todo.append(p.plan())
    return total


def test_hashes_read_follow_the_batch_not_the_store(spark, tmp_path):
    n = 200000
    chunks = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.lit(b"x").alias("data"), F.col("id").alias("seq"))
    rows = storage.new_store_rows(chunks, storage.empty_store(spark), ["seq"]).persist()
    spark.conf.set("parquet.page.row.count.limit", "100")
    try:
        membership.write_index(rows, f"{tmp_path}/index")
        storage.write_store(rows, f"{tmp_path}/store")
    finally:
        spark.conf.unset("parquet.page.row.count.limit")
        rows.unpersist()
    store = spark.read.schema(CHUNK_STORE).parquet(f"{tmp_path}/store")
    wanted = frame(spark, [sha(i) for i in range(0, 20)] + [sha(i) for i in range(n, n + 20)])
    known = membership.stored_hashes(wanted, store, membership.read_index(spark, f"{tmp_path}/index"))
    assert sorted(r[0] for r in known.collect()) == sorted(sha(i) for i in range(20))
    assert 20 <= _rows_read(known) < n // 10


@pytest.mark.parametrize("with_index", [True, False])
def test_replayed_upload_batch_stores_nothing_twice(spark, tmp_path, with_index):
    from conftest import SF_SMALL
    from tidepool.sources import tables

    conv = tables.conv_chunks(spark, SF_SMALL)
    feed = uploads.upload_feed(conv, tables.announced(conv))
    work = str(tmp_path)
    if not with_index:  # a store from before it had an index
        storage.write_store(storage.new_store_rows(conv, storage.empty_store(spark), ["conv_id", "chunk_index"]), f"{work}/chunk_store")
    for _ in range(2):
        uploads.process_batch(spark, feed, 0, work, 7)
    stored = spark.read.parquet(f"{work}/chunk_store")
    assert stored.count() == stored.select("hash").distinct().count() == conv.select("hash").distinct().count()
