"""Physical-plan properties that the scale design relies on."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL

Q = entry.queries()
STREAMS = {"ingest_uploads", "upload_responses"}
BATCH = [n for n in Q if not n.endswith("_stream") and n not in STREAMS and not n.startswith("op") and n != "pipeline"]


def _plan(spark, name):
    df = Q[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in BATCH if n not in ("apply_changes", "distinct_hashes_estimate")])  # max_by over a struct sorts, sketches are objects
def test_no_sort_or_object_aggregates(spark, name):
    plan = _plan(spark, name)
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_top1_is_limited_before_the_shuffle(spark):
    # at scale the log has more splits than cores: Spark keeps a partial
    # top-1 per key in every map task before the shuffle
    from pyspark.sql import functions as F

    from tidepool.operators import files

    log = spark.range(0, 20000, numPartitions=16).select(
        (F.col("id") % 7).alias("k"), F.col("id").alias("seq"), F.col("id").cast("string").alias("v"))
    plan = files.latest_per_key(log, ["k"], ["seq"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert {r["k"]: r["seq"] for r in files.latest_per_key(log, ["k"], ["seq"]).collect()} == {
        k: max(i for i in range(20000) if i % 7 == k) for k in range(7)}


def test_filter_reaches_the_scan(spark):
    from tidepool.operators import files
    from tidepool.sources import tables

    plan = files.modified_since(tables.src_files(spark, SF_SMALL).drop("content"), 500)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThan(doc_id,500)]" in plan


@pytest.mark.parametrize("name,most", [("delta_summary", 2), ("bandwidth_reduction", 2), ("upsert_manifest", 1), ("chunk_stats", 0),
                                       ("cdc_chunks", 0), ("window_fingerprints", 1), ("apply_changes", 1)])
def test_exchanges(spark, name, most):
    plan = _plan(spark, name)
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange SinglePartition") <= most


@pytest.mark.parametrize("name", ["chunk_offsets", "file_chunks"])
def test_blocked_prefix_runs_its_input_once(spark, name):
    df = Q[name](spark, SF_SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 1 and plan.count("Scan parquet") == 1


def test_change_feed_is_scanned_once(spark):
    assert _plan(spark, "apply_changes").count("FileScan") == 1


def test_only_winning_bytes_are_shuffled_into_the_store(spark):
    from tidepool.operators import storage
    from tidepool.sources import tables

    new = storage.new_store_rows(tables.conv_chunks(spark, SF_SMALL), storage.empty_store(spark), ["conv_id", "chunk_index"])
    plan = new._jdf.queryExecution().executedPlan().toString()
    ranked = plan[plan.index("WindowGroupLimit"):]
    assert " AS data#" not in ranked[: ranked.index("FileScan")]


def test_scan_reads_only_needed_columns(spark):
    plan = _plan(spark, "counter")
    read = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert read and all("ReadSchema: struct<event_type:string,value:double>" in r for r in read)


def test_no_cross_joins_or_cartesian_products(spark):
    for name in BATCH:
        plan = _plan(spark, name)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
