"""The published dedup and delta benchmark numbers, reproduced through the
Spark operators (inputs built as the benchmarks describe them)."""

import pytest
from pyspark.sql import functions as F

from tidepool.operators import chunking, delta


def _dedup_files():
    base = "".join(f"This is line {i} of the document.\n" for i in range(10000))
    out = []
    for i in range(10):
        own = "".join(f"Unique content for file {i} line {j}\n" for j in range(1000))
        out.append((f"/tmp/dedup_test_{i}.txt", (base + own).encode()))
    return out


def test_dedup_benchmark_golden(spark):
    files = spark.createDataFrame(_dedup_files(), "path string, content binary")
    chunks = chunking.cdc_chunks(files, ["path"])
    r = delta.dedup_report(chunks).collect()[0]
    assert (r["total_chunks"], r["unique_chunks"]) == (128, 29)
    assert (r["total_bytes"], r["unique_bytes"]) == (3837800, 916697)
    assert r["dedup_ratio"] == pytest.approx(76.114, abs=1e-3)
    assert r["storage_saving"] == r["dedup_ratio"]


def _delta_pair(pct):
    original = bytes(ord("A") + (i + j) % 26 for i in range(10240) for j in range(1024))
    data = bytearray(original)
    k = int(len(data) * pct / 100.0)
    start = len(data) // 2
    data[start:start + k] = b"X" * min(k, len(data) - start)
    return original, bytes(data)


@pytest.mark.parametrize("pct,old_n,new_n,new_chunks,distinct_new,new_bytes,saved", [
    (0.1, 191, 210, 110, 78, 5295724, 49.496),
    (1.0, 191, 224, 124, 100, 5295724, 49.496),
    (5.0, 191, 205, 56, 41, 2737138, 73.897),
    (10.0, 191, 220, 85, 50, 3688572, 64.823),
    (25.0, 191, 249, 137, 45, 4760009, 54.605),
])
def test_delta_benchmark_golden(spark, pct, old_n, new_n, new_chunks, distinct_new, new_bytes, saved):
    old, new = _delta_pair(pct)
    o = chunking.cdc_chunks(spark.createDataFrame([("f", old)], "path string, content binary"), ["path"])
    n = chunking.cdc_chunks(spark.createDataFrame([("f", new)], "path string, content binary"), ["path"])
    r = delta.bandwidth_reduction(o, n, ["path"]).collect()[0]
    assert (r["original_chunks"], r["modified_chunks"], r["new_chunks"]) == (old_n, new_n, new_chunks)
    assert r["new_bytes"] == new_bytes
    assert r["bandwidth_reduction"] == pytest.approx(saved, abs=1e-3)
    s = delta.delta_summary(o, n, ["path"]).collect()[0]
    assert s["new_chunks"] == new_chunks and s["bytes_to_transfer"] == new_bytes
    assert s["existing_chunks"] == new_n - new_chunks
    assert delta.delta_new(n, o, ["path"]).select("hash").distinct().count() == distinct_new


def test_empty_and_missing_files_give_no_chunks(spark):
    files = spark.createDataFrame([("empty", b""), ("missing", None), ("one", b"x")], "path string, content binary")
    rows = chunking.cdc_chunks(files, ["path"]).collect()
    assert [(r["path"], r["size"], r["offset"]) for r in rows] == [("one", 1, 0)]
    stats = {r["path"]: r for r in chunking.chunk_stats(files, ["path"]).collect()}
    assert (stats["empty"]["total_chunks"], stats["empty"]["avg_size"]) == (0, 0.0)


def test_chunks_reassemble_to_file_hash(spark):
    import hashlib
    payload = bytes(range(256)) * 700
    files = spark.createDataFrame([("f", payload)], "path string, content binary")
    ch = chunking.cdc_chunks(files, ["path"], min_size=64, avg_size=512, max_size=4096, mask_bits=9, with_data=True)
    whole = ch.groupBy("path").agg(F.expr("listagg(data) WITHIN GROUP (ORDER BY chunk_index)").alias("b")).collect()[0]["b"]
    assert hashlib.sha256(whole).hexdigest() == hashlib.sha256(payload).hexdigest()
    offs = [(r["offset"], r["size"]) for r in ch.orderBy("chunk_index").collect()]
    assert all(a[0] + a[1] == b[0] for a, b in zip(offs, offs[1:]))


@pytest.mark.parametrize("seg", [50_000, 1_048_576 + 3])
def test_segmented_files_chunk_like_whole_files(spark, seg):
    import numpy as np
    rng = np.random.default_rng(5)
    files = {
        "a": np.concatenate([rng.integers(0, 256, 1_500_000, dtype=np.uint8), np.zeros(200_000, np.uint8)]).tobytes(),
        "b": (b"The quick brown fox jumps over the lazy dog. " * 40000),
        "c": b"tiny",
    }
    whole = spark.createDataFrame(list(files.items()), "path string, content binary")
    rows = [(p, i // seg, d[i:i + seg]) for p, d in files.items() for i in range(0, len(d), seg)]
    segs = spark.createDataFrame(rows[::-1], "path string, seg long, content binary")  # any input order
    cols = ["path", "chunk_index", "offset", "size", "hash"]
    for kw in ({}, dict(min_size=64, avg_size=512, max_size=4096, mask_bits=9)):
        a = sorted(tuple(r) for r in chunking.cdc_chunks(whole, ["path"], **kw).select(*cols).collect())
        b = sorted(tuple(r) for r in chunking.cdc_chunks_segmented(segs, ["path"], **kw).select(*cols).collect())
        assert a == b and len(a) > 10


def test_documents_sf001_golden(spark):
    """FIXTURES golden values for documents at sf0.01, defaults and small parameters."""
    from conftest import SF_MID
    from tidepool.plans import catalog

    small = catalog.q_dedup_report(spark, SF_MID).collect()[0]
    assert (small["total_chunks"], small["unique_chunks"]) == (6848, 6290)
    assert (small["total_bytes"], small["unique_bytes"]) == (2472458, 2284112)
    assert small["dedup_ratio"] == pytest.approx(7.6178, abs=1e-4)
    default = delta.dedup_report(catalog.q_cdc_chunks(spark, SF_MID)).collect()[0]
    assert (default["total_chunks"], default["unique_chunks"]) == (1017, 943)
    assert (default["total_bytes"], default["unique_bytes"]) == (2472458, 2308497)
    assert default["dedup_ratio"] == pytest.approx(6.6315, abs=1e-4)
