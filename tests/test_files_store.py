"""Files of any size (S1, F3, C1), the file sink (S6, S9) and the bucketed store."""

import hashlib
import os
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.operators import chunking, storage
from tidepool.sources import client_files, files

RNG = np.random.default_rng(5)
TREE = {
    "a/x.bin": RNG.integers(0, 256, 3_000_000, dtype=np.uint8).tobytes(),
    "a/b c/d%20e/é#?.bin": b"abc" * 100_000,
    "a/b c/empty": b"",
    "z": b"q",
    "zeros": bytes(70_000),
}


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, data in TREE.items():
        os.makedirs(os.path.dirname(root / name), exist_ok=True)
        (root / name).write_bytes(data)
    (root / ".hidden").write_bytes(b"h")
    return str(root)


def named(rows, root):
    return {r["path"].split(root + "/")[1]: r for r in rows}


def test_listing_finds_every_file_at_any_depth(spark, tree):
    got = named(files.list_files(spark, tree).collect(), tree)
    assert {k: r["size"] for k, r in got.items()} == {k: len(v) for k, v in TREE.items()}
    assert set(named(files.list_files(spark, tree, hidden=True).collect(), tree)) == {*TREE, ".hidden"}
    assert files.list_files(spark, f"{tree}/z").count() == 1  # a file by itself
    assert files.list_files(spark, f"{tree}/nothing-here").count() == 0


def test_scan_hashes_streams(spark, tree, monkeypatch):
    monkeypatch.setattr(files, "READ_BYTES", 70_001)
    got = named(files.scan(files.list_files(spark, tree), "c7").collect(), tree)
    assert {k: (r["client_id"], r["size"], r["hash"]) for k, r in got.items()} == {k: ("c7", len(v), sha(v)) for k, v in TREE.items()}
    assert all(r["modified_time"] == int(os.stat(f"{tree}/{k}").st_mtime) for k, r in got.items())


@pytest.mark.parametrize("step", [70_001, 1 << 22])
def test_streamed_and_segmented_chunks_equal_whole_files(spark, tree, monkeypatch, step):
    monkeypatch.setattr(files, "READ_BYTES", step)
    listing = files.list_files(spark, tree)
    base = listing.first()["path"].split(tree)[0] + tree + "/"
    whole = spark.createDataFrame([(base + k, v) for k, v in TREE.items()], "path string, content binary")
    key = ["path", "chunk_index", "offset", "size", "hash"]
    want = sorted(chunking.cdc_chunks(whole, ["path"]).select(key).collect())
    assert sorted(chunking.cdc_file_chunks(listing).select(key).collect()) == want
    ranges = files.segments(listing, 100_000)
    assert ranges.where("octet_length(content) > 100000").count() == 0
    assert sorted(chunking.cdc_chunks_segmented(ranges, ["path"]).select(key).collect()) == want
    with_data = chunking.cdc_file_chunks(listing, with_data=True)
    assert with_data.where((F.sha2("data", 256) != F.col("hash")) | (F.octet_length("data") != F.col("size"))).count() == 0


ROWS = [("c", "d/f1", 1, b"cd"), ("c", "d/f1", 0, b"ab"), ("c", "bad", 0, b"x"), ("c", "bad", 1, None), ("c", "hole", 0, b""), ("c", "none", None, None),
        ("k", ".bashrc", 0, b"zz")]
WRITTEN = {("c", "d/f1"): b"abcd", ("c", "none"): b"", ("k", ".bashrc"): b"zz"}


def on_disk(root):
    out = {}
    for folder, _, names in os.walk(f"{root}/clients"):
        for n in names:
            rel = os.path.relpath(f"{folder}/{n}", f"{root}/clients")
            client, path = rel.split("/", 1)
            with open(f"{folder}/{n}", "rb") as f:
                out[client, path] = f.read()
    return out


def test_sink_writes_whole_files_after_the_commit_only(spark, tmp_path):
    root = str(tmp_path)
    job = client_files.write_files(spark.createDataFrame(ROWS, client_files.ROW), root)
    assert on_disk(root) == {}  # staged and committed, not published
    got = {(r["client_id"], r["path"]): (r["size"], r["hash"]) for r in client_files.publish(spark, root, job).collect()}
    assert got == {k: (len(v), sha(v)) for k, v in WRITTEN.items()}
    assert on_disk(root) == WRITTEN


def test_publishing_goes_on_after_a_crash(spark, tmp_path):
    root = str(tmp_path)
    job = client_files.write_files(spark.createDataFrame(ROWS, client_files.ROW), root)
    first = sorted(client_files.publish(spark, root, job).collect())
    assert sorted(client_files.publish(spark, root, job).collect()) == first  # everything moved already
    newer = client_files.write_files(spark.createDataFrame([("c", "d/f1", 0, b"new")], client_files.ROW), root)
    client_files.publish(spark, root, newer)
    assert on_disk(root) == WRITTEN | {("c", "d/f1"): b"new"}


@pytest.mark.parametrize("client, path", [("c", "../x"), ("c", "/etc/x"), ("..", "x"), ("c", "a//b"), ("", "x"), ("c/d", "x")])
def test_a_failed_task_leaves_no_file(spark, tmp_path, client, path):
    root = str(tmp_path)
    with pytest.raises(Exception, match="no place"):
        client_files.write_files(spark.createDataFrame([*ROWS, (client, path, 0, b"evil")], client_files.ROW), root)
    assert on_disk(root) == {} and not os.path.exists(f"{root}/_commits")
    assert [n for _, _, names in os.walk(f"{root}/_staging") for n in names] == []


def test_write_client_files_skips_incomplete_and_broken(spark, tmp_path):
    chunk = [b"one", b"two", b"three"]
    store = spark.createDataFrame([(sha(c)[:2], sha(c), len(c), c) for c in chunk[:2]], "hash_prefix string, hash string, size int, data binary")
    manifest = spark.createDataFrame(
        [("c", "ok", 1, sha(b"one")), ("c", "ok", 0, sha(b"two")), ("c", "short", 0, sha(b"one")), ("c", "lost", 0, sha(b"three"))],
        "client_id string, file_path string, chunk_index int, hash string",
    )
    announced = spark.createDataFrame([("c", "ok", 2), ("c", "short", 2), ("c", "lost", 1), ("c", "nil", 0)], "client_id string, file_path string, total_chunks int")
    complete = storage.upload_complete(manifest, announced, ["client_id", "file_path"])
    got = storage.write_client_files(manifest, store, complete, str(tmp_path)).collect()
    assert {(r["path"], r["size"]) for r in got} == {("ok", 6), ("nil", 0)}
    assert on_disk(str(tmp_path)) == {("c", "ok"): b"twoone", ("c", "nil"): b""}


@pytest.fixture()
def bucketed(spark, tmp_path):
    name = f"store_{uuid.uuid4().hex[:8]}"
    rows = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.encode(F.col("id").cast("string"), "UTF-8").alias("data"))
    rows = rows.select(F.substring("hash", 1, 2).alias("hash_prefix"), "hash", F.length("data").cast("int").alias("size"), "data")
    for part in (0, 1):  # two appends
        storage.write_bucketed_store(rows.where(F.crc32("data") % 2 == part), name, f"{tmp_path}/store", 8)
    yield name, f"{tmp_path}/store"
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan[: plan.index("== Initial Plan")]
    lines = plan.splitlines()
    return [(line, lines[i + 1 :]) for i, line in enumerate(lines) if re.search(r"[+:]- (Broadcast)?Exchange|\+- Exchange", line)]


def test_bytes_of_the_bucketed_store_move_once(spark, bucketed):
    """The exchange by file is the only one that carries bytes; S5: none does."""
    name, _ = bucketed
    manifest = spark.range(2000).select(
        (F.col("id") % 7).cast("string").alias("file"), F.col("id").cast("int").alias("chunk_index"), F.sha2((F.col("id") % 500).cast("string"), 256).alias("hash"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rebuilt = storage.reassemble(manifest, spark.table(name), ["file"])
        found = exchanges(rebuilt)
        assert len(found) == 2  # the manifest by hash, the bytes by file
        assert [("hashpartitioning(file" in line) for line, _ in found].count(True) == 1
        below_hash = [rest for line, rest in found if "hashpartitioning(hash" in line]
        assert len(below_hash) == 1 and "FileScan" not in "\n".join(below_hash[0][:4])
        fetched = storage.fetch_chunks(manifest, spark.table(name), bucketed=True)
        assert all("FileScan" not in "\n".join(rest[:3]) for _, rest in exchanges(fetched)) and fetched.where("found").count() == 500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    want = {str(f): sha("".join(str(i % 500) for i in range(2000) if i % 7 == f).encode()) for f in range(7)}
    assert {r["file"]: r["hash"] for r in rebuilt.collect()} == want


def test_a_bucketed_store_can_be_attached(spark, bucketed):
    name, path = bucketed
    spark.sql(f"DROP TABLE {name}")  # the files stay
    again = storage.attach_store(spark, name, path, 8)
    assert again.count() == 500 and again.select("hash").distinct().count() == 500
