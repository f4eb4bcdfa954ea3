"""Edge cases: token buckets, path names, sync/conflicts, store/upload, streaming == batch."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tidepool.functions import paths
from tidepool.operators import files, ratelimit, storage, sync
from tidepool.plans import catalog
from tidepool.schemas import FILES

T0 = dt.datetime(2024, 1, 1)


def _log(spark, rows):
    data = [(k, T0 + dt.timedelta(microseconds=us), i, b) for i, (k, us, b) in enumerate(rows)]
    return spark.createDataFrame(data, "key string, ts timestamp, event_id long, bytes long")


# ---------------------------------------------------------------- token bucket
def test_burst_then_refuse(spark):
    out = ratelimit.admit(_log(spark, [("k", 0, 2048), ("k", 0, 1)]), rate=1024, burst=2048).orderBy("event_id").collect()
    assert [r["admitted"] for r in out] == [True, False]


def test_null_keys_sizes_and_long_gaps(spark):
    day = 86_400_000_000
    rows = [(None, 0, 10), (None, 0, 2000), ("k", 0, 900), ("k", 365 * day, 1000), ("k", 365 * day, 1), ("k", 365 * day, 2**60)]
    got = [r["admitted"] for r in ratelimit.admit(_log(spark, rows), rate=10**9, burst=1000).orderBy("event_id").collect()]
    assert got == [True, False, True, True, False, False]
    log = _log(spark, [("k", 0, 5)]).withColumn("bytes", F.lit(None).cast("long"))
    assert [r["admitted"] for r in ratelimit.admit(log, 10).collect()] == [True]


def test_admission_stream_decides_every_row_across_batches(spark, tmp_path):
    # key b arrives 10 s behind key a, and one row of a comes late: no row is dropped
    from tidepool.streaming.admission import admission_stream

    parts = [[("a", 0, 20), ("b", 0, 5)], [("a", 10_000_000, 15), ("a", 2_000_000, 1)], [("b", 1_000_000, 40), (None, 1, 3), ("b", 1_500_000, 18)]]
    log = str(tmp_path / "log")
    n = 0
    got = None
    for rows in parts:
        df = spark.createDataFrame([(k, T0 + dt.timedelta(microseconds=us), n + i, b) for i, (k, us, b) in enumerate(rows)],
                                   "key string, ts timestamp, event_id long, bytes long")
        n += len(rows)
        df.write.mode("append").parquet(log)
        stream = spark.readStream.schema(df.schema).parquet(log)
        got = admission_stream(spark, stream, str(tmp_path / "work"), rate=10, burst=20).orderBy("event_id").collect()
        assert len(got) == n
    # batch 1 leaves a 0 and b 15; a is full again at 10 s (5 left after 15), the late row takes 1 more;
    # b has 20 at 1 s: 40 is refused, and 18 fits
    assert [r["admitted"] for r in got] == [True, True, True, True, False, True, True]


def test_stream_in_time_order_equals_batch(spark, tmp_path):
    import random

    from tidepool.streaming.admission import admission_stream
    rnd = random.Random(8)
    rows, t = [], 0
    for _ in range(600):
        t += rnd.randint(0, 900_000)
        rows.append((rnd.choice("abc"), t, rnd.randint(1, 4000)))
    whole = _log(spark, rows)
    log = str(tmp_path / "log")
    for a in range(0, 600, 150):
        whole.where((F.col("event_id") >= a) & (F.col("event_id") < a + 150)).coalesce(1).write.mode("append").parquet(log)
        out = admission_stream(spark, spark.readStream.schema(whole.schema).parquet(log), str(tmp_path / "work"), 1000, 5000)
    assert _same(out, ratelimit.admit(whole, 1000, 5000))


def test_admit_matches_float_simulation(spark):
    import random
    rnd = random.Random(3)
    rows, t = [], 0
    for _ in range(400):
        t += rnd.randint(0, 3_000_000)
        rows.append((rnd.choice("ab"), t, rnd.randint(1, 4000)))
    got = {r["event_id"]: r["admitted"] for r in ratelimit.admit(_log(spark, rows), rate=1000, burst=5000).collect()}
    state = {}
    for i, (k, us, b) in enumerate(rows):
        tok, last = state.get(k, (5000.0, us))
        tok = min(tok + (us - last) / 1e6 * 1000, 5000.0)
        ok = tok >= b
        state[k] = (tok - b if ok else tok, us)
        assert got[i] == ok


# ---------------------------------------------------------------- names
@pytest.mark.parametrize("path,stem,ext", [
    (".bashrc", ".bashrc", ""), ("a.tar.gz", "a.tar", "gz"), ("dot.", "dot", ""), ("noext", "noext", ""),
    (".a.b", ".a", "b"), ("dir.d/noext", "noext", ""), ("x/.", ".", ""), ("x/..", "..", ""), ("d/f.txt", "f", "txt"),
])
def test_stem_and_extension(spark, path, stem, ext):
    r = spark.createDataFrame([(path,)], "p string").select(
        paths.stem("p").alias("s"), paths.extension("p").alias("e")).collect()[0]
    assert (r["s"], r["e"]) == (stem, ext)


def test_conflict_name_layout(spark):
    at = F.timestamp_seconds(F.lit(1700000000))
    rows = spark.createDataFrame([("docs/report.final.pdf",), ("notes",), ("a/b/",)], "p string").select(
        paths.conflict_name("p", F.lit("local"), at).alias("n")).collect()
    assert [r["n"] for r in rows] == [
        "docs/report.final (conflicted copy local 2023-11-14 22-13-20).pdf",
        "notes (conflicted copy local 2023-11-14 22-13-20)",
        "a/b/ (conflicted copy local 2023-11-14 22-13-20)",
    ]


# ---------------------------------------------------------------- sync and conflicts
def _files(spark, rows):
    full = [(c, p, 1, m, h, v, False, d, 0) for (c, p, m, h, v, d) in rows]
    return spark.createDataFrame(full, FILES)


def test_sync_changes_rules(spark):
    server = _files(spark, [("c", "same", 5, "h1", 1, False), ("c", "diff", 5, "h2", 1, False),
                            ("c", "new_old", 5, "h3", 1, False), ("c", "new_recent", 50, "h4", 1, False),
                            ("c", "gone", 50, "h5", 1, True)])
    local = _files(spark, [("c", "same", 1, "h1", 1, False), ("c", "diff", 99, "zz", 1, False),
                           ("c", "local_only", 1, "h9", 1, False)])
    got = {(r["path"], r["type"]) for r in sync.sync_changes(server, local, 10).collect()}
    assert got == {("diff", "MODIFIED"), ("new_recent", "CREATED")}


def test_conflicts_versions_and_auto_strategy(spark):
    server = _files(spark, [("c", "a", 5, "s", 1, False), ("c", "b", 5, "s", 1, False),
                            ("c", "z", 5, "s", 1, False), ("c", "e", 7, "s", 1, False)])
    local = _files(spark, [("c", "a", 9, "l", 1, False), ("c", "b", 5, "l", 1, False),
                           ("c", "z", 5, "l", 0, False), ("c", "e", 3, "l", 2, False)])
    res = sync.resolve_conflicts(sync.conflicts(local, server), 1700000000).collect()
    got = {r["path"]: (r["strategy"], r["resolved_path"]) for r in res}
    assert set(got) == {"a", "b", "e"}  # version 0 on one side: no conflict
    assert got["a"] == ("KEEP_LOCAL", "a") and got["e"] == ("KEEP_REMOTE", "e")
    assert got["b"] == ("KEEP_BOTH", "b (conflicted copy local 2023-11-14 22-13-20)")


def test_resolve_manual_gives_empty(spark):
    df = spark.createDataFrame([("p",)], "path string")
    r = df.select(sync.resolve("path", F.lit("MANUAL"), F.current_timestamp()).alias("x")).collect()[0]
    assert r["x"] == ""


def test_tombstoned_file_found_by_path_and_tombstone_keeps_columns(spark):
    base = _files(spark, [("c", "a", 5, "h", 3, False), ("c", "b", 6, "g", 1, True)])
    want = spark.createDataFrame([("c", "b"), ("c", "nope")], "client_id string, path string")
    assert [r["path"] for r in files.file_metadata(base, want).collect()] == ["b"]
    t = {r["path"]: r for r in files.tombstone(base, spark.createDataFrame([("c", "a"), ("c", "x")], "client_id string, path string")).collect()}
    assert t["a"]["deleted"] and t["a"]["version"] == 3 and t["a"]["hash"] == "h" and len(t) == 2


def test_first_local_row_wins(spark):
    local = spark.createDataFrame([("c", "p", "h1", 2), ("c", "p", "h0", 1)], "client_id string, path string, hash string, seq long")
    assert sync.first_local(local, "seq").collect()[0]["hash"] == "h0"


# ---------------------------------------------------------------- store and uploads
def _chunks(spark, rows):
    return spark.createDataFrame(
        [(c, f, i, hashlib.sha256(d).hexdigest() if h is None else h, d, s) for (c, f, i, d, h, s) in rows],
        "client_id string, file_path string, chunk_index int, hash string, data binary, seq long")


def test_store_first_writer_and_unverified_hash(spark):
    inc = _chunks(spark, [("c", "f", 0, b"abc", None, 2), ("c", "g", 0, b"abc", None, 1), ("c", "f", 1, b"zz", "bad", 3)])
    rows = {r["hash"]: r for r in storage.new_store_rows(inc, storage.empty_store(spark), ["seq"]).collect()}
    good = hashlib.sha256(b"abc").hexdigest()
    assert rows[good]["first_seq"] == 1 and rows[good]["hash_ok"] and rows[good]["hash_prefix"] == good[:2]
    assert rows["bad"]["hash_ok"] is False  # stored anyway, flagged


def test_upload_fewer_chunks_than_announced_is_rejected(spark):
    man = _chunks(spark, [("c", "f", 0, b"a", None, 1), ("c", "f", 1, b"b", None, 2)])
    ann = spark.createDataFrame([("c", "f", 3), ("c", "e", 0)], "client_id string, file_path string, total_chunks int")
    got = {r["file_path"]: r["complete"] for r in storage.upload_complete(man, ann, ["client_id", "file_path"]).collect()}
    assert got == {"f": False, "e": True}
    store = storage.new_store_rows(man, storage.empty_store(spark), ["seq"])
    done = storage.finalize_files(storage.reassemble(man, store, ["client_id", "file_path"]),
                                  storage.upload_complete(man, ann, ["client_id", "file_path"]),
                                  ["client_id", "file_path"], 7).collect()
    assert [(r["file_path"], r["size"], r["hash"]) for r in done] == [("e", 0, hashlib.sha256(b"").hexdigest())]


def test_reassemble_fails_on_missing_or_empty_chunk(spark):
    man = _chunks(spark, [("c", "f", 0, b"a", None, 1), ("c", "f", 1, b"", None, 2), ("c", "g", 0, b"q", None, 3)])
    store = storage.new_store_rows(man.where("file_path = 'f'"), storage.empty_store(spark), ["seq"])
    got = {r["file_path"]: r["ok"] for r in storage.reassemble(man, store, ["client_id", "file_path"]).collect()}
    assert got == {"f": False, "g": False}


def test_apply_delta_overrun_and_trailing(spark):
    lists = spark.createDataFrame([("f", 0, 2), ("f", 1, 3), ("g", 0, 9)], "file_path string, chunk_index int, size int")
    pay = spark.createDataFrame([("f", b"abcdeXX"), ("g", b"short")], "file_path string, payload binary")
    got = {r["file_path"]: r for r in storage.apply_delta(lists, pay, ["file_path"]).collect()}
    assert got["f"]["ok"] and got["f"]["hash"] == hashlib.sha256(b"abcde").hexdigest()
    assert not got["g"]["ok"] and got["g"]["hash"] is None


def test_apply_delta_of_an_empty_chunk_list_writes_an_empty_file(spark):
    lists = spark.createDataFrame([], "file_path string, chunk_index int, size int")
    pay = spark.createDataFrame([("f", b"abc")], "file_path string, payload binary")
    r = storage.apply_delta(lists, pay, ["file_path"]).collect()[0]
    assert r["ok"] and r["written_bytes"] == 0 and bytes(r["content"]) == b"" and r["hash"] == hashlib.sha256(b"").hexdigest()


def test_emptied_file_has_a_summary_row(spark):
    from tidepool.operators import delta
    old = spark.createDataFrame([("f", "h1", 5), ("g", "h2", 3)], "path string, hash string, size int")
    new = old.where("path = 'g'")
    names = spark.createDataFrame([("f",), ("g",), ("never",)], "path string")
    got = {r["path"]: tuple(r)[1:] for r in delta.delta_summary(old, new, ["path"], names).collect()}
    assert got == {"f": (0, 0, 0, 0), "g": (0, 1, 0, 0), "never": (0, 0, 0, 0)}
    assert {r["path"]: r["bandwidth_reduction"] for r in delta.bandwidth_reduction(old, new, ["path"], names).collect()} == {
        "f": 100.0, "g": 100.0, "never": None}


def test_upsert_takes_the_last_update_of_a_path(spark):
    base = _files(spark, [("c", "p", 1, "base", 1, False), ("c", "q", 1, "kept", 1, False)])
    updates = _files(spark, [("c", "p", 1, f"u{i}", 1, False) for i in range(3)]).withColumn("pos", F.substring("hash", 2, 1).cast("int"))
    assert {r["path"]: r["hash"] for r in files.upsert_files(base, updates, "pos").collect()} == {"p": "u2", "q": "kept"}


def test_repeated_local_rows_report_a_path_once(spark):
    server = _files(spark, [("c", "p", 5, "s", 1, False)])
    local = _files(spark, [("c", "p", 1, "l", 1, False)] * 3)
    assert [(r["path"], r["type"]) for r in sync.sync_changes(server, local, 0).collect()] == [("p", "MODIFIED")]


def test_local_edit_conflicts_with_a_server_delete(spark):
    server = _files(spark, [("c", "p", 5, "s", 1, True)])
    local = _files(spark, [("c", "p", 6, "l", 1, False)])
    assert [r["path"] for r in sync.conflicts(local, server).collect()] == ["p"]


# ---------------------------------------------------------------- streaming == batch
def _same(a, b):
    key = lambda r: tuple(str(v) for v in r)
    return sorted(map(key, a.collect())) == sorted(map(key, b.collect()))


def test_apply_changes_stream_equals_batch(spark):
    assert _same(catalog.q_apply_changes_stream(spark, SF_SMALL), catalog.q_apply_changes(spark, SF_SMALL))


# ---------------------------------------------------------------- binary file source
def test_binary_files_source_and_chunking(spark, tmp_path):
    from tidepool.operators import chunking
    from tidepool.sources.tables import binary_files
    (tmp_path / "a.bin").write_bytes(b"A" * 100000)
    (tmp_path / "empty.bin").write_bytes(b"")
    df = binary_files(spark, str(tmp_path / "*.bin"))
    meta = {r["path"].rsplit("/", 1)[-1]: r for r in df.collect()}
    assert meta["a.bin"]["size"] == 100000
    assert meta["a.bin"]["hash"] == hashlib.sha256(b"A" * 100000).hexdigest()
    assert (meta["empty.bin"]["size"], meta["empty.bin"]["hash"]) == (0, hashlib.sha256(b"").hexdigest())
    assert binary_files(spark, str(tmp_path / "nothing*")).count() == 0
    sizes = [r["size"] for r in chunking.cdc_chunks(df, ["path"]).orderBy("path", "chunk_index").collect()]
    assert sizes == [49990, 49990, 20]


def test_file_hashes_missing_is_empty_string(spark):
    files_df = spark.createDataFrame([("c", "a", b"x"), ("c", "e", b"")], "client_id string, path string, content binary")
    req = spark.createDataFrame([("c", "a"), ("c", "e"), ("c", "gone")], "client_id string, path string")
    got = {r["path"]: r["hash"] for r in files.file_hashes(files_df, req).collect()}
    assert got == {"a": hashlib.sha256(b"x").hexdigest(), "e": hashlib.sha256(b"").hexdigest(), "gone": ""}


def test_sync_state_read_and_advance(spark):
    server = _files(spark, [("c", "old", 5, "h", 1, False), ("c", "new", 50, "g", 1, True), ("d", "x", 1, "k", 1, False)])
    state = spark.createDataFrame([("c", 10)], "client_id string, last_sync_time long")
    sent = {(r["client_id"], r["path"]) for r in sync.incremental_sync(server, state).collect()}
    assert sent == {("c", "new"), ("d", "x")}  # tombstones included; absent client starts at 0
    nxt = sync.advance_sync_state(state, spark.createDataFrame([("c", 60), ("d", 3)], "client_id string, sync_time long"))
    assert {r["client_id"]: r["last_sync_time"] for r in nxt.collect()} == {"c": 60, "d": 3}


# ---------------------------------------------------------------- skew
def test_hot_file_offsets_and_positions_with_small_blocks(spark):
    # one file holds most rows; blocks of 7 force the two-level path
    rows = [("c", "hot", i, f"h{i % 5}", 0, 1 + i % 13) for i in range(500)] + \
           [("c", "cold", i, "x", 0, 10) for i in range(3)]
    man = spark.createDataFrame(rows, "client_id string, file_path string, chunk_index int, hash string, offset long, size int")
    got = {(r["file_path"], r["chunk_index"]): r["offset"] for r in files.chunk_offsets(man, block=7).collect()}
    run = 0
    for i in range(500):
        assert got[("hot", i)] == run
        run += 1 + i % 13
    assert [got[("cold", i)] for i in range(3)] == [0, 10, 20]
    pos = {(r["file_path"], r["chunk_index"]): r["position"] for r in files.file_chunks(man, block=7).collect()}
    assert all(pos[("hot", i)] == i + 1 for i in range(500))


def test_hot_key_upsert_reduces_before_shuffle(spark):
    log = spark.createDataFrame([("c", "p", i, f"h{i}") for i in range(3000)] + [("c", "q", 1, "z")],
                                "client_id string, path string, seq long, hash string")
    out = files.latest_per_key(log, ["client_id", "path"], ["seq"])
    assert {r["path"]: r["hash"] for r in out.collect()} == {"p": "h2999", "q": "z"}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def _feed(spark, rows):
    """(upload, client, path, seq, index, data, total) as upload messages."""
    from tidepool.streaming import uploads

    return spark.createDataFrame(
        [(u, c, f, seq, (i, 0, len(d), hashlib.sha256(d).hexdigest(), d), total) for (u, c, f, seq, i, d, total) in rows], uploads.UPLOAD)


def _deliver(spark, tmp_path, rows, at):
    from tidepool.streaming import uploads

    d, work = str(tmp_path / "feed"), str(tmp_path / "work")
    _feed(spark, rows).coalesce(1).write.mode("append").parquet(d)
    uploads.run_uploads(spark, d, work, at)
    return uploads.uploaded_files(spark, work).collect(), uploads.upload_responses(spark, work)


def test_reupload_with_fewer_chunks_is_rejected_by_stream(spark, tmp_path):
    first, _ = _deliver(spark, tmp_path, [("u", "c", "f", 1, 0, b"aa", 3), ("u", "c", "f", 2, 1, b"bb", 3), ("u", "c", "f", 3, 2, b"cc", 3)], 5)
    assert [(r["path"], r["size"], r["hash"]) for r in first] == [("f", 6, hashlib.sha256(b"aabbcc").hexdigest())]
    # the second upload announces 2 chunks; the stale index 2 stays, so the count (3) != 2: not finalised
    again, resp = _deliver(spark, tmp_path, [("v", "c", "f", 4, 0, b"xx", 2), ("v", "c", "f", 5, 1, b"yy", 2)], 9)
    assert [(r["path"], r["hash"], r["modified_time"]) for r in again] == [("f", hashlib.sha256(b"aabbcc").hexdigest(), 5)]
    assert sorted((r["batch_id"], r["success"], r["chunks_received"]) for r in resp.collect()) == [(0, True, 3), (1, False, None)]


def test_upload_over_two_batches_keeps_its_first_header(spark, tmp_path):
    from tidepool.streaming import uploads

    first, resp = _deliver(spark, tmp_path, [("u", "c", "right", 1, 0, b"ab", 2)], 1)
    assert first == [] and [r["success"] for r in resp.collect()] == [False]
    # the second message comes alone and names nothing (or something else)
    second, resp = _deliver(spark, tmp_path, [("u", "", "", 2, 1, b"cd", 0)], 2)
    assert [(r["client_id"], r["path"], r["size"], r["hash"]) for r in second] == [("c", "right", 4, hashlib.sha256(b"abcd").hexdigest())]
    assert sorted((r["batch_id"], r["success"], r["reason"]) for r in resp.collect()) == [(0, False, uploads.NOT_COMPLETE), (1, True, None)]
    # replaying the second batch stores nothing twice and doesn't answer twice
    work = str(tmp_path / "work")
    uploads.process_batch(spark, _feed(spark, [("u", "", "", 2, 1, b"cd", 0)]), 1, work, 2)
    assert len(uploads.uploaded_files(spark, work).collect()) == 1 and uploads.upload_responses(spark, work).count() == 2
    assert spark.read.parquet(f"{work}/chunk_store").count() == 2


def test_unreadable_log_is_an_error(spark, tmp_path):
    from tidepool.streaming import uploads

    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        uploads._log(spark, str(tmp_path / "log"), uploads.UPLOADS_LOG).collect()
    assert uploads._log(spark, str(tmp_path / "absent"), uploads.UPLOADS_LOG).count() == 0


def test_reassembled_bytes(spark):
    man = _chunks(spark, [("c", "f", 1, b"cd", None, 1), ("c", "f", 0, b"ab", None, 2)])
    store = storage.new_store_rows(man, storage.empty_store(spark), ["seq"])
    r = storage.reassemble(man, store, ["client_id", "file_path"], with_content=True).collect()[0]
    assert bytes(r["content"]) == b"abcd" and r["chunks"] == 2


def test_download_status_not_found_and_tombstones(spark):
    from tidepool.operators import delta
    base = _files(spark, [("c", "a", 5, "h", 1, False), ("c", "t", 6, "g", 1, True)])
    req = spark.createDataFrame([("c", "a"), ("c", "t"), ("c", "zz")], "client_id string, path string")
    got = {r["path"]: r["status"] for r in delta.download_status(req, base).collect()}
    assert got == {"a": "OK", "t": "OK", "zz": "NOT_FOUND"}


def test_client_tables_partition_pruning(spark, tmp_path):
    base = _files(spark, [("c1", "a", 5, "h", 1, False), ("c2", "b", 6, "g", 1, False)])
    root = str(tmp_path / "clients")
    files.write_client_tables(base, root)
    one = spark.read.parquet(root).where("client_id = 'c2'")
    assert [r["path"] for r in one.collect()] == ["b"]
    assert "PartitionFilters: [isnotnull(client_id" in one._jdf.queryExecution().executedPlan().toString()


def test_defaults_use_the_clock(spark):
    rows = spark.createDataFrame([("c", "p", "l", 1, 1, "r", 1, 1)],
                                 "client_id string, path string, local_hash string, local_modified_time long, "
                                 "local_version int, remote_hash string, remote_modified_time long, remote_version int")
    r = sync.resolve_conflicts(rows).collect()[0]
    assert r["strategy"] == "KEEP_BOTH" and r["resolved_path"].startswith("p (conflicted copy local 20")


def test_sync_changes_first_local_row_wins(spark):
    server = _files(spark, [("c", "p", 5, "h1", 1, False)])
    local = spark.createDataFrame([("c", "p", "h1", 0), ("c", "p", "zz", 1)],
                                  "client_id string, path string, hash string, pos long")
    assert sync.sync_changes(server, local, 0, local_order="pos").collect() == []
    swapped = local.withColumn("pos", 1 - F.col("pos"))
    got = [(r["path"], r["type"]) for r in sync.sync_changes(server, swapped, 0, local_order="pos").collect()]
    assert got == [("p", "MODIFIED")]


def test_store_lookup_by_hash_is_pushed_to_the_scan(spark, tmp_path):
    rows = [(hashlib.sha256(str(i).encode()).hexdigest(), str(i).encode(), i) for i in range(200)]
    inc = spark.createDataFrame(rows, "hash string, data binary, seq long")
    d = str(tmp_path / "store")
    storage.write_store(storage.new_store_rows(inc, storage.empty_store(spark), ["seq"]), d)
    h = rows[7][0]
    q = spark.read.parquet(d).where((F.col("hash_prefix") == h[:2]) & (F.col("hash") == h))
    assert [r["data"] for r in q.collect()] == [b"7"]
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(hash), EqualTo(hash," in plan and "PartitionFilters: [isnotnull(hash_prefix" in plan
