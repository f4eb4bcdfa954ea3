"""T3 and T4 as streams, and the snapshot log under the streams' tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidepool.operators import ratelimit, sync
from tidepool.streaming import changes, sync_feed
from tidepool.streaming.admission import admission_stream
from tidepool.streaming.snapshots import SnapshotLog

T0 = dt.datetime(2024, 1, 1)


# ------------------------------------------------------------------ snapshot log
def log_of(spark, root, every=100):
    return SnapshotLog(spark, str(root), "k string, v long", ["k"], every=every)


def rows_of(log, upto=None, only=None):
    return {r["k"]: r["v"] for r in log.read(upto, only).collect()}


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "k string, v long")


def test_latest_batch_holds_before_and_after_compaction(spark, tmp_path):
    log = log_of(spark, tmp_path)
    batches = [[("a", 1), ("b", 1)], [("b", 2), (None, 5)], [], [("c", 3), ("a", 4)]]
    for i, pairs in enumerate(batches):
        log.append(i, rows(spark, pairs))
    want = {"a": 4, "b": 2, "c": 3, None: 5}
    assert rows_of(log) == want and rows_of(log, 1) == {"a": 1, "b": 2, None: 5} and rows_of(log, -1) == {}
    log.compact(1)
    assert rows_of(log) == want and rows_of(log, 1) == {"a": 1, "b": 2, None: 5}
    log.compact(3)
    log.vacuum()
    assert rows_of(log) == want and log._numbers("log") == [2, 3] and log._numbers("snapshot") == [1, 3]
    assert rows_of(log, only=rows(spark, [("a", 0), ("a", 1), ("x", 0)])) == {"a": 4}
    log.append(4, rows(spark, [("b", 9)]))
    assert rows_of(log) == want | {"b": 9}


def test_a_snapshot_counts_from_its_commit_on(spark, tmp_path):
    """A crash while a snapshot is written leaves files without the mark; the next try replaces them."""
    log = log_of(spark, tmp_path)
    log.append(0, rows(spark, [("a", 1)]))
    log.append(1, rows(spark, [("a", 2)]))
    log.compact(1)
    (tmp_path / "snapshot" / "batch_id=1" / "_SUCCESS").unlink()
    for f in (tmp_path / "snapshot" / "batch_id=1").glob("*.parquet"):
        f.write_bytes(b"torn")
    assert rows_of(log) == {"a": 2}
    log.compact(1)
    assert log._numbers("snapshot") == [1] and rows_of(log) == {"a": 2}


def test_a_replayed_batch_replaces_its_rows_and_old_batches_go(spark, tmp_path):
    log = log_of(spark, tmp_path, every=2)
    for i in range(7):
        for _ in range(2 if i == 3 else 1):
            log.append(i, rows(spark, [("a", i), (f"k{i}", i)]))
    assert rows_of(log) == {"a": 6, **{f"k{i}": i for i in range(7)}}
    assert log._numbers("snapshot") == [3, 5] and log._numbers("log") == [4, 5, 6]


def test_state_log_of_changes_reads_a_snapshot_and_few_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(changes, "SnapshotLog", lambda *a, **k: SnapshotLog(*a, **k, every=2))
    feed = spark.range(60).select(
        F.lit("c").alias("client_id"), (F.col("id") % 7).cast("string").alias("path"), F.lit("MODIFIED").alias("type"), F.lit(None).cast("string").alias("old_path"),
        F.struct(F.col("id").alias("size"), F.col("id").alias("modified_time"), F.col("id").cast("string").alias("hash"), F.lit(1).alias("version"),
                 F.lit(False).alias("is_directory"), F.lit(False).alias("deleted"), F.lit(0).cast("long").alias("last_sync_time")).alias("metadata"),
        F.col("id").alias("seq"),
    )
    for k in range(5):
        feed.where((F.col("seq") >= 12 * k) & (F.col("seq") < 12 * k + 12)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
        got = changes.apply_changes_stream(spark, spark.readStream.schema(feed.schema).parquet(f"{tmp_path}/feed"), f"{tmp_path}/work")
    assert sorted(got.collect()) == sorted(changes.apply_changes(feed).collect())
    log = changes.state_log(spark, f"{tmp_path}/work")
    assert log._numbers("snapshot") == [1, 3] and log._numbers("log") == [2, 3, 4]


# ------------------------------------------------------------------ T3
FILE = "client_id string, path string, modified_time long"


def sent_rows(df):
    return sorted((r["client_id"], r["path"], r["modified_time"]) for r in df.collect())


def test_each_row_is_sent_once_over_deliveries(spark, tmp_path):
    work = f"{tmp_path}/work"
    first = spark.createDataFrame([("a", 10), ("z", 99)], "client_id string, last_sync_time long")
    deliveries = [
        [("a", "1", 9), ("a", "2", 11), ("b", "1", 1), ("b", "0", 0)],
        [("a", "2", 11), ("b", "1", 1), ("a", "3", 12), ("c", "1", 5)],  # partly again
        [("a", "late", 12), ("a", "4", 13), ("z", "1", 99), ("z", "2", 100)],
    ]
    for k, d in enumerate(deliveries):
        spark.createDataFrame(d, FILE).coalesce(1).write.parquet(f"{tmp_path}/feed/d={k}")
        feed = spark.readStream.schema(FILE).parquet(f"{tmp_path}/feed/d=[0-9]")
        got = sync_feed.sync_stream(spark, feed, work, first)
    assert sent_rows(got) == [("a", "2", 11), ("a", "3", 12), ("a", "4", 13), ("b", "1", 1), ("c", "1", 5), ("z", "2", 100)]
    # the same, round by round, with the batch operators
    state, total = first, []
    for d in deliveries:
        out = sync.incremental_sync(spark.createDataFrame(d, FILE), state)
        total += sent_rows(out)
        state = sync.advance_sync_state(state, out.groupBy("client_id").agg(F.max("modified_time").alias("sync_time")))
    assert sent_rows(got) == sorted(total)
    now = {r["client_id"]: r["last_sync_time"] for r in sync_feed.current_positions(spark, work).collect()}
    assert now == {r["client_id"]: r["last_sync_time"] for r in state.collect()} == {"a": 13, "b": 1, "c": 5, "z": 100}


def test_a_replayed_sync_batch_sends_the_same_again_in_its_place(spark, tmp_path):
    work = str(tmp_path)
    batch = spark.createDataFrame([("a", "1", 5), ("a", "2", 6), ("b", "1", 1)], FILE)
    for _ in range(2):  # the second run is the replay after a crash behind the output
        sync_feed.process_batch(spark, batch, 0, work, None)
    later = spark.createDataFrame([("a", "2", 6), ("a", "3", 7)], FILE)
    for _ in range(2):
        sync_feed.process_batch(spark, later, 1, work, None)
    sent = spark.read.parquet(f"{work}/sent")
    assert sent_rows(sent) == [("a", "1", 5), ("a", "2", 6), ("a", "3", 7), ("b", "1", 1)]
    # a batch touches the positions of its own clients only
    assert spark.read.parquet(f"{work}/positions/log/batch_id=1").select("client_id").collect() == [("a",)]


# ------------------------------------------------------------------ T4
def requests(spark, data):
    return spark.createDataFrame([(k, T0 + dt.timedelta(microseconds=us), i, b) for i, (k, us, b) in enumerate(data)],
                                 "key string, ts timestamp, event_id long, bytes long")


@pytest.mark.parametrize("seed", [1, 2])
def test_keyed_stream_equals_batch_on_time_ordered_deliveries(spark, tmp_path, seed):
    rnd = random.Random(seed)
    data, t = [], 0
    for _ in range(400):
        t += rnd.randint(0, 900_000)
        data.append((rnd.choice(["a", "b", "c", None]), t, rnd.choice([0, 1, 500, 4000, 9000])))
    whole = requests(spark, data)
    for a in range(0, 400, 100):
        whole.where((F.col("event_id") >= a) & (F.col("event_id") < a + 100)).repartition(3).write.mode("append").parquet(f"{tmp_path}/log")
        got = admission_stream(spark, spark.readStream.schema(whole.schema).parquet(f"{tmp_path}/log"), f"{tmp_path}/work", 1000, 5000)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, ratelimit.admit(whole, 1000, 5000).collect()))


def test_keyed_stream_keeps_nulls(spark, tmp_path):
    data = spark.createDataFrame([("a", None, 1, 5), ("a", T0, None, 6), ("a", T0, 3, None), (None, T0, 4, 7)], "key string, ts timestamp, event_id long, bytes long")
    data.write.parquet(f"{tmp_path}/log")
    got = admission_stream(spark, spark.readStream.schema(data.schema).parquet(f"{tmp_path}/log"), f"{tmp_path}/work", 10, 10)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, ratelimit.admit(data, 10, 10).collect()))
