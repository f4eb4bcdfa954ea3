"""Token buckets over transfer logs: T4 admission decisions.

A refused request costs nothing, so decisions are no plain window sum.  The plan
hash-partitions by key, sorts within partitions by ``(key, ts, event_id)``
(external sort, spills), and decides each key's rows batch by batch with running
sums (``functions.bucket``); a key's state between batches is two numbers.  One
key's requests depend on each other in order, so they pass through one task, in
bounded memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions.bucket import MICRO, decide

ADMIT_SCHEMA = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("ts_us", T.LongType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("admitted", T.BooleanType()),
    T.StructField("tokens_after", T.LongType()),
])
# a decision, or (``is_state``) a key's bucket after its last row, in ``tokens_after`` and ``ts_us``
FOLD_SCHEMA = T.StructType([*ADMIT_SCHEMA.fields, T.StructField("is_state", T.BooleanType())])


def fold(rows: DataFrame, rate: int, burst: int) -> DataFrame:
    """Decisions and final states for ``(key, ts_us, event_id, bytes, is_state, tokens)`` rows.

    A state row (``is_state``, with the bucket's ``tokens`` at ``ts_us``) comes before
    its key's requests; a key without one starts full at its first request.  Rows with
    a NULL key share a bucket; a NULL time or size counts as the bucket's time or 0.
    """
    ordered = rows.select("key", F.col("is_state"), "ts_us", "event_id", "bytes", "tokens").repartition("key").sortWithinPartitions(
        F.col("key").asc_nulls_first(), F.col("is_state").desc(), F.col("ts_us").asc_nulls_first(), "event_id"
    )
    cap = burst * MICRO

    def run(batches):
        key, known, missing, last = None, False, 0, None

        def state_row():
            return pa.RecordBatch.from_arrays([
                pa.array([key], pa.string()), pa.array([None], pa.int64()), pa.array([last], pa.int64()), pa.array([None], pa.int64()),
                pa.array([None], pa.bool_()), pa.array([cap - missing], pa.int64()), pa.array([True]),
            ], names=FOLD_SCHEMA.names)

        for rb in batches:
            keys = rb.column("key")
            n = len(keys)
            if not n:
                continue
            ids = keys.dictionary_encode().indices.fill_null(-1).to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))).tolist()
            is_state = rb.column("is_state").to_numpy(zero_copy_only=False)
            ts_null = rb.column("ts_us").is_null().to_numpy(zero_copy_only=False)
            ts = rb.column("ts_us").fill_null(np.iinfo(np.int64).min).to_numpy()
            size = rb.column("bytes").fill_null(0).to_numpy()
            tokens = rb.column("tokens").fill_null(0).to_numpy()
            admitted, after = np.zeros(n, bool), np.zeros(n, np.int64)
            for s, e in zip(starts, [*starts[1:], n]):
                k = keys[s].as_py()
                if not known or k != key:
                    if known:
                        yield state_row()
                    key, known, missing, last = k, True, 0, None
                while s < e and is_state[s]:
                    missing, last = cap - int(tokens[s]), int(ts[s])
                    s += 1
                if s == e:
                    continue
                if last is None:
                    last = int(ts[s:e][~ts_null[s:e]][0]) if not ts_null[s:e].all() else 0
                admitted[s:e], left, missing, last = decide(ts[s:e], size[s:e], rate, burst, missing, last)
                after[s:e] = cap - left
            keep = np.flatnonzero(~is_state)
            if len(keep):
                out = rb.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([
                    out.column("key"), out.column("event_id"), out.column("ts_us"), out.column("bytes"),
                    pa.array(admitted[keep]), pa.array(after[keep]), pa.array(np.zeros(len(keep), bool)),
                ], names=FOLD_SCHEMA.names)
        if known:
            yield state_row()

    return ordered.mapInArrow(run, FOLD_SCHEMA)


def requests(log: DataFrame) -> DataFrame:
    """A transfer log ``(key, ts, event_id, bytes)`` as rows for ``fold``."""
    return log.select(
        "key", F.lit(False).alias("is_state"), F.unix_micros("ts").alias("ts_us"), "event_id", "bytes", F.lit(None).cast("long").alias("tokens")
    )


def admit(log: DataFrame, rate: int, burst: int | None = None) -> DataFrame:
    """T4: a decision per row of ``(key, ts, event_id, bytes)``.

    Tokens refill with time up to ``burst``; a request is admitted, and its bytes are
    taken, iff there are as many.  Buckets start full; ``burst`` defaults to ``rate``.
    """
    return fold(requests(log), rate, burst or rate).where(~F.col("is_state")).drop("is_state")
