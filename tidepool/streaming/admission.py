"""T4 in Structured Streaming: a token bucket per key in the state store.

``transformWithStateInPandas`` keeps two numbers per key in RocksDB: what the bucket lacks to
full, and when.  A micro-batch reads and writes the buckets of its own keys only, and
the checkpoint ties states and decisions together, so a replayed batch starts from the
states before it.  A key's requests of one micro-batch are put in time order and
decided by the same running sums as in the batch job (``functions.bucket``); they are held as
numbers, some 33 bytes a request, so the trigger's batch size bounds a hot key's memory.
There is no watermark: every request gets a decision, a late one at the bucket's own time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tidepool.functions.bucket import MICRO, decide
from tidepool.operators.ratelimit import ADMIT_SCHEMA

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
NONE = -(1 << 63)  # stands for NULL on the way through pandas, which would make floats of the column
OUT = "key string, event_id long, ts_us long, bytes long, admitted boolean, tokens_after long"


class Buckets(StatefulProcessor):
    """A key's requests against its bucket."""

    def __init__(self, rate: int, burst: int):
        self.rate, self.burst = rate, burst

    def init(self, handle) -> None:
        self.bucket = handle.getValueState("bucket", "missing long, last_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows)).sort_values(["ts_us", "event_id"], kind="stable")
        ts, size = rows["ts_us"].to_numpy(np.int64), rows["bytes"].to_numpy(np.int64)
        if self.bucket.exists():
            missing, last = self.bucket.get()
        else:  # full, from the first dated request on
            dated = ts[ts != NONE]
            missing, last = 0, int(dated[0]) if len(dated) else 0
        admitted, left, missing, last = decide(ts, np.where(size == NONE, 0, size), self.rate, self.burst, missing, last)
        self.bucket.update((missing, last))
        out = rows[["event_id", "ts_us", "bytes"]].reset_index(drop=True)
        out.insert(0, "key", key[0])
        yield out.assign(admitted=admitted, tokens_after=self.burst * MICRO - left)

    def close(self) -> None:
        pass


def admission_stream(spark: SparkSession, stream: DataFrame, work: str, rate: int, burst: int | None = None) -> DataFrame:
    """Run the stream over ``(key, ts, event_id, bytes)`` to completion; return its decisions."""
    burst = burst or rate
    whole = lambda c: F.coalesce(c, F.lit(NONE))
    rows = stream.select(
        "key", whole(F.unix_micros("ts")).alias("ts_us"), whole(F.col("event_id")).alias("event_id"), whole(F.col("bytes")).alias("bytes")
    )
    decided = rows.groupBy("key").transformWithStateInPandas(Buckets(rate, burst), OUT, "append", "none")
    nulls = lambda c: F.when(F.col(c) != NONE, F.col(c)).alias(c)
    decided = decided.select("key", nulls("event_id"), nulls("ts_us"), nulls("bytes"), "admitted", "tokens_after")
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)  # the query keeps the settings it starts with
    try:
        q = (
            decided.writeStream.format("parquet").option("path", f"{work}/decisions")
            .option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
        )
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    q.awaitTermination()
    try:
        return spark.read.schema(ADMIT_SCHEMA).parquet(f"{work}/decisions")
    except AnalysisException as e:  # a stream without a batch
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ADMIT_SCHEMA)
