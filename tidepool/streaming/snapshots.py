"""Latest row per key over micro-batches: a versioned snapshot and the batches after it.

A stream's ``foreachBatch`` appends each batch's rows under its number; a replayed batch
overwrites its own folder.  The table as of a batch is the latest row per key of
the newest snapshot up to it and of the batches in between, so a read costs the snapshot
and at most ``every`` batches, however long the stream has run.

A snapshot is written beside the old ones, and counts once Spark's job has committed it
(``_SUCCESS``): that is the switch.  A crash before it leaves a folder that is
overwritten by the next try; a crash after it loses nothing, since the batches it covers
are removed later, by ``vacuum``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.operators.files import latest_per_key

VERSION = "batch_id"


class SnapshotLog:
    """Rows of ``schema`` by ``keys``; of a key's rows the one of the latest batch holds, and
    within a batch the one that is greatest by ``order``."""

    def __init__(self, spark: SparkSession, root: str, schema: str | T.StructType, keys: list[str], order: tuple[str, ...] = (), every: int = 20):
        self.spark, self.root, self.keys, self.order, self.every = spark, root.rstrip("/"), keys, list(order), every
        fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
        self.schema = T.StructType([*fields, T.StructField(VERSION, T.LongType())])

    # ---- folders
    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _numbers(self, kind: str, above: int = -1, upto: int | None = None) -> list[int]:
        """Numbers of the committed folders of a kind in ``(above, upto]``, ascending."""
        fs, p = self._fs(f"{self.root}/{kind}")
        if not fs.exists(p):
            return []
        found = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(p) if "=" in s.getPath().getName()]
        return sorted(n for n in found if n > above and (upto is None or n <= upto) and self._done(kind, n))

    def _done(self, kind: str, n: int) -> bool:
        fs, p = self._fs(f"{self.root}/{kind}/{VERSION}={n}/_SUCCESS")
        return fs.exists(p)

    def _folder(self, kind: str, n: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{kind}/{VERSION}={n}")

    # ---- table
    def append(self, batch_id: int, rows: DataFrame) -> None:
        """The rows of a batch; the same batch again replaces them.  Every ``every`` batches a snapshot follows."""
        columns = self.schema.names[:-1]
        rows.select(*columns, F.lit(batch_id).cast("long").alias(VERSION)).write.mode("overwrite").parquet(f"{self.root}/log/{VERSION}={batch_id}")
        if (batch_id + 1) % self.every == 0:
            self.compact(batch_id)
            self.vacuum()

    def read(self, upto: int | None = None, only: DataFrame | None = None) -> DataFrame:
        """The latest row per key as of batch ``upto`` (all), for the keys in ``only`` (all)."""
        snapshots = self._numbers("snapshot", upto=upto)
        start = snapshots[-1] if snapshots else -1
        parts = [self._folder("snapshot", start)] if snapshots else []
        parts += [self._folder("log", n) for n in self._numbers("log", start, upto)]
        rows = self.spark.createDataFrame([], self.schema)
        for p in parts:
            rows = rows.unionByName(p)
        if only is not None:
            rows = rows.join(only.select(*self.keys).distinct(), self.keys, "left_semi")
        return latest_per_key(rows, self.keys, [VERSION, *self.order])

    def compact(self, upto: int) -> None:
        """Write the table as of ``upto`` as a snapshot; readers switch to it when it is committed."""
        if not self._done("snapshot", upto):
            self.read(upto).write.mode("overwrite").parquet(f"{self.root}/snapshot/{VERSION}={upto}")

    def vacuum(self, keep: int = 2) -> None:
        """Remove the snapshots but the last ``keep``, and the batches that the oldest of these covers."""
        snapshots = self._numbers("snapshot")
        if len(snapshots) < keep:
            return
        oldest = snapshots[-keep]
        for kind, last in (("snapshot", oldest - 1), ("log", oldest)):
            for n in self._numbers(kind, upto=last):
                fs, p = self._fs(f"{self.root}/{kind}/{VERSION}={n}")
                fs.delete(p, True)
