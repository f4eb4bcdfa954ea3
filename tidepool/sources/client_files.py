"""Rebuilt files written below ``<root>/clients/<id>/<path>``, a data source for writing.

Two phases.  Tasks stream the chunks of their files into a staging folder of their own and
note them in an index file; when all tasks are done the driver writes one commit record
that names the index files.  ``publish`` then moves the files to their places, in tasks.  Nothing
appears before the commit record, a job that fails removes its staging folder, and publishing
can be repeated after a failure at any point: what was moved stays, the rest follows.
Each file appears whole, in place of an older one.

Rows of a file come together, in order of ``chunk_index``; a NULL or empty chunk spoils its
file, which isn't written; ``chunk_index`` NULL marks an empty file.  A path that would
leave the client's folder is an error.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tidepool.session import work_dir
from tidepool.sources.files import resolved, store_of

ROW = "client_id string, file_path string, chunk_index int, data binary"
PUBLISHED = "client_id string, path string, size long, hash string"


def safe(client_id: str, path: str) -> str:
    """The place below the root; never outside the client's folder."""
    parts = path.split("/")
    if not client_id or "/" in client_id or client_id in (".", "..") or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"no place for client {client_id!r}, path {path!r}")
    return f"clients/{client_id}/{path}"


class StagedFiles:
    """The files that one task writes: at most one is open."""

    def __init__(self, folder: str):
        self.store, self.folder = store_of(folder)
        self.store.create_dir(self.folder, recursive=True)
        self.key, self.out, self.index = None, None, []

    def add(self, key: tuple[str, str], chunk_index: int | None, data: bytes | None) -> None:
        if key != self.key:
            self.close()
            safe(*key)
            self.key, self.digest, self.size, self.spoilt = key, hashlib.sha256(), 0, False
            self.name = f"{self.folder}/{len(self.index)}-{uuid.uuid4().hex[:8]}"
            self.out = self.store.open_output_stream(self.name)
        if chunk_index is None:
            return
        if not data:
            self.spoilt = True
        elif not self.spoilt:
            self.out.write(data)
            self.digest.update(data)
            self.size += len(data)

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        self.out = None
        if self.spoilt:
            self.store.delete_file(self.name)
        else:
            self.index.append({"staged": self.name, "client_id": self.key[0], "path": self.key[1], "size": self.size, "hash": self.digest.hexdigest()})


class Staged(WriterCommitMessage):
    def __init__(self, index: str):
        self.index = index


class ClientFilesWriter(DataSourceArrowWriter):
    def __init__(self, root: str, job: str):
        self.root, self.job = root, job

    def write(self, iterator):
        folder = f"{self.root}/_staging/{self.job}/{uuid.uuid4().hex}"  # a second attempt has a folder of its own
        files = StagedFiles(folder)
        for rb in iterator:
            ids, paths, at, data = (rb.column(n) for n in ("client_id", "file_path", "chunk_index", "data"))
            for r in range(rb.num_rows):
                files.add((ids[r].as_py(), paths[r].as_py()), at[r].as_py(), data[r].as_py())
        files.close()
        with files.store.open_output_stream(f"{files.folder}/index") as out:
            out.write("".join(json.dumps(f) + "\n" for f in files.index).encode())
        return Staged(f"{folder}/index")

    def commit(self, messages):
        store, root = store_of(self.root)
        store.create_dir(f"{root}/_commits", recursive=True)
        with store.open_output_stream(f"{root}/_commits/.{self.job}") as out:
            out.write("".join(m.index + "\n" for m in messages if m is not None).encode())
        store.move(f"{root}/_commits/.{self.job}", f"{root}/_commits/{self.job}")  # the switch

    def abort(self, messages):
        store, root = store_of(self.root)
        store.create_dir(f"{root}/_staging/{self.job}", recursive=True)
        store.delete_dir(f"{root}/_staging/{self.job}")


class ClientFiles(DataSource):
    """``df.write.format("client_files").option("job", id).save(root)``."""

    @classmethod
    def name(cls):
        return "client_files"

    def schema(self):
        return ROW

    def writer(self, schema, overwrite):
        return ClientFilesWriter(self.options["path"], self.options["job"])


def write_files(rows: DataFrame, root: str) -> str:
    """Stage and commit the files of ``rows`` (``ROW``); returns the job's id for ``publish``."""
    spark = rows.sparkSession
    spark.dataSource.register(ClientFiles)
    job = uuid.uuid4().hex
    ordered = rows.select("client_id", "file_path", "chunk_index", "data").repartition("client_id", "file_path").sortWithinPartitions(
        "client_id", "file_path", "chunk_index"
    )
    ordered.write.format("client_files").option("job", job).mode("append").save(resolved(spark, root))
    return job


def publish(spark: SparkSession, root: str, job: str) -> DataFrame:
    """Move a committed job's files to their places; ``(client_id, path, size, hash)`` of each.

    Safe to repeat: a file that was moved already is only reported.
    """
    root = resolved(spark, root)
    store, base = store_of(root)
    with store.open_input_file(f"{base}/_commits/{job}") as f:  # one line per task
        names = f.read().decode().split()

    def run(batches):
        from pyarrow import fs

        for rb in batches:
            for index in rb.column(0).to_pylist():
                store, at = store_of(index)
                with store.open_input_file(at) as f:
                    entries = [json.loads(line) for line in f.read().splitlines()]
                for e in entries:
                    target = f"{base}/{safe(e['client_id'], e['path'])}"
                    if store.get_file_info(e["staged"]).type != fs.FileType.NotFound:
                        store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                        store.move(e["staged"], target)
                cols = [pa.array([e[k] for e in entries], t) for k, t in (("client_id", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("hash", pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names=["client_id", "path", "size", "hash"])

    work = work_dir(spark, "published")
    tasks = max(1, min(len(names), 10_000))
    spark.createDataFrame([(n,) for n in names], "index string").repartition(tasks).mapInArrow(run, PUBLISHED).write.parquet(work)
    return spark.read.schema(PUBLISHED).parquet(work)
