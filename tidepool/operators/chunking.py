"""Content-defined chunking of a binary column, chunk statistics.

Cuts chain inside one file, so parallelism is across files: each Spark task
chunks the files of its partition with the vectorised kernel and emits one
row per chunk.  Only the key columns and the bytes enter Python; the chunk
bytes go back to the JVM only when ``with_data`` is asked for.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions import cdc
from tidepool.sources.files import dealt, pieces


def _binary_parts(arr: pa.Array):
    """(offsets, data) numpy views of a (large_)binary Arrow array, zero-copy."""
    arr = arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr
    wide = pa.types.is_large_binary(arr.type) or pa.types.is_large_string(arr.type)
    off_type = np.int64 if wide else np.int32
    bufs = arr.buffers()
    offsets = np.frombuffer(bufs[1], dtype=off_type)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.empty(0, np.uint8)
    return offsets, data, arr.is_null()


def cdc_chunks(
    files: DataFrame,
    keys: list[str],
    content: str = "content",
    min_size: int = cdc.DEFAULT_MIN,
    avg_size: int = cdc.DEFAULT_AVG,
    max_size: int = cdc.DEFAULT_MAX,
    mask_bits: int = cdc.DEFAULT_MASK_BITS,
    switch: int | None = None,
    with_data: bool = False,
) -> DataFrame:
    """One row per chunk: ``keys..., chunk_index, offset, size, hash[, data]``.

    Empty or NULL content (a missing file) gives no rows.
    """
    params = dict(min_size=min_size, avg_size=avg_size, max_size=max_size, mask_bits=mask_bits, switch=switch)
    src = files.select(*keys, F.col(content).alias("__content"))
    key_fields = [src.schema[k] for k in keys]
    out_schema = T.StructType(
        key_fields
        + [
            T.StructField("chunk_index", T.IntegerType(), False),
            T.StructField("offset", T.LongType(), False),
            T.StructField("size", T.IntegerType(), False),
            T.StructField("hash", T.StringType(), False),
        ]
        + ([T.StructField("data", T.BinaryType(), False)] if with_data else [])
    )
    n_keys = len(keys)

    def run(batches):
        for rb in batches:
            offsets, data, nulls = _binary_parts(rb.column(n_keys))
            starts = offsets[:-1].astype(np.int64)
            ends = np.where(nulls.to_numpy(zero_copy_only=False), starts, offsets[1:])
            file, end = cdc.cut_many(data, starts, ends, **params)
            new = np.flatnonzero(np.diff(file, prepend=-1))  # the first chunk of each file
            begin = np.concatenate(([0], end))[:-1].astype(np.int64)
            begin[new] = 0
            index = np.arange(len(file)) - np.repeat(new, np.diff(np.append(new, len(file))))
            lo, view = starts[file] + begin, memoryview(data)
            chunks = [view[a:b] for a, b in zip(lo.tolist(), (lo + end - begin).tolist())]
            cols = [rb.column(i).take(pa.array(file)) for i in range(n_keys)]
            cols += [
                pa.array(index.astype(np.int32)),
                pa.array(begin),
                pa.array((end - begin).astype(np.int32)),
                pa.array([hashlib.sha256(p).hexdigest() for p in chunks], pa.string()),
            ]
            if with_data:
                cols.append(pa.array([p.tobytes() for p in chunks], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(
                [pa.field(f.name, c.type) for f, c in zip(out_schema.fields, cols)]))

    return src.mapInArrow(run, out_schema)


def chunk_stats(files: DataFrame, keys: list[str], content: str = "content", **params) -> DataFrame:
    """A1: per file count/min/max/avg chunk size; files without chunks give zeros.

    A file is one row of the scan, so its statistics come straight from the
    kernel: no shuffle, no join, and chunks are not hashed.
    """
    src = files.select(*keys, F.col(content).alias("__content"))
    stats = [("total_chunks", T.LongType()), ("min_size", T.LongType()), ("max_size", T.LongType()), ("avg_size", T.DoubleType())]
    out_schema = T.StructType([src.schema[k] for k in keys] + [T.StructField(n, t, False) for n, t in stats])
    n_keys = len(keys)

    def run(batches):
        for rb in batches:
            offsets, data, nulls = _binary_parts(rb.column(n_keys))
            starts = offsets[:-1].astype(np.int64)
            ends = np.where(nulls.to_numpy(zero_copy_only=False), starts, offsets[1:])
            file, end = cdc.cut_many(data, starts, ends, **params)
            count = np.bincount(file, minlength=rb.num_rows)
            new = np.flatnonzero(np.diff(file, prepend=-1))
            size = np.diff(end, prepend=0)
            size[new] = end[new]
            least, most = np.zeros((2, rb.num_rows), np.int64)
            if len(new):
                least[file[new]], most[file[new]] = np.minimum.reduceat(size, new), np.maximum.reduceat(size, new)
            average = np.divide(ends - starts, count, out=np.zeros(rb.num_rows), where=count > 0)
            cols = [rb.column(i) for i in range(n_keys)] + [pa.array(c) for c in (count, least, most, average)]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in out_schema.fields])

    return src.mapInArrow(run, out_schema)


def cdc_file_chunks(listing: DataFrame, with_data: bool = False, **params) -> DataFrame:
    """C1 over files of any size: ``path, chunk_index, offset, size, hash[, data]`` from a listing.

    A file is read as a stream by one task, since its cuts chain; the task holds the open
    chunk and ``READ_BYTES`` of the file.  No bytes are shuffled.  An empty file has no chunks.
    """
    schema = "path string, chunk_index int, offset long, size int, hash string" + (", data binary" if with_data else "")
    fields = [("path", pa.string()), ("chunk_index", pa.int32()), ("offset", pa.int64()), ("size", pa.int32()), ("hash", pa.string())]
    fields += [("data", pa.binary())] if with_data else []

    def run(batches):
        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])

        for rb in batches:
            for path in rb.column(0).to_pylist():
                h, open_len, base, held, rows = 0, 0, 0, [], []
                for data in pieces(path):
                    part = np.frombuffer(data, np.uint8)
                    ends, h, open_len = cdc.scan_cuts(part, **params, h=h, open_len=open_len)
                    at = 0
                    for e in ends:
                        held.append(data[at:e])
                        chunk = b"".join(held)
                        rows.append((path, rows[-1][1] + 1 if rows else 0, base, len(chunk), hashlib.sha256(chunk).hexdigest(), chunk))
                        base, held, at = base + len(chunk), [], e
                    held.append(data[at:])
                    if len(rows) > 1:  # the last one numbers what follows
                        yield table(rows[:-1])
                        rows = rows[-1:]
                if open_len:
                    chunk = b"".join(held)
                    rows.append((path, rows[-1][1] + 1 if rows else 0, base, len(chunk), hashlib.sha256(chunk).hexdigest(), chunk))
                if rows:
                    yield table(rows)

    return dealt(listing).select("path").mapInArrow(run, schema)


def cdc_chunks_segmented(
    segments: DataFrame,
    keys: list[str],
    seg_col: str = "seg",
    content: str = "content",
    **params,
) -> DataFrame:
    """C1 for files stored as ordered segments (files beyond the 2 GB value
    limit, or any file split into parts): same rows as ``cdc_chunks`` on the
    whole file.

    Segments are hash-partitioned by file and sorted by ``seg_col``; one Arrow
    pass per partition scans each byte once and carries the open chunk as its
    rolling hash, length and SHA-256 state, so a task holds one segment
    whatever the file size.  The segments of one file go through one task in
    order: the cuts of a file chain from its first byte.
    """
    src = (
        segments.select(*keys, seg_col, F.col(content).alias("__content"))
        .repartition(*keys)
        .sortWithinPartitions(*keys, seg_col)
    )
    out_schema = T.StructType(
        [src.schema[k] for k in keys]
        + [
            T.StructField("chunk_index", T.IntegerType(), False),
            T.StructField("offset", T.LongType(), False),
            T.StructField("size", T.IntegerType(), False),
            T.StructField("hash", T.StringType(), False),
        ]
    )
    n_keys = len(keys)

    def run(batches):
        cur, h, open_len, digest, base, idx = None, 0, 0, hashlib.sha256(), 0, 0
        out = {f.name: [] for f in out_schema.fields}
        types = {"chunk_index": pa.int32(), "offset": pa.int64(), "size": pa.int32(), "hash": pa.string()}

        def emit():
            """The open chunk of the current file ends here."""
            nonlocal digest, open_len, base, idx
            for k, v in zip(keys, cur):
                out[k].append(v)
            out["chunk_index"].append(idx)
            out["offset"].append(base)
            out["size"].append(open_len)
            out["hash"].append(digest.hexdigest())
            digest, base, open_len, idx = hashlib.sha256(), base + open_len, 0, idx + 1

        def flush():
            cols = [pa.array(out[f.name], type=types[f.name]) for f in out_schema.fields]
            for v in out.values():
                v.clear()
            return pa.RecordBatch.from_arrays(cols, names=[f.name for f in out_schema.fields])

        for rb in batches:
            for i, k in enumerate(keys):
                types[k] = rb.schema.field(i).type
            key_rows = list(zip(*[rb.column(i).to_pylist() for i in range(n_keys)]))
            offsets, data, nulls = _binary_parts(rb.column(n_keys + 1))
            nulls = nulls.to_numpy(zero_copy_only=False)
            for r, key in enumerate(key_rows):
                if key != cur:
                    if open_len:
                        emit()
                    cur, h, open_len, digest, base, idx = key, 0, 0, hashlib.sha256(), 0, 0
                if nulls[r]:
                    continue
                part = data[int(offsets[r]) : int(offsets[r + 1])]
                ends, h, _ = cdc.scan_cuts(part, **params, h=h, open_len=open_len)
                prev = 0
                for e in ends:
                    digest.update(part[prev:e])
                    open_len += e - prev
                    emit()
                    prev = e
                digest.update(part[prev:])
                open_len += len(part) - prev
            if out["chunk_index"]:
                yield flush()
        if open_len:
            emit()
            yield flush()

    return src.mapInArrow(run, out_schema)
