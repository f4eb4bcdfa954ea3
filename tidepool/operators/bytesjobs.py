"""Byte-level jobs as Spark tasks: C3 window fingerprints and their roll-up."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions import cdc
from tidepool.operators.chunking import _binary_parts


STRETCH = 1 << 20  # bytes of neighbouring documents that are hashed in one go
HELD = 1 << 22  # windows that a task combines before it passes them on
RANGE_BITS = 18  # fingerprints are below 2^30: 4,096 ranges, each a dense array of 2 MB where it is summed


def window_fingerprints(docs: DataFrame, keys: list[str], content: str = "content", window: int = 48) -> DataFrame:
    """``(keys..., pos, fp)`` for every position with a full window of ``window``
    bytes; ``pos`` is the window's end byte."""
    src = docs.select(*keys, F.col(content).alias("__content"))
    out_schema = T.StructType(
        [src.schema[k] for k in keys]
        + [T.StructField("pos", T.LongType(), False), T.StructField("fp", T.LongType(), False)]
    )
    n_keys = len(keys)

    def run(batches):
        for rb in batches:
            offsets, data, nulls = _binary_parts(rb.column(n_keys))
            nulls = nulls.to_numpy(zero_copy_only=False)
            for r in range(rb.num_rows):
                if nulls[r]:
                    continue
                fp = cdc.window_fingerprints(data[int(offsets[r]) : int(offsets[r + 1])], window)
                if len(fp):
                    take = pa.array(np.full(len(fp), r))
                    pos = np.arange(window - 1, window - 1 + len(fp), dtype=np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [rb.column(i).take(take) for i in range(n_keys)] + [pa.array(pos), pa.array(fp.view(np.int64))],
                        names=[f.name for f in out_schema.fields],
                    )

    return src.mapInArrow(run, out_schema)


def _packed(fp: np.ndarray, n_docs: np.ndarray, n_occ: np.ndarray):
    """(range, payload) per range of sorted distinct fingerprints with their counts.

    A payload is the step width, the fingerprints as steps (2 bytes each, 4 where they are far apart), then
    the place and the counts of those that don't come once in one document.
    """
    at = fp >> RANGE_BITS
    cuts = np.flatnonzero(np.diff(at, prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(fp)]):
        low = fp[a:b] & ((1 << RANGE_BITS) - 1)
        steps = np.diff(low, prepend=0)
        wide = int(steps.max()) >= 1 << 16
        many = np.flatnonzero(n_occ[a:b] > 1)
        payload = (
            np.array([wide, b - a], np.uint32).tobytes() + steps.astype(np.uint32 if wide else np.uint16).tobytes()
            + many.astype(np.uint32).tobytes() + n_docs[a:b][many].astype(np.int64).tobytes() + n_occ[a:b][many].astype(np.int64).tobytes()
        )
        yield int(at[a]), payload


def _unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the range, n_docs, n_occurrences) of a payload."""
    wide, n = np.frombuffer(payload, np.uint32, 2).tolist()
    end = 8 + n * (4 if wide else 2)
    low = np.cumsum(np.frombuffer(payload, np.uint32 if wide else np.uint16, n, 8), dtype=np.int64)
    k = (len(payload) - end) // 20
    many = np.frombuffer(payload, np.uint32, k, end)
    docs, occ = np.ones(n, np.int64), np.ones(n, np.int64)
    counts = np.frombuffer(payload[end + 4 * k :], np.int64)
    docs[many], occ[many] = counts[:k], counts[k:]
    return low, docs, occ


def _combined(fp: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints, the documents and the windows that have each."""
    key = np.sort(fp << np.uint64(32) | doc.astype(np.uint64))  # one sort by (fingerprint, document)
    of = (key >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(of, prepend=-1))
    new_pair = np.concatenate(([True], key[1:] != key[:-1]))
    return of[first], np.add.reduceat(new_pair.astype(np.int64), first), np.diff(np.append(first, len(of)))


def shared_passages(docs: DataFrame, content: str = "content", window: int = 48) -> DataFrame:
    """Roll-up of C3: every fingerprint seen in more than one document (row), with its documents and occurrences.

    A document is whole in its row, so a task combines the windows of some thousands of documents.
    Fingerprints are below 2^30; sorted, most are a 2-byte step from the one before, so what
    is shuffled is some 2 bytes per input byte, in a row per task and range.  A range is summed
    in dense arrays of fixed size, whatever the number of rows that arrive for it.
    """
    src = docs.select(F.col(content).alias("__content"))

    def run(batches):
        held: list = []
        n = 0

        def flush():
            nonlocal held, n
            fp, doc = (np.concatenate(c) for c in zip(*held))
            held, n = [], 0
            rows = list(_packed(*_combined(fp, doc)))
            return pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], names=["range", "payload"])

        number = 0  # of documents in this task
        for rb in batches:
            offsets, data, nulls = _binary_parts(rb.column(0))
            nulls = nulls.to_numpy(zero_copy_only=False)
            r = 0
            while r < rb.num_rows:
                # neighbouring documents in one go; windows across their borders are left out
                e = max(r + 1, int(np.searchsorted(offsets, offsets[r] + STRETCH, side="right")) - 1)
                e = min(e, rb.num_rows)
                lo, hi = int(offsets[r]), int(offsets[e])
                fps = cdc.window_fingerprints(data[lo:hi], window)
                sizes = np.diff(offsets[r : e + 1]).astype(np.int64)
                owner = np.repeat(np.arange(r, e), sizes)[window - 1 :]
                begin = np.repeat(offsets[r:e].astype(np.int64), sizes)[window - 1 :]
                inside = (np.arange(lo + window - 1, hi) - begin >= window - 1) & ~nulls[owner] if len(fps) else np.zeros(0, bool)
                held.append((fps[inside], owner[inside] + number))
                n += int(inside.sum())
                if n >= HELD:
                    yield flush()
                r = e
            number += rb.num_rows
        if n:
            yield flush()

    def total(batches):
        at, docs_in, occ_in = None, None, None

        def flush():
            found = np.flatnonzero(docs_in > 1)
            return pa.RecordBatch.from_arrays(
                [pa.array((at << RANGE_BITS) + found), pa.array(docs_in[found]), pa.array(occ_in[found])], names=["fp", "n_docs", "n_occurrences"]
            )

        for rb in batches:
            for r, payload in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
                if r != at:
                    if at is not None:
                        yield flush()
                    at = r
                    docs_in, occ_in = np.zeros((2, 1 << RANGE_BITS), np.int64)
                low, docs_of, occ = _unpacked(payload)
                docs_in[low] += docs_of
                occ_in[low] += occ
        if at is not None:
            yield flush()

    packed = src.mapInArrow(run, "range int, payload binary").repartition("range").sortWithinPartitions("range")
    return packed.mapInArrow(total, "fp long, n_docs long, n_occurrences long")
