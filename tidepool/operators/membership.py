"""Membership in a large chunk store (S4, T1): Bloom filters beside the store, hits confirmed.

The index is a Parquet log of rows ``(cell, n, bits)``: a cell is the first three digits of a
hash, and each batch that was stored adds one filter per cell, built in tasks.  A lookup
sends the batch's hashes and the filters of their cells to the same tasks.  Hashes that no
filter knows are new, and the store is not read for them.  The others are looked up in
the store, which is sorted by hash: the read is limited to at most ``RANGES`` ranges of hashes that
cover the cells with a hit, so that Parquet's statistics skip the other pages.  What
is read follows the batch, and the result is exact: filters have no false negatives, and false
positives (about 1 in 100) don't pass the lookup.

The index is written before the store.  After a crash between the two it knows hashes that
the store doesn't have, which the lookup settles; it is only ever appended to, so that a
replayed batch, which finds its hashes stored already, takes nothing out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELL_DIGITS = 3
BITS = 10  # per hash
PROBES = 7
RANGES = 64
INDEX = "cell string, n long, bits binary"
_DIGITS = "0123456789abcdef"


def _cell(hash_col: str) -> Column:
    """The cell of a hash; hashes that are no hexadecimal digits share a cell (of their own)."""
    head = F.substring(hash_col, 1, CELL_DIGITS)
    return F.when(head.rlike(f"^[0-9a-f]{{{CELL_DIGITS}}}$"), head).otherwise(F.lit(""))


def _places(keys: np.ndarray, n_bits: int) -> Iterator[np.ndarray]:
    """The bits of each key, one array per probe."""
    keys = keys.view(np.uint64)
    low, high = keys & np.uint64(0xFFFFFFFF), keys >> np.uint64(32) | np.uint64(1)
    for i in range(PROBES):
        yield (low + np.uint64(i) * high) % np.uint64(n_bits)


def _filter(keys: np.ndarray) -> bytes:
    bits = np.zeros(-(-BITS * len(keys) // 8), np.uint8)
    for at in _places(keys, 8 * len(bits)):
        np.bitwise_or.at(bits, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
    return bits.tobytes()


def _may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), bool)
    for at in _places(keys, 8 * len(bits)):
        found &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return found


def _runs(cells: list[str]) -> Iterator[tuple[str, int, int]]:
    """(cell, begin, end) of each run of equal cells."""
    begin = 0
    for k in range(1, len(cells) + 1):
        if k == len(cells) or cells[k] != cells[begin]:
            yield cells[begin], begin, k
            begin = k


def filters(hashes: DataFrame) -> DataFrame:
    """One index row per cell of ``hash`` (a null is no hash)."""
    rows = hashes.where(F.col("hash").isNotNull()).select(_cell("hash").alias("cell"), F.xxhash64("hash").alias("key"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def row() -> pa.RecordBatch:
            keys = np.concatenate(held)
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([len(keys)], pa.int64()), pa.array([_filter(keys)], pa.binary())], names=["cell", "n", "bits"])

        for batch in batches:
            keys = batch.column(1).to_numpy()
            for cell, begin, end in _runs(batch.column(0).to_pylist()):
                if cell != at:
                    if held:
                        yield row()
                    at, held = cell, []
                held.append(keys[begin:end])
        if held:
            yield row()

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(build, INDEX)


def write_index(hashes: DataFrame, path: str) -> None:
    """Add the filters of ``hash`` to the index; call it before the hashes are stored."""
    filters(hashes).write.mode("append").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The index at ``path``, None before its first row."""
    try:
        return spark.read.schema(INDEX).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def may_be_stored(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """``(hash, cell)`` of the distinct hashes of ``wanted`` that some filter knows."""
    asked = wanted.select("hash").where(F.col("hash").isNotNull()).distinct().select(
        _cell("hash").alias("cell"), F.lit(1).alias("kind"), F.xxhash64("hash").alias("key"), "hash", F.lit(None).cast("binary").alias("bits")
    )
    cells = [r[0] for r in asked.select("cell").distinct().collect()]  # 16^3 + 1 at most
    known = index.where(covering("cell", cells)).select(
        "cell", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("key"), F.lit(None).cast("string").alias("hash"), "bits"
    )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            kinds, keys = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for cell, begin, end in _runs(batch.column(0).to_pylist()):
                if cell != at:
                    at, held = cell, []
                first = begin + int(np.searchsorted(kinds[begin:end], 1))
                held += [np.frombuffer(b.as_buffer(), np.uint8) for b in batch.column(4).slice(begin, first - begin)]
                if first < end and held:
                    found = np.zeros(end - first, bool)
                    for bits in held:
                        found |= _may_hold(bits, keys[first:end])
                    hits = batch.column(3).slice(first, end - first).filter(pa.array(found))
                    yield pa.RecordBatch.from_arrays([hits, pa.array([cell] * len(hits), pa.string())], names=["hash", "cell"])

    both = known.unionByName(asked).repartition("cell").sortWithinPartitions("cell", "kind")
    return both.mapInArrow(probe, "hash string, cell string")


def covering(column: str, cells: list[str]) -> Column:
    """A condition on ``column`` (a cell or a hash) that holds in all ``cells``, made of at most
    ``RANGES`` ranges: neighbours are one, and beyond that the narrowest gaps are taken in."""
    if "" in cells:  # hashes of another form may be anywhere
        return F.lit(True)
    numbers = sorted(int(c, 16) for c in set(cells))
    if not numbers:
        return F.lit(False)
    gaps = sorted((k for k in range(1, len(numbers)) if numbers[k] > numbers[k - 1] + 1), key=lambda k: numbers[k - 1] - numbers[k])
    cuts = [0, *sorted(gaps[: RANGES - 1]), len(numbers)]
    digits = lambda n: f"{n:0{CELL_DIGITS}x}"
    parts = []
    for a, b in zip(cuts, cuts[1:]):
        low, high = digits(numbers[a]), digits(numbers[b - 1])
        parts.append((F.col(column) >= low) & (F.col(column) < high + _after_digits()))
    while len(parts) > 1:  # balanced, so that the expression stays shallow
        parts = [parts[k] | parts[k + 1] if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def _after_digits() -> str:
    """Sorts after every hexadecimal digit."""
    return chr(ord(_DIGITS[-1]) + 1)


def stored_hashes(wanted: DataFrame, store: DataFrame, index: DataFrame | None) -> DataFrame:
    """``hash``: the hashes of ``wanted`` that ``store`` holds, each once.

    The hits are persisted (64 bytes each); they are let go with the session's cache or by ``unpersist``.
    """
    if index is None:
        return store.select("hash").limit(0)
    hits = may_be_stored(wanted, index).persist()
    cells = [r[0] for r in hits.select("cell").distinct().collect()]
    confirmed = store.where(covering("hash", cells)).select("hash")
    return hits.select("hash").join(confirmed, "hash", "left_semi")
