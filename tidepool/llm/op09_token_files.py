"""Token files: static range asymmetric numeral system (rANS), shared frequencies.

Documents become token ids (each with an end id), ordered by document id over all
files.  One frequency table, counted over all tokens and scaled to 2^20, serves
every block.  A block holds whole documents and decodes by itself:

    magic "TPA1" | digest of the table (16 bytes)
    u32 lanes | u32 documents | u64 tokens | u32 words
    i64 document ids | u8 id present | u32 tokens per document
    u64 final state per lane | u32 code words

Token ``i`` belongs to lane ``i mod lanes``; all lanes advance together, so encoding
and decoding are vector operations over a step.  States stay in [2^31, 2^63) and
give or take one 32-bit word per step at most; words lie in the order in which the
decoder wants them.  Every block's row is a checkpoint (file, number, first token
and byte offset in the file) with the CRC-32 of its bytes, so decoders start
anywhere, in parallel, and detect damage.  The blocks of a file, joined, are a
plain binary stream; they are kept as rows of Parquet files, which Spark commits
and reads on any store.

Ids are held once, packed, in the shared folder; they are shuffled by document id
once.  No task holds more than a block or its largest document.

Cases: null and empty texts hold the end id alone; null document ids come first;
rows that share an id follow each other, ordered by their ids; an empty table gives
no blocks and no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.llm.common import shared_dir, slices, table, text_of
from tidepool.llm.tokens import pieces
from tidepool.operators.chunking import _binary_parts

END_ID = 1
SCALE_BITS = 20
BLOCK_TOKENS = 1 << 19
MAX_LANES = 2048
ROWS = 256
STEPS = 256  # fewer lanes rather than fewer steps in a small block
LOW = 31  # states lie in [2^LOW, 2^(LOW + 32))
MAGIC = b"TPA1"
_HEAD = "<4s16sIIQI"

BLOCK = "file_no int, block_no int, first_token long, byte_offset long, n_docs int, n_tokens long, crc32 long, payload binary"
DOCUMENT = "file_no int, doc_id long, start_in_file long, n_tokens long, ids_crc32 long"


class Frequencies:
    """Counts scaled to 2^SCALE_BITS, at least 1 each, with their running sums."""

    def __init__(self, counts: np.ndarray):
        total, space = int(counts.sum()), 1 << SCALE_BITS
        used = np.flatnonzero(counts)
        if len(used) > space:
            raise ValueError(f"{len(used)} symbols do not fit {SCALE_BITS} bits")
        freq = np.zeros(len(counts), np.int64)
        if total:
            exact = counts[used] * (space / total)
            freq[used] = np.maximum(1, np.floor(exact)).astype(np.int64)
            over = int(freq.sum()) - space
            order = used[np.argsort(-freq[used], kind="stable")]
            while over > 0:  # ones rounded up: the largest give way, in proportion
                give = np.minimum(freq[order] - 1, np.maximum(1, freq[order] * over // space))
                give = np.where(np.cumsum(give) <= over, give, np.maximum(0, over - (np.cumsum(give) - give)))
                freq[order] -= give
                over -= int(give.sum())
            freq[order[0]] -= over
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.digest = hashlib.md5(self.freq.tobytes()).digest()
        self._symbols: np.ndarray | None = None

    @property
    def symbols(self) -> np.ndarray:
        """Symbol of every slot."""
        if self._symbols is None:
            self._symbols = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._symbols


def encode(tokens: np.ndarray, f: Frequencies) -> tuple[int, np.ndarray, np.ndarray]:
    """(lanes, final states, code words) of a block."""
    n = len(tokens)
    lanes = max(1, min(MAX_LANES, -(-n // STEPS)))
    steps = -(-n // lanes)
    freq, start = f.freq[tokens], f.start[tokens]
    state = np.full(lanes, 1 << LOW, np.uint64)
    words: list[np.ndarray] = []
    limit, word, bits = np.uint64(LOW + 32 - SCALE_BITS), np.uint64(32), np.uint64(SCALE_BITS)
    for s in range(steps - 1, -1, -1):
        fr, st = freq[s * lanes : (s + 1) * lanes], start[s * lanes : (s + 1) * lanes]
        x = state[: len(fr)]
        full = x >> limit >= fr
        words.append(x[full].astype(np.uint32))
        x = np.where(full, x >> word, x)
        q = x // fr
        state[: len(fr)] = (q << bits) + (x - q * fr) + st
    return lanes, state, np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)


def decode(n: int, lanes: int, state: np.ndarray, words: np.ndarray, f: Frequencies) -> np.ndarray:
    out = np.empty(n, np.uint32)
    state, at = state.copy(), 0
    mask, low, word, bits = np.uint64((1 << SCALE_BITS) - 1), np.uint64(1 << LOW), np.uint64(32), np.uint64(SCALE_BITS)
    symbols, words = f.symbols, words.astype(np.uint64)
    for a in range(0, n, lanes):
        m = min(lanes, n - a)
        x = state[:m]
        slot = x & mask
        token = symbols[slot]
        out[a : a + m] = token
        x = f.freq[token] * (x >> bits) + slot - f.start[token]
        need = x < low
        k = int(np.count_nonzero(need))
        if k:
            x[need] = (x[need] << word) | words[at : at + k]
            at += k
        state[:m] = x
    if at != len(words) or (state != low).any():
        raise ValueError("block does not decode to its start")
    return out


def pack(ids: list[int | None], lengths: list[int], tokens: np.ndarray, f: Frequencies) -> bytes:
    lanes, state, words = encode(tokens, f)
    return b"".join((
        struct.pack(_HEAD, MAGIC, f.digest, lanes, len(ids), len(tokens), len(words)),
        np.array([i or 0 for i in ids], "<i8").tobytes(), np.array([i is not None for i in ids], "u1").tobytes(),
        np.array(lengths, "<u4").tobytes(), state.astype("<u8").tobytes(), words.astype("<u4").tobytes(),
    ))


def unpack(data: bytes, f: Frequencies) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, tokens per document, tokens) of a block."""
    magic, digest, lanes, n_docs, n, n_words = struct.unpack_from(_HEAD, data)
    if magic != MAGIC or digest != f.digest:
        raise ValueError("not a block of this table")
    at = struct.calcsize(_HEAD)
    parts = []
    for kind, count in (("<i8", n_docs), ("u1", n_docs), ("<u4", n_docs), ("<u8", lanes), ("<u4", n_words)):
        parts.append(np.frombuffer(data, kind, count, at))
        at += parts[-1].nbytes
    ids, present, lengths, state, words = parts
    if at != len(data):
        raise ValueError("block has the wrong length")
    return [int(i) if p else None for i, p in zip(ids, present, strict=True)], lengths, decode(n, lanes, state.astype(np.uint64), words, f)


def _tokenized(tokenizer_file: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(tokenizer_file)
        end = np.array([end_id], p.dtype).tobytes()
        for batch in slices(batches, ROWS):
            ids = pa.array([p.ids(t) + end for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["id", "ids"])

    return run


def _counts(dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            # the values lie one after the other: counted where they are
            ends, data, _ = _binary_parts(batch.column("ids"))
            found = np.bincount(data[int(ends[0]) : int(ends[-1])].view(dtype), minlength=len(total))
            found[: len(total)] += total
            total = found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["token", "n"])

    return run


def _encoded(sent, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, file_no = Frequencies(sent.value), TaskContext.get().partitionId()
        ids, parts, held, block_no, first, offset = [], [], 0, 0, 0, 0

        def block() -> pa.RecordBatch:
            nonlocal ids, parts, held, block_no, first, offset
            tokens = np.frombuffer(b"".join(parts), dtype)
            size = np.dtype(dtype).itemsize
            data = pack(ids, [len(p) // size for p in parts], tokens, f)
            row = [file_no, block_no, first, offset, len(ids), len(tokens), zlib.crc32(data), data]
            ids, parts, held, block_no, first, offset = [], [], 0, block_no + 1, first + len(tokens), offset + len(data)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in BLOCK.split(", ")])

        for batch in batches:
            for i, x in zip(batch.column("id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids.append(i)
                parts.append(x)
                held += len(x) // np.dtype(dtype).itemsize
                if held >= BLOCK_TOKENS:
                    yield block()
        if ids:
            yield block()

    return run


def _decoded(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Frequencies(sent.value)
        for batch in batches:
            for row in batch.to_pylist():
                if zlib.crc32(row["payload"]) != row["crc32"]:
                    raise ValueError(f"file {row['file_no']}, block {row['block_no']}: checksum differs")
                ids, lengths, tokens = unpack(row["payload"], f)
                ends = np.cumsum(lengths.astype(np.int64))
                starts = ends - lengths
                raw = memoryview(tokens.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["file_no"]] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(starts + row["first_token"], pa.int64()),
                     pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], names=[x.split()[0] for x in DOCUMENT.split(", ")],
                )

    return run


def write_files(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the blocks (``path``/blocks) and the frequency table (``path``/frequencies) of ``docs``."""
    spark = docs.sparkSession
    dtype = pieces(tokenizer_file).dtype.str
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    packed = shared_dir(spark, "token-ids")
    rows.mapInArrow(_tokenized(tokenizer_file, end_id), "id long, ids binary").write.option("compression", "zstd").parquet(packed)
    ids = spark.read.schema("id long, ids binary").parquet(packed)
    counted = ids.mapInArrow(_counts(dtype), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counted.repartition(1).write.parquet(f"{path}/frequencies")
    sent = spark.sparkContext.broadcast(read_counts(spark, path))
    in_order = ids.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "ids")
    in_order.mapInArrow(_encoded(sent, dtype), BLOCK).write.option("compression", "none").parquet(f"{path}/blocks")


def read_counts(spark: SparkSession, path: str) -> np.ndarray:
    """Token counts of a folder: one row per token that occurs, so at most the vocabulary."""
    rows = spark.read.schema("token long, n long").parquet(f"{path}/frequencies").toPandas()
    counts = np.zeros(int(rows.token.max()) + 1 if len(rows) else 1, np.int64)
    counts[rows.token.to_numpy()] = rows.n.to_numpy()
    return counts


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the blocks."""
    sent = spark.sparkContext.broadcast(read_counts(spark, path))
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    # one row per file: its tokens, and those of all files before it
    files = blocks.groupBy("file_no").agg(F.sum("n_tokens").alias("file_tokens"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select(F.col("file_no").alias("f"), F.coalesce(F.sum("file_tokens").over(before), F.lit(0)).alias("base"))
    found = blocks.select("file_no", "block_no", "first_token", "crc32", "payload").mapInArrow(_decoded(sent), DOCUMENT)
    return found.join(base, F.col("file_no") == F.col("f")).select(
        "doc_id", (F.col("base") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32"
    )


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_dir(spark, "token-files")
    write_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(spark, path)
