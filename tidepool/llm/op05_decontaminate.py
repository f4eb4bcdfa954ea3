"""Benchmark decontamination with an FM-index per shard of the training text.

A shard is a bounded run of document words inside a task.  Its words become
symbols of the benchmark's vocabulary; words outside it, and stretches too short
to hold any window, end up as separators (no window can touch them).  The shard's
suffixes are sorted by prefix doubling, the BWT goes into a wavelet tree (one bit
vector with ranks per level), and all benchmark windows are searched backwards
together.  Rows of a match are walked back with LF steps to a sampled suffix
position (every 16th word and each stretch's first word); the located occurrences
are merged into word ranges and character spans to remove.

Documents never shuffle: each row is answered where it is read.  A document longer
than a shard is cut into pieces that overlap by one word less than a window, so no
occurrence is lost.

The benchmark may be of any size, and one item id may hold most of it.  Tasks cut its
texts into pieces that overlap likewise, repeated pieces of an item meet, and pieces
are dealt out by hash to chunks that hold ``CHUNK_BYTES`` at most, which is checked.  A
task builds the windows of a chunk; only one chunk at a time passes through the driver
to the tasks.  With more than one, the hits of a pass are stored before the next one.

Cases: null or empty texts have no words; items without words have no windows; the
null item id is an item of its own, listed as "null"; repeated rows are answered
alike; equal windows of several items count for each; an empty benchmark hits nothing;
a word of over 64 bytes is held by its SHA-256.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.llm.common import slices, stored, table, text_of, unused

WINDOW = 10
SHARD_WORDS = 1 << 20
SAMPLE = 16
TEXTS = 2048  # texts that are searched together
CHUNK_BYTES = 16 << 20  # benchmark text that one pass holds in memory
CHUNK_PIECES = 16  # pieces of long items that fill a chunk
WORD_BYTES = 64

# word bytes: digits, letters, all non-ASCII; A-Z in lower case, the rest is white space
_TABLE = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _short(word: bytes) -> bytes:
    """``word``, or a digest of a long one behind a zero byte, which no word holds."""
    return word if len(word) <= WORD_BYTES else b"\0" + hashlib.sha256(word).hexdigest().encode()


def _listed(name: str | None) -> tuple[str, bool]:
    """Order of item names: as they are listed, the null id as "null"."""
    return ("null", True) if name is None else (name, False)


class Patterns:
    """Distinct windows of items (name, words), grouped by length, over their own vocabulary."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]]):
        self.vocab: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items}, key=_listed)
        number = {name: k for k, name in enumerate(self.names)}
        windows: dict[int, list[tuple[np.ndarray, int]]] = {}
        for name, words in items:
            if words:
                ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], np.int32)
                n = min(WINDOW, len(ids))
                windows.setdefault(n, []).append((np.lib.stride_tricks.sliding_window_view(ids, n), number[name]))
        self.shortest = min(windows, default=0)
        self.has_digests = any(w[:1] == b"\0" for w in self.vocab)
        self.groups = []  # (length, matrix of windows, offsets into owners, owners)
        for n, own in sorted(windows.items()):
            rows, which = np.unique(np.concatenate([w for w, _ in own]), axis=0, return_inverse=True)
            owner = np.repeat(np.array([k for _, k in own], np.int64), [len(w) for w, _ in own])
            pairs = np.unique(which.reshape(-1).astype(np.int64) * len(self.names) + owner)
            at = np.searchsorted(pairs, np.arange(len(rows) + 1, dtype=np.int64) * len(self.names))
            self.groups.append((n, rows, at, pairs % len(self.names)))


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of ``text``; each 0 is a separator of its own (order by position)."""
    n = len(text)
    seps = text == 0
    rank = np.where(seps, np.cumsum(seps) - 1, text.astype(np.int64) + int(seps.sum()))
    order = np.argsort(rank, kind="stable")
    step = 1
    sorted_rank = rank[order]
    starts = np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]])
    while True:
        # rank of a row: first row of its group
        first = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
        rank = np.empty(n, np.int64)
        rank[order] = first
        alone = starts & np.concatenate([starts[1:], [True]])
        rows = np.flatnonzero(~alone)  # only groups that still tie are sorted on
        if not len(rows):
            return order
        at = order[rows] + step
        key = np.where(at < n, rank[np.minimum(at, n - 1)], -1)
        within = np.lexsort((key, first[rows]))
        order[rows] = order[rows][within]
        key = key[within]
        group = first[rows]
        starts[rows] = np.concatenate([[True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])])
        step *= 2


class WaveletTree:
    """Ranks of symbols in a sequence: one bit vector per bit of the symbols, high bit first."""

    def __init__(self, seq: np.ndarray, n_symbols: int):
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.levels: list[tuple[np.ndarray, int]] = []
        for b in range(self.bits - 1, -1, -1):
            bit = (seq >> b) & 1
            ones = np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32)
            self.levels.append((ones, len(seq) - int(ones[-1])))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before row ``at``."""
        low = np.zeros_like(at)
        for b, (ones, zeros) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            one = ((symbol >> b) & 1).astype(bool)
            low_ones, at_ones = ones[low], ones[at]
            low = np.where(one, zeros + low_ones, low - low_ones)
            at = np.where(one, zeros + at_ones, at - at_ones)
        return at - low

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of row ``at`` and its occurrences before that row."""
        symbol, low, at = np.zeros_like(at), np.zeros_like(at), at.copy()
        for ones, zeros in self.levels:
            one = ones[at + 1] > ones[at]
            low_ones, at_ones = ones[low], ones[at]
            symbol = symbol * 2 + one
            low = np.where(one, zeros + low_ones, low - low_ones)
            at = np.where(one, zeros + at_ones, at - at_ones)
        return symbol, at - low


class FMIndex:
    def __init__(self, text: np.ndarray, n_symbols: int):
        order = suffix_order(text)
        bwt = text[order - 1]  # row of suffix 0: the last separator
        self.tree = WaveletTree(bwt, n_symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        # sampled: every SAMPLE-th position, and each position after a separator, so no walk crosses one
        kept = (order % SAMPLE == 0) | (bwt == 0)
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.kept, self.positions = kept, order[kept]

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows [low, high) of each window that occurs: (window, low, high)."""
        alive = np.arange(len(windows))
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(self.kept), np.int64)
        for k in range(windows.shape[1] - 1, -1, -1):
            c = windows[alive, k].astype(np.int64)
            low, high = (self.before[c] + self.tree.rank(c, x) for x in (low, high))
            some = low < high
            alive, low, high = alive[some], low[some], high[some]
            if not len(alive):
                break
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by LF steps to the next sampled one."""
        found, todo, at, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            hit = self.kept[at]
            found[todo[hit]] = self.positions[self.kept_before[at[hit]]] + steps
            todo, at = todo[~hit], at[~hit]
            symbol, rank = self.tree.symbol_and_rank(at)
            at = self.before[symbol] + rank
            steps += 1
        return found


def occurrences(words: np.ndarray, p: Patterns) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(window length, start words, item numbers) of all windows in ``words`` (0: not in the vocabulary)."""
    # stretches of known words at least as long as the shortest window
    known = np.concatenate([[0], words > 0, [0]]).astype(np.int8)
    edge = np.diff(known)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= p.shortest
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return
    lengths = ends - starts + 1  # with a separator after each
    offset = np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = np.arange(int(lengths.sum())) - offset + np.repeat(starts, lengths)
    text = np.where(place < np.repeat(ends, lengths), words[np.minimum(place, len(words) - 1)], 0).astype(np.int64)
    index = FMIndex(text, len(p.vocab) + 1)
    for n, windows, at, owners in p.groups:
        which, low, high = index.search(windows)
        if not len(which):
            continue
        counts = high - low
        rows = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        found = place[index.locate(rows)]
        which = np.repeat(which, counts)
        yield n, found, which, at, owners


HITS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("ranges", T.ArrayType(T.LongType())), T.StructField("spans", T.ArrayType(T.LongType())),
])
_ARROW_HITS = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("ranges", pa.list_(pa.int64())), ("spans", pa.list_(pa.int64()))])


def batch_hits(texts: list[str | None], earlier: list[dict] | None, p: Patterns) -> list[dict]:
    """Hits of each text: words, items, merged word ranges and character spans (start, end, start, end, ...)."""
    lookup = (lambda w, none: p.vocab.get(_short(w), none)) if p.has_digests else p.vocab.get
    ids = [np.fromiter((lookup(w, 0) for w in words), np.int32, len(words)) for words in (words_of(t or "") for t in texts)]
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    base = np.cumsum(sizes) - sizes
    hit = np.zeros(int(sizes.sum()) + 1, np.int32)
    pairs: list[np.ndarray] = []
    overlap = WINDOW - 1

    def run(shard: list[tuple[int, int, np.ndarray]]) -> None:
        # pieces (first word in the batch, document, ids), a separator after each
        joined = np.concatenate([x for _, _, a in shard for x in (a, np.zeros(1, np.int32))])
        lengths = np.array([len(a) + 1 for _, _, a in shard])
        first = np.cumsum(lengths) - lengths
        for n, found, which, at, owners in occurrences(joined, p):
            piece = np.searchsorted(first, found, "right") - 1
            begin = found - first[piece] + np.array([b for b, _, _ in shard])[piece]
            np.add.at(hit, begin, 1)
            np.add.at(hit, begin + n, -1)
            doc_window = np.unique(np.array([d for _, d, _ in shard], np.int64)[piece] * (int(which.max()) + 1) + which)
            doc, window = np.divmod(doc_window, int(which.max()) + 1)
            counts = at[window + 1] - at[window]
            flat = np.repeat(at[window] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
            pairs.append(np.unique(np.repeat(doc, counts) * len(p.names) + owners[flat]))

    shard: list[tuple[int, int, np.ndarray]] = []
    held = 0
    for d, a in enumerate(ids):
        for start in range(0, max(1, len(a) - overlap), SHARD_WORDS - overlap):
            piece = a[start : start + SHARD_WORDS]
            if shard and held + len(piece) > SHARD_WORDS:
                run(shard)
                shard, held = [], 0
            if len(piece):
                shard.append((int(base[d]) + start, d, piece))
                held += len(piece) + 1
    if shard:
        run(shard)

    items: dict[int, list[str | None]] = {}
    for x in np.unique(np.concatenate(pairs)) if pairs else ():
        items.setdefault(int(x) // len(p.names), []).append(p.names[int(x) % len(p.names)])
    cover = np.cumsum(hit[:-1]) > 0
    out = []
    for d, text in enumerate(texts):
        n, own = int(sizes[d]), cover[base[d] : base[d] + sizes[d]]
        names = set(items.get(d, ()))
        if earlier and earlier[d] and earlier[d]["items"]:
            own = own.copy()
            names.update(earlier[d]["items"])
            for s, e in zip(earlier[d]["ranges"][::2], earlier[d]["ranges"][1::2], strict=True):
                own[s:e] = True
        ranges, spans = [], []
        if names:
            ranges = np.flatnonzero(np.diff(np.concatenate([[0], own, [0]]).astype(np.int8))).tolist()
            at = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
            spans = [at[x][0] if k % 2 == 0 else at[x - 1][1] for k, x in enumerate(ranges)]
        out.append({"n_words": n, "n_hit": int(own.sum()), "items": sorted(names, key=_listed), "ranges": ranges, "spans": spans})
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the items, in pieces of some ``CHUNK_BYTES / CHUNK_PIECES``; together these hold every window once or more."""
    for batch in slices(batches, 256):
        names, pieces = [], []
        for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = [_short(w) for w in words_of(text)]
            ends = np.cumsum([len(w) + 1 for w in words])
            start = 0
            while words:
                limit = (int(ends[start - 1]) if start else 0) + CHUNK_BYTES // CHUNK_PIECES
                stop = max(start + WINDOW, int(np.searchsorted(ends, limit, "right")))
                names.append(name)
                pieces.append(b" ".join(words[start:stop]))
                if stop >= len(words):
                    break
                start = stop - WINDOW + 1
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(pieces, pa.binary())], names=["name", "words"])


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Patterns of each chunk; rows come sorted by chunk."""
    held: list[tuple[str | None, list[bytes]]] = []
    chunk = None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()), "patterns": pa.array([pickle.dumps(vars(Patterns(held)))], pa.binary())})

    for batch in batches:
        for k, name, words in zip(*(batch.column(x).to_pylist() for x in ("chunk", "name", "words")), strict=True):
            if held and k != chunk:
                yield row()
                held = []
            chunk = k
            held.append((name, words.split(b" ")))
    if held:
        yield row()


def benchmark_chunks(benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(chunk, patterns): the benchmark's windows in chunks made of ``CHUNK_BYTES`` of its words at most."""
    items = benchmark.select(F.col(item_col).cast("string").alias("name"), text_of(item_text_col).alias("text"))
    pieces = stored(items.mapInArrow(_pieces, "name string, words binary").distinct(), "pieces")
    size = F.octet_length("words") + 1
    total, longest = pieces.agg(F.sum(size), F.max(size)).first()
    n = max(1, -(-int(total or 0) // CHUNK_BYTES))
    while True:
        dealt = pieces.withColumn("chunk", F.pmod(F.xxhash64("name", "words"), F.lit(n).cast("long")))
        largest = dealt.groupBy("chunk").agg(F.sum(size).alias("size")).agg(F.max("size")).first()[0] or 0
        if largest <= max(CHUNK_BYTES, longest or 0):
            break
        n *= 2
    by_chunk = dealt.repartition("chunk").sortWithinPartitions("chunk")
    return stored(by_chunk.mapInArrow(_built, "chunk long, patterns binary"), "benchmark")


def with_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", out: str = "hits") -> DataFrame:
    """``docs`` with a struct column ``out`` of its benchmark hits; all other columns pass through."""
    spark = docs.sparkSession
    built = benchmark_chunks(benchmark, item_col, item_text_col)
    chunks = sorted(r[0] for r in built.select("chunk").collect())  # a number per chunk of CHUNK_BYTES
    rows = docs.select(*[c for c in docs.columns if c != out])
    schema = T.StructType([*rows.schema.fields, T.StructField(out, HITS)])
    for k in chunks or [None]:
        plain = vars(Patterns([])) if k is None else pickle.loads(built.filter(F.col("chunk") == k).first()["patterns"])
        if out in rows.columns:
            rows = stored(rows, "hits")  # one pass at a time holds its patterns
        sent = spark.sparkContext.broadcast(plain)  # plain values load before any module does
        rows = rows.mapInArrow(_pass(sent, text_col, out), schema)
    listed = F.transform(F.col(out)["items"], lambda name: F.coalesce(name, F.lit("null")))
    return rows.withColumn(out, F.col(out).withField("items", listed))


def _pass(sent, text_col: str, out: str):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Patterns.__new__(Patterns)
        vars(p).update(sent.value)
        for batch in slices(batches, TEXTS):
            names = batch.schema.names
            earlier = batch.column(names.index(out)).to_pylist() if out in names else None
            hits = batch_hits(batch.column(names.index(text_col)).to_pylist(), earlier, p)
            kept = [n for n in names if n != out]
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index(n)) for n in kept] + [pa.array(hits, _ARROW_HITS)], names=[*kept, out]
            )

    return search


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the hit spans; what stood around a span is parted by a line feed.

    Documents of which nothing but hits was left are dropped; columns stay as they are.
    """
    out = unused(docs, "hits")
    hits = F.col(out)
    spans, text = hits["spans"], F.col(text_col)
    n = (F.size(spans) / 2).cast("int")
    # piece k lies between the end of span k - 1 and the start of span k
    start = lambda k: F.when(k == 0, F.lit(0).cast("long")).otherwise(F.get(spans, 2 * k - 1))
    piece = lambda k: F.when(k == n, F.substring(text, start(k) + 1, F.length(text))).otherwise(
        F.substring(text, start(k) + 1, F.get(spans, 2 * k) - start(k))
    )
    cut = F.array_join(F.filter(F.transform(F.sequence(F.lit(0), n), piece), lambda x: F.trim(x) != ""), "\n")
    found = with_hits(docs, benchmark, text_col, out=out).filter((hits["n_hit"] == 0) | (hits["n_hit"] < hits["n_words"]))
    return found.withColumn(text_col, F.when(hits["n_hit"] > 0, cut).otherwise(text)).drop(out)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = F.col("hits")
    items = F.array_join(hits["items"], ",")
    return with_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", hits["n_words"].alias("n_words"), hits["n_hit"].alias("n_hit"), F.size(hits["items"]).cast("long").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"), (hits["n_hit"] > 0).alias("contaminated"),
    )
