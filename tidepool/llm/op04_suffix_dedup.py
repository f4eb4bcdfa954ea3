"""Repeated passages: depth-limited radix sort of suffixes, 100 bytes deep.

Every start of a 100-byte window is a suffix that matters through 100 bytes only.
Suffixes are sorted by most-significant-digit passes; a group that holds one suffix
leaves the sort, and the groups left at full depth are exactly the repeated windows.

First digit (one shuffle).  It must bring equal windows together without moving every
suffix: a window's digit is its anchor, the smallest (hashed) 32-byte gram in it, the
leftmost on ties.  Equal windows have equal anchors at equal offsets, and about 35
neighbouring windows share one occurrence of theirs, so a record stands for a run of
suffixes: anchor, digest of the run's bytes, document, first and last start.

* Runs with equal bytes repeat as a whole: all but the earliest are removed.  Batches
  settle this among their own runs first, so a passage that many documents share
  sends one record per batch.
* An anchor with one kind of run is done.  Where kinds differ (at the edges of
  repeated passages), the earliest run of each kind goes on, as bytes.

Further digits (one shuffle of the edges' bytes).  A task sorts the suffixes of its
anchors by 8-byte digits, pass by pass, splitting groups and dropping single ones,
until depth 100.  In each remaining group all but the earliest start are removed.
Anchors with more than ``HOT`` kinds are dealt out start by start, by 128 bits of hash
of all 100 bytes: only equal windows meet.  Batches settle them among their own starts
first, and a task holds the earliest start of one window, however many share it.

Cases: null and empty texts, and texts under 100 bytes, keep all bytes; null ids come
after all others; rows that share an id are documents of their own, ordered by a hash
of their text; rows equal in id and text count as one document (all get its result);
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import stored, table, text_of

DEPTH = 100
GRAM = 32
_SPAN = DEPTH - GRAM + 1  # grams in a window
PIECE = 1 << 21  # bytes whose suffixes are looked at together
HOT = 1024  # kinds of runs at an anchor that one task compares
TASK_SUFFIXES = 1 << 20
_LAST = np.iinfo(np.int64).max

_G = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of each GRAM-byte gram, by doubling: 32 bytes take five steps."""
    h = _mix((data.astype(np.uint64) + np.uint64(1)) * _G)
    size = 1
    while size < GRAM:
        factor = pow(0x2545F4914F6CDD1D, size, 1 << 64)
        h = h[:-size] * np.uint64(factor) + h[size:]
        size *= 2
    return _mix(h)


def anchors(h: np.ndarray, n_windows: int) -> np.ndarray:
    """Position of the anchor of each window: its smallest hash, leftmost on ties."""
    # upper bits of the hash and the position in one number, so minima carry their place
    v = (h & ~np.uint64((1 << 23) - 1)) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= _SPAN:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    rest = _SPAN - size
    v = np.minimum(v[: len(v) - rest], v[rest:]) if rest else v
    return (v[:n_windows] & np.uint64((1 << 23) - 1)).astype(np.int64)


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs (document, lo, hi, anchor offset, key, digest) of windows with one anchor occurrence.

    Windows start at lo..hi in their document.  Long documents are looked at in pieces
    that overlap by a window less one byte.
    """
    pieces: list[tuple[int, int, bytes]] = []
    for d, t in enumerate(texts):
        for a in range(0, max(0, len(t) - DEPTH + 1), PIECE - DEPTH + 1):
            pieces.append((d, a, t[a : a + PIECE]))
    out: list[tuple[np.ndarray, ...]] = []
    at = 0
    while at < len(pieces):
        group, size = [], 0
        while at < len(pieces) and (not group or size + len(pieces[at][2]) <= PIECE):
            group.append(pieces[at])
            size += len(pieces[at][2])
            at += 1
        out.append(_runs(group))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _runs(group: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    joined = b"".join(t for _, _, t in group)
    data = np.frombuffer(joined, np.uint8)
    lengths = np.array([len(t) for _, _, t in group], np.int64)
    first = np.cumsum(lengths) - lengths
    h = gram_hashes(data)
    n = len(data) - DEPTH + 1
    p = anchors(h, n)
    # windows inside one piece, runs of equal anchors inside one piece
    piece = np.repeat(np.arange(len(group)), lengths)[:n]
    inside = np.arange(n) <= (first + lengths - DEPTH)[piece]
    begins = np.concatenate([[True], (p[1:] != p[:-1]) | (piece[1:] != piece[:-1])])
    lo = np.flatnonzero(begins & inside)
    ends = np.concatenate([begins[1:], [True]]) | ~np.concatenate([inside[1:], [False]])
    hi = np.flatnonzero(ends & inside)
    view = memoryview(joined)
    digest = xxhash.xxh3_64_intdigest
    ctx = np.fromiter((digest(view[a:b]) for a, b in zip(lo.tolist(), (hi + DEPTH).tolist(), strict=True)), np.uint64, len(lo))
    own = piece[lo]
    base = np.array([a for _, a, _ in group], np.int64)[own] - first[own]
    return np.array([d for d, _, _ in group], np.int64)[own], lo + base, hi + base, p[lo] - lo, h[p[lo]].view(np.int64), ctx.view(np.int64)


RUN = "key long, ctx long, id long, ord long, lo int, n int, off int, done boolean"
_RUN_NAMES = [x.split()[0] for x in RUN.split(", ")]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a batch: the earliest of each kind, and the others as done (repeated within the batch)."""
    for batch in batches:
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        ords = batch.column("ord").to_numpy(zero_copy_only=False)
        texts = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        doc, lo, hi, off, key, ctx = runs_of(texts)
        if not len(doc):
            continue
        i, o = ids[doc], ords[doc]
        order = np.lexsort((lo, o, i, ctx, key))
        i, o, lo, hi, off, key, ctx = (x[order] for x in (i, o, lo, hi, off, key, ctx))
        like = np.concatenate([[False], (key[1:] == key[:-1]) & (ctx[1:] == ctx[:-1])])
        twice = like & np.concatenate([[False], (i[1:] == i[:-1]) & (o[1:] == o[:-1]) & (lo[1:] == lo[:-1])])
        # a repeated run needs no partner any more: it is dealt out by its place
        key = np.where(like, _mix((i ^ o ^ (lo << 32)).view(np.uint64) + _G).view(np.int64), key)
        kinds = (np.int64, np.int64, np.int64, np.int64, np.int32, np.int32, np.int32, bool)
        columns = [x[~twice].astype(t) for x, t in zip((key, ctx, i, o, lo, hi - lo, off, like), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_names(RUN))


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated runs (level 0) and edges (level 1, or 2 at a hot anchor).

    Rows come sorted by (done, key, ctx, id, ord, lo).  Held are the kinds of one
    anchor until their number is known, HOT at most.
    """
    held: list[tuple] = []
    found: list[tuple] = []
    key = ctx = place = None  # of the last row that isn't done
    kinds = 0

    def flush() -> None:
        nonlocal kinds
        if 1 < kinds <= HOT:
            found.extend((*r, 1) for r in held)
        held.clear()
        kinds = 0

    def rows_of(columns: list[np.ndarray]) -> pa.RecordBatch:
        types = (np.int64, np.int64, np.int64, np.int32, np.int32, np.int32, np.int8)
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, t)) for c, t in zip(columns, types, strict=True)], names=_names(EDGE))

    for batch in batches:
        k, c, i, o, lo, n, off, done = (batch.column(x).to_numpy(zero_copy_only=False) for x in _names(RUN))
        done = done.astype(bool)
        live = np.flatnonzero(~done)
        rows = k[live], c[live], i[live], o[live], lo[live], n[live], off[live]
        if len(live):
            before = lambda x, last: np.concatenate([[last is not None and x[0] == last], x[1:] == x[:-1]])
            same_key = before(rows[0], key)
            same_ctx = same_key & before(rows[1], ctx)
            twice = same_ctx & before(rows[2], place and place[0]) & before(rows[3], place and place[1]) & before(rows[4], place and place[2])
            last_key = key
            key, ctx, place = rows[0][-1], rows[1][-1], (rows[2][-1], rows[3][-1], rows[4][-1])
            repeated = same_ctx & ~twice
            fresh = np.flatnonzero(~same_ctx)
            if len(fresh):
                own = rows[0][fresh]
                new = np.concatenate([[last_key is None or own[0] != last_key], own[1:] != own[:-1]])
                # anchors with one kind are done, but the batch's first and last may go on outside it
                alone = new & np.concatenate([new[1:], [False]])
                alone[-1] = False
                if alone[0]:
                    flush()
                for r, begins in zip(fresh[~alone].tolist(), new[~alone].tolist(), strict=True):
                    if begins:
                        flush()
                    kinds += 1
                    held.append((rows[0][r], rows[2][r], rows[3][r], rows[4][r], rows[5][r], rows[6][r]))
                    if kinds > HOT:
                        found.extend((*x, 2) for x in held)
                        held.clear()
            out = live[repeated]
        else:
            out = live
        out = np.concatenate([out, np.flatnonzero(done)])
        if len(out):
            yield rows_of([k[out], i[out], o[out], lo[out], n[out], off[out], np.zeros(len(out))])
        if found:
            yield rows_of(list(zip(*found, strict=True)))
            found.clear()
    flush()
    if found:
        yield rows_of(list(zip(*found, strict=True)))


EDGE = "key long, id long, ord long, lo int, n int, off int, level byte"
CONTEXT = "what byte, g long, ctx long, id long, ord long, lo int, n int, off int, bytes binary"
REPEAT, EDGE_BYTES, START = range(3)  # what a row of CONTEXT is: a settled span, an edge, a start at a hot anchor
SPAN = "id long, ord long, lo int, n int"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _ranges(places: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(id, ord, lo, n) of the stretches of neighbouring starts among rows of (id, ord, start)."""
    if not len(places):
        return []
    places = np.unique(places, axis=0)
    begins = np.concatenate([[True], (places[1:, :2] != places[:-1, :2]).any(axis=1) | (places[1:, 2] != places[:-1, 2] + 1)])
    ends = np.concatenate([begins[1:], [True]])
    return [(a, b, c, int(z - c)) for (a, b, c), z in zip(places[begins].tolist(), places[ends, 2].tolist(), strict=True)]


def _starts(edges: list[tuple[int, int, int, int]], hashes: bytes) -> tuple[list[np.ndarray], list[tuple[int, int, int, int]]]:
    """Earliest start of each window of a batch's hot edges as (g, ctx, id, ord, lo), and the spans of the others."""
    i, o, lo, n = np.array(edges, np.int64).T
    row = np.repeat(np.arange(len(n)), n + 1)
    start = lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1)
    g, ctx = np.frombuffer(hashes, np.int64).reshape(-1, 2).T
    order = np.lexsort((start, o[row], i[row], ctx, g))
    columns = [x[order] for x in (g, ctx, i[row], o[row], start)]
    same = [np.concatenate([[False], x[1:] == x[:-1]]) for x in columns]
    like = same[0] & same[1]
    later = like & ~(same[2] & same[3] & same[4])
    return [x[~like] for x in columns], _ranges(np.stack([x[later] for x in columns[2:]], axis=1))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the edges of each document; starts at hot anchors, of which a batch sends the earliest of each window."""
    digest = xxhash.xxh3_128_digest
    types = (pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    for batch in batches:
        out: list[tuple] = []
        hot: list[tuple[int, int, int, int]] = []
        hashes: list[bytes] = []
        for i, o, text, edges in zip(*(batch.column(x).to_pylist() for x in ("id", "ord", "text", "edges")), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            for e in edges:
                lo, n, off = e["lo"], e["n"], e["off"]
                if e["level"] == 1:
                    out.append((EDGE_BYTES, e["key"], 0, i, o, lo, n, off, data[lo : lo + n + DEPTH]))
                else:
                    hot.append((i, o, lo, n))
                    hashes.append(b"".join([digest(data[s : s + DEPTH]) for s in range(lo, lo + n + 1)]))
        if hot:
            (g, ctx, i, o, lo), spans = _starts(hot, b"".join(hashes))
            none = np.zeros(len(g), np.int32)
            columns = (none + START, g, ctx, i, o, lo, none, none)
            yield pa.RecordBatch.from_arrays([*(pa.array(c).cast(t) for c, t in zip(columns, types)), pa.nulls(len(g), pa.binary())], names=_names(CONTEXT))
            # a repeated start needs no partner any more: it is dealt out by its place
            out += [(REPEAT, xxhash.xxh3_64_intdigest(b"%d %d %d" % r[:3]) - (1 << 63), 0, *r, 0, None) for r in spans]
        for a in range(0, len(out), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[a : a + 20_000], strict=True), types, strict=True)], names=_names(CONTEXT))


def repeated_suffixes(rows: list[tuple]) -> list[tuple[int, int, int, int]]:
    """(id, ord, lo, n) of the starts that repeat an earlier one, by MSD radix passes of 8 bytes to DEPTH."""
    data = np.frombuffer(b"".join(r[6] for r in rows), np.uint8)
    lengths = np.array([len(r[6]) for r in rows], np.int64)
    first = np.cumsum(lengths) - lengths
    g, i, o, lo, n, off = (np.array(c, np.int64) for c in list(zip(*rows, strict=True))[:6])
    row = np.repeat(np.arange(len(rows)), n + 1)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1)
    at = first[row] + step

    def split(keep: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order ``keep`` by ``keys``, drop groups of one; the rest with their group numbers."""
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(order), bool)
        new[:1] = True
        for x in keys:
            y = x[order]
            new[1:] |= y[1:] != y[:-1]
        size = np.diff(np.concatenate([np.flatnonzero(new), [len(order)]]))
        group = np.cumsum(new) - 1
        many = size[group] > 1
        return keep[order][many], group[many]

    # equal suffixes have the same anchor at the same distance
    suffix, group = split(np.arange(len(row)), g[row], off[row] - step)
    for d in [*range(0, DEPTH - 8, 8), DEPTH - 8]:
        if not len(suffix):
            return []
        digit = data[at[suffix][:, None] + np.arange(d, d + 8)].view(">u8").ravel()
        suffix, group = split(suffix, group, digit)
    if not len(suffix):
        return []
    r, start = row[suffix], lo[row[suffix]] + step[suffix]
    order = np.lexsort((start, o[r], i[r], group))
    group, r, start = group[order], r[order], start[order]
    head = np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]]), np.arange(len(group)), 0))
    later = (i[r] != i[r[head]]) | (o[r] != o[r[head]]) | (start != start[head])
    return _ranges(np.stack([i[r][later], o[r][later], start[later]], axis=1))


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of repeated suffixes; rows come sorted by (what, g, ctx, id, ord, lo).

    A task sorts whole groups of edges together; of the starts of one window it holds the earliest.
    """
    rows: list[tuple] = []
    suffixes = 0
    head: list[int] | None = None  # (g, ctx, id, ord, lo) of the last window's earliest start

    def spans(found: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=_names(SPAN))

    for batch in batches:
        out: list[tuple] = []
        what = batch.column("what").to_numpy()
        edges = batch.filter(pa.array(what != START))
        for kind, *r in zip(*(c.to_pylist() for c in edges.columns), strict=True):
            g, _, i, o, lo, n, off, data = r
            if kind == REPEAT:
                out.append((i, o, lo, n))
                continue
            if suffixes >= TASK_SUFFIXES and g != rows[-1][0]:
                out += repeated_suffixes(rows)
                rows, suffixes = [], 0
            rows.append((g, i, o, lo, n, off, data))
            suffixes += n + 1
        if out:
            yield spans(out)
        if len(at := np.flatnonzero(what == START)):
            columns = [batch.column(x).to_numpy()[at].astype(np.int64) for x in ("g", "ctx", "id", "ord", "lo")]
            if head:
                columns = [np.concatenate([[h], c]) for h, c in zip(head, columns, strict=True)]
            new = np.concatenate([[True], (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])])
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            head = [int(c[first[-1]]) for c in columns]
            later = np.any([c != c[first] for c in columns[2:]], axis=0)
            if later.any():
                yield spans(_ranges(np.stack([c[later] for c in columns[2:]], axis=1)))
    if rows and (out := repeated_suffixes(rows)):
        yield spans(out)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed byte ranges and kept bytes of each document."""
    for batch in batches:
        sizes, ranges, kept = [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            own: list[list[int]] = []
            for s in sorted((s["lo"], s["lo"] + s["n"] + DEPTH) for s in spans or ()):
                if own and s[0] <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], s[1])
                else:
                    own.append(list(s))
            cuts = [0, *(x for r in own for x in r), len(data)]
            sizes.append(len(data))
            ranges.append([{"start": a, "end": b} for a, b in own])
            kept.append(b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(ranges, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
            names=["id", "n_bytes", "removed", "kept"],
        )


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ord, text): ``ord`` tells rows apart that share an id but not the text, however many (null ids are one id)."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), text_of(text_col).alias("text"))
    h = F.xxhash64("text")
    shared = rows.select("id", h.alias("h")).groupBy("id").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a != b")
    return rows.select("id", (F.lit(0).cast("long") if shared.isEmpty() else h).alias("ord"), "text")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, removed, kept): removed byte ranges, and the bytes left, of every row."""
    rows = _numbered(docs, id_col, text_col)
    runs = rows.mapInArrow(_scan, RUN).repartition("key").sortWithinPartitions("done", "key", "ctx", "id", "ord", "lo")
    edges = stored(runs.mapInArrow(_kinds, EDGE), "edges")
    todo = edges.filter("level > 0").groupBy("id", "ord").agg(F.collect_list(F.struct("key", "lo", "n", "off", "level")).alias("edges"))
    contexts = rows.join(todo, ["id", "ord"]).select("id", "ord", "text", "edges").mapInArrow(_contexts, CONTEXT)
    sorted_spans = contexts.repartition("g").sortWithinPartitions("what", "g", "ctx", "id", "ord", "lo").mapInArrow(_sorted, SPAN)
    spans = edges.filter("level = 0").select("id", "ord", "lo", "n").unionByName(sorted_spans)
    per_doc = spans.groupBy("id", "ord").agg(F.collect_list(F.struct("lo", "n")).alias("spans"))
    cut = rows.join(per_doc, ["id", "ord"], "left").select("id", "text", "spans").mapInArrow(
        _cut, "id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary"
    )
    return cut.select(F.when(F.col("id") != _LAST, F.col("id")).alias("doc_id"), "n_bytes", "removed", "kept")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
