"""Near-duplicate documents: SuperMinHash, banding, verification, union-find.

1. Each text becomes its set of 5-word shingles (64-bit hashes) and a SuperMinHash
   signature: every element walks a random permutation of the slots of its own and
   offers slot ``p(j)`` the value ``j + r``, r uniform in [0, 1).  An element's
   values use each whole number once, so slots are negatively correlated and the
   estimate has less variance than independent hashes; a document stops as soon as
   all its slots hold values below the current step, after 2 to 4 steps for most.
2. Documents with equal sets are one class, represented by the row with the smallest id
   and text digest, under a number of its own; only representatives go on, so exact
   copies cost one row each.
3. Signatures are cut into bands; documents that share a band are joined to the
   smallest of their bucket.  The components of these star edges are the cells:
   every pair that shares a band lies in one cell.
4. In a cell, overlaps are counted exactly on the full sets through an inverted
   list of shingles; links feed a union-find.  Shingles and documents that cannot
   matter go first: a document needs 85 % (``percent``) of its shingles in other
   documents of its cell.  Cells too large for a task are cut by set size (sets of linked
   documents differ by at most 15 % in size) and hash into blocks that are compared
   block by block, exactly.
5. Components over all links give the smallest reachable id.

With 6 rows in 32 bands a pair at the threshold is missed with probability 2.6e-7,
a pair at 0.9 with 1e-10.  At another ``percent`` bands have the most rows with which
a pair at the threshold is missed with at most ``MISSED`` (at 80: 5 rows, 38 bands).

Cases: null or empty texts have empty sets and stay alone; a text of fewer than five
words is one shingle of all its words; repeated rows are copies of each other; rows that
share an id but not the text are different documents, each in its own text's group; a row
with a null id is in its text's group like any other, and if no row of a group has an id,
its component is null and the rows of one of its texts are kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.llm.common import slices, stored, table, text_of
from tidepool.llm.graph import components

SHINGLE = 5
PERCENT = 85
SLOTS = 192
MISSED = 1e-6
TEXTS = 512  # texts whose words are held at once
CELL_SHINGLES = 2_000_000  # shingles that one task compares at once
_ELEMENTS = 1 << 15  # elements whose permutations are held at once

_G = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FACTORS = _mix(np.arange(1, SHINGLE + 1, dtype=np.uint64) * _G) | np.uint64(1)
_BAND_FACTORS = _mix(np.arange(101, 101 + SLOTS, dtype=np.uint64) * _G) | np.uint64(1)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    digest = xxhash.xxh3_64_intdigest
    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((digest(w) for ws in words for w in ws), np.uint64, int(sizes.sum()))
    n = len(flat) - SHINGLE + 1
    mixed = flat[:0]
    if n > 0:
        mixed = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            mixed += flat[k : k + n] * _FACTORS[k]
        mixed = _mix(mixed)
    out, at = [], 0
    for ws, size in zip(words, sizes.tolist(), strict=True):
        if size >= SHINGLE:
            out.append(np.unique(mixed[at : at + size - SHINGLE + 1]))
        else:
            out.append(np.array([digest(b" ".join(ws), seed=size)] if size else [], np.uint64))
        at += size
    return out


def super_minhash(sets: list[np.ndarray]) -> np.ndarray:
    """Signatures (documents x SLOTS); an entry is step << 40 | 40 random bits."""
    out = np.full((len(sets), SLOTS), np.uint64(SLOTS) << np.uint64(40), np.uint64)
    group: list[int] = []
    held = 0
    for d, s in enumerate(sets):
        if len(s) > _ELEMENTS:  # a long text goes alone, piece by piece on the same slots
            for a in range(0, len(s), _ELEMENTS):
                _fill(out[d : d + 1], s[a : a + _ELEMENTS], np.zeros(min(_ELEMENTS, len(s) - a), np.int64))
            continue
        if held + len(s) > _ELEMENTS:
            _fill_docs(out, sets, group)
            group, held = [], 0
        group.append(d)
        held += len(s)
    _fill_docs(out, sets, group)
    return out


def _fill_docs(out: np.ndarray, sets: list[np.ndarray], docs: list[int]) -> None:
    if docs:
        part = out[docs]
        _fill(part, np.concatenate([sets[d] for d in docs]), np.repeat(np.arange(len(docs)), [len(sets[d]) for d in docs]))
        out[docs] = part


def _fill(slots: np.ndarray, elements: np.ndarray, owner: np.ndarray) -> None:
    """Lower ``slots`` (documents x SLOTS, in place) by the elements of their documents."""
    flat = slots.reshape(-1)
    perm = np.broadcast_to(np.arange(SLOTS, dtype=np.uint8), (len(elements), SLOTS)).copy()
    row = np.arange(len(elements))
    for j in range(SLOTS):
        u = _mix(elements + np.uint64((j + 1) * int(_G) & (1 << 64) - 1))
        k = j + ((u & np.uint64(0xFFFFFF)) * np.uint64(SLOTS - j) >> np.uint64(24)).astype(np.int64)
        slot = perm[row, k]
        perm[row, k] = perm[row, j]
        np.minimum.at(flat, owner * SLOTS + slot, (u >> np.uint64(24)) | (np.uint64(j) << np.uint64(40)))
        # documents whose slots are all below the next step's values are done
        active = (slots.max(axis=1) >= np.uint64(j + 1) << np.uint64(40))[owner]
        if not active.all():
            elements, owner, row = elements[active], owner[active], row[active]
            if not len(elements):
                return
            if len(row) * 2 < len(perm):
                perm, row = perm[row], np.arange(len(row))


def banding(percent: int) -> tuple[int, int]:
    """Rows of a band and number of bands."""
    fits = [r for r in range(1, SLOTS + 1) if (1 - (percent / 100) ** r) ** (SLOTS // r) <= MISSED]
    rows = max(fits, default=1)
    return rows, SLOTS // rows


def band_keys(signatures: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    rows, bands = banding(percent)
    parts = signatures[:, : rows * bands].reshape(len(signatures), bands, rows)
    return _mix((parts * _BAND_FACTORS[:rows]).sum(axis=2, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * _G)


def _signed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, TEXTS):
        texts = batch.column(2).to_pylist()
        place = {t: k for k, t in enumerate(dict.fromkeys(texts))}  # equal texts of a batch are computed once
        sets = shingle_sets(list(place))
        keys = band_keys(super_minhash(sets), percent).view(np.int64)
        digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        at = [place[t] for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([len(sets[k]) for k in at], pa.int64()), pa.array([digests[k] for k in at], pa.binary()),
             pa.FixedSizeListArray.from_arrays(pa.array(keys[at].reshape(-1)), keys.shape[1]).cast(pa.list_(pa.int64()))],
            names=["id", "key", "n_shingles", "digest", "bands"],
        )


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, TEXTS):
        # equal rows arrive one after the other: one of them is enough
        names = list(zip(batch.column("cell").to_pylist(), batch.column("id").to_pylist()))
        batch = batch.take(pa.array([k for k, n in enumerate(names) if not k or n != names[k - 1]], pa.int32()))
        sets = shingle_sets(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays(
            [batch.column("cell"), batch.column("id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cell", "id", "set"]
        )


def links_in(ids: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """(id, root) for every document that a link joins to others, by exact overlaps.

    A document of the largest group found so far needs no probe of its own: every
    document outside probes against all, so a link between two groups is always
    seen from one side.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    while True:  # shingles of one document only link nothing; documents with too many of them have no link
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        new = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, bool)
        number = np.cumsum(new) - 1
        shared = np.bincount(number)[number] > 1 if len(flat) else new
        able = np.bincount(owner[shared], minlength=n) * 100 >= percent * sizes
        keep = shared & able[owner]
        if keep.all():
            break
        flat, owner = flat[keep], owner[keep]
    alive = np.flatnonzero(np.bincount(owner, minlength=n) > 0)
    if len(alive) < 2:
        return []
    begin = np.concatenate([np.flatnonzero(new), [len(flat)]])
    of_doc = np.argsort(owner, kind="stable")
    elements = number[of_doc]
    doc_begin = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
    weight = np.bincount(owner, weights=np.diff(begin)[number], minlength=n) / np.maximum(sizes, 1)

    parent = np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    hubs = alive[np.argsort(-weight[alive], kind="stable")][:4]
    members = np.ones(n, np.int64)
    largest = int(hubs[0])
    for i in [*hubs, *[x for x in alive if x not in set(hubs.tolist())]]:
        i = int(i)
        if root(i) == root(largest) and i != largest and members[root(largest)] > 1:
            continue
        e = elements[doc_begin[i] : doc_begin[i + 1]]
        counts = begin[e + 1] - begin[e]
        post = owner[np.repeat(begin[e] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))]
        common = np.bincount(post, minlength=n)
        linked = np.flatnonzero(common * 100 >= percent * (sizes[i] + sizes - common))
        for j in linked[sizes[linked] > 0].tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
                members[a] += members[b]
        if members[root(i)] > members[root(largest)]:
            # the group that may skip probes changes only while nothing has been skipped
            largest = largest if members[root(largest)] > 1 else i
    groups: dict[int, list[int]] = {}
    for x in alive.tolist():
        groups.setdefault(root(x), []).append(int(ids[x]))
    return [(x, min(g)) for g in groups.values() if len(g) > 1 for x in g if x != min(g)]


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links per cell; rows arrive sorted by cell."""
    cell, ids, sets = None, [], []

    def emit() -> Iterator[pa.RecordBatch]:
        found = links_in(np.array(ids, np.int64), sets, percent) if len(ids) > 1 else []
        if found:
            u, v = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for batch in batches:
        for c, i, s in zip(batch.column("cell").to_pylist(), batch.column("id").to_pylist(), batch.column("set").to_pylist(), strict=True):
            if c != cell:
                yield from emit()
                cell, ids, sets = c, [], []
            if not ids or i != ids[-1]:
                ids.append(i)
                sets.append(np.frombuffer(s, np.uint64))
    yield from emit()


def bucket_edges(reps: DataFrame) -> DataFrame:
    """Star edges (u, v): each document to the smallest one of each of its buckets."""
    buckets = reps.select("id", F.explode("bands").alias("bucket"))
    hubs = buckets.groupBy("bucket").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    return buckets.join(hubs, "bucket").filter("id != hub").select(F.col("id").alias("u"), F.col("hub").alias("v")).distinct()


def placed(cells: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(id, cell) with ``cell`` a name of one comparison task; ``cells``: (id, root, n_shingles).

    A cell within CELL_SHINGLES is one task.  A larger one is cut by size class
    (factor 100 / percent, so links join equal or neighbouring classes) and hash into
    blocks of half that size; each pair of blocks that may hold links is a task.
    """
    size_class = F.floor(F.log("n_shingles") / float(np.log(100 / percent)) + 1e-9).cast("int")
    rows = cells.withColumn("g", size_class)
    per_class = rows.groupBy("root", "g").agg(F.sum("n_shingles").alias("s"))
    large = per_class.groupBy("root").agg(F.sum("s").alias("total")).filter(F.col("total") > CELL_SHINGLES).select("root")
    small = rows.join(large, "root", "left_anti").select("id", F.col("root").cast("string").alias("cell"))
    blocks = stored(
        per_class.join(large, "root").select("root", "g", F.ceil(F.col("s") / (CELL_SHINGLES // 2)).cast("int").alias("blocks")), "blocks"
    )
    own = rows.join(blocks, ["root", "g"]).withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pair = lambda lo_g, lo_b, hi_g, hi_b: F.concat_ws("/", F.col("root"), lo_g, lo_b, hi_g, hi_b)
    up, down = (blocks.select("root", (F.col("g") + d).alias("g"), F.col("blocks").alias("other")) for d in (-1, 1))
    other = F.explode(F.sequence(F.lit(0), F.col("other") - 1)).alias("o")
    same = own.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")).select(
        "id", pair(F.col("g"), F.least("b", "o"), F.col("g"), F.greatest("b", "o")).alias("cell")
    )
    with_up = own.join(up, ["root", "g"]).select("*", other).select("id", pair(F.col("g"), F.col("b"), F.col("g") + 1, F.col("o")).alias("cell"))
    with_down = own.join(down, ["root", "g"]).select("*", other).select("id", pair(F.col("g") - 1, F.col("o"), F.col("g"), F.col("b")).alias("cell"))
    return small.unionByName(same).unionByName(with_up).unionByName(with_down)


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per document row; links from a similarity of ``percent`` on."""
    return judged(docs, id_col, text_col, percent).select("doc_id", "n_shingles", "component_id", "kept")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``grouped`` with ``text_key`` (SHA-256 of the text) and ``first``: of each group the rows of one text
    under one id are first, and every row without words; a caller who joins its
    documents on id and text key keeps one of each group, null and shared ids included.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("key"), text.alias("text"))
    signed = rows.mapInArrow(lambda batches: _signed(batches, percent), "id long, key binary, n_shingles long, digest binary, bands array<long>")
    signed = stored(signed, "minhash")
    # a class is a set of shingles; its node has a number of its own, whatever ids its rows have
    worded = signed.filter("digest is not null")
    order = Window.partitionBy("digest").orderBy(F.col("id").asc_nulls_last(), "key")  # the limit to one row also holds before the shuffle
    reps = worded.withColumn("k", F.row_number().over(order)).filter("k = 1").drop("k").withColumn("node", F.monotonically_increasing_id())
    reps = stored(reps, "reps")

    nodes = reps.select(F.col("node").alias("id"), "n_shingles", "bands")
    cells = components(bucket_edges(nodes)).withColumnRenamed("node", "id").join(nodes.select("id", "n_shingles"), "id")
    tasks = stored(placed(stored(cells, "cells"), percent), "cell-tasks")
    # the text goes to the candidates once; sets go to each task of theirs
    wanted = tasks.groupBy("id").agg(F.collect_set("cell").alias("cells")).withColumnRenamed("id", "node")
    wanted = wanted.join(reps.select("node", F.col("id").alias("rep"), F.col("key").alias("rep_key")), "node")
    found = rows.join(wanted, (F.col("key") == F.col("rep_key")) & F.col("id").eqNullSafe(F.col("rep")))
    sets = found.select(F.explode("cells").alias("cell"), F.col("node").alias("id"), "text").mapInArrow(_with_sets, "cell string, id long, set binary")
    links = sets.repartition("cell").sortWithinPartitions("cell", "id").mapInArrow(lambda batches: _linked(batches, percent), "u long, v long")
    roots = components(links).withColumnRenamed("node", "member")

    member = reps.join(roots, F.col("node") == F.col("member"), "left").select(F.coalesce("root", "node").alias("root"), "node", "id", "key", "digest")
    # of each group the class with the smallest id, null last, and of several with it the first one
    smallest = member.groupBy("root").agg(F.min("id").alias("component"))
    chosen = member.join(smallest, "root").withColumn("at", F.when(F.col("id").eqNullSafe(F.col("component")), F.col("node")))
    winner = chosen.groupBy("root").agg(F.min("at").alias("winner"))
    of_class = chosen.join(winner, "root").select(
        F.col("digest").alias("d"), "component", F.when(F.col("node") == F.col("winner"), F.col("id")).alias("first_id"),
        F.when(F.col("node") == F.col("winner"), F.col("key")).alias("first_key"),
    )
    joined = signed.select("id", "key", "n_shingles", "digest").join(of_class, F.col("digest") == F.col("d"), "left")
    alone = F.col("digest").isNull()
    first = alone | (F.col("key").eqNullSafe(F.col("first_key")) & F.col("id").eqNullSafe(F.col("first_id")))
    component = F.when(alone, F.col("id")).otherwise(F.col("component"))
    return joined.select(
        F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("id") == component, component.isNull() & first).alias("kept"), F.col("key").alias("text_key"), first.alias("first"),
    )


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents"))
