"""op4 repeated passages, op5 decontamination, op6 near-dedup."""

import pickle
import random

import numpy as np
import pytest
from helpers import DOCS, SF, components, documents, hits, removed, rows_of, sha, shingles
from pyspark.sql import functions as F

from tidepool.llm import graph, op04_suffix_dedup, op05_decontaminate, op06_minhash

LINE = "A very common line that a third of all documents share with each other, word for word, and it is over a hundred bytes long. "


def hot_documents(n=60):
    """Copies, near copies of one text, and one line in many different texts."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    base = [word() for _ in range(120)]
    docs = []
    for i in range(n):
        near = list(base)
        for _ in range(i % 7):
            near[rnd.randrange(120)] = word()
        docs.append((3 * i, " ".join(near)))
        docs.append((3 * i + 1, " ".join(word() for _ in range(20)) + " " + LINE + " ".join(word() for _ in range(20))))
        docs.append((3 * i + 2, "exact copy " + " ".join(base[:60])))
    return docs


# ---------------------------------------------------------------- op4
def cut(df):
    rows = op04_suffix_dedup.deduplicated(df).collect()
    out = {}
    for r in rows:
        gone = sum(x["end"] - x["start"] for x in r["removed"])
        out.setdefault(r["doc_id"], []).append((r["n_bytes"], gone, len(r["removed"]), sha(bytes(r["kept"]))))
    return out


ODD4 = [(9_000, None), (9_001, ""), (9_002, "x" * 99), (9_003, "x" * 100), (9_004, "x" * 500), (9_005, "ab" * 300), (9_006, "ab" * 300 + "c"), (9_007, "é" * 200),
        (9_008, "😀" * 60), (9_009, "x" * 150 + "y" + "x" * 150)]


@pytest.mark.parametrize("hot,piece,suffixes", [(4096, 1 << 21, 1 << 20), (2, 3000, 4000)])
def test_repeats_equal_brute_force(spark, monkeypatch, hot, piece, suffixes):
    for name, value in (("HOT", hot), ("PIECE", piece), ("TASK_SUFFIXES", suffixes)):
        monkeypatch.setattr(op04_suffix_dedup, name, value)
    docs = documents() + [(20_000 + i, t) for i, t in hot_documents()] + ODD4
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, key int, removed string").repartition(7)
    got, want = cut(df), removed(docs)
    assert {i: v[0] for i, v in got.items()} == want and all(len(v) == 1 for v in got.values())


def test_repeated_ids_nulls_and_empty_tables(spark):
    long = " ".join(str(i) for i in range(100))
    docs = [(5, long), (5, long), (6, long), (7, "own " + long[:200]), (None, long), (8, "z" + str(list(range(90)))), (8, long + " more")]
    got = cut(spark.createDataFrame(docs, DOCS))
    n = len(long)
    # equal rows of one id are one document: both keep all; later ones lose what they repeat; null ids come last
    assert [x[1] for x in got[5]] == [0, 0] and got[6][0][1] == n and got[None][0][1] == n and got[7][0][1] == 200
    assert sorted(x[1] for x in got[8]) == [0, n]
    assert cut(spark.createDataFrame([], DOCS)) == {}


def test_many_rows_without_an_id(spark):
    # one id (none) with most rows: texts are still told apart, the earliest by hash keeps what they share
    rnd = random.Random(5)
    own = ["".join(rnd.choice("abcdefgh ") for _ in range(120)) for _ in range(300)]
    docs = [(None, t) for t in own] + [(None, t + LINE) for t in own[:200]] + [(7, LINE), (8, own[0])]
    df = spark.createDataFrame(docs, DOCS).repartition(5)
    got = cut(df)
    ordered = [r["text"] for r in df.filter("doc_id is null").sort(F.xxhash64("text")).collect()]
    want = removed([(7, LINE), (8, own[0]), *((100 + k, t) for k, t in enumerate(ordered))])
    assert [got[7], got[8]] == [[want[7]], [want[8]]]
    assert sorted(got[None]) == sorted(v for k, v in want.items() if k >= 100) and len(got[None]) == 500


def test_different_windows_at_the_edges_of_a_common_passage_do_not_meet():
    import collections

    import pyarrow as pa

    rnd = random.Random(7)
    some = lambda n: "".join(rnd.choice("abcdefghijklmnop ") for _ in range(n))
    texts = [some(150) + LINE + some(150) for _ in range(100)]
    doc, lo, hi, off, key, _ = op04_suffix_dedup.runs_of([t.encode() for t in texts])
    edges = [[] for _ in texts]
    for d, a, b, o, k in zip(doc.tolist(), lo.tolist(), hi.tolist(), off.tolist(), key.tolist()):
        edges[d].append({"key": k, "lo": a, "n": b - a, "off": o, "level": 2})
    batches = [pa.RecordBatch.from_pydict({"id": list(range(a, a + 50)), "ord": [0] * 50, "text": texts[a : a + 50], "edges": edges[a : a + 50]}) for a in (0, 50)]
    rows = pa.Table.from_batches(list(op04_suffix_dedup._contexts(iter(batches))))
    # one row of a window and batch at most, whatever the number of documents with the passage
    assert max(collections.Counter(rows["g"].to_pylist()).values()) <= 2
    order = [(x, "ascending") for x in rows.column_names[:6]]
    spans = pa.Table.from_batches(list(op04_suffix_dedup._sorted(iter(rows.sort_by(order).to_batches(max_chunksize=7)))))
    cut = {(i, s) for i, a, n in zip(*(spans[x].to_pylist() for x in ("id", "lo", "n"))) for s in range(a, a + n + 1)}
    seen, want = set(), set()
    for i, t in enumerate(texts):
        for s in range(len(t) - 99):
            if t[s : s + 100] in seen:
                want.add((i, s))
            seen.add(t[s : s + 100])
    assert cut == want and len(want) >= 99 * (len(LINE) - 99)


def test_repeats_query(spark):
    rows = op04_suffix_dedup.op4_suffix_dedup(spark, SF).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == removed(documents())


# ---------------------------------------------------------------- op5
def test_hits_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op05_decontaminate, "SHARD_WORDS", 300)  # many shards; documents cut into overlapping pieces
    items = rows_of("benchmark", "item_id", "text")
    long = items[0][1]
    items += [(900, None), (901, "!!!"), (902, "Short Item"), (903, "the same short item twice"), (904, "the same short item twice"), (None, "nobody knows this name")]
    docs = documents() + [(5_000, None), (5_001, ""), (5_002, "x " * 1500 + long + " y" * 1500 + " " + long), (5_003, "a short\nITEM here"), (5_003, "a short\nITEM here"),
                          (5_004, "THE same-short item, twice; nobody knows this name"), (5_005, "Émile " + long.upper())]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = hits(docs, [("null" if i is None else i, t) for i, t in items])
    for chunk in (1 << 25, 2000):  # one pass, and several passes over parts of the benchmark
        monkeypatch.setattr(op05_decontaminate, "CHUNK_BYTES", chunk)
        got = op05_decontaminate.with_hits(df, bench).collect()
        assert len(got) == len(docs) and got[0]["n_words"] == 1
        for r in got:
            assert (r["hits"]["n_words"], r["hits"]["n_hit"], r["hits"]["items"]) == want[r["doc_id"]]


def test_one_item_with_most_of_the_benchmark(spark, monkeypatch):
    # an item far above a chunk is cut into pieces that keep every window; its id is listed once
    monkeypatch.setattr(op05_decontaminate, "CHUNK_BYTES", 30_000)
    rnd = random.Random(11)
    book = [f"w{rnd.randrange(3000)}" for _ in range(12_000)]
    giant = "g" * 5_000  # a word longer than a piece
    items = [("hot", " ".join(book)), ("hot", " ".join(book[:50])), (None, "one two three"), ("null", "four five six"), ("big", f"a {giant} b")]
    docs = [(i, "before " + " ".join(book[a : a + 10]) + " after") for i, a in enumerate(range(0, 11_990, 97))]
    docs += [(1_000, "one two three four five six"), (1_001, f"x a {giant.upper()} b y"), (1_002, f"x a {giant}g b y"), (1_003, " ".join(book[9_000:9_009]))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    chunks = op05_decontaminate.benchmark_chunks(bench).count()
    assert 3 <= chunks <= 12
    got = {r["doc_id"]: r["hits"] for r in op05_decontaminate.with_hits(spark.createDataFrame(docs, DOCS), bench).collect()}
    for i, _ in docs[:-4]:
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (12, 10, ["hot"])
    assert got[1_000]["n_hit"] == 6 and got[1_000]["items"] == ["null", "null"]  # the null id and the item of that name
    assert (got[1_001]["n_hit"], got[1_001]["items"]) == (3, ["big"])
    assert got[1_002]["n_hit"] == 0 and got[1_003]["n_hit"] == 0


def test_chunks_stay_below_their_bound(spark, monkeypatch):
    monkeypatch.setattr(op05_decontaminate, "CHUNK_BYTES", 4_000)
    items = [(None if i % 3 else i, " ".join(f"v{(i * 31 + k) % 997}" for k in range(40))) for i in range(300)]
    built = op05_decontaminate.benchmark_chunks(spark.createDataFrame(items * 2, "item_id long, text string")).collect()
    sizes = [sum(len(g[1]) for g in pickle.loads(r["patterns"])["groups"]) for r in built]
    # repeated rows meet before they are dealt out; a window is 40 bytes of numbers
    assert max(sizes) <= 4_000 / 5 and sum(sizes) <= 300 * 40


def test_removal_leaves_no_window_and_keeps_clean_text(spark):
    items = rows_of("benchmark", "item_id", "text")
    docs = documents() + [(5_000, items[0][1]), (5_001, "Before it. " + items[1][1] + " After it."), (5_002, None)]
    df = spark.createDataFrame([(*d, 3) for d in docs], "doc_id long, text string, other int")
    out = {r["doc_id"]: r["text"] for r in op05_decontaminate.decontaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    before = hits(docs, items)
    assert set(out) == {i for i, _ in docs if i != 5_000}  # nothing but benchmark text is left of 5000
    for i, t in docs:
        if i in out and not before[i][1]:
            assert out[i] == t
    assert all(v[1] == 0 for v in hits(list(out.items()), items).values())
    assert out[5_001].startswith("Before it.") and out[5_001].endswith("After it.") and items[1][1][20:60] not in out[5_001]


def test_no_items_no_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    df = spark.createDataFrame(documents()[:5], DOCS)
    assert op05_decontaminate.with_hits(df, none).filter("hits.n_hit > 0 or size(hits.items) > 0").count() == 0
    assert op05_decontaminate.with_hits(df.limit(0), none).count() == 0


def test_hits_query(spark):
    want = hits(documents(), rows_of("benchmark", "item_id", "text"))
    for r in op05_decontaminate.op5_decontaminate(spark, SF).collect():
        n, hit, items = want[r["doc_id"]]
        assert tuple(r)[1:] == (n, hit, len(items), sha(",".join(items)), hit > 0)


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 4, 400)
    text[-1] = 0
    index = op05_decontaminate.FMIndex(text.astype(np.int64), 4)
    for n in (1, 2, 5):
        windows = np.array(sorted({tuple(w) for w in rng.integers(1, 4, (60, n)).tolist()}), np.int32)
        which, low, high = index.search(windows)
        found = {tuple(windows[w]): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, low, high)}
        for w in map(tuple, windows.tolist()):
            assert found.get(w, []) == [k for k in range(400 - n + 1) if tuple(text[k : k + n]) == w]


# ---------------------------------------------------------------- op6
@pytest.mark.parametrize("cell", [2_000_000, 1500])
def test_groups_equal_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(op06_minhash, "CELL_SHINGLES", cell)  # the small one cuts cells into blocks
    docs = [d for d in documents()][:120] + [(20_000 + i, t) for i, t in hot_documents(40)]
    docs += [(30_000, None), (30_001, ""), (30_002, "two words"), (30_003, "Two  words"), (30_004, "words two"), (30_005, " \t\n")]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, id int, cell string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op06_minhash.grouped(df).collect()}
    want = components(docs)
    assert got == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in op06_minhash.grouped(df).collect())


def test_repeated_rows_nulls_and_empty_tables(spark):
    text = "one two three four five six seven eight"
    docs = [(4, text), (4, text), (2, text.upper()), (None, text), (None, "something else"), (9, "alone")]
    got = sorted(op06_minhash.grouped(spark.createDataFrame(docs, DOCS)).collect(), key=str)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[4] == [(4, 2, False)] * 2 and by[2] == [(4, 2, True)] and by[9] == [(1, 9, True)]
    assert sorted(by[None], key=str) == [(1, None, True), (4, 2, False)]
    assert op06_minhash.grouped(spark.createDataFrame([], DOCS)).count() == 0


def test_shared_and_null_ids_lose_no_link(spark):
    a = " ".join(f"a{i}" for i in range(60))
    near, other = a.replace("a59", "x"), " ".join(f"b{i}" for i in range(60))
    group = lambda docs: sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in op06_minhash.grouped(spark.createDataFrame(docs, DOCS)).collect()), key=repr)
    assert group([(1, a), (5, other), (5, near)]) == [(1, 1, True), (5, 1, False), (5, 5, True)]
    assert group([(None, a), (7, near), (None, other)]) == sorted([(None, 7, False), (7, 7, True), (None, None, True)], key=repr)
    assert group([(None, a), (None, near)]) == sorted([(None, None, False), (None, None, True)], key=repr)


def test_signatures_estimate_with_less_variance_than_independent_hashes():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(150):
        both, own = rng.integers(0, 2**63, 70).astype(np.uint64), rng.integers(0, 2**63, (2, 30)).astype(np.uint64)
        s = op06_minhash.super_minhash([np.unique(np.concatenate([both, x])) for x in own])
        errors.append((s[0] == s[1]).mean() - 70 / 130)
    j = 70 / 130
    assert abs(np.mean(errors)) < 0.01 and np.var(errors) < 0.9 * j * (1 - j) / op06_minhash.SLOTS
    # a long set in pieces gives the same slots as at once
    big = np.unique(rng.integers(0, 2**63, 80_000).astype(np.uint64))
    at_once = op06_minhash.super_minhash([big])
    slots = np.full((1, op06_minhash.SLOTS), np.uint64(op06_minhash.SLOTS) << np.uint64(40), np.uint64)
    op06_minhash._fill(slots, big, np.zeros(len(big), np.int64))
    assert (at_once == slots).all()


def test_links_in_a_cell_equal_all_pairs():
    rnd = random.Random(4)
    docs = [(i, t) for i, t in hot_documents(30)]
    sets = op06_minhash.shingle_sets([t for _, t in docs])
    assert [len(s) for s in sets] == [len(shingles(t)) for _, t in docs]
    order = list(range(len(docs)))
    rnd.shuffle(order)
    links = op06_minhash.links_in(np.array([docs[k][0] for k in order]), [sets[k] for k in order])
    want = components(docs)
    assert dict(links) == {i: c for i, (_, c) in want.items() if c != i}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(200, 200), (301, 300), (300, 301)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + k: 100 for k in range(50)} | {300: 300, 301: 300}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_links_from_another_percent_on(spark):
    words = [f"w{i}" for i in range(200)]
    # 196 shingles each; 20 changed words at an end leave 176 in common, 176 / 216 = 0.815, and 25 leave 171 / 221 = 0.774
    rows = [(1, " ".join(words)), (2, " ".join(words[:180] + [f"x{i}" for i in range(20)])), (3, " ".join([f"y{i}" for i in range(25)] + words[25:]))]
    df = spark.createDataFrame(rows, DOCS)
    kept = lambda **percent: {r["doc_id"]: r["kept"] for r in op06_minhash.grouped(df, **percent).collect()}
    assert kept(percent=80) == {1: True, 2: False, 3: True}
    assert kept() == {1: True, 2: True, 3: True} and kept(percent=75) == {1: True, 2: False, 3: False}
    assert op06_minhash.banding(85) == (6, 32) and op06_minhash.banding(80) == (5, 38)


def test_near_dedup_query(spark):
    docs = documents()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op06_minhash.op6_minhash_near_dedup(spark, SF).collect()}
    assert got == components(docs)
