"""op8 WARC, op10 mixing, the pipeline."""

import random
import gzip
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
import public_tokenizers
from helpers import SF, WORD, components, documents, hits, quality, rows_of, sha, targets
from tokenizers import Tokenizer

import corpus_pipeline
from tidepool.llm import op08_warc, op10_mixing, queries
from tidepool.llm.common import shared_dir, stored, table


# ---------------------------------------------------------------- op8
def test_archives_round_trip(spark):
    nasty = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + "é😀" * 60
    pages = [(1, "http://a/", "b" * 200), (2, "http://b/\r\nX: y", "b" * 200), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"),
             (7, "u", nasty), (8, "u", nasty), (8, "u", nasty), (9, "u", "c" * 300_000), (None, "n", "b" * 200), (0, "first", nasty)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, id int").repartition(3)
    path = shared_dir(spark, "warc")
    op08_warc.write_archives(df, path)
    rows = op08_warc.assembled(op08_warc.read_records(spark, path)).collect()
    assert len(rows) == len(pages)
    got = sorted(((r["response"]["page_id"], r["response"]["type"], r["response"]["refers_to"], r["response"]["n_bytes"], r["response"]["digest"]) for r in rows), key=str)
    want = []
    for i, _, html in pages:
        data = (html or "").encode()
        first = min((j for j, _, t in pages if (t or "") == (html or "") and j is not None), default=None)
        again = len(data) >= 100 and i is not None and i > first
        want.append((i, "revisit" if again else "response", str(first) if again else None, len(data), sha(data)))
    assert got == sorted(want, key=str)
    for r in rows:
        own = next(h for i, _, h in pages if i == r["response"]["page_id"])
        if r["response"]["type"] == "response":
            assert bytes(r["response"]["body"]) == (own or "").encode() and r["response"]["checked"]
        else:
            assert bytes(r["response"]["body"]) == b""
        assert r["request"]["type"] == "request" and r["metadata"]["type"] == "metadata" and r["request"]["uri"] == r["response"]["uri"]
    assert op08_warc.read_records(spark, path).select("record_id").distinct().count() == 3 * len(pages)


def test_no_pages(spark):
    path = shared_dir(spark, "warc")
    op08_warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert op08_warc.assembled(op08_warc.read_records(spark, path)).count() == 0


def test_broken_archives_are_errors():
    record = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in op08_warc.parse_records(record * 2)] == [b"abc"] * 2
    for bad in (record[:-2], b"x" + record, record[:-8]):
        with pytest.raises(ValueError):
            list(op08_warc.parse_records(bad))


FOREIGN = [
    b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:i>\r\nContent-Length: 4\r\n\r\ninfo\r\n\r\n",
    b"WARC/1.0\r\nWARC-Type:response\r\nwarc-record-id:<urn:uuid:r>\r\nWARC-Target-URI: http://a:80/\r\nContent-Length:24\r\n\r\n"
    b"HTTP/1.1 200 OK\r\n\r\nbody!\r\n\r\n",
    b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <urn:uuid:m>\r\nWARC-Concurrent-To: <urn:uuid:r>\r\nWARC-Concurrent-To: <urn:uuid:q>\r\n"
    b"X-Folded: one\r\n two\r\nContent-Length: 0\r\n\r\n\r\n\r\n",
    b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:b>\r\nContent-Length: 3000000\r\n\r\n" + b"z" * 3_000_000 + b"\r\n\r\n",
]


@pytest.mark.parametrize("how", ["members", "whole", "padded", "plain"])
def test_archives_of_other_writers(spark, tmp_path, monkeypatch, how):
    """One gzip member per record, as is usual; headers in any case, without a space, repeated, folded."""
    monkeypatch.setattr(op08_warc, "STEP", 1 << 16)
    pack = {"members": lambda: b"".join(map(gzip.compress, FOREIGN)), "whole": lambda: gzip.compress(b"".join(FOREIGN)),
            "padded": lambda: b"\0\0".join(map(gzip.compress, FOREIGN)), "plain": lambda: b"".join(FOREIGN)}[how]()
    (tmp_path / "x.warc.gz").write_bytes(pack)
    got = {r["record_id"]: r for r in op08_warc.read_records(spark, str(tmp_path)).collect()}
    assert set(got) == {f"<urn:uuid:{x}>" for x in "irmb"}
    assert bytes(got["<urn:uuid:r>"]["body"]) == b"body!" and got["<urn:uuid:r>"]["uri"] == "http://a:80/" and len(got["<urn:uuid:b>"]["body"]) == 3_000_000
    assert got["<urn:uuid:m>"]["concurrent"] == ["<urn:uuid:r>", "<urn:uuid:q>"]
    assert [h["x-folded"] for h, _ in op08_warc.parse_records(b"".join(FOREIGN)) if "x-folded" in h] == [["one two"]]


def test_a_member_that_is_cut_off_is_an_error():
    whole = b"".join(map(gzip.compress, FOREIGN[:3]))
    assert len(list(op08_warc.parse_records(op08_warc.inflated(whole)))) == 3
    with pytest.raises(ValueError):
        list(op08_warc.parse_records(op08_warc.inflated(whole[:-9])))


def test_revisits_name_a_record(spark):
    df = spark.createDataFrame([(k, f"u{k}", "b" * 200) for k in (3, 1, 2, 1)], "page_id long, url string, html string")
    path = shared_dir(spark, "warc")
    op08_warc.write_archives(df, path)
    records = op08_warc.read_records(spark, path).collect()
    ids = {r["record_id"]: r for r in records}
    again = [r for r in records if r["type"] == "revisit"]
    assert len(again) == 2 and all(ids[r["refers_to_record"]]["page_id"] == 1 and ids[r["refers_to_record"]]["type"] == "response" for r in again)


# ---------------------------------------------------------------- op10
def check_mix(rows, docs):
    """``docs``: (doc_id, text, source)."""
    sizes = {}
    for _, text, source in docs:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    want = targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
    taken = dict.fromkeys(sizes, 0)
    largest = dict.fromkeys(sizes, 0)
    assert len(rows) == len(docs)
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1, (s, taken[s], want[s])
    return taken, want


def test_mix_meets_targets(spark):
    docs = rows_of("documents", "doc_id", "text", "source")
    docs += [(5_000 + k, "copy of one text " * 10, "hot") for k in range(300)] + [(6_000, None, None), (6_001, "a b", None), (6_002, "", "empty"), (None, "x y z", "hot")]
    docs += [docs[-1]]
    df = spark.createDataFrame([(*d, 1, 2.0) for d in docs], "doc_id long, text string, source string, size int, rate double").repartition(4)
    rows = op10_mixing.mixed(df).collect()
    taken, want = check_mix(rows, docs)
    key = lambda r: (str(r["doc_id"]), r["size"], r["copies"])
    again = op10_mixing.mixed(df.repartition(9)).collect()
    assert sorted(map(key, rows)) == sorted(map(key, again))
    # a tilt: within a source that is cut back, rates fall with size, else they rise
    for s in {r["source"] for r in rows}:
        own = sorted({(r["size"], r["rate"]) for r in rows if r["source"] == s and r["size"] and r["rate"] is not None})
        rates = [x for _, x in own]
        assert rates == sorted(rates) or rates == sorted(rates, reverse=True)


def test_rates_equal_a_plain_solver(spark):
    """Bisection on each source's dual, row by row."""
    rows = op10_mixing.mixed(table(spark, SF, "documents")).collect()
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        mean, target = sum(r["size"] for r in own) / len(own), own[0]["target"]
        worded = [r for r in own if r["size"]]
        if target >= 2 * own[0]["source_size"]:
            assert all(r["rate"] == 2.0 for r in worded)
            continue
        low, high = -60.0, 60.0
        for _ in range(200):
            lam = (low + high) / 2
            rates = [2.0 if lam * r["size"] / mean > 1 else min(2.0, math.exp(lam * r["size"] / mean)) for r in worded]
            taken = sum(w * r["size"] for w, r in zip(rates, worded, strict=True))
            low, high = (low, lam) if taken > target else (lam, high)
        assert [r["rate"] for r in worded] == pytest.approx(rates, rel=1e-5)


def test_rows_without_an_id_are_ranked_in_parts(spark):
    docs = [(None, f"w{k} of one size", "hot") for k in range(3000)] + [(7, "a b", "other")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = op10_mixing.mixed(df).collect()
    check_mix(rows, [(i, t, s) for i, t, s in docs])
    marks = df.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(op10_mixing.SALTS)).alias("salt")).groupBy("salt").count()
    assert marks.agg(F.max("count")).first()[0] < 30


def test_a_mix_that_does_not_settle_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(op10_mixing, "NEWTON_STEPS", 1)
    with pytest.raises(RuntimeError, match="did not settle"):
        op10_mixing.mixed(table(spark, SF, "documents")).count()


def test_mix_of_nothing(spark):
    schema = "doc_id long, text string, source string"
    assert op10_mixing.mixed(spark.createDataFrame([], schema)).count() == 0
    check_mix(op10_mixing.mixed(spark.createDataFrame([(1, None, "a"), (2, " ", None)], schema)).collect(), [(1, None, "a"), (2, " ", None)])
    one = [(1, "a b c", "only")]
    check_mix(op10_mixing.mixed(spark.createDataFrame(one, schema)).collect(), one)


@pytest.mark.parametrize("seed", range(3))
def test_targets_equal_resharing(spark, seed):
    rnd = random.Random(seed)
    sizes = {f"s{k}": int(10 ** rnd.uniform(0, 6)) for k in range(17)} | {None: 50, "Z": 7}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in op10_mixing.source_targets(df).collect()}
    assert got == pytest.approx(targets(sizes))


def test_mix_is_native(spark):
    plan = op10_mixing.op10_entropy_mix(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    docs = rows_of("documents", "doc_id", "text", "source")
    rows = op10_mixing.mixed(table(spark, SF, "documents")).collect()
    check_mix(rows, docs)


# ---------------------------------------------------------------- pipeline
def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    extra = spark.createDataFrame([(900_000, None, "en", "src1", 0), (900_001, documents()[0][1], None, None, 5), (0, documents()[0][1], "en", "src0", 1)], docs.schema)
    docs = stored(docs.unionByName(extra), "in")
    columns = docs.columns
    items = rows_of("benchmark", "item_id", "text")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF), name)
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        after = out.collect()
        if name != "token_files":
            assert out.columns == columns
        if name == "quality":
            kept = {r["doc_id"] for r in after}
            for i, t in before:
                n, _, _, _, rep = quality(t)
                if n < 10 or 100 * rep > 20 * n:
                    assert i not in kept or i == 0
            assert 900_000 not in kept and len(kept) > 100
        elif name == "near_dedup":
            groups = components(list(dict(before).items()), corpus_pipeline.NEAR_PERCENT)
            assert sorted(r["doc_id"] for r in after) == sorted(i for i, (_, c) in groups.items() if i == c)
        elif name == "decontaminate":
            assert all(v[1] == 0 for v in hits([(r["doc_id"], r["text"]) for r in after], items).values())
            dirty = hits(before, items)
            clean = {i: t for i, t in before if not dirty[i][1]}
            assert {r["doc_id"]: r["text"] for r in after if r["doc_id"] in clean} == clean
        elif name == "mix":
            counts = {}
            for r in after:
                counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
            assert max(counts.values()) <= 2 and set(counts) <= {i for i, _ in before}
            words = sum(len(WORD.findall(t)) for _, t in before)
            assert abs(sum(len(WORD.findall(r["text"])) for r in after) - 1.5 * words) < 0.1 * words
        else:
            t = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
            at = 0
            want = []
            for i, text in sorted(before):
                ids = t.encode(text, add_special_tokens=False).ids + [1]
                want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
                at += len(ids)
            assert sorted(map(tuple, after), key=lambda r: r[1]) == want
        seen[name] = len(after)
        docs = out
    assert list(seen) == [n for n, _ in corpus_pipeline.STAGES]


NEAR_A = " ".join(f"a{i}" for i in range(60))
OTHER = " ".join(f"b{i}" for i in range(60))
NEAR_COPY = " ".join([*(f"a{i}" for i in range(58)), "x", "y"])


def test_near_copies_with_shared_and_null_ids(spark):
    """Texts under one id are documents of their own: none is lost, and no link is."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    run = lambda rows: sorted(
        ((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], schema), SF).collect()),
        key=repr,
    )
    assert run([(1, NEAR_A), (1, OTHER), (2, NEAR_COPY)]) == sorted([(1, NEAR_A), (1, OTHER)], key=repr)
    assert run([(1, NEAR_A), (5, OTHER), (5, NEAR_COPY)]) == sorted([(1, NEAR_A), (5, OTHER)], key=repr)
    assert len(run([(None, NEAR_A), (None, NEAR_COPY), (None, OTHER)])) == 2
    assert run([(None, NEAR_A), (3, NEAR_COPY), (3, NEAR_COPY), (None, OTHER), (None, OTHER)]) == sorted([(3, NEAR_COPY), (None, OTHER)], key=repr)


def test_stages_with_clashing_columns(spark):
    """Columns named like the stages' own helpers pass through."""
    docs = table(spark, SF, "documents").limit(40)
    names = ["_id", "_k", "_hits", "_quality", "hits", "kept_id", "kept_key", "quality", "mix_id", "mix_total", "mix_rows", "mix_copies", "mix_copy", "HITS_", "text_key", "first"]
    docs = stored(docs.select("*", *[F.lit(n).alias(n) for n in names]), "clash")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert all(r[n] == n for r in out.collect() for n in names)


def test_run_and_registry(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len(rows) > 100 and corpus_pipeline.ORACLE_SQL is None
    import __spark_entry__ as entry

    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, duck, name):
    from test_oracle import _canon

    df = queries.QUERIES[name](spark, SF)
    cols, rows = _canon(df.columns, [tuple(r) for r in df.collect()])
    rel = duck(SF).sql(queries.ORACLE[name])
    assert (cols, rows) == _canon(rel.columns, rel.fetchall())
