"""op3 token counts and op9 token files."""

import zlib

import hypothesis as h
import hypothesis.strategies as st
import numpy as np
import pytest
import public_tokenizers
from helpers import DOCS, SF, documents
from tokenizers import Tokenizer

from tidepool.llm import op03_token_counts, op09_token_files
from tidepool.llm.common import shared_dir
from tidepool.llm.tokens import Pieces

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}
OWN = {p: Pieces(p) for p in (BYTE, WORD)}
ODD = ["", "  ", " a", "a ", "a  b", "\n\nx", "don't  we'll 'S ", "<|endoftext|> x<|endoftext|>y <|ENDOFTEXT|>", "Éa É, ß. ÀÁ́ é", "a\x1cb \x1c c",
       "a.b ,. c., 12,345. x²", "漢字 テスト。", "a\r\nb\tc \t d", "abc.,", "foo.. bar,.", "İstanbul ŞŁ", "a b  c ​"]


def encode(path, text):
    return LIBRARY[path].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_equal_the_library_on_whole_texts(path):
    assert OWN[path].kind
    for text in ODD + [t for _, t in documents()]:
        assert np.frombuffer(OWN[path].ids(text), OWN[path].dtype).tolist() == encode(path, text), text[:80]


@pytest.mark.parametrize("path", [BYTE, WORD])
@h.settings(max_examples=400, deadline=None)
@h.given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,'sStréÉ<|>endoftx019"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_pieces_equal_the_library_on_any_text(path, text):
    assert np.frombuffer(OWN[path].ids(text), OWN[path].dtype).tolist() == encode(path, text)


def test_memo_generations_forget_nothing_needed(monkeypatch):
    from tidepool.llm import tokens

    monkeypatch.setattr(tokens, "MEMO_ENTRIES", 7)
    p = Pieces(WORD)
    for _, text in documents()[:20]:
        assert np.frombuffer(p.ids(text), p.dtype).tolist() == encode(WORD, text)
    assert len(p) <= 8 and len(p.older) <= 8


def test_counts_and_cache(spark):
    docs = documents()[:60] + [(1, documents()[0][1]), (None, "q"), (None, None), (7_000, ""), (7_001, "x" * 30_000)]
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, digest int")
    cache = shared_dir(spark, "cache")
    want = sorted((i or -1, len((t or "").encode()), len(encode(BYTE, t))) for i, t in docs)
    read = lambda f, d: sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in op03_token_counts.counted(d, f, cache).collect())
    assert read(BYTE, df) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t in docs})
    # all known: nothing is encoded or appended; a false count in the cache would show
    assert read(BYTE, df) == want and spark.read.parquet(cache).count() == stored.count()
    # only the new text is appended
    more = spark.createDataFrame([(1, "brand new text"), (2, docs[0][1])], DOCS)
    read(BYTE, more)
    assert spark.read.parquet(cache).count() == stored.count() + 1
    # another tokenizer doesn't meet these counts
    assert read(WORD, more) == sorted((i, len(t.encode()), len(encode(WORD, t))) for i, t in [(1, "brand new text"), (2, docs[0][1])])
    assert read(BYTE, df.limit(0)) == []
    spark.createDataFrame([(op03_token_counts.file_digest(BYTE), bytes(32), 99)], op03_token_counts.CACHE).write.mode("append").parquet(cache)
    assert read(BYTE, df) == want


def test_count_query(spark):
    want = {i: len(encode(BYTE, t)) for i, t in documents()}
    rows = op03_token_counts.op3_token_counts(spark, SF).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == want and all(r["over_limit"] == (r["n_tokens"] > 1024) for r in rows)


# ---------------------------------------------------------------- op9
@h.settings(max_examples=60, deadline=None)
@h.given(st.lists(st.integers(0, 300), max_size=3000), st.integers(1, 5000))
def test_rans_round_trip(tokens, skew):
    t = np.array(tokens, np.uint32)
    counts = np.bincount(t, minlength=301).astype(np.int64) + np.arange(301) % 3 * skew
    f = op09_token_files.Frequencies(counts)
    if counts.sum():
        assert int(f.freq.sum()) == 1 << op09_token_files.SCALE_BITS and (f.freq[counts > 0] > 0).all()
    lanes, state, words = op09_token_files.encode(t, f)
    assert (op09_token_files.decode(len(t), lanes, state, words, f) == t).all()


def test_frequencies_of_many_rare_symbols_and_size_near_entropy():
    counts = np.ones(50_000, np.int64)
    counts[0] = 10**9
    f = op09_token_files.Frequencies(counts)
    assert int(f.freq.sum()) == 1 << 20 and (f.freq > 0).all()
    p = np.random.default_rng(0).zipf(1.4, 300_000) % 5000
    f = op09_token_files.Frequencies(np.bincount(p).astype(np.int64))
    lanes, _, words = op09_token_files.encode(p, f)
    q = np.bincount(p) / len(p)
    entropy = -(q[q > 0] * np.log2(q[q > 0])).sum()
    assert (len(words) * 32 + lanes * 64) / len(p) < entropy * 1.05


def test_damage_is_detected():
    f = op09_token_files.Frequencies(np.array([5, 3, 2]))
    data = op09_token_files.pack([1, None], [2, 1], np.array([0, 2, 1]), f)
    ids, lengths, tokens = op09_token_files.unpack(data, f)
    assert (ids, list(lengths), list(tokens)) == ([1, None], [2, 1], [0, 2, 1])
    with pytest.raises(ValueError):
        op09_token_files.unpack(data + b"x", f)
    with pytest.raises(ValueError):
        op09_token_files.unpack(data, op09_token_files.Frequencies(np.array([5, 3, 3])))
    flipped = bytes([*data[:-1], data[-1] ^ 1])
    assert zlib.crc32(flipped) != zlib.crc32(data)


def expected(docs):
    at, out = 0, []
    for i, ids in sorted(((i, encode(WORD, t) + [1]) for i, t in docs), key=lambda d: (d[0] is not None, d[0] or 0, np.array(d[1], "<u2").tobytes())):
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("block", [1 << 19, 50])
def test_files_round_trip(spark, monkeypatch, block):
    monkeypatch.setattr(op09_token_files, "BLOCK_TOKENS", block)
    docs = documents()[:80] + [(None, "b"), (None, None), (7_000, ""), (7_001, "x y" * 9_000), (3, "again"), (3, "again"), (-5, "neg")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs[::-1]], "doc_id long, text string, ids string, id int").repartition(5)
    path = shared_dir(spark, "files")
    op09_token_files.write_files(df, path, WORD)
    rows = op09_token_files.read_documents(spark, path).collect()
    assert sorted((tuple(r) for r in rows), key=lambda r: r[1]) == expected(docs)
    # checkpoints: every block starts where the one before it in its file ends
    blocks = spark.read.parquet(f"{path}/blocks").orderBy("file_no", "block_no").collect()
    for a, b in zip(blocks, blocks[1:]):
        if a["file_no"] == b["file_no"]:
            assert (b["first_token"], b["byte_offset"]) == (a["first_token"] + a["n_tokens"], a["byte_offset"] + len(a["payload"]))


def test_no_documents_no_files(spark):
    path = shared_dir(spark, "none")
    op09_token_files.write_files(spark.createDataFrame([], DOCS), path, WORD)
    assert op09_token_files.read_documents(spark, path).count() == 0


def test_files_query(spark):
    rows = op09_token_files.op9_token_files(spark, SF).collect()
    assert sorted((tuple(r) for r in rows), key=lambda r: r[1]) == expected(documents())
