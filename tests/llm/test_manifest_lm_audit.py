"""op11 Merkle manifest, op12 hidden Markov model, op13 filter audit."""

import hashlib
import itertools
import math
import zlib

import numpy as np
import pytest
from helpers import LOWER, SF, WORD, documents, rows_of

from tidepool.llm import op11_manifest, op12_hmm, op13_filter_audit

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, chunk string, idx string, part string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ------------------------------------------------------------------ op11
def leaf(doc_id, source, lang, n_chars, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(digests):
    """(root, siblings of every leaf level by level) of a list of digests."""
    proofs, place, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, p in enumerate(place):
            run = level[p // 8 * 8 : p // 8 * 8 + 8]
            proofs[i].append((run[: p % 8], run[p % 8 + 1 :]))
            place[i] = p // 8
        level = [h(*level[k : k + 8]) for k in range(0, len(level), 8)]
    return (level or [None])[0], proofs


def manifest(rows):
    """{doc_id: (leaf, subroot, root, proof, folded, verified)} of distinct ids, brute force."""
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        docs = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0], leaf(*r)))
        trees[lang] = (docs, *tree([leaf(*r) for r in docs]))
    root, tops = tree([trees[x][1] for x in langs])
    out = {}
    for k, lang in enumerate(langs):
        docs, sub, proofs = trees[lang]
        for r, proof in zip(docs, proofs):
            path = proof + tops[k]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            folded = leaf(*r[:4], r[4].translate(LOWER) if r[4] is not None else None) if hit else leaf(*r)
            for left, right in path:
                folded = h(*left, folded, *right)
            out[r[0]] = (leaf(*r), sub, root, h(*[d for a, b in path for d in a + b]), folded, folded == root)
    return out


def verified(spark, rows):
    df = spark.createDataFrame([(i, t, lang, s, n, "x", "y", "z", "w") for i, s, lang, n, t in rows], DOCS)
    return {r[0]: tuple(r[1:]) for r in op11_manifest.verified(df).collect()}


@pytest.mark.parametrize("block_level", [1, 5])
def test_manifest_equals_brute_force(spark, monkeypatch, block_level):
    """With blocks of 8 leaves the levels above are repeated per block; the result doesn't change."""
    monkeypatch.setattr(op11_manifest, "BLOCK_LEVEL", block_level)
    rows = rows_of("documents", "doc_id", "source", "lang", "n_chars", "text")
    rows += [(10**9 + k, None, None, None, None) for k in range(9)] + [(-5, "s", "zz", 3, "ABC")] + [(None, "s", "en", 1, "A")]
    assert verified(spark, rows) == manifest(rows)


def test_manifest_small_trees(spark):
    for rows in (
        [],
        [(1, "s", "en", 2, "Ab")],
        [(1, "s", "en", 2, "Ab"), (2, "s", None, 0, "")],
        [(k, "s", "en", k, f"T{k}") for k in range(9)],  # the second run is one leaf
        [(k, "s", f"l{k}", k, "x" * 3000) for k in range(10)],  # ten languages of a leaf each
    ):
        assert verified(spark, rows) == manifest(rows)


def test_manifest_repeated_rows(spark):
    rows = [(7, "s", "en", 1, "same")] * 20 + [(7, "s", "en", 1, "other")]
    df = spark.createDataFrame([(i, t, lang, s, n, "x", "y", "z", "w") for i, s, lang, n, t in rows], DOCS)
    got = op11_manifest.verified(df).collect()
    order = sorted(leaf(*r) for r in rows)
    assert len(got) == 21 and {r["root"] for r in got} == {tree(order)[0]} and all(r["verified"] for r in got)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "1000000"


# ------------------------------------------------------------------ op12
def tokens(text):
    return (text or "").translate(LOWER).encode().split() + [b" "]


def unigram(rows):
    train = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    c = {}
    for t in train:
        for w in tokens(t):
            c[w] = c.get(w, 0) + 1
    return c, sum(c.values())


def path_sum(model, sym):
    """Probability ratio of a symbol sequence, summed over all paths one by one."""
    k = len(model.start)
    return sum(
        model.start[p[0]] * model.ratio[sym[0], p[0]] * math.prod(model.trans[a, b] * model.ratio[s, b] for a, b, s in zip(p, p[1:], sym[1:]))
        for p in itertools.product(range(k), repeat=len(sym))
    )


def plain_forward_backward(model, sym):
    """(log10 likelihood, starts, moves, emissions) of one sequence, one token after the other, in logs."""
    k, n = len(model.start), len(sym)
    with np.errstate(divide="ignore"):
        la, lb = np.log(model.trans), np.log(model.ratio)
    alpha, beta = np.zeros((n, k)), np.zeros((n, k))
    alpha[0] = np.log(model.start) + lb[sym[0]]
    for t in range(1, n):
        alpha[t] = np.logaddexp.reduce(alpha[t - 1][:, None] + la, axis=0) + lb[sym[t]]
    for t in range(n - 2, -1, -1):
        beta[t] = np.logaddexp.reduce(la + lb[sym[t + 1]] + beta[t + 1], axis=1)
    total = np.logaddexp.reduce(alpha[-1])
    gamma = np.exp(alpha + beta - total)
    moves = np.zeros((k, k))
    for t in range(1, n):
        moves += np.exp(alpha[t - 1][:, None] + la + lb[sym[t]] + beta[t] - total)
    emit = np.zeros_like(model.ratio)
    np.add.at(emit, sym, gamma)
    return total / math.log(10), gamma[0], moves, emit


def random_model(rng, states=3, size=12):
    q = rng.dirichlet(np.ones(size))
    emit = rng.dirichlet(np.ones(size) * 0.3, states).T
    return op12_hmm.Model(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), op12_hmm.Model.ratios(emit, q))


def test_likelihood_is_the_sum_over_all_paths():
    rng = np.random.default_rng(1)
    model = random_model(rng)
    for n in (1, 2, 7):
        sym = rng.integers(0, 12, n).astype(np.uint16)
        assert math.isclose(10 ** op12_hmm.log10_ratio(model, sym, np.array([n]))[0], path_sum(model, sym), rel_tol=1e-12)


@pytest.mark.parametrize("piece, window", [(256, 1 << 18), (4, 16), (1, 1)])
def test_pieces_equal_plain_recursion(monkeypatch, piece, window):
    monkeypatch.setattr(op12_hmm, "PIECE", piece)
    monkeypatch.setattr(op12_hmm, "WINDOW", window)
    rng = np.random.default_rng(2)
    model = random_model(rng)
    lens = np.array([1, 300, 3, 4, 5, 1, 1000, 8, 257, 256])
    sym = rng.integers(0, 12, lens.sum()).astype(np.uint16)
    cuts = np.split(sym, np.cumsum(lens)[:-1])
    plain = [plain_forward_backward(model, s) for s in cuts]
    np.testing.assert_allclose(op12_hmm.log10_ratio(model, sym, lens), [p[0] for p in plain], rtol=1e-10, atol=1e-10)
    for got, want in zip(op12_hmm.expected(model, sym, lens), [sum(p[k] for p in plain) for k in (1, 2, 3)]):
        np.testing.assert_allclose(got, want, rtol=1e-8, atol=1e-8)


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return op12_hmm.fitted(docs)


def test_base_scores_and_counts(spark, trained):
    chunked, model, n = trained
    rows = documents()
    c, total = unigram(rows)
    assert n == total
    got = {r["doc_id"]: r for r in op12_hmm.scores(chunked, model).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        r, words = got[i], tokens(text)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"]) == (len(words), sum(w in c for w in words))
        want = sum(math.log10((c.get(w, 0) + 1) / (total + len(c) + 1)) for w in words)
        assert math.isclose(r["base_score"], want, rel_tol=1e-9)


def test_scores_equal_brute_force_over_words(trained):
    """Scores from the model's definition, with symbols and probabilities worked out per word."""
    chunked, model, n = trained
    rows = documents()
    c, total = unigram(rows)
    often = sorted((w for w, k in c.items() if k > 1 and k * op12_hmm.PROFILES >= total), key=lambda w: (-c[w], w))
    profiled = {w: op12_hmm.SHAPES + i for i, w in enumerate(often)}
    got = {r["doc_id"]: r for r in op12_hmm.scores(chunked, model).collect()}
    for i, text in rows[:40]:
        words = tokens(text)
        sym = np.array([op12_hmm.symbol_of(w, c.get(w, 0), profiled) for w in words])
        want = got[i]["base_score"] + plain_forward_backward(model, sym)[0]
        assert math.isclose(got[i]["score"], want, rel_tol=1e-9)
    # every state's words and the unknown word have probability 1 together
    q = lambda k: (k + 1) / (total + len(c) + 1)
    mass = q(0) * model.ratio[0] + sum(q(k) * model.ratio[op12_hmm.symbol_of(w, k, profiled)] for w, k in c.items())
    np.testing.assert_allclose(mass, 1, rtol=1e-6)


def test_training_helps_held_out_texts(spark, trained):
    chunked, model, _ = trained
    held = [r for r in op12_hmm.scores(chunked, model).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.97 * sum(r["base_score"] for r in held)  # both are negative


def test_each_step_raises_the_likelihood(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    totals = []
    for steps in (0, 1, 3):
        chunked, model, _ = op12_hmm.fitted(docs, steps=steps)
        totals.append(sum(r["score"] for r in op12_hmm.scores(chunked, model).collect() if not r["held_out"]))
    assert totals == sorted(totals)


def test_hmm_edge_cases(spark):
    schema = "doc_id long, text string, chunk string, words string, id string, held string"
    rows = [(1, None), (2, ""), (None, "A b"), (3, "x " * 40_000), (4, "a b"), (4, "a b"), (5, "É a b\x1cc")]
    df = spark.createDataFrame([(i, t, "c", "w", "i", "h") for i, t in rows], schema)
    chunked, model, n = op12_hmm.fitted(df)
    got = op12_hmm.scores(chunked, model).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["n_tokens"]) for r in got if r["doc_id"]) == [
        (False, 1, 1), (False, 2, 1), (False, 3, 40_001), (False, 4, 3), (False, 4, 3), (False, 5, 3)]
    c, total = unigram(rows)
    assert n == total and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    empty = op12_hmm.fitted(df.limit(0))
    assert op12_hmm.scores(empty[0], empty[1]).count() == 0 and empty[2] == 0
    only_held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    chunked, model, n = op12_hmm.fitted(spark.createDataFrame([(only_held, "a b")], "doc_id long, text string"))
    row = op12_hmm.scores(chunked, model).collect()[0]
    assert n == 0 and row["n_known"] == 0 and row["base_score"] == 0 and abs(row["score"]) < 1e-12


# ------------------------------------------------------------------ op13
def fails(rows):
    """Failed filters per row of (id, text, ...)."""
    least = {}
    for r in rows:
        if r[0] is not None:
            least[r[1] or ""] = min(least.get(r[1] or "", r[0]), r[0])
    out = []
    for r in rows:
        t = r[1] or ""
        w = WORD.findall(t)
        bad = ("A" if len(w) < 200 else "") + ("B" if 100 * len(set(w)) < 50 * len(w) else "")
        bad += ("C" if 100 * sum("A" <= ch <= "Z" for ch in t) > 2 * len(t) else "") + ("D" if set(t) & set("#$%&*|") else "")
        bad += "E" if t in least and (r[0] is None or r[0] > least[t]) else ""
        out.append(bad)
    return out


def walk(rows, labels):
    """Every order applied to every document, one after the other."""
    bad = fails(rows)
    out = {}
    for part in {r[2] or "" for r in rows}:
        mine = [(r, b) for r, b in zip(rows, bad) if (r[2] or "") == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left, gone = list(mine), []
            for k, f in enumerate(order):
                hit = [x for x in left if f in x[1]]
                label = lambda x: labels.get(x[0][0], (0, 0)) if x[0][0] is not None else (0, 0)
                redundant = sum(f in x[1] for x in gone)
                left, gone = [x for x in left if f not in x[1]], gone + hit
                removed_by[f] += len(hit)
                out[part, "".join(order), k + 1] = [
                    len(left), len(hit), redundant, sum(b == f for _, b in mine),
                    sum(label(x)[0] for x in hit), sum(label(x)[1] for x in hit)]
        for (p, order, k), row in out.items():
            if p == part:
                row.append(removed_by[order[k - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, source string, id string, part string")
    marks = spark.createDataFrame([(i, q, t) for i, (q, t) in labels.items()], "doc_id long, quality int, toxic int")
    got = op13_filter_audit.audit(op13_filter_audit.counts(docs, marks)).collect()
    return {tuple(r[:3]): tuple(r[3:]) for r in got}, len(got)


def test_audit_equals_walking_every_order(spark):
    rows = [r for r in rows_of("documents", "doc_id", "text", "source") if r[2] in ("src0", "src1", "src2")]
    labels = {i: (q, t) for i, q, t in rows_of("labels", "doc_id", "quality", "toxic")}
    long_ok = " ".join(f"w{k}" for k in range(250))
    rows += [(10**6, None, None), (10**6 + 1, "", ""), (10**6 + 2, None, "src0"), (10**6 + 3, long_ok, "src0"), (10**6 + 3, long_ok, "src1"),
             (None, long_ok, "src1"), (None, "only without id", "src1"), (None, "only without id", "src1"), (10**6 + 4, "W " * 30_000, "n")]
    labels |= {10**6 + 3: (1, 1), 10**6: (1, 0)}
    got, n = audited(spark, rows, labels)
    want = walk(rows, labels)
    assert n == len(want) == 600 * 5 and got == want


def test_potential_is_the_mean_over_orders():
    """The recursion on a game of random coalition values gives the mean marginal over all orders."""
    rng = np.random.default_rng(3)
    v = np.concatenate(([0], rng.integers(0, 1000, 31)))
    q = [0] * 32
    for s in sorted(range(1, 32), key=int.bit_count):
        q[s] = math.factorial(s.bit_count() - 1) * int(v[s]) + sum(q[s ^ 1 << i] for i in range(5) if s >> i & 1)
    sums = [0] * 5
    for step in op13_filter_audit.order_steps():
        sums[step["i"]] += int(v[step["after"]] - v[step["before"]])
    assert sums == [q[31] - 5 * q[31 ^ 1 << i] for i in range(5)]


def test_audit_edge_cases(spark):
    assert audited(spark, [(1, "a", "s")], {})[0] == walk([(1, "a", "s")], {})
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    marks = spark.createDataFrame([(None, 1, 1), (1, None, None), (1, 1, None)], "doc_id long, quality int, toxic int")
    assert op13_filter_audit.audit(op13_filter_audit.counts(docs, marks)).count() == 0
    one = spark.createDataFrame([(1, "a", "s"), (None, "b", "s")], "doc_id long, text string, source string")
    got = op13_filter_audit.audit(op13_filter_audit.counts(one, marks)).where("filter_order = 'ABCDE' and step = 1").collect()
    assert [(r["removed"], r["good_lost"], r["toxic_lost"]) for r in got] == [(2, 1, 0)]
