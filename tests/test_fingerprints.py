"""Shared window fingerprints, packed on the way to their sums."""

import collections

import numpy as np
import pytest

from tidepool.functions import cdc
from tidepool.operators import bytesjobs

WINDOW = 8


def brute(texts):
    docs, occ = collections.defaultdict(set), collections.Counter()
    for i, t in enumerate(texts):
        for fp in cdc.window_fingerprints(np.frombuffer(t or b"", np.uint8), WINDOW).tolist():
            docs[fp].add(i)
            occ[fp] += 1
    return {fp: (len(d), occ[fp]) for fp, d in docs.items() if len(d) > 1}


@pytest.mark.parametrize("held, stretch", [(1 << 22, 1 << 20), (50, 30), (1, 1)])
def test_shared_passages_equal_brute_force(spark, monkeypatch, held, stretch):
    monkeypatch.setattr(bytesjobs, "HELD", held)
    monkeypatch.setattr(bytesjobs, "STRETCH", stretch)
    rng = np.random.default_rng(4)
    common = rng.integers(97, 123, 60, dtype=np.uint8).tobytes()
    texts = [None, b"", b"short", common[:8], b"z" * 300, b"z" * 9, common]
    texts += [rng.integers(97, 123, k, dtype=np.uint8).tobytes() + common[a : a + 25] for k, a in [(0, 3), (7, 9), (8, 0), (200, 30), (41, 35)]]
    texts += [common, bytes(range(256)) * 3, bytes(range(256))]
    df = spark.createDataFrame([(t,) for t in texts], "content binary").repartition(3)
    got = {r["fp"]: (r["n_docs"], r["n_occurrences"]) for r in bytesjobs.shared_passages(df, "content", WINDOW).collect()}
    assert got == brute(texts)


def test_packing_round_trip():
    rng = np.random.default_rng(6)
    for n, top in ((1, 1 << 30), (5000, 1 << 30), (5000, 1 << 16), (3, 4)):
        fp = np.unique(rng.integers(0, top, n))
        docs = rng.integers(1, 3, len(fp)) * rng.integers(1, 1 << 40, len(fp)) // (1 << 39) + 1
        occ = docs + rng.integers(0, 2, len(fp))
        back = [(r, *bytesjobs._unpacked(p)) for r, p in bytesjobs._packed(fp, docs, occ)]
        assert np.array_equal(np.concatenate([(r << bytesjobs.RANGE_BITS) + low for r, low, _, _ in back]), fp)
        assert np.array_equal(np.concatenate([d for _, _, d, _ in back]), docs) and np.array_equal(np.concatenate([o for *_, o in back]), occ)


def test_few_repeats_take_about_two_bytes_a_window():
    fp = np.unique(np.random.default_rng(7).integers(0, cdc.MOD, bytesjobs.HELD))
    one = np.ones(len(fp), np.int64)
    assert sum(len(p) for _, p in bytesjobs._packed(fp, one, one)) < 2.1 * len(fp)
