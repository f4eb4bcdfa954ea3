"""Chunking kernel: golden values of the published benchmarks and the
unit tests, and equality with the cut rule's definition."""

import hashlib
import itertools

import numpy as np
import pytest

from tidepool.functions import cdc

SMALL = dict(min_size=64, avg_size=512, max_size=4096, mask_bits=9)


def sizes(buf, **kw):
    ends = cdc.cut_ends(np.frombuffer(buf, dtype=np.uint8) if isinstance(buf, bytes) else buf, **kw)
    return list(np.diff([0] + ends))


def cuts_by_definition(data, min_size=cdc.DEFAULT_MIN, avg_size=cdc.DEFAULT_AVG, max_size=cdc.DEFAULT_MAX,
                       mask_bits=cdc.DEFAULT_MASK_BITS, switch=None):
    """Chunk ends by the definition: a chunk takes the first size that its hash allows, else the largest."""
    sw = cdc.switch_point(min_size, avg_size) if switch is None else switch
    sums = [0, *itertools.accumulate(b * pow(cdc.INV_BASE, j, cdc.MOD) for j, b in enumerate(data))]

    def allowed(start, size):
        bits = mask_bits - (size < sw)
        of_bytes = (sums[start + size] - sums[start]) * pow(cdc.BASE, start + size - 1, cdc.MOD) % cdc.MOD
        return (size >= min_size or size >= sw) and of_bytes % (1 << bits) == 0

    ends = [0]
    while ends[-1] < len(data):
        most = min(max_size, len(data) - ends[-1])
        ends.append(ends[-1] + next((k for k in range(1, most) if allowed(ends[-1], k)), most))
    return ends[1:]


def test_uniform_bytes_sum_and_golden():
    s = sizes(b"A" * 100000)
    assert sum(s) == 100000 and len(s) >= 1
    assert s == [49990, 49990, 20]


def test_empty_gives_no_chunks():
    assert sizes(b"") == []


def test_zero_bytes_cut_every_4096():
    assert sizes(bytes(10000)) == [4096, 4096, 1808]


@pytest.mark.parametrize("n", [1, 4095, 4096, 4097, 34815, 34816, 34817])
def test_edge_lengths_match_the_definition(n):
    rng = np.random.default_rng(n)
    buf = rng.integers(0, 256, n, dtype=np.uint8)
    assert cdc.cut_ends(buf) == cuts_by_definition(buf.tobytes())


@pytest.mark.parametrize("seed,params", [
    (1, {}), (2, SMALL), (3, dict(min_size=64, avg_size=512, max_size=4096, mask_bits=20)),
    (4, dict(min_size=16, avg_size=64, max_size=256, mask_bits=5)),
    (5, dict(min_size=100, avg_size=90, max_size=1000, mask_bits=7)),
])
def test_kernel_equals_the_definition(seed, params):
    rng = np.random.default_rng(seed)
    buf = rng.integers(0, 256, 150_000, dtype=np.uint8)
    assert cdc.cut_ends(buf, **params) == cuts_by_definition(buf.tobytes(), **params)


def test_max_size_cut_when_no_boundary():
    # 20 mask bits almost never hit: every chunk but the last is max-sized
    rng = np.random.default_rng(7)
    buf = rng.integers(0, 256, 50_000, dtype=np.uint8)
    s = sizes(buf, min_size=64, avg_size=512, max_size=4096, mask_bits=20)
    assert all(x == 4096 for x in s[:-1]) and sum(s) == 50_000


def test_invariants_on_documents_like_text():
    text = ("lorem ipsum dolor sit amet " * 5000).encode()
    s = sizes(text, **SMALL)
    assert sum(s) == len(text)
    assert all(64 <= x <= 4096 for x in s[:-1])


def _mib_text():
    sent = b"The quick brown fox jumps over the lazy dog. "
    return (sent * (2**20 // len(sent) + 1))[: 2**20]


def test_text_100mib_golden():
    buf = np.frombuffer(_mib_text() * 100, dtype=np.uint8)
    s = np.array(sizes(buf))
    assert len(s) == 3366 and s.min() == 1490 and s.max() == 394724
    assert abs(s.mean() / 1024 - 30.42) < 0.01


def test_zeros_10mib_all_4096():
    s = sizes(np.zeros(10 * 2**20, dtype=np.uint8))
    assert len(s) == 2560 and set(s) == {4096}


def test_sha256_golden():
    assert hashlib.sha256(b"Hello, World!").hexdigest() == (
        "dffd6021bb2bd5b0af676290809ec3a53191dd81c7f70a4b28688a362182986f")
    assert hashlib.sha256(b"").hexdigest() == (
        "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")
    h = hashlib.sha256(b"test data").hexdigest()
    assert len(h) == 64 and h == hashlib.sha256(b"test data").hexdigest()


def test_rolling_append_golden():
    of = lambda b: cdc.scan_cuts(np.frombuffer(b, np.uint8))[1]
    assert of(b"a") == 97 and of(b"ab") == 3105
    # appending goes on from the carried hash and length
    assert cdc.scan_cuts(np.frombuffer(b"b", np.uint8), h=97, open_len=1)[1:] == (3105, 2)


def test_window_fingerprints_equal_the_polynomial():
    rng = np.random.default_rng(11)
    buf = rng.integers(0, 256, 2000, dtype=np.uint8)
    w = 48
    expect = [
        sum(int(b) * cdc.BASE**k for k, b in enumerate(buf[i - w + 1 : i + 1][::-1])) % cdc.MOD for i in range(w - 1, len(buf))
    ]
    assert cdc.window_fingerprints(buf, w).tolist() == expect


def test_switch_parameter_variant():
    # the declared-but-unused boundary rule switches masks at 65536 instead of 34816
    rng = np.random.default_rng(21)
    buf = rng.integers(0, 256, 200_000, dtype=np.uint8)
    assert cdc.cut_ends(buf, switch=65536) == cuts_by_definition(buf.tobytes(), switch=65536)


def test_switch_point_below_the_minimum_cuts_short_files():
    params = dict(min_size=8, avg_size=1, max_size=79, mask_bits=1)
    for data in (b"\xd9\x10A\xa8\x9c", b"abcdefg", b"A" * 8):
        assert cdc.cut_ends(np.frombuffer(data, np.uint8), **params) == cuts_by_definition(data, **params)


def test_max_size_beyond_any_block():
    # no upper limit on max_size: hash state is carried from block to block
    buf = np.random.default_rng(9).integers(0, 256, 400_000, dtype=np.uint8)
    assert sizes(buf, min_size=64, avg_size=512, max_size=1 << 26, mask_bits=29) == [400_000]


from hypothesis import given, settings
from hypothesis import strategies as st


@settings(max_examples=80, deadline=None)
@given(
    data=st.binary(min_size=0, max_size=3000),
    min_size=st.integers(1, 300),
    span=st.integers(-250, 600),
    max_extra=st.integers(0, 3000),
    mask_bits=st.integers(1, 12),
    seg=st.integers(1, 2500),
)
def test_property_whole_and_segmented_equal_the_definition(data, min_size, span, max_extra, mask_bits, seg):
    params = dict(min_size=min_size, avg_size=min_size + span, max_size=min_size + max_extra + 1, mask_bits=mask_bits)
    buf = np.frombuffer(data, dtype=np.uint8)
    expect = cuts_by_definition(data, **params)
    assert cdc.cut_ends(buf, **params) == expect
    # the same file fed in segments: only the open chunk's hash and length are carried
    h = open_len = 0
    ends = []
    for i in range(0, len(buf), seg):
        got, h, open_len = cdc.scan_cuts(buf[i : i + seg], **params, h=h, open_len=open_len)
        ends += [i + e for e in got]
    assert ends + ([len(buf)] if open_len else []) == expect


@pytest.mark.parametrize("params", [
    dict(min_size=64, avg_size=512, max_size=4096, mask_bits=9),
    dict(min_size=64, avg_size=512, max_size=4096, mask_bits=9, switch=20),
    dict(min_size=1, avg_size=4, max_size=9, mask_bits=2),
    dict(min_size=16, avg_size=64, max_size=40, mask_bits=1),
    {},
])
def test_files_side_by_side_equal_files_alone(monkeypatch, params):
    """Files of all sizes in one buffer, over several runs and groups, with gaps for null rows."""
    monkeypatch.setattr(cdc, "GROUP", 50_000)
    monkeypatch.setattr(cdc, "RUN", 9_000)
    monkeypatch.setattr(cdc, "ROWS", 5)
    rng = np.random.default_rng(11)
    sizes = np.concatenate(([0, 1, 2, 63, 64, 65, 0, 4096, 4097, 9000, 9001, 20_000, 0], rng.integers(0, 3000, 60)))
    gaps = rng.integers(0, 2, len(sizes)) * 7
    ends = np.cumsum(sizes + gaps)
    starts = ends - sizes
    data = rng.integers(0, 256, ends[-1] + 3, dtype=np.uint8)
    data[starts[11] : starts[11] + 5000] = 0
    file, end = cdc.cut_many(data, starts, ends, **params)
    want = [(i, e) for i in range(len(sizes)) for e in cdc.cut_ends(data[starts[i] : ends[i]], **params)]
    assert list(zip(file.tolist(), end.tolist())) == want


def test_no_files_side_by_side():
    none = np.empty(0, np.int64)
    assert [len(x) for x in cdc.cut_many(np.empty(0, np.uint8), none, none, 64, 512, 4096, 9)] == [0, 0]
