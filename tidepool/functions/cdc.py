"""Content-defined chunking kernel (numpy), used inside Spark Arrow tasks.

The cut rule: a polynomial hash of the bytes since the last cut,
``h = (31 * h + byte) mod 1000000009`` restarted at 0 after every cut.
A cut happens after byte ``i`` when the open chunk has ``c`` bytes and

* ``min_size <= c < switch`` and ``h & small_mask == 0`` (small mask has
  ``mask_bits - 1`` low bits), or
* ``c >= switch`` and ``h & big_mask == 0`` (``mask_bits`` low bits), or
* ``c == max_size``, or ``i`` is the last byte.

Because the hash is a prefix hash (it never drops bytes), it has a closed form
over a block of positions that starts at ``t``: with ``G_k`` the running sum of
``b_(t+j) * 31^-j`` and ``H`` the hash of the open chunk's bytes before ``t``,
``h_(t+k) = 31^k * (G_k + 31 * H)``; a chunk that starts inside the block
subtracts the running sum up to its start instead.  That turns the byte loop
into vector operations on blocks that stay in the cache; only the hash and
the length of the open chunk go from block to block, and from segment to
segment of a file.
"""

from __future__ import annotations

import numpy as np

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical cut points)
#   hash modulus 1000000009, hash base 31
#   min chunk 4096 bytes, average chunk 65536 bytes, max chunk 1048576 bytes
#   mask bits 16; switch point = min + (avg - min) / 2 = 34816
# ---------------------------------------------------------------------------
MOD = 1000000009
BASE = 31
DEFAULT_MIN = 4096
DEFAULT_AVG = 65536
DEFAULT_MAX = 1048576
DEFAULT_MASK_BITS = 16

INV_BASE = pow(BASE, MOD - 2, MOD)  # 838709685
_MOD64 = np.uint64(MOD)
# a scan for the next cut starts small (a cut right after min_size is common, e.g. zero runs)
FIRST_STEP, MAX_STEP = 512, 1 << 13
BLOCK = 1 << 16  # positions that are looked at together; their arrays fit the cache


class _PowerCache:
    """Per-process cache of 31^k and 31^-k mod p and of masks; pickles as empty, so task
    closures never carry a cache grown in the driver."""

    def __init__(self):
        self.pow = np.ones(1, dtype=np.uint64)
        self.inv = np.ones(1, dtype=np.uint64)
        self.masks: dict[tuple[int, int], np.ndarray] = {}

    def __reduce__(self):
        return (_PowerCache, ())


_CACHE = _PowerCache()


def _grow(table: np.ndarray, base: int, n: int) -> np.ndarray:
    """Extend a table of base^k mod p to at least ``n`` entries by doubling."""
    if len(table) >= n:
        return table
    size = len(table)
    while size < n:
        size *= 2
    out = np.empty(size, dtype=np.uint64)
    out[: len(table)] = table
    k = len(table)
    while k < size:
        step = min(k, size - k)
        out[k : k + step] = out[:step] * np.uint64(pow(base, k, MOD)) % _MOD64
        k += step
    return out


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Return (31^k mod p, 31^-k mod p) for k < n (cached per process)."""
    _CACHE.pow = _grow(_CACHE.pow, BASE, n)
    _CACHE.inv = _grow(_CACHE.inv, INV_BASE, n)
    return _CACHE.pow, _CACHE.inv


def _masks(switch: int, mask_bits: int) -> np.ndarray:
    """Mask of each chunk size, from 1 up to the switch point and one scan beyond."""
    key = (switch, mask_bits)
    if key not in _CACHE.masks:
        masks = np.full(switch + MAX_STEP, np.uint64((1 << mask_bits) - 1))
        masks[: switch - 1] >>= np.uint64(1)
        _CACHE.masks[key] = masks
    return _CACHE.masks[key]


def switch_point(min_size: int, avg_size: int) -> int:
    return min_size + (avg_size - min_size) // 2


def reduce_mod(x: np.ndarray, q: np.ndarray) -> None:
    """``x %= MOD`` in place (uint64); numpy divides by a scalar much faster than it takes remainders."""
    np.floor_divide(x, _MOD64, out=q)
    np.multiply(q, _MOD64, out=q)
    np.subtract(x, q, out=x)


def scan_cuts(
    buf: np.ndarray,
    min_size: int = DEFAULT_MIN,
    avg_size: int = DEFAULT_AVG,
    max_size: int = DEFAULT_MAX,
    mask_bits: int = DEFAULT_MASK_BITS,
    switch: int | None = None,
    h: int = 0,
    open_len: int = 0,
) -> tuple[list[int], int, int]:
    """(ends, h, open_len): exclusive ends of the chunks that close inside ``buf``.

    ``h`` and ``open_len`` are the hash and the length of the chunk that is open
    before ``buf``, and in the result of the one that is open after it.
    """
    if switch is None:
        switch = switch_point(min_size, avg_size)
    # smallest chunk a hash can cut: min_size, or the switch point if it is lower
    least = max(1, min(min_size, switch))
    big = np.uint64((1 << mask_bits) - 1)
    masks = _masks(switch, mask_bits)
    pw, inv = power_tables(BLOCK)
    n, s = len(buf), -open_len
    # written in place throughout: fresh arrays would cost more than the arithmetic
    sums, scratch, quotient = np.empty((3, min(n, BLOCK)), np.uint64)
    ends: list[int] = []
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        # b * 31^-j < 2^38: 2^16 terms and the carried hash stay far below 2^64
        g, v = sums[: hi - lo], scratch[: hi - lo]
        np.multiply(buf[lo:hi], inv[: hi - lo], out=v)
        np.cumsum(v, out=g)
        add = BASE * h % MOD
        while s < hi:
            hard = s + max_size
            stop, a, step, cut = min(hi, hard), max(lo, s + least - 1), FIRST_STEP, None
            shift = np.uint64(add)
            while a < stop:
                e = min(a + step, stop)
                v, q = scratch[: e - a], quotient[: e - a]
                np.add(g[a - lo : e - lo], shift, out=v)
                reduce_mod(v, q)
                np.multiply(v, pw[a - lo : e - lo], out=v)
                reduce_mod(v, q)
                np.bitwise_and(v, masks[a - s : e - s] if a - s < switch else big, out=v)
                j = int(v.argmin())  # the first zero, if any
                if v[j] == 0:
                    cut = a + j
                    break
                a, step = e, min(step * 4, MAX_STEP)
            if cut is None:
                if hard > hi:
                    break  # open beyond this block
                cut = hard - 1
            ends.append(cut + 1)
            s = cut + 1
            add = MOD - int(g[cut - lo]) % MOD
        h = (int(g[-1]) + add) % MOD * int(pw[hi - lo - 1]) % MOD if s < hi else 0
    return ends, h, n - s


def cut_ends(buf: np.ndarray, min_size: int = DEFAULT_MIN, avg_size: int = DEFAULT_AVG, max_size: int = DEFAULT_MAX,
             mask_bits: int = DEFAULT_MASK_BITS, switch: int | None = None) -> list[int]:
    """Exclusive end offsets of the chunks of a whole file (uint8 array)."""
    n = len(buf)
    least = min(min_size, switch_point(min_size, avg_size) if switch is None else switch)
    if n <= min(least, max_size):  # no byte but the last can end a chunk
        return [n] if n else []
    ends, _, open_len = scan_cuts(buf, min_size, avg_size, max_size, mask_bits, switch)
    return ends + [n] if open_len else ends


GROUP = 1 << 23  # bytes of files that are looked at together
RUN = 1 << 20  # bytes that share a running sum and the power tables
ROWS = 512  # files whose open chunks are scanned side by side; their arrays stay in the cache
SIDE_BY_SIDE = 4096  # expected chunk size up to which that pays; beyond, a scan is long enough by itself


def cut_many(
    data: np.ndarray,
    starts: np.ndarray,
    ends: np.ndarray,
    min_size: int = DEFAULT_MIN,
    avg_size: int = DEFAULT_AVG,
    max_size: int = DEFAULT_MAX,
    mask_bits: int = DEFAULT_MASK_BITS,
    switch: int | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """(file, end) of all chunks of the files ``data[starts[i]:ends[i]]``, by file and position; ``end``
    counts from the file's first byte.

    Files lie one behind the other in ``data``, as in an Arrow buffer.  Where chunks are small, the
    open chunks of many files are scanned side by side, a span of each a round: array operations
    on a span of one file would cost more in calls than in arithmetic.
    """
    params = dict(min_size=min_size, avg_size=avg_size, max_size=max_size, mask_bits=mask_bits, switch=switch)
    alone = (ends - starts > RUN) | (min(max_size, min_size + (1 << max(0, mask_bits - 1))) > SIDE_BY_SIDE)
    files, cuts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    at, n = 0, len(starts)
    while at < n:
        if alone[at]:
            e = np.array(cut_ends(data[starts[at] : ends[at]], **params), np.int64)
            f, until = np.zeros(len(e), np.int64), at + 1
        else:
            until = max(at + 1, int(np.searchsorted(ends, starts[at] + GROUP, side="right")))
            until = at + int(alone[at:until].argmax()) if alone[at:until].any() else until
            lo = starts[at]
            f, e = _cut_group(data[lo : ends[until - 1]], (starts[at:until] - lo).astype(np.int64), (ends[at:until] - lo).astype(np.int64), **params)
        files.append(f + at)
        cuts.append(e)
        at = until
    return np.concatenate(files), np.concatenate(cuts)


def _running_sums(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums, shift, base): running sums mod p of runs of whole files, each run behind a 0 of its own.

    A file's byte ``i`` has its sum at ``i + shift + 1``; powers count from ``base``, its run's first byte.
    """
    runs = [0]
    while ends[-1] - starts[runs[-1]] > RUN:
        runs.append(max(runs[-1] + 1, int(np.searchsorted(ends, starts[runs[-1]] + RUN, side="right"))))
    sums = np.zeros(len(buf) + len(runs) + pad, np.uint32)
    shift, base = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
    _, inv = power_tables(RUN + pad)
    products, quotient = np.empty((2, min(len(buf), RUN)), np.uint64)
    for r, (a, b) in enumerate(zip(runs, [*runs[1:], len(starts)])):
        lo, hi = int(starts[a]), int(ends[b - 1])
        v, q = products[: hi - lo], quotient[: hi - lo]
        # b * 31^-j < 2^38: 2^20 terms stay below 2^58; reduced here once, so that a position costs one remainder
        np.multiply(buf[lo:hi], inv[: hi - lo], out=v)
        np.cumsum(v, out=v)
        reduce_mod(v, q)
        sums[lo + r + 1 : hi + r + 1] = v
        shift[a:b], base[a:b] = r, lo
    return sums, shift, base


def _cut_group(buf, starts, ends, min_size, avg_size, max_size, mask_bits, switch) -> tuple[np.ndarray, np.ndarray]:
    """``cut_many`` of up to about ``GROUP`` bytes, no file beyond ``RUN``."""
    if switch is None:
        switch = switch_point(min_size, avg_size)
    least = max(1, min(min_size, switch))
    span = int(min(max(16, 3 << max(0, mask_bits - 3)), max_size))  # 3/4 of the way to the cut that is expected
    big = np.uint64((1 << mask_bits) - 1)
    small = big >> np.uint64(1)
    sums, shifts, bases = _running_sums(buf, starts, ends, span)
    rows_of_sums = np.lib.stride_tricks.sliding_window_view(sums[1:], span)
    powers = np.lib.stride_tricks.sliding_window_view(power_tables(RUN + span)[0][: RUN + span], span)

    out_file, out_end = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    by_size = np.argsort(starts - ends, kind="stable")  # files of like size need as many rounds
    by_size = by_size[(ends > starts)[by_size]]
    for k in range(0, len(by_size), ROWS):
        file = by_size[k : k + ROWS]
        first, end, shift, base = starts[file], ends[file], shifts[file], bases[file]
        s = first
        a = s + least - 1
        while len(file):
            stop = np.minimum(end, s + max_size)  # a cut at the latest after the byte before
            v = rows_of_sums[np.minimum(a, end) + shift].astype(np.uint64)
            v += (_MOD64 - sums[s + shift])[:, None]
            v *= powers[np.minimum(a, end) - base]
            q = v // _MOD64
            q *= _MOD64
            v -= q
            np.bitwise_and(v, small, out=q)
            hits = np.flatnonzero(q == 0)  # a byte that ends a large chunk passes the small mask, too
            row, j = np.divmod(hits, span)
            pos = a[row] + j
            good = (pos < stop[row]) & ((pos - s[row] + 1 < switch) | (v.ravel()[hits] & big == 0))
            row, pos = row[good], pos[good]
            a = a + span
            cut = np.where(a >= stop, stop - 1, -1)
            firsts = np.flatnonzero(np.diff(row, prepend=-1))
            cut[row[firsts]] = pos[firsts]
            closed = np.flatnonzero(cut >= 0)
            if len(closed):
                out_file.append(file[closed])
                out_end.append(cut[closed] + 1 - first[closed])
                s = s.copy()
                s[closed] = cut[closed] + 1
                a[closed] = s[closed] + least - 1
                left = s < end
                if not left.all():
                    file, s, end, first, a, shift, base = (x[left] for x in (file, s, end, first, a, shift, base))
    f, e = np.concatenate(out_file), np.concatenate(out_end)
    order = np.argsort(f, kind="stable")  # a file's chunks were found in order
    return f[order], e[order]


def window_fingerprints(buf: np.ndarray, window: int) -> np.ndarray:
    """Hash of the last ``window`` bytes at each position ``i >= window - 1``.

    Equals sliding ``h = (h - out * 31^(w-1)) * 31 + in`` from a hash built by
    appending the first ``window`` bytes; uint64, ``max(0, n - window + 1)`` long.
    Blocks overlap by ``window - 1`` bytes, so memory stays bounded for any row.
    """
    n = len(buf)
    out = np.empty(max(0, n - window + 1), dtype=np.uint64)
    block = max(BLOCK, 2 * window)
    pw, inv = power_tables(block)
    sums, quotient = np.empty((2, min(n, block)), np.uint64)
    for t in range(0, len(out), block - window + 1):
        end = min(n, t + block)
        g, v = sums[: end - t], quotient[: end - t]
        np.multiply(buf[t:end], inv[: end - t], out=v)
        np.cumsum(v, out=g)
        fp = out[t : end - window + 1]
        fp[:] = g[window - 1 :]
        fp[1:] -= g[: end - t - window]
        q = quotient[: len(fp)]
        reduce_mod(fp, q)
        np.multiply(fp, pw[window - 1 : end - t], out=fp)
        reduce_mod(fp, q)
    return out
