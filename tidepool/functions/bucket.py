"""Token-bucket decisions for the ordered requests of one key, as array operations.

Let ``d`` be what is missing to a full bucket when a request arrives.  While
requests are admitted, ``d`` is a waiting-time recursion: it grows by the cost of
each and shrinks with time, never below 0,

    d_i = max(0, d_(i-1) + cost_(i-1) - gain_i),

so with ``x_i`` the running sum of ``cost_(i-1) - gain_i`` it is ``x_i`` less its
running minimum.  A request is admitted iff ``d_i + cost_i`` fits the bucket, and
a whole run is decided by one running sum up to the first request that doesn't;
that one costs nothing, and the next run starts from its ``d``.

Amounts are exact integers in micro-tokens (bytes x 1,000,000).
"""

from __future__ import annotations

import numpy as np

MICRO = 1_000_000


def decide(ts_us: np.ndarray, nbytes: np.ndarray, rate: int, burst: int, missing: int, last_us: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(admitted, missing after each request, missing, last_us) of requests in time order.

    ``missing`` and ``last_us`` are the bucket's state before the first request: what
    it lacked to full, and when.  A request dated before ``last_us`` gains nothing and
    doesn't turn the clock back.
    """
    n, cap = len(ts_us), burst * MICRO
    clock = np.maximum.accumulate(np.concatenate(([last_us], ts_us)))
    # after burst / rate seconds any bucket is full: longer gaps count as that, so products stay small
    gain = np.minimum(np.diff(clock), -(-cap // rate)) * rate
    # more than the bucket holds is refused whatever the exact size
    cost = np.minimum(nbytes, burst + 1) * MICRO
    admitted, after = np.zeros(n, bool), np.empty(n, np.int64)
    at, run = 0, 32
    while at < n:
        end = min(n, at + run)
        step = -gain[at:end]
        step[0] += missing
        step[1:] += cost[at : end - 1]
        x = np.cumsum(step)
        d = x - np.minimum(np.minimum.accumulate(x), 0)
        refused = d + cost[at:end] > cap
        k = int(refused.argmax()) if refused.any() else end - at
        admitted[at : at + k] = True
        after[at : at + k] = d[:k] + cost[at : at + k]
        if k < end - at:
            after[at + k] = missing = int(d[k])
            at, run = at + k + 1, max(8, run // 2)
        else:
            missing = int(after[end - 1])
            at, run = end, run * 2
    return admitted, after, missing, int(clock[-1])
