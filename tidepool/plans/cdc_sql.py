"""The chunking rule written as DuckDB SQL, for the oracle side only.

Bytes are unnested from ``hex(content)``; ``w_i = b_i * 31^-i mod p`` and
its running sum ``G`` come from a window; powers of 31 are products of
``31^(2^k)`` constants picked by the bits of ``i``.  A recursive CTE then
takes one step per chunk: from start ``s`` it scans the candidate
positions with ``h_i = 31^i * (G_i - G_(s-1)) mod p`` and cuts at the
first hit (or at max size / the last byte).
"""

from __future__ import annotations

from tidepool.functions.cdc import BASE, DEFAULT_AVG, DEFAULT_MASK_BITS, DEFAULT_MAX, DEFAULT_MIN, INV_BASE, MOD, switch_point

POW_BITS = 24  # positions below 2^24 (16 MiB per file)


def _pow_expr(col: str, base: int) -> str:
    """SQL for ``base^col mod p`` as a product over the bits of ``col``."""
    expr = "CAST(1 AS BIGINT)"
    for k in range(POW_BITS):
        c = pow(base, 1 << k, MOD)
        expr = f"(({expr}) * (CASE WHEN ({col} >> {k}) & 1 = 1 THEN {c} ELSE 1 END) % {MOD})"
    return expr


def cdc_cte(files: str, keys: list[str], min_size: int = DEFAULT_MIN, avg_size: int = DEFAULT_AVG,
            max_size: int = DEFAULT_MAX, mask_bits: int = DEFAULT_MASK_BITS, prefix: str = "c", switch: int | None = None) -> str:
    """CTE text defining ``{prefix}_chunks(keys..., chunk_index, offset, size, hash)``
    from a CTE ``files(keys..., content BLOB)``.  Must sit inside WITH RECURSIVE."""
    sw = switch_point(min_size, avg_size) if switch is None else switch
    min_size = min(min_size, sw)
    big = (1 << mask_bits) - 1
    small = big >> 1
    k = ", ".join(keys)
    kq = ", ".join(f"q.{c}" for c in keys)
    on = " AND ".join(f"q.{c} = d.{c}" for c in keys)
    def end_of(s: str) -> str:
        gs = f"(CASE WHEN {s} = 0 THEN 0 ELSE g[{s}] END)"
        scan = (
            f"list_position(list_transform(range({s} + {min_size - 1}, least({s} + {max_size}, n)), "
            f"lambda i: ((pw[i + 1] * ((g[i + 1] - {gs}) % {MOD})) % {MOD}) "
            f"& (CASE WHEN i - {s} + 1 < {sw} THEN {small} ELSE {big} END) = 0), true)"
        )
        return (
            f"(CASE WHEN n - {s} <= {min_size} THEN n "
            f"ELSE coalesce({s} + {min_size - 1} + {scan}, least({s} + {max_size}, n)) END)"
        )

    p = prefix
    return f"""
{p}_len AS MATERIALIZED (
  SELECT {k}, content, CAST(octet_length(content) AS BIGINT) AS n, hex(content) AS hx FROM {files}
),
{p}_bytes AS (
  SELECT {k}, i, CAST('0x' || h AS BIGINT) AS b
  FROM (SELECT {k}, unnest(range(n)) AS i, unnest(regexp_extract_all(hx, '..')) AS h
        FROM {p}_len WHERE n > {min_size})
),
{p}_plo AS MATERIALIZED (
  SELECT j, {_pow_expr('j', BASE)} AS p, {_pow_expr('j', INV_BASE)} AS v FROM range(4096) AS t(j)
),
{p}_phi AS MATERIALIZED (
  SELECT m, {_pow_expr('m * 4096', BASE)} AS p, {_pow_expr('m * 4096', INV_BASE)} AS v
  FROM range({1 << (POW_BITS - 12)}) AS t(m)
),
{p}_w AS (
  SELECT {k}, i,
         CAST(sum(b * (lo.v * hi.v % {MOD}) % {MOD}) OVER (PARTITION BY {k} ORDER BY i
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS gi,
         lo.p * hi.p % {MOD} AS pi
  FROM {p}_bytes
  JOIN {p}_plo lo ON lo.j = (i & 4095)
  JOIN {p}_phi hi ON hi.m = (i >> 12)
),
{p}_doc AS MATERIALIZED (
  SELECT l.{k.replace(', ', ', l.')}, l.n, list(w.gi ORDER BY w.i) AS g, list(w.pi ORDER BY w.i) AS pw
  FROM {p}_len l JOIN {p}_w w USING ({k})
  GROUP BY ALL
),
{p}_steps({k}, chunk_index, s, e) AS (
  SELECT {k}, 0, CAST(0 AS BIGINT), {end_of('CAST(0 AS BIGINT)')} FROM {p}_doc
  UNION ALL
  SELECT {kq}, q.chunk_index + 1, q.e, {end_of('q.e')}
  FROM {p}_steps q JOIN {p}_doc d ON {on}
  WHERE q.e < d.n
),
{p}_cuts AS (
  SELECT {k}, chunk_index, s, e FROM {p}_steps
  UNION ALL
  SELECT {k}, 0, 0, n FROM {p}_len WHERE n > 0 AND n <= {min_size}
),
{p}_chunks AS (
  SELECT {kq}, CAST(q.chunk_index AS INTEGER) AS chunk_index, CAST(q.s AS BIGINT) AS "offset",
         CAST(q.e - q.s AS INTEGER) AS size,
         sha256(array_slice(l.content, q.s + 1, q.e)) AS hash
  FROM {p}_cuts q JOIN {p}_len l ON {on.replace('d.', 'l.')}
)"""
