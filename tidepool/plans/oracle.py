"""DuckDB oracle SQL for every registered query (same names as the catalog).

Views of the driver tables are repeated here as CTEs with the same
definitions as ``tidepool.sources.tables``.  ``scan_files`` has no SQL form
(it reads the table's folder as binary files).
"""

from __future__ import annotations

from tidepool.plans import params as P
from tidepool.plans.cdc_sql import cdc_cte

FILE_COLS = "client_id, path, size, modified_time, hash, version, is_directory, deleted, last_sync_time"
DOC_PATH = "source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt'"
SMALL = P.SMALL
MICRO = 1000000
CAP = P.TOKEN_BURST * MICRO
RATE = P.TOKEN_RATE

SRC_FILES = f"""src_files AS (
  SELECT doc_id, source AS client_id, {DOC_PATH} AS path,
         CAST(octet_length(encode(text)) AS BIGINT) AS size, doc_id AS modified_time,
         sha256(encode(text)) AS hash, 1 AS version, false AS is_directory, false AS deleted,
         CAST(0 AS BIGINT) AS last_sync_time, encode(text) AS content
  FROM documents)"""

SERVER_FILES = f"""server_all AS (
  SELECT source AS client_id, {DOC_PATH} AS path, CAST(octet_length(encode(t)) AS BIGINT) AS size,
         CAST(doc_id + (doc_id // 7 % 5 - 2) * 10 AS BIGINT) AS modified_time, sha256(encode(t)) AS hash, 1 AS version,
         false AS is_directory, (doc_id % 11 = 0) AS deleted, CAST(0 AS BIGINT) AS last_sync_time, doc_id
  FROM (SELECT *, CASE WHEN doc_id % 7 = 0 THEN text || ' edited' ELSE text END AS t FROM documents)),
server_files AS (SELECT * EXCLUDE (doc_id) FROM server_all WHERE doc_id % 10 <> 0)"""

LOCAL_FILES = f"""local_list AS (
  SELECT source AS client_id, {DOC_PATH} AS path, CAST(octet_length(encode(t)) AS BIGINT) AS size,
         doc_id AS modified_time, sha256(encode(t)) AS hash, CAST(doc_id % 4 AS INTEGER) AS version,
         false AS is_directory, false AS deleted, CAST(0 AS BIGINT) AS last_sync_time, list_pos
  FROM (SELECT *, text AS t, doc_id * 2 AS list_pos FROM documents WHERE doc_id % 3 <> 0
        UNION ALL
        SELECT *, text || ' later', doc_id * 2 + 1 FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 15 = 1)),
local_files AS (SELECT * FROM local_list QUALIFY row_number() OVER (PARTITION BY client_id, path ORDER BY list_pos) = 1),
local_last AS (SELECT * FROM local_list QUALIFY row_number() OVER (PARTITION BY client_id, path ORDER BY list_pos DESC) = 1)"""

VERSIONS = f"""old_files AS (SELECT {DOC_PATH} AS path, encode(text) AS content FROM documents),
new_files AS (
  SELECT {DOC_PATH} AS path,
         encode(CASE WHEN doc_id % 7 = 0 THEN text || ' edited'
                     WHEN doc_id % 7 = 3 THEN substring(text, 1, CAST(length(text) // 2 AS BIGINT))
                     WHEN doc_id % 31 = 5 THEN '' ELSE text END) AS content
  FROM documents)"""

MANIFEST = """manifest AS (
  SELECT client_id, file_path, chunk_index, hash, "offset", size FROM (
    SELECT 'c0' AS client_id, CAST(l_orderkey AS VARCHAR) AS file_path,
           CAST(l_linenumber AS INTEGER) AS chunk_index, sha256(CAST(l_partkey AS VARCHAR)) AS hash,
           CAST(0 AS BIGINT) AS "offset", CAST(1 + l_partkey % 1000 AS INTEGER) AS size,
           row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                              ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS rn
    FROM lineitem) WHERE rn = 1)"""

CONV = """conv AS (
  SELECT 'c0' AS client_id, CAST(conv_id AS VARCHAR) AS file_path, CAST(turn AS INTEGER) AS chunk_index,
         conv_id, role, text, encode(text) AS data, CAST(octet_length(encode(text)) AS INTEGER) AS size,
         sha256(encode(CASE WHEN conv_id % 13 = 5 AND turn = 1 THEN text || '!' ELSE text END)) AS hash
  FROM conversations),
announced AS (
  SELECT client_id, file_path,
         CAST(max(chunk_index) + 1 + CASE WHEN any_value(conv_id) % 9 = 4 THEN 1 ELSE 0 END AS INTEGER) AS total_chunks
  FROM conv GROUP BY client_id, file_path)"""

CONV_STORE = """conv_store AS (
  SELECT substring(hash, 1, 2) AS hash_prefix, hash, size, data, text FROM (
    SELECT hash, size, data, text, row_number() OVER (PARTITION BY hash ORDER BY conv_id, chunk_index) AS rn FROM conv)
  WHERE rn = 1),
kept_store AS (
  SELECT hash, size, data, text FROM (
    SELECT hash, size, data, text, row_number() OVER (PARTITION BY hash ORDER BY conv_id, chunk_index) AS rn FROM conv
    WHERE conv_id % 17 <> 3 OR chunk_index <> 0)
  WHERE rn = 1)"""

PROBE = """probe AS (
  SELECT sha256(CAST(p_partkey AS VARCHAR)) AS hash FROM part
  UNION SELECT hash FROM conv)"""

METRICS = """m AS (
  SELECT event_type AS name, ts, event_id, CAST(round(value * 100) AS BIGINT) AS value FROM events)"""

TRANSFER = """tl AS (
  SELECT CAST(user_id AS VARCHAR) AS key, event_id, epoch_us(ts) AS ts_us, event_type,
         CAST(round(value * 1000) AS BIGINT) AS bytes,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events)"""

CHANGES = """cl AS (
  SELECT 'c0' AS client_id,
         CASE WHEN event_type = 'purchase' THEN base || '.r' ELSE base END AS path,
         CASE WHEN event_type = 'signup' THEN 'CREATED' WHEN event_type IN ('view', 'click') THEN 'MODIFIED'
              WHEN event_type = 'purchase' THEN 'RENAMED' WHEN event_type = 'error' THEN 'DELETED' END AS type,
         CASE WHEN event_type = 'purchase' THEN base END AS old_path,
         CAST(round(value * 1000) AS BIGINT) AS size, epoch_us(ts) // 1000000 AS modified_time,
         sha256(CAST(event_id AS VARCHAR)) AS hash, event_id AS seq
  FROM (SELECT *, 'u' || CAST(user_id AS VARCHAR) || '/k' || json_extract_string(props, '$.k') AS base FROM events)),
touches AS (
  SELECT client_id, path, seq, true AS is_up, size, modified_time, hash FROM cl
  WHERE type IN ('CREATED', 'MODIFIED', 'RENAMED')
  UNION ALL
  SELECT client_id, path, seq, false, NULL, NULL, NULL FROM cl WHERE type = 'DELETED'
  UNION ALL
  SELECT client_id, old_path, seq, false, NULL, NULL, NULL FROM cl WHERE type = 'RENAMED' AND old_path IS NOT NULL),
st AS (
  SELECT client_id, path,
         max(seq) FILTER (WHERE is_up) AS up_seq, max(seq) FILTER (WHERE NOT is_up) AS del_seq,
         arg_max(size, seq) FILTER (WHERE is_up) AS size,
         arg_max(modified_time, seq) FILTER (WHERE is_up) AS modified_time,
         arg_max(hash, seq) FILTER (WHERE is_up) AS hash
  FROM touches GROUP BY client_id, path)"""


def _with(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"


def _fname(p: str) -> str:
    return f"regexp_extract({p}, '([^/]*)$', 1)"


def _split(p: str) -> str:
    f = _fname(p)
    return f"(regexp_matches({f}, '^(.+)[.]([^.]*)$') AND {f} NOT IN ('.', '..'))"


def _stem(p: str) -> str:
    f = _fname(p)
    return f"(CASE WHEN {_split(p)} THEN regexp_extract({f}, '^(.+)[.]([^.]*)$', 1) ELSE {f} END)"


def _ext(p: str) -> str:
    f = _fname(p)
    return f"(CASE WHEN {_split(p)} THEN regexp_extract({f}, '^(.+)[.]([^.]*)$', 2) ELSE '' END)"


def _conflict_name(p: str, client: str, at_seconds: int) -> str:
    ts = f"strftime(make_timestamp(CAST({at_seconds} AS BIGINT) * {MICRO}), '%Y-%m-%d %H-%M-%S')"
    name = (f"({_stem(p)} || ' (conflicted copy ' || {client} || ' ' || {ts} || ')' || "
            f"CASE WHEN {_ext(p)} <> '' THEN '.' || {_ext(p)} ELSE '' END)")
    return f"(CASE WHEN contains({p}, '/') THEN regexp_extract({p}, '^(.*)/[^/]*$', 1) || '/' || {name} ELSE {name} END)"


def _doc_cdc(small: bool, **more) -> str:
    kw = (SMALL if small else {}) | more
    src = f"src AS (SELECT source AS client_id, {DOC_PATH} AS path, encode(text) AS content FROM documents)"
    return _with(src, cdc_cte("src", ["client_id", "path"], **kw).strip(), recursive=True)


def _ver_cdc() -> str:
    return _with(VERSIONS, cdc_cte("old_files", ["path"], prefix="o", **SMALL).strip(),
                 cdc_cte("new_files", ["path"], prefix="n", **SMALL).strip(), recursive=True)


CONFLICTS = """conflicts AS (
  SELECT l.client_id, l.path, l.hash AS local_hash, l.modified_time AS local_modified_time,
         l.version AS local_version, s.hash AS remote_hash, s.modified_time AS remote_modified_time,
         s.version AS remote_version
  FROM local_files l JOIN server_files s ON l.client_id = s.client_id AND l.path = s.path
  WHERE l.hash <> s.hash AND l.version > 0 AND s.version > 0)"""

STRATEGY = ("CASE WHEN local_modified_time > remote_modified_time THEN 'KEEP_LOCAL' "
            "WHEN remote_modified_time > local_modified_time THEN 'KEEP_REMOTE' ELSE 'KEEP_BOTH' END")

def _rebuilt(store: str) -> str:
    return f"""rebuilt AS (
  SELECT c.client_id, c.file_path, CAST(count(*) AS INTEGER) AS chunks,
         count(*) FILTER (WHERE s.data IS NULL OR octet_length(s.data) = 0) = 0 AS ok,
         string_agg(s.text, '' ORDER BY c.chunk_index) AS content, any_value(a.total_chunks) AS total_chunks
  FROM conv c LEFT JOIN {store} s USING (hash) JOIN announced a ON a.client_id = c.client_id AND a.file_path = c.file_path
  GROUP BY c.client_id, c.file_path)"""


FINALIZED = f"""
SELECT client_id, file_path AS path, CAST(strlen(content) AS BIGINT) AS size,
       CAST({P.FINALIZED_AT} AS BIGINT) AS modified_time, sha256(content) AS hash, 1 AS version,
       false AS is_directory, false AS deleted, CAST(0 AS BIGINT) AS last_sync_time
FROM rebuilt WHERE ok AND chunks = total_chunks"""


def _token_admit() -> str:
    return _with(TRANSFER, f"""b(key, rn, event_id, ts_us, bytes, admitted, tokens, last) AS (
  SELECT key, 0, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BOOLEAN, CAST({CAP} AS BIGINT), ts_us FROM tl WHERE rn = 1
  UNION ALL
  SELECT key, rn, event_id, ts_us, bytes, t1 >= want, CASE WHEN t1 >= want THEN t1 - want ELSE t1 END, ts_us
  FROM (SELECT n.key, n.rn, n.event_id, n.ts_us, n.bytes, n.bytes * {MICRO} AS want,
               least(p.tokens + (n.ts_us - p.last) * {RATE}, {CAP}) AS t1
        FROM b p JOIN tl n ON n.key = p.key AND n.rn = p.rn + 1))""", recursive=True) + \
        "SELECT key, event_id, ts_us, bytes, admitted, tokens AS tokens_after FROM b WHERE rn > 0"


FETCHED = _with(CONV, CONV_STORE, PROBE) + """
SELECT p.hash, s.hash IS NOT NULL AS found,
       CAST(coalesce(octet_length(s.data), 0) AS INTEGER) AS n_bytes,
       sha256(coalesce(s.data, ''::BLOB)) AS data_hash
FROM probe p LEFT JOIN conv_store s ON s.hash = p.hash"""

ORACLE: dict[str, str] = {
    # ------------------------------------------------------------ chunking
    "cdc_chunks": _doc_cdc(False) + 'SELECT client_id, path, chunk_index, "offset", size, hash FROM c_chunks',
    "cdc_chunks_small": _doc_cdc(True) + 'SELECT client_id, path, chunk_index, "offset", size, hash FROM c_chunks',
    "chunk_stats": _doc_cdc(True) + """
SELECT f.client_id, f.path, CAST(count(c.size) AS BIGINT) AS total_chunks,
       CAST(coalesce(min(c.size), 0) AS BIGINT) AS min_size, CAST(coalesce(max(c.size), 0) AS BIGINT) AS max_size,
       coalesce(avg(c.size), 0.0) AS avg_size
FROM src f LEFT JOIN c_chunks c ON c.client_id = f.client_id AND c.path = f.path
GROUP BY f.client_id, f.path""",
    "dedup_report": _doc_cdc(True) + """
SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS total_chunks, CAST(count(*) AS BIGINT) AS unique_chunks,
       CAST(coalesce(sum(bytes), 0) AS BIGINT) AS total_bytes, CAST(coalesce(sum(first_size), 0) AS BIGINT) AS unique_bytes,
       100.0 * (1.0 - CAST(sum(first_size) AS DOUBLE) / CAST(sum(bytes) AS DOUBLE)) AS dedup_ratio,
       100.0 * (1.0 - CAST(sum(first_size) AS DOUBLE) / CAST(sum(bytes) AS DOUBLE)) AS storage_saving
FROM (SELECT hash, count(*) AS n, sum(size) AS bytes, min(size) AS first_size FROM c_chunks GROUP BY hash)""",
    "cdc_chunks_switch": _doc_cdc(True, switch=P.SWITCH) + 'SELECT client_id, path, chunk_index, "offset", size, hash FROM c_chunks',
    "distinct_hashes": _doc_cdc(True) + "SELECT DISTINCT hash FROM c_chunks",
    "distinct_hashes_estimate": """
SELECT 'c0' AS client_id, CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n_hashes,
       count(DISTINCT l_partkey) AS distinct_hashes, true AS within_3_percent
FROM lineitem GROUP BY year(l_shipdate)""",
    # ------------------------------------------------------------ delta
    "delta_new": _ver_cdc() + """
SELECT n.path, n.chunk_index, n."offset", n.size, n.hash FROM n_chunks n
WHERE NOT EXISTS (SELECT 1 FROM o_chunks o WHERE o.path = n.path AND o.hash = n.hash)""",
    "delta_existing": _ver_cdc() + """
SELECT n.path, n.chunk_index, n."offset", n.size, n.hash FROM n_chunks n
WHERE EXISTS (SELECT 1 FROM o_chunks o WHERE o.path = n.path AND o.hash = n.hash)""",
    "delta_summary": _ver_cdc()[:-1] + """,
marked AS (
  SELECT n.*, NOT EXISTS (SELECT 1 FROM o_chunks o WHERE o.path = n.path AND o.hash = n.hash) AS is_new
  FROM n_chunks n),
ph AS (SELECT path, hash, count(*) AS n, any_value(is_new) AS is_new, any_value(size) AS size, sum(size) AS bytes
       FROM marked GROUP BY path, hash)
SELECT f.path,
       CAST(coalesce(sum(CASE WHEN is_new THEN n END), 0) AS BIGINT) AS new_chunks,
       CAST(coalesce(sum(CASE WHEN NOT is_new THEN n END), 0) AS BIGINT) AS existing_chunks,
       CAST(coalesce(sum(CASE WHEN is_new THEN bytes END), 0) AS BIGINT) AS bytes_to_transfer,
       CAST(coalesce(sum(CASE WHEN is_new THEN size END), 0) AS BIGINT) AS distinct_new_bytes
FROM new_files f LEFT JOIN ph ON ph.path = f.path GROUP BY f.path""",
    "bandwidth_reduction": _ver_cdc()[:-1] + """,
known AS (SELECT DISTINCT path, hash FROM o_chunks),
new_side AS (
  SELECT n.path, count(*) AS modified_chunks,
         sum(CASE WHEN k.hash IS NULL THEN 1 ELSE 0 END) AS new_chunks,
         sum(CASE WHEN k.hash IS NULL THEN n.size ELSE 0 END) AS new_bytes
  FROM n_chunks n LEFT JOIN known k ON k.path = n.path AND k.hash = n.hash GROUP BY n.path),
old_side AS (SELECT path, count(*) AS original_chunks, sum(size) AS original_bytes FROM o_chunks GROUP BY path)
SELECT f.path,
       CAST(coalesce(original_chunks, 0) AS BIGINT) AS original_chunks,
       CAST(coalesce(modified_chunks, 0) AS BIGINT) AS modified_chunks,
       CAST(coalesce(new_chunks, 0) AS BIGINT) AS new_chunks,
       CAST(coalesce(original_bytes, 0) AS BIGINT) AS original_bytes,
       CAST(coalesce(new_bytes, 0) AS BIGINT) AS new_bytes,
       CASE WHEN original_bytes > 0
            THEN 100.0 * (1.0 - CAST(coalesce(new_bytes, 0) AS DOUBLE) / CAST(original_bytes AS DOUBLE)) END AS bandwidth_reduction
FROM new_files f LEFT JOIN old_side o ON o.path = f.path LEFT JOIN new_side n ON n.path = f.path""",
    "chunk_exists": _with(MANIFEST, CONV, PROBE) + """
SELECT p.hash,
       EXISTS (SELECT 1 FROM manifest m WHERE m.hash = p.hash) AS in_manifest,
       EXISTS (SELECT 1 FROM conv c WHERE c.hash = p.hash) AS in_store
FROM probe p""",
    "identical_files": _with(SRC_FILES) + """
SELECT f.hash, f.client_id, f.path, CAST(g.copies AS BIGINT) AS copies
FROM src_files f JOIN (
  SELECT hash, count(*) AS copies FROM src_files WHERE hash <> ''
  GROUP BY hash HAVING count(*) > 1) g ON g.hash = f.hash""",
    # ------------------------------------------------------------ file tables
    "live_files": _with(SERVER_FILES) + f"SELECT {FILE_COLS} FROM server_all WHERE NOT deleted",
    "file_hashes": _with(VERSIONS) + f"""
SELECT 'c0' AS client_id, path, sha256(content) AS hash FROM new_files
UNION ALL SELECT 'c0', path || '.bak', '' FROM new_files""",
    "file_chunks": _with(MANIFEST) + """
SELECT client_id, file_path, chunk_index, hash,
       CAST(row_number() OVER (PARTITION BY client_id, file_path ORDER BY chunk_index) AS INTEGER) AS position
FROM manifest""",
    "file_metadata": _with(SERVER_FILES, LOCAL_FILES) + f"""
SELECT {FILE_COLS} FROM server_files s
WHERE EXISTS (SELECT 1 FROM local_files l WHERE l.client_id = s.client_id AND l.path = s.path)""",
    "modified_since": _with(SERVER_FILES) + f"SELECT {FILE_COLS} FROM server_all WHERE modified_time > {P.MODIFIED_SINCE}",
    "tombstone": _with(SRC_FILES, SERVER_FILES) + f"""
SELECT client_id, path, size, modified_time, hash, version, is_directory,
       deleted OR EXISTS (SELECT 1 FROM src_files r WHERE r.client_id = s.client_id AND r.path = s.path
                          AND contains(r.path, '/{P.TOMBSTONE_LANG}/')) AS deleted,
       last_sync_time
FROM server_files s""",
    "upsert_files": _with(SERVER_FILES, LOCAL_FILES) + f"""
SELECT {FILE_COLS} FROM local_last
UNION ALL
SELECT {FILE_COLS} FROM server_files s
WHERE NOT EXISTS (SELECT 1 FROM local_files l WHERE l.client_id = s.client_id AND l.path = s.path)""",
    "upsert_manifest": _with(MANIFEST) + 'SELECT client_id, file_path, chunk_index, hash, "offset", size FROM manifest',
    "chunk_offsets": _with(MANIFEST) + """
SELECT client_id, file_path, chunk_index, hash,
       CAST(coalesce(sum(size) OVER (PARTITION BY client_id, file_path ORDER BY chunk_index
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
       size
FROM manifest""",
    "chunk_address": _with(CONV) + """
SELECT hash, substring(hash, 1, 2) AS hash_prefix, 'chunks/' || substring(hash, 1, 2) || '/' || hash AS address
FROM (SELECT DISTINCT hash FROM conv)""",
    "client_namespace": _with(SERVER_FILES) + """
SELECT client_id, path, 'clients/' || client_id || '/' || path AS target_path,
       'clients/' || client_id || '/metadata.db' AS metadata_db
FROM server_all""",
    # ------------------------------------------------------------ sync and conflicts
    "sync_changes": _with(SERVER_FILES, LOCAL_FILES) + f"""
SELECT * FROM (
  SELECT s.client_id, s.path,
         CASE WHEN l.hash IS NOT NULL AND l.hash <> s.hash THEN 'MODIFIED'
              WHEN l.hash IS NULL AND s.modified_time > {P.LAST_SYNC_TIME} THEN 'CREATED' END AS type
  FROM server_files s LEFT JOIN local_files l ON l.client_id = s.client_id AND l.path = s.path
  WHERE NOT s.deleted)
WHERE type IS NOT NULL""",
    "sync_response": _with(SERVER_FILES, LOCAL_FILES, CONFLICTS) + f"""
SELECT client_id, 'CHANGE' AS kind, path, type, NULL::VARCHAR AS local_hash, NULL::VARCHAR AS remote_hash,
       CAST({P.SERVER_TIME} AS BIGINT) AS server_time FROM (
  SELECT s.client_id, s.path,
         CASE WHEN l.hash IS NOT NULL AND l.hash <> s.hash THEN 'MODIFIED'
              WHEN l.hash IS NULL AND s.modified_time > {P.LAST_SYNC_TIME} THEN 'CREATED' END AS type
  FROM server_files s LEFT JOIN local_files l ON l.client_id = s.client_id AND l.path = s.path
  WHERE NOT s.deleted) WHERE type IS NOT NULL
UNION ALL
SELECT client_id, 'CONFLICT', path, {STRATEGY}, local_hash, remote_hash, {P.SERVER_TIME} FROM conflicts""",
    "advance_sync_state": _with(SERVER_FILES, LOCAL_FILES) + """
SELECT t.client_id, CAST(greatest(t.last_sync_time, coalesce(max(s.modified_time), 0)) AS BIGINT) AS last_sync_time
FROM (SELECT client_id, max(modified_time) AS last_sync_time FROM local_files GROUP BY client_id) t
LEFT JOIN server_all s ON s.client_id = t.client_id
GROUP BY t.client_id, t.last_sync_time
UNION ALL
SELECT client_id, CAST(max(modified_time) AS BIGINT) FROM server_all
WHERE client_id NOT IN (SELECT client_id FROM local_files) AND modified_time > 0 GROUP BY client_id""",
    "incremental_sync": _with(SERVER_FILES, LOCAL_FILES) + f"""
SELECT {', '.join('s.' + c for c in FILE_COLS.split(', '))}
FROM server_all s
LEFT JOIN (SELECT client_id, max(modified_time) AS last_sync_time FROM local_files GROUP BY client_id) t
  ON t.client_id = s.client_id
WHERE s.modified_time > coalesce(t.last_sync_time, 0)""",
    "incremental_sync_stream": _with(SERVER_FILES, LOCAL_FILES) + f"""
SELECT {', '.join('s.' + c for c in FILE_COLS.split(', '))}
FROM server_all s
LEFT JOIN (SELECT client_id, min(modified_time) + 100 AS last_sync_time FROM local_files GROUP BY client_id) t
  ON t.client_id = s.client_id
WHERE s.modified_time > coalesce(t.last_sync_time, 0)""",
    "conflicts": _with(SERVER_FILES, LOCAL_FILES, CONFLICTS) + "SELECT * FROM conflicts",
    "auto_resolve": _with(SERVER_FILES, LOCAL_FILES, CONFLICTS) + f"SELECT *, {STRATEGY} AS strategy FROM conflicts",
    "resolve_conflicts": _with(SERVER_FILES, LOCAL_FILES, CONFLICTS) + f"""
SELECT *, CASE WHEN strategy IN ('KEEP_LOCAL', 'KEEP_REMOTE') THEN path
               WHEN strategy = 'KEEP_BOTH' THEN {_conflict_name('path', "'local'", P.RESOLVED_AT)}
               ELSE '' END AS resolved_path
FROM (SELECT *, {STRATEGY} AS strategy FROM conflicts)""",
    "conflict_name": f"""
SELECT page_id, url AS path, {_stem('url')} AS stem, {_ext('url')} AS extension,
       {_conflict_name('url', "'local'", P.RESOLVED_AT)} AS conflict_name
FROM pages""",
    # ------------------------------------------------------------ store, upload, reassembly
    "store_chunks": _with(CONV) + """
SELECT substring(hash, 1, 2) AS hash_prefix, hash, size, conv_id AS first_conv_id,
       chunk_index AS first_chunk_index, sha256(data) = hash AS hash_ok
FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY conv_id, chunk_index) AS rn FROM conv)
WHERE rn = 1 AND hash NOT IN (SELECT hash FROM conv WHERE chunk_index = 0)""",
    "fetch_chunks": FETCHED,
    "upload_complete": _with(CONV) + """
SELECT c.client_id, c.file_path, any_value(a.total_chunks) AS total_chunks,
       CAST(count(*) AS INTEGER) AS received_chunks, count(*) = any_value(a.total_chunks) AS complete
FROM conv c JOIN announced a ON a.client_id = c.client_id AND a.file_path = c.file_path GROUP BY c.client_id, c.file_path""",
    "reassemble": _with(CONV, CONV_STORE, _rebuilt("kept_store")) + """
SELECT client_id, file_path, chunks, ok,
       CASE WHEN ok THEN CAST(strlen(content) AS BIGINT) END AS size,
       CASE WHEN ok THEN sha256(content) END AS hash, CASE WHEN ok THEN content END AS content
FROM rebuilt""",
    "reassemble_bucketed": _with(CONV, CONV_STORE, _rebuilt("kept_store")) + """
SELECT client_id, file_path, chunks, ok,
       CASE WHEN ok THEN CAST(strlen(content) AS BIGINT) END AS size, CASE WHEN ok THEN sha256(content) END AS hash
FROM rebuilt""",
    "fetch_chunks_bucketed": FETCHED,
    "finalize_files": _with(CONV, CONV_STORE, _rebuilt("kept_store")) + FINALIZED,
    "write_client_files": _with(CONV, CONV_STORE, _rebuilt("kept_store")) + """
SELECT client_id, file_path AS path, CAST(strlen(content) AS BIGINT) AS size, sha256(content) AS hash
FROM rebuilt WHERE ok AND chunks = total_chunks""",
    "cdc_file_chunks": _with(
        CONV, CONV_STORE, _rebuilt("kept_store"),
        "written AS (SELECT file_path AS path, encode(content) AS content FROM rebuilt WHERE ok AND chunks = total_chunks)",
        cdc_cte("written", ["path"], **SMALL), recursive=True,
    ) + 'SELECT path, chunk_index, "offset", size, hash FROM c_chunks',
    "download_response": _with(CONV)[:-1] + """,
need AS (
  SELECT c.* FROM conv c
  WHERE NOT EXISTS (SELECT 1 FROM conv h WHERE h.role = 'user' AND h.client_id = c.client_id
                    AND h.file_path = c.file_path AND h.hash = c.hash)),
known AS (SELECT DISTINCT client_id, file_path FROM conv)
SELECT k.client_id, k.file_path, 'OK' AS status, n.chunk_index, n.hash, n.size,
       CASE WHEN n.chunk_index IS NOT NULL
            THEN n.chunk_index = max(n.chunk_index) OVER (PARTITION BY k.client_id, k.file_path) END AS is_last
FROM known k LEFT JOIN need n ON n.client_id = k.client_id AND n.file_path = k.file_path
UNION ALL
SELECT client_id, file_path || '.bak', 'NOT_FOUND', NULL, NULL, NULL, NULL FROM known""",
    "download_plan": _with(CONV)[:-1] + """,
need AS (
  SELECT c.* FROM conv c
  WHERE NOT EXISTS (SELECT 1 FROM conv h WHERE h.role = 'user' AND h.client_id = c.client_id
                    AND h.file_path = c.file_path AND h.hash = c.hash))
SELECT client_id, file_path, chunk_index, hash, size,
       chunk_index = max(chunk_index) OVER (PARTITION BY client_id, file_path) AS is_last
FROM need""",
    "apply_delta": _ver_cdc()[:-1] + """,
need AS (SELECT path, count(*) AS chunks, sum(size) AS need FROM n_chunks GROUP BY path),
j AS (SELECT o.path, coalesce(n.chunks, 0) AS chunks, coalesce(n.need, 0) AS need, o.content
      FROM old_files o LEFT JOIN need n ON n.path = o.path)
SELECT path, CAST(chunks AS INTEGER) AS chunks, CAST(octet_length(content) AS BIGINT) AS payload_size,
       need <= octet_length(content) AS ok,
       CASE WHEN need <= octet_length(content) THEN CAST(need AS BIGINT) END AS written_bytes,
       CASE WHEN need = 0 THEN sha256('') WHEN need <= octet_length(content) THEN sha256(array_slice(content, 1, need)) END AS hash,
       CASE WHEN need = 0 THEN '' WHEN need <= octet_length(content) THEN hex(array_slice(content, 1, need)) END AS content
FROM j""",
    "storage_stats": _with(CONV, CONV_STORE, SERVER_FILES) + """
SELECT (SELECT CAST(count(*) AS BIGINT) FROM conv_store) AS total_chunks,
       (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM conv_store) AS total_bytes,
       (SELECT CAST(count(*) AS BIGINT) FROM server_all WHERE NOT deleted) AS total_files,
       (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM conv)
         - (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM conv_store) AS deduplicated_bytes""",
    # ------------------------------------------------------------ metrics
    "counter": _with(METRICS) + "SELECT name, CAST(sum(coalesce(value, 1)) AS BIGINT) AS counter FROM m GROUP BY name",
    "gauge": _with(METRICS) + """
SELECT name, value AS gauge FROM (
  SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY ts DESC, event_id DESC) AS rn FROM m)
WHERE rn = 1""",
    "latency": _with(METRICS) + """
SELECT name, CAST(count(value) AS BIGINT) AS count, CAST(sum(value) AS BIGINT) AS sum_us,
       CAST(min(value) AS BIGINT) AS min_us, CAST(max(value) AS BIGINT) AS max_us, avg(value) AS avg_us
FROM m GROUP BY name HAVING count(value) > 0""",
    "throughput": _with(METRICS) + f"""
SELECT name, total_bytes, elapsed_s,
       CASE WHEN total_bytes > 0 AND elapsed_s > 0 THEN total_bytes / elapsed_s ELSE 0.0 END AS bytes_per_sec
FROM (SELECT name, CAST(sum(value) AS BIGINT) AS total_bytes,
             CAST(floor((epoch_us(TIMESTAMP '{P.AS_OF}') - epoch_us(min(ts) FILTER (WHERE value > 0))) / {MICRO}) AS BIGINT) AS elapsed_s
      FROM m GROUP BY name)""",
    "metrics_report": _with(METRICS)[:-1] + f""",
g AS (
  SELECT name, CAST(sum(coalesce(value, 1)) AS DOUBLE) AS counter,
         CAST(arg_max(value, struct_pack(t := ts, e := event_id)) AS DOUBLE) AS gauge,
         CAST(count(value) AS DOUBLE) AS cnt, avg(value) AS avg_v,
         CAST(min(value) AS DOUBLE) AS min_v, CAST(max(value) AS DOUBLE) AS max_v,
         sum(value) AS total_bytes,
         CAST(floor((epoch_us(TIMESTAMP '{P.AS_OF}') - epoch_us(min(ts) FILTER (WHERE value > 0))) / {MICRO}) AS BIGINT) AS secs
  FROM m GROUP BY name)
SELECT 'counter' AS kind, name, 'value' AS stat, counter AS value FROM g
UNION ALL SELECT 'gauge', name, 'value', gauge FROM g
UNION ALL SELECT 'latency', name, 'count', cnt FROM g
UNION ALL SELECT 'latency', name, 'avg', avg_v FROM g
UNION ALL SELECT 'latency', name, 'min', min_v FROM g
UNION ALL SELECT 'latency', name, 'max', max_v FROM g
UNION ALL SELECT 'throughput', name, 'mb_per_sec',
  CASE WHEN total_bytes > 0 AND secs > 0 THEN total_bytes / secs ELSE 0.0 END / 1024.0 / 1024.0 FROM g""",
    # ------------------------------------------------------------ byte jobs
    "window_fingerprints": "",  # filled below
    # ------------------------------------------------------------ token buckets
    "token_bucket_admit": _token_admit(),
    # ------------------------------------------------------------ change feed and uploads
    "apply_changes": _with(CHANGES) + """
SELECT client_id, path, size, modified_time, hash, 1 AS version, false AS is_directory,
       coalesce(del_seq > up_seq, false) AS deleted, CAST(0 AS BIGINT) AS last_sync_time
FROM st WHERE up_seq IS NOT NULL""",
}
ORACLE["apply_changes_stream"] = ORACLE["apply_changes"]
ORACLE["cdc_chunks_segmented"] = ORACLE["cdc_chunks_small"]
ORACLE["token_bucket_admit_stream"] = ORACLE["token_bucket_admit"]
ORACLE["ingest_uploads"] = _with(CONV, CONV_STORE, _rebuilt("conv_store")) + FINALIZED
# an upload is answered in every delivery that holds messages of it; it succeeds in the last one, if at all
ORACLE["upload_responses"] = _with(CONV, CONV_STORE, _rebuilt("conv_store"))[:-1] + """,
parts AS (SELECT client_id, file_path, chunk_index % 2 AS part, count(*) AS n FROM conv GROUP BY ALL),
answers AS (
  SELECT p.client_id, p.file_path, CAST(p.part AS BIGINT) AS batch_id,
         sum(p.n) OVER (PARTITION BY p.client_id, p.file_path ORDER BY p.part) = r.total_chunks AND r.ok AS success, r.chunks
  FROM parts p JOIN rebuilt r ON r.client_id = p.client_id AND r.file_path = p.file_path)
SELECT client_id, file_path, batch_id, success, CASE WHEN success THEN chunks END AS chunks_received,
       CASE WHEN NOT success THEN 'INCOMPLETE_OR_BROKEN' END AS reason
FROM answers"""


def _fingerprints_sql() -> str:
    from tidepool.functions.cdc import BASE, INV_BASE, MOD
    from tidepool.plans.cdc_sql import POW_BITS, _pow_expr

    w = P.FP_WINDOW
    return f"""WITH
d AS (SELECT doc_id, hex(encode(text)) AS hx, octet_length(encode(text)) AS n FROM documents),
bytes AS (
  SELECT doc_id, i, CAST('0x' || h AS BIGINT) AS b
  FROM (SELECT doc_id, unnest(range(n)) AS i, unnest(regexp_extract_all(hx, '..')) AS h FROM d WHERE n >= {w})),
plo AS MATERIALIZED (SELECT j, {_pow_expr('j', BASE)} AS p, {_pow_expr('j', INV_BASE)} AS v FROM range(4096) AS t(j)),
phi AS MATERIALIZED (SELECT k, {_pow_expr('k * 4096', BASE)} AS p, {_pow_expr('k * 4096', INV_BASE)} AS v
                     FROM range({1 << (POW_BITS - 12)}) AS t(k)),
g AS (
  SELECT doc_id, i, lo.p * hi.p % {MOD} AS pi,
         CAST(sum(b * (lo.v * hi.v % {MOD}) % {MOD}) OVER (PARTITION BY doc_id ORDER BY i
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS gi
  FROM bytes JOIN plo lo ON lo.j = (i & 4095) JOIN phi hi ON hi.k = (i >> 12)),
fp AS (
  SELECT doc_id, i, pi * ((gi - coalesce(lag(gi, {w}) OVER (PARTITION BY doc_id ORDER BY i), 0)) % {MOD}) % {MOD} AS fp
  FROM g),
full_windows AS (SELECT doc_id, fp FROM fp WHERE i >= {w - 1})
SELECT fp, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs, CAST(count(*) AS BIGINT) AS n_occurrences
FROM full_windows GROUP BY fp HAVING count(DISTINCT doc_id) > 1"""


ORACLE["window_fingerprints"] = _fingerprints_sql()
ORACLE["store_chunks_indexed"] = ORACLE["store_chunks"]
