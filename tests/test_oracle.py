"""Every registered query against its DuckDB oracle on the same parquet
tables (row count, column names, order-insensitive values)."""

import decimal
import math

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL

QUERIES = entry.queries()
ORACLE = entry.oracle_sql()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v).hex()
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)


def test_every_query_has_an_oracle_or_is_documented():
    assert set(ORACLE) <= set(QUERIES)
    # scan_files reads the folder as binary files; the pipeline's queries have their own tests
    own = {n for n in QUERIES if not n.startswith("op") and n != "pipeline"}
    assert own - set(ORACLE) == {"scan_files"}


@pytest.mark.parametrize("name", sorted(n for n in ORACLE if not n.startswith("op")))
def test_query_matches_oracle(spark, duck, name):
    con = duck(SF_SMALL)
    df = QUERIES[name](spark, SF_SMALL)
    s_cols, s_rows = _canon(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(ORACLE[name])
    d_cols, d_rows = _canon(rel.columns, rel.fetchall())
    assert s_cols == d_cols
    assert len(s_rows) == len(d_rows)
    assert s_rows == d_rows


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0]["total_chunks"] >= rows[0]["unique_chunks"] > 0


def test_scan_files_reads_the_table_as_one_file(spark):
    import hashlib
    import os

    path = f"{SF_SMALL}/documents.parquet"
    rows = QUERIES["scan_files"](spark, SF_SMALL).collect()
    with open(path, "rb") as f:
        data = f.read()
    assert [(r["name"], r["size"], r["n_bytes"], r["hash"]) for r in rows] == [
        (os.path.basename(path), len(data), len(data), hashlib.sha256(data).hexdigest())
    ]


@pytest.mark.parametrize("name,column,values", [
    ("resolve_conflicts", "strategy", {"KEEP_LOCAL", "KEEP_REMOTE", "KEEP_BOTH"}),
    ("upload_complete", "complete", {True, False}),
    ("reassemble", "ok", {True, False}),
    ("upload_responses", "success", {True, False}),
    ("apply_delta", "ok", {True, False}),
    ("chunk_exists", "in_store", {True, False}),
    ("store_chunks", "hash_ok", {True, False}),
    ("download_response", "status", {"OK", "NOT_FOUND"}),
    ("token_bucket_admit", "admitted", {True, False}),
    ("sync_response", "kind", {"CHANGE", "CONFLICT"}),
])
def test_every_branch_occurs(spark, name, column, values):
    from conftest import SF_MID

    assert {r[0] for r in QUERIES[name](spark, SF_MID).select(column).distinct().collect()} == values
