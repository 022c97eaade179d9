"""The contract queries themselves: against DuckDB where SQL can express them, else against the operator's plain values."""

import hashlib
import math
import zlib

import duckdb
import pyarrow.parquet as pq
import pytest

from glossaflow.llm import media, oracles, pii, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF), con.sql(oracles.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    wanted = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
    assert len(rows) == len(wanted)
    for a, b in zip(rows, wanted):
        assert all(x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-4)) for x, y in zip(a, b)), (a, b)


def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def test_pii_digests(spark):
    for r in queries.op3_pii(spark, SF).collect():
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert [k for k, *_ in spans if k not in pii.KINDS] == [] and spans == sorted(spans, key=lambda s: (int(s[1]), pii.KINDS.index(s[0]), int(s[2])))
        base = r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"]
        assert base <= len(spans) and len(r["base_sha256"]) == 64
        if base == len(spans):
            assert r["base_sha256"] == hashlib.sha256(r["spans"].encode()).hexdigest()


def test_media_digests(spark):
    texts = {r["doc_id"]: r["text"] for r in documents()}
    for r in queries.op10_media(spark, SF).collect():
        payload = media.padded((texts[r["doc_id"]] or "").encode())
        form = media.encode(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(form), hashlib.sha256(form).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-16:]) and r["payload_bytes"] == len(payload)
        mean = sum(payload) / len(payload)
        assert r["feature"].startswith(f"mean={mean:.4f};")


def test_dedup_spans(spark):
    texts = {r["doc_id"]: r["text"] for r in documents()}
    rows = queries.op4_linededup(spark, SF).collect()
    assert rows
    for r in rows:
        spans = [tuple(map(int, s.split(":"))) for s in r["spans"].split(",")]
        assert len(spans) == r["n_spans"] and all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        words = sum(len(texts[r["doc_id"]][a:b].encode().split()) for a, b in spans)
        assert words == r["n_words"]
