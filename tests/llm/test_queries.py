"""The registered queries' columns, types and digests on a small table."""

import hashlib
import os

import pytest

from tidepool.llm import queries
from tidepool.llm.pii import KINDS

from .test_pii import brute as brute_pii
from .test_secrets import brute as brute_secrets

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op2_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op4_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op6_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op7_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op8_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op9_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op10_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def text_of(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_types_and_digests(spark, name):
    out = queries.QUERIES[name](spark, SF)
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema.fields) == COLUMNS[name]
    rows = out.collect()
    assert rows
    if name in ("op1_pii", "op7_secrets"):
        kinds = KINDS if name == "op1_pii" else ("assign", "access", "hex")
        texts = text_of(spark)
        for r in rows:
            found = [(KINDS[k], s, e) for s, k, e in brute_pii(texts[r.doc_id])] if name == "op1_pii" else brute_secrets(texts[r.doc_id])
            told = ",".join(f"{k}:{s}:{e}" for k, s, e in found)
            assert r.base_sha256 == sha(told) and set(filter(None, told.split(","))) <= set(r.spans.split(","))
            assert [r[f"n_{k}"] for k in kinds] == [sum(x == k for x, _, _ in found) for k in kinds]
    if name == "op4_toxicity":
        assert all(r.predicted == (r.score >= 0.5) for r in rows) and {r.held_out for r in rows} == {True, False}
    if name == "op8_bpe":
        texts = text_of(spark)
        assert all(r.decoded_sha256 == sha(texts[r.doc_id]) for r in rows)
    if name == "op6_simhash":
        assert all(len(r.fingerprint) == 16 and int(r.fingerprint, 16) >= 0 and r.component_id <= r.doc_id for r in rows)
