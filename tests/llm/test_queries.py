"""The registered corpus queries over the smallest tables, against SQL where there is any."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from tokenizers import Tokenizer

import __spark_entry__ as contract
from carelake.llm.queries import ORACLE, QUERIES, WORD_BPE
from tests.llm.test_copies import slow_fingerprint
from tests.llm.test_search import slow_base
from verification.compare import _rows, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_all_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert {*QUERIES, "pipeline"} <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", ORACLE)
def test_same_as_sql(spark, name):
    got = QUERIES[name](spark, SF)
    found = connect(SF).execute(ORACLE[name])
    assert _rows(got.columns, got.collect()) == _rows([d[0] for d in found.description], found.fetchall())


def test_token_digests(spark, texts):
    library = Tokenizer.from_file(WORD_BPE)
    coded = {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    packed = lambda ids: b"".join(n.to_bytes(4, "little") for n in ids)
    for r in QUERIES["op9_bpe"](spark, SF).collect():
        ids = coded[r["doc_id"]]
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    start, got = 0, {r["doc_id"]: r for r in QUERIES["op10_orc_ids"](spark, SF).collect()}
    for i in sorted(texts):
        ids = [*coded[i], 1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(packed(ids)))
        start += len(ids)


def test_fingerprints_and_secrets(spark, texts):
    for r in QUERIES["op5_simhash"](spark, SF).collect():
        assert r["fingerprint"] == f"{slow_fingerprint(texts[r['doc_id']]):016x}" and r["component_id"] <= r["doc_id"]
    for r in QUERIES["op8_secrets"](spark, SF).collect():
        base = slow_base(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == n for k, _, _ in base) for n in ("assign", "access", "hex")]
        assert set(joined.split(",")) - {""} <= set(r["spans"].split(","))


def test_the_others_return_a_row_per_document(spark, texts):
    for name in ("op1_toxicity", "op2_sharding", "op3_line_dedup"):
        assert sorted(r["doc_id"] for r in QUERIES[name](spark, SF).collect()) == sorted(texts)
