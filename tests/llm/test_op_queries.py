"""The registered queries on the small tables: their columns, one row for each input row, and held-out quality."""

import hashlib
import os

import pytest

from flowloom.llm import queries

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
COLUMNS = {
    "op1_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op2_sentencepiece": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op4_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op5_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op6_quality_classifier": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op7_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op8_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op9_minhash_near_dedup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op10_media_columns": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, docs, name):
    df = queries.queries()[name](spark, SF)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    got = df.toPandas()
    if name == "op1_url_filter":
        assert len(got) == spark.read.parquet(f"{SF}/pages.parquet").count() and set(got.verdict) <= {"allow", "block"}
        return
    assert sorted(got.doc_id) == sorted(docs.index)
    got = got.set_index("doc_id")
    if name == "op4_language_id":
        held = got[got.held_out]
        assert (held.lang_pred == docs.lang[held.index]).mean() > 0.98 and got.score.between(0, 1).all()
    if name == "op6_quality_classifier":
        labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").quality
        held = got[got.held_out & got.index.isin(labels.index)]
        assert (held.predicted == labels[held.index]).mean() > 0.95
    if name == "op5_token_counts":
        assert (got.n_bytes == docs.text[got.index].map(lambda t: len(t.encode()))).all()
    if name == "op10_media_columns":
        for i, t in docs.text.items():
            raw = t.encode()
            padded = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
            assert got.payload_sha256[i] == hashlib.sha256(padded).hexdigest() and got.payload_bytes[i] == len(padded)


def test_packing_query(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    from flowloom.llm import packing

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    rows = queries.queries()["op3_best_fit_packing"](spark, SF)
    got = {r.doc_id: r.ids for r in packing.unpacked(rows.withColumnRenamed("doc_ids", "owners")).collect()}
    assert got == {i: [*plain.encode(t, add_special_tokens=False).ids, 50256] for i, t in docs.text.items()}
    sums = rows.selectExpr("sum(used) AS used", "sum(size) AS size", "bool_and(used <= size AND used = size(ids)) AS ok").first()
    assert sums.ok and sums.used / sums["size"] > 0.95
