"""The registered queries: SQL twins where there are any, and the contract's columns for all."""

import os
from collections import Counter

import duckdb
import pytest

from support import rows

import corpus_pipeline
from millrace.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
COLUMNS = {
    "op1": "doc_id held_out lang_pred score",
    "op2": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op3": "doc_id piece start length ids_crc32 sequence_id offset",
    "op4": "doc_id n_bytes n_tokens over_limit",
    "op5": "page_id payload_bytes payload_digest record_type refers_to",
    "op6": "doc_id n_tokens rate copies",
    "op7": "doc_id held_out score predicted",
    "op8": "doc_id n_shingles n_similar component_id",
    "op9": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op10": "doc_id n_bytes n_removed n_spans kept_sha256",
}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twins(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages"):
        duck.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    twin = duck.sql(queries.oracle_sql()[name])
    assert rows(queries.queries()[name](spark, DATA).select(*twin.columns)) == sorted(twin.fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_contract(spark, name):
    df = queries.queries()[name](spark, DATA)
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(df.columns)


def test_pipeline_stages(spark):
    """Every stage but the last keeps the columns of documents; ids of the pieces are ids of documents."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    known = {r[0] for r in docs.select("doc_id").collect()}
    columns, before = docs.columns, len(known)
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns
        now = {r[0] for r in docs.select("doc_id").collect()}
        assert now <= known and len(now) <= before
        before = len(now)
    pieces = corpus_pipeline.run(spark, DATA).collect()
    assert {r["doc_id"] for r in pieces} <= known
    assert all(r["offset"] + r["length"] <= 4096 for r in pieces)


def test_pipeline_cases(spark, docs, corpus, empty):
    """Nulls in every column, repeated rows, clashing and odd column names, an empty table: columns stay, rows go for reasons only."""
    odd = docs.withColumnRenamed("one", "my col").withColumnRenamed("s", "a.b")
    found = odd
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = corpus_pipeline.staged(stage(spark, found, DATA), name)
        assert after.columns == odd.columns and after.schema["n_chars"].dataType == odd.schema["n_chars"].dataType
        n, before = after.count(), found.count()
        if name == "language_id":
            texts = {r["text"] for r in after.collect()}
            assert None not in texts and not {"", " \n\t"} & texts and n >= before - 6, "only texts without letters, or unlike all others"
        elif name == "ngram_jaccard":
            kept = Counter(r["doc_id"] for r in after.collect())
            assert kept[43] == kept[40] == 0 and kept[3] == 1, "copies go, the smallest id stays"
        elif name == "suffix_dedup":
            assert n == before and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in after.collect())
        found = after
    pieces = corpus_pipeline.packed_sequences(spark, found, DATA).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in found.collect()}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0, name


def test_pipeline_leaves_only_what_is_read(spark, monkeypatch):
    """What stages wrote on their way is deleted; the result is read after that."""
    from millrace.llm import common

    before = len(common._written)
    pieces = corpus_pipeline.run(spark, DATA)
    files = common.Files(spark)
    assert all(files.exists(path) for _, path in common._written[before:])
    assert len(common._written) - before <= 8 and pieces.count() > 0
