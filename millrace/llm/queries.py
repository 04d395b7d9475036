"""The registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import langid, media, mixing, ngram_join, packing, quality, repeats, tokencount, toxicity, warc
from millrace.llm.common import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, crc_mod("doc_id", 3) != 1)
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_media(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = toxicity.training_labels(table(spark, sf_dir, "labels"))
    found = toxicity.scored(table(spark, sf_dir, "documents"), labels)
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "evidence")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "n_similar", "component_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 5) != 0)
    found = quality.judged(table(spark, sf_dir, "documents"), labels)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_media_columns, op3_best_fit_packing, op4_token_counts, op5_warc, op6_mixing, op7_toxicity, op8_ngram_jaccard, op9_quality_rules, op10_suffix_dedup)}


_WARC = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html) as n, sha1(html) as digest from p),
h as (select digest, max(page_id) as head from d where n >= 1000 group by digest)
select page_id, n::bigint as payload_bytes, digest as payload_digest, case when n >= 1000 and head <> page_id then 'revisit' else 'response' end as record_type, case when n >= 1000 and head <> page_id then head end as refers_to
from d left join h using (digest)
"""

_SIMILAR = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select doc_id, case when len(ws) >= 5 then list_distinct([array_to_string(ws[i : i + 4], ' ') for i in range(1, len(ws) - 3)]) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as sh from w),
e as (select doc_id, len(sh) as n, unnest(sh) as x from s),
p as (select a.doc_id as a, b.doc_id as b from e a join e b on a.x = b.x and a.doc_id <> b.doc_id and 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach(a, b) as (select a, b from p union select r.a, p.b from reach r join p on r.b = p.a)
select doc_id, len(sh)::bigint as n_shingles, (select count(*) from p where a = doc_id) as n_similar, least(doc_id, coalesce((select min(b) from reach where a = doc_id), doc_id)) as component_id
from s
"""


def oracle_sql() -> dict[str, str]:
    """Twins of the queries that SQL can express; the others' tests use brute force, round trips or held-out accuracy."""
    return {"op5_warc": _WARC, "op8_ngram_jaccard": _SIMILAR}
