"""Registered queries: each operator over its whole table, with its digest columns."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sloframe.llm import bpe, brown, html, importance, lines, minhash, mixing, quality, search, sketch, suffix, warc, whitening
from sloframe.llm.registry import Plan, table
from sloframe.llm.sql import ORACLES

PLANS: dict[str, Plan] = {}


def query(fn: Plan) -> Plan:
    PLANS[fn.__name__] = fn
    return fn


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(table(spark, sf_dir, "pages"))
    return warc.read_records(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extract_main_text(pages, html.fit_extractor(pages))


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_documents(table(spark, sf_dir, "documents"), digests=True)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.ratio_model(docs, quality.trusted_sample(table(spark, sf_dir, "labels")))
    out = quality.judge_documents(docs, model)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 6).alias("score"))


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.kept_digest(suffix.remove_repeats(table(spark, sf_dir, "documents")))


@query
def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op8_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_documents(table(spark, sf_dir, "documents"))


@query
def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return search.search(search.build_index(docs), docs.filter("doc_id % 100 = 0"), k=10)


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.calibrated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "lang", "topic", "tokens", F.round("probability", 9).alias("probability"), "kept")


@query
def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprint_edits(table(spark, sf_dir, "documents"), recovered=False)


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


PLANS["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

__all__ = ["ORACLES", "PLANS"]
