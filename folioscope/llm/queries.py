"""The queries of the corpus operators, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import langid, lexical, mil, minhash, mixing, packing, pii, rules, simhash, substring, turns, urls, warc
from folioscope.llm.common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return docs.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).cast("long").alias("taken"))


def op2_collinear_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = mil.scored(docs, mil.trained(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", mil.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= mil.KEEP).cast("int").alias("predicted"))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = minhash.edited(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        minhash.packed(F.col("signature")).alias("fingerprint"),
        minhash.packed(F.col("edited_signature")).alias("edited_fingerprint"),
        minhash.likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        minhash.likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )


def op6_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymized(table(spark, sf_dir, "documents").select("doc_id", "text"), counts="found")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(packing.sized(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))


def op8_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents").select("doc_id", "text"), k=4, bits=4, seeds=(42,), blocks=2, least=None)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    rows = langid.predicted(docs.select("doc_id", "text"), langid.trained(docs))
    return rows.select("doc_id", mil.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.reported(turns.repaired(turns.damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_collinear_chains": op2_collinear_chains,
    "op3_mil_quality": op3_mil_quality,
    "op4_warc_revisits": op4_warc_revisits,
    "op5_minhash_fingerprints": op5_minhash_fingerprints,
    "op6_feistel_pseudonyms": op6_feistel_pseudonyms,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_simhash_anchors": op8_simhash_anchors,
    "op9_quality_rules": op9_quality_rules,
    "op10_url_rules": op10_url_rules,
    "op11_lexical_search": op11_lexical_search,
    "op12_language_id": op12_language_id,
    "op13_conversation_repair": op13_conversation_repair,
}
