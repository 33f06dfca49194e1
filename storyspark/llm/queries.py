"""Registered queries opN_<name>: each operator over its whole table, with
production parameters, and the DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package
from ..sources.tables import read_table
from . import (chat, decontam, host_rules, html_text, license_scan, lm_score, merkle, packing, passages, phrases,
               pii, simhash_cover, token_counts)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, *tables: str, sql: str | None = None):
    """Register ``fn(table frames...)`` under ``name``."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_checkpoint_dir(spark)
            ship_package(spark)
            return fn(*[read_table(spark, sf_dir, t) for t in tables])
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql.strip()
        return fn
    return deco


@_query("op5_simhash_dedup", "documents")
def op5(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    return simhash_cover.simhash_components(docs)


@_query("op1_pii", "documents")
def op1(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans of personal data in every document."""
    return pii.pii_digest(docs)


@_query("op2_chat_format", "conversations", sql=chat.DIGEST_SQL)
def op2(turns: DataFrame) -> DataFrame:
    """Every conversation formatted and read back, and conversation -7."""
    spark = turns.sparkSession
    text = "</s>[INST] ok [/INST]"
    own = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"),
                 F.lit(role).alias("role"), F.lit(text).alias("text"))
        for i, role in enumerate(("user", "assistant"))])).alias("r")).select("r.*")
    rows = turns.select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.chat_digest(chat.format_conversations(rows))


@_query("op9_host_rules", "documents", sql=host_rules.QUERY_SQL)
def op9(docs: DataFrame) -> DataFrame:
    """Rule features, base rules and the host verdict of every document."""
    return host_rules.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_query("op10_token_counts", "documents")
def op10(docs: DataFrame) -> DataFrame:
    """Bytes and byte-level BPE tokens of every document."""
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@_query("op7_packing", "documents")
def op7(docs: DataFrame) -> DataFrame:
    """Every document's pieces with their place in a sequence."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@_query("op3_decontamination", "documents", "benchmark")
def op3(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Benchmark items found in documents, with their least edit distance."""
    return decontam.leaks(docs, benchmark)


@_query("op8_html_text", "pages")
def op8(pages: DataFrame) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(pages)


@_query("op4_lm_score", "documents")
def op4(docs: DataFrame) -> DataFrame:
    """Masked pseudo-likelihood of every document."""
    return lm_score.score(docs)


@_query("op6_license_scan", "documents", sql=license_scan.DOCUMENTS_SQL)
def op6(docs: DataFrame) -> DataFrame:
    """Licence of every document, as the file source/lang/doc_id.txt."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return license_scan.scan(docs.select("doc_id", path.alias("path"), "text"), ("doc_id", "path"))


@_query("op12_merkle_manifest", "documents", sql=merkle.PROOFS_SQL)
def op12(docs: DataFrame) -> DataFrame:
    """Merkle proof of every document, folded from its tampered leaf."""
    return merkle.proofs(docs, merkle.tampered())


@_query("op11_phrase_collocations", "documents", sql=phrases.COLLOCATIONS_SQL)
def op11(docs: DataFrame) -> DataFrame:
    """The first 2000 collocations of every language."""
    return phrases.collocations(docs)


@_query("op13_repeated_passages", "documents")
def op13(docs: DataFrame) -> DataFrame:
    """Words that stay of every document when passages of earlier documents go."""
    return passages.without_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
