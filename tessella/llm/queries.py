"""Queries of the operators, one for each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, exact_dedup, filter_audit, langid, licenses, line_dedup, mixing, order_minhash, packing, simhash, token_alignment, toxicity
from .common import default_partitions

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path() -> str:
    """The vocabulary file of op9 in the installed folder of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digest(text: F.Column) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return clean.select("doc_id", "line_count", F.size("line_dropped").alias("n_dropped"), "line_dropped", digest(F.coalesce("text", F.lit(""))).alias("text_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = langid.fit(docs.where(part != 1))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return langid.predict(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    return found.select("doc_id", F.size("matches").alias("n_matches"), names.alias("licenses"), "matches")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.grade_documents(docs.select("doc_id", "text"), model).select("doc_id", "tox.severity", "tox.grade", "tox.p_toxic", F.col("tox.marked").alias("marked_words"), (F.col("tox.p_toxic") >= 0.5).alias("toxic"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string"))
    back = chat.read_chat(chat.format_chat(rows))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest(turns).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), digest(F.col("loss_text")).alias("loss_sha256"), "formatted_chars")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = bpe.encode(table(spark, sf_dir, "documents"), vocabulary_path(), decoded=True)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprint_and_edit(table(spark, sf_dir, "documents"), buckets=max(8, 4 * default_partitions(spark)))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_language_id, op3_license_scan, op4_exact_dedup, op5_toxicity, op6_simhash, op7_source_mix, op8_chat_format, op9_bpe, op10_order_minhash, op11_filter_audit, op12_token_alignment, op13_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": exact_dedup.SQL, "op7_source_mix": mixing.SQL.format(documents="documents"), "op8_chat_format": chat.SQL, "op11_filter_audit": filter_audit.SQL}
