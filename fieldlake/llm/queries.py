"""The corpus operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, language_id, license_scan, mixture, packing, quality_rules
from .embedding_dedup import embedding_groups
from .line_dedup import dedup_lines
from .minhash_dedup import minhash_groups
from .store import Scratch
from .suffix_dedup import without_repeats

#: Tokens of a packed sequence.
SEQUENCE = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_groups(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, fragments = mixture.mixture(table(spark, sf_dir, "documents"))
    return mixture.taken(documents, fragments).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scanned(table(spark, sf_dir, "documents"), license_scan.known_digests(spark))
    return found.withColumnRenamed("id", "doc_id")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "packing")
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), scratch, tokenizer_path(), SEQUENCE)
    assigned = packing.assign(pieces, scratch, SEQUENCE)
    digests = pieces.select("row", F.col("id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return digests.join(assigned, ["row", "piece"]).drop("row")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "chat")
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    messages = scratch.save(chat_format.linear_messages(said.union(own)))
    return chat_format.digests(chat_format.formatted(messages, scratch))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(~language_id.held_out()))
    found = language_id.predicted(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op6_license_scan": license_scan.sql(), "op8_quality_rules": quality_rules.sql()}
