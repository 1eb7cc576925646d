"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, crf, nndescent, quality
from . import simhash as sim
from .bpe import bpe_round_trip, read_vocab, token_counts
from .brown import score_texts
from .decontaminate import contaminated
from .repeats import remove_repeats

VOCAB = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocab_path(name: str = VOCAB) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    found = crf.identify(docs, crf.fit(docs, F.col("doc_id").isNotNull() & ~out))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op5_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    return score_texts(table(spark, sf_dir, "documents"), held_out)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = sim.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_token_counts(spark: SparkSession, sf_dir: str, limit: int = 512) -> DataFrame:
    counted = token_counts(table(spark, sf_dir, "documents"), read_vocab(vocab_path()), limit)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "cut_chars")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_round_trip(table(spark, sf_dir, "documents"), read_vocab(vocab_path()))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = chat.rotate_perspectives(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return turned.select("conv_id", "part", "speaker", "n_messages", "rendered", mask.alias("mask"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_substring_dedup, op2_embedding_near_dedup, op3_decontamination, op4_language_id, op5_brown_lm, op6_simhash_near_dedup, op7_token_counts, op8_bpe, op9_chat_perspectives, op10_quality_classifier]
    return {q.__name__: q for q in found}


def llm_oracle_sql() -> dict[str, str]:
    return {"op9_chat_perspectives": chat.ORACLE_SQL}
