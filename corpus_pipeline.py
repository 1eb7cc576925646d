"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept, and all but the last
return the columns of ``documents``, extra columns included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import bpe, crf, decontaminate, queries, repeats, simhash
from shelfmark.plans.durable import durable, ship

#: A text goes if it has no letter (``und``) or its language is less likely than this.
LEAST_LANGUAGE_SCORE = 0.4


def _others(docs: DataFrame, *but: str) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c not in but)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised; the model learns from those outside the held-out quarter."""
    ship(spark)
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.lit(False))
    model = crf.fit(docs, learn)
    keep = _others(docs, "doc_id")
    plain = docs.select("doc_id", *(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)), F.col("text").alias("_text_in"))
    judged = crf.identify(plain, model, text_col="_text_in", keep=tuple(f"c{i}" for i in range(len(keep))))
    good = judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return good.select("doc_id", *(F.col(f"c{i}").alias(c) for i, c in enumerate(keep))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group, the first by id (null last), fingerprint and text. Null texts count as empty, and
    empty texts are one group; rows are chosen, so rows that repeat, or share an id, do not all stay."""
    ship(spark)
    return simhash.deduplicate(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the words of passages that start earlier elsewhere. Texts that lose nothing keep every
    byte (null stays null); of the others n_chars follows the text."""
    ship(spark)
    return repeats.cut_repeats(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship(spark)
    return decontaminate.clean(docs, queries.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether decoding them gives the text back."""
    ship(spark)
    back = bpe.bpe_round_trip(docs, bpe.read_vocab(queries.vocab_path()), keep=("text",))
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("language_id", language), ("simhash_near_dedup", near_duplicates), ("substring_dedup", substrings), ("decontamination", benchmark), ("bpe", encode)]

#: SQL cannot express the trained language model, so the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
