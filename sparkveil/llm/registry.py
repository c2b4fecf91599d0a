"""One query per operator, over whole tables, and the SQL that checks it where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, counts, langid, lines, mixing, negatives, packing, phrases, quality, sigtree, simhash, suffix
from .common import materialize, shared_dir, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), "fingerprint", "component_id")


def op2_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op4_hash_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *[F.col(f"q.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept")


def op6_segment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.format_conversations(chat.with_control_conversation(table(spark, sf_dir, "conversations"))))


def op8_langid_marginal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"))
    found = langid.predict(docs, langid.train(docs.where(~held)))
    return found.select(F.col("key").alias("doc_id"), langid.held_out(F.col("key")).alias("held_out"), "lang_pred", "score")


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents arrive in four batches, of which one is sent again under its number and once more under another;
    the latter is taken back, documents without a language are revised to ``und``, and the first batches are compacted."""
    counted = materialize(counts.count_documents(table(spark, sf_dir, "documents")))
    batch = lambda b: counted.where(counts.part_of(F.col("key"), 4) == b)
    roll = counts.Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    for b in range(4):
        roll.commit(b, counts.inserts(batch(b)))
    roll.commit(2, counts.inserts(batch(2)))
    roll.commit(4, counts.inserts(batch(1)))
    roll.commit(5, counts.deletes(batch(1)))
    unknown = counted.where("lang is null")
    roll.commit(6, counts.revisions(unknown, unknown.withColumn("lang", F.lit("und"))))
    roll.compact(5)
    return roll.totals()


def rollup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of op9 for the version that counts words."""
    return op9_token_rollup(spark, sf_dir).where("version = 'words/1'")


def op10_suffix_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(suffix.remove_repeats(table(spark, sf_dir, "documents"))).withColumnRenamed("key", "doc_id")


def op11_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigtree.near_sets(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op12_prefix_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_pca_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, moved)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash, op2_prefix_forest, op3_vector_packing, op4_hash_mix, op5_quality_rules, op6_segment_lines, op7_chat_format, op8_langid_marginal, op9_token_rollup, rollup_words, op10_suffix_buckets, op11_signature_trees, op12_prefix_growth, op13_pca_negatives)}

ORACLE_SQL: dict[str, str] = {"op4_hash_mix": mixing.ORACLE_OP4, "op5_quality_rules": quality.ORACLE_OP5, "op7_chat_format": chat.ORACLE_OP7, "rollup_words": counts.ORACLE_WORDS, "op11_signature_trees": sigtree.ORACLE_OP11, "op12_prefix_growth": phrases.ORACLE_OP12, "op13_pca_negatives": negatives.ORACLE_OP13}
