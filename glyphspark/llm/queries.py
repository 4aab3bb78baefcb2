"""One query for each operator over its whole table, and SQL where it can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, fim, jaccard, langid, mixing, pairrank, quality, repair, secrets, sharding, tokencount, toxicity
from .common import WORD, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversation_digests(chat.with_probe(table(spark, sf_dir, "conversations"))).drop("n_tokens")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    none = F.lit("")
    taken = mixing.mix(docs)
    domain, epochs = taken.columns[-2:]
    return taken.select("doc_id", F.col(domain).alias("domain"), F.coalesce("lang", none).alias("lang"), F.coalesce("source", none).alias("source"), words.alias("n_tokens"), F.col(epochs).alias("epochs"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fim_digests(table(spark, sf_dir, "documents"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairrank.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair.repair_digests(repair.damage(turns), turns)


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_toxicity, op3_chat_formatting, op4_sharding, op5_quality_rules, op6_benchmark_decontamination, op7_language_id, op8_token_counts, op9_ngram_jaccard, op10_source_mixing, op11_fill_in_middle, op12_quality_classifier, op13_conversation_repair)}

ORACLE_SQL: dict[str, str] = {"op3_chat_formatting": chat.ORACLE_SQL, "op10_source_mixing": mixing.ORACLE_SQL, "op11_fill_in_middle": fim.ORACLE_SQL, "op13_conversation_repair": repair.ORACLE_SQL}
