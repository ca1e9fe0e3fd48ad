"""The query of each corpus operator with production parameters, and SQL where it can express one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwarden.llm import alignment, bpe, conversations, digest, html, langid, lmscore, mixing, mpeg, pii, simhash, toxicity, wordbpe
from fieldwarden.session import table


def fold(divisor: int):
    """crc32 of doc_id as text, modulo the divisor: the held-out fold of the contract."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(divisor))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """by_shard: the words that each of the output shards takes, as a text."""
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", F.concat_ws(",", F.transform("by_shard", lambda x: x.cast("string"))).alias("by_shard"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learned = labels.where(fold(3) != 1).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.train(docs, learned)
    return toxicity.score(docs, model).select(
        "doc_id", (F.coalesce(fold(3), F.lit(0)) == 1).alias("held_out"), "score", "predicted"
    )


def op4_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.compare_edited(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


#: Stands for the secret that a production job gets from its key store.
PII_KEY = b"key of the registered queries"


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.found(table(spark, sf_dir, "documents"), PII_KEY)
    return rows.select("doc_id", "text", F.size("spans").alias("n_found"), "spans")


#: The vocabulary of op7; its path is a parameter of the operator.
RANKS = "byte_bpe_multi_50k.tiktoken"


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path(RANKS))
    return bpe.tokens(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(F.coalesce(fold(4), F.lit(0)) != 2).select("doc_id", "text", "lang"))
    found = langid.identify(docs, model)
    return found.select("doc_id", (F.coalesce(fold(4), F.lit(0)) == 2).alias("held_out"), "lang_pred", "score")


def op9_lm_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return lmscore.score(table(spark, sf_dir, "documents"), good)


def op10_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.store(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audit(conversations.damage(table(spark, sf_dir, "conversations")))


#: The vocabulary of op12; its path is a parameter of the operator.
WORDS = "word_bpe_49k.json"


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordbpe.tokens(table(spark, sf_dir, "documents"), wordbpe.load(public_tokenizers.path(WORDS)))


#: The vocabularies of op13, sides A and B; their paths are parameters of the operator.
SIDES = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = map(public_tokenizers.path, SIDES)
    return alignment.align(table(spark, sf_dir, "documents"), alignment.load(a, b, public_tokenizers.PATTERN))


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_source_mix": op2_source_mix,
    "op3_toxicity": op3_toxicity,
    "op4_quartile_digest": op4_quartile_digest,
    "op5_simhash": op5_simhash,
    "op6_pii_pseudonyms": op6_pii_pseudonyms,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_language_id": op8_language_id,
    "op9_lm_cross_entropy": op9_lm_cross_entropy,
    "op10_mpeg_audio": op10_mpeg_audio,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_word_bpe": op12_word_bpe,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}
ORACLE_SQL: dict[str, str] = {"op2_source_mix": mixing.SQL}
