"""The queries of this folder's operators: thin, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import best_two_fit, hmm_lm, html_tagpath, langid_segments, license_minhash, lsi_decontam, simhash_ball, telephony, token_shards, toxicity_kn
from brindle.llm.common import fold, read_table
from brindle.llm.tokens import vocabulary_path


def unsigned_hex(column: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def op1_html_tagpath(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tagpath.extract(read_table(spark, sf_dir, "pages"))


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    shards = token_shards.write_shards(docs, vocabulary_path("byte_bpe_50k.json"), end_id=0)
    index, buckets = token_shards.build_index(shards)
    located = token_shards.lookup(docs.select("doc_id"), index, buckets)
    return token_shards.read_records(located, shards).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32", "shard", "copy")


def op3_lsi_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lsi_decontam.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "cosine", "lcs_share")


def op4_license_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_minhash.scan(read_table(spark, sf_dir, "documents", dealt=False))


def op5_toxicity_kn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    models = toxicity_kn.fit(docs, read_table(spark, sf_dir, "labels"), learn=fold("k", 5) != 0)
    scored = toxicity_kn.score(docs, models)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_langid_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid_segments.fit(docs, vocabulary_path("piece_bpe_32k.model"), learn=fold("k", 4) != 2)
    found = langid_segments.predict(docs, model)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op7_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_ball.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", unsigned_hex("fp").alias("fingerprint"), "component_id")


def op8_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = hmm_lm.score(read_table(spark, sf_dir, "documents"), fold("k", 5) != 1)
    return scored.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = telephony.store_texts(read_table(spark, sf_dir, "documents"), block=192, codec="mulaw", rate=16000)
    return telephony.digest(stored, block=192).withColumnRenamed("key", "doc_id")


def op10_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    pieces = best_two_fit.cut_pieces(docs, vocabulary_path("word_bpe_49k.json"), end_id=1, capacity=4096)
    return best_two_fit.pack(pieces, capacity=4096).withColumnRenamed("key", "doc_id")


QUERIES = {f.__name__: f for f in (op1_html_tagpath, op2_token_shards, op3_lsi_decontam, op4_license_minhash, op5_toxicity_kn, op6_langid_segments, op7_simhash_ball, op8_hmm_lm, op9_telephony, op10_best_two_fit)}
ORACLE_SQL: dict[str, str] = {"op4_license_minhash": license_minhash.oracle_sql()}
