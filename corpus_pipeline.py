"""The corpus pipeline: documents pass five stages, each written as Parquet and read again by the next.

1. toxicity: documents that the class-conditional Kneser-Ney models find toxic go.
2. language: documents without a language that the vocabulary's unigrams can tell (`und`) go.
3. near-duplicates: of each component of the SimHash ball join the first document stays.
4. decontamination: documents that hold a passage of the benchmark go.
5. packing: what is left is packed into sequences; one row for each piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import best_two_fit, langid_segments, lsi_decontam, simhash_ball, toxicity_kn
from brindle.llm.common import read_table, stored
from brindle.llm.tokens import vocabulary_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity score of 0.5 or more. A document's score depends on its text alone."""
    models = toxicity_kn.fit(docs, read_table(spark, sf_dir, "labels"), learn=F.lit(True))
    return toxicity_kn.keep_below(docs, models, 0.5)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is undetermined."""
    model = langid_segments.fit(docs, vocabulary_path("piece_bpe_32k.model"), learn=F.lit(True))
    return langid_segments.keep_known(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the one with the smallest doc_id."""
    return simhash_ball.keep_first(docs, shingle=3, radius=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage, verbatim or paraphrased."""
    return lsi_decontam.keep_clean(docs, lsi_decontam.find_leaks(docs, read_table(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places."""
    pieces = best_two_fit.cut_pieces(docs, vocabulary_path("word_bpe_49k.json"), end_id=1, capacity=4096)
    return best_two_fit.pack(pieces, capacity=4096).withColumnRenamed("key", "doc_id")


STAGES = [("toxicity", toxicity), ("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: The models' numbers can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
