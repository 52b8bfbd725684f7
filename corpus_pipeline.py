"""The corpus pipeline: language ID, near-dedup, substring dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. Between
stages the documents are written as Parquet to the folder all executors share and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatt.llm._common import small, text_of, written
from tidewatt.llm.decontaminate import key_of, occurrences
from tidewatt.llm.language_id import UNDETERMINED, fit, identify
from tidewatt.llm.mixing import mix
from tidewatt.llm.near_dedup import near_duplicates
from tidewatt.llm.span_dedup import span_dedup

#: A language must be more probable than by chance: by this part of what chance leaves.
ABOVE_CHANCE = 0.1


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter, or of no language clearly above chance (one of the number
    of learned languages), go."""
    net = fit(docs)
    chance = 1 / max(1, len(net.languages)) if net else 0.0
    least = chance + ABOVE_CHANCE * (1 - chance) - 1e-6
    found = identify(docs, net)
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select(*docs.columns)


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, key): the columns in a struct, so that none of any name meets others, and the digest of the text."""
    return docs.select(F.struct(*docs.columns).alias("row"), key_of(text_of(docs)).alias("key"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: of least doc_id, or of least digest where none has an id. Rows
    are told by doc_id and text, null ids included; of wholly equal rows one stays."""
    found = written(near_duplicates(docs).select("doc_id", "text_key", "kept"), "near")
    keyed = _keyed(docs).withColumn("id", F.col("row.doc_id").cast("long"))

    def of(rows: DataFrame) -> DataFrame:
        return small(written(rows.select("doc_id", "text_key").distinct(), "rows"))

    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key"))
    again = of(found.where("kept").groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1"))
    once = keyed.join(of(found.where("not kept")), same, "left_anti").join(again, same, "left_anti")
    return once.unionByName(keyed.join(again, same, "left_semi").dropDuplicates(["id", "key"])).select("row.*")


def span_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated runs of sentences, n_chars to match; documents with nothing left go."""
    out = span_dedup(docs)
    left = out.where((F.col("n_removed") == 0) | (F.trim(F.translate("text", "\n\r\t\f\v", "     ")) != ""))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return left.withColumn("n_chars", n_chars).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark; a text that does goes in all its rows, whatever their ids."""
    hits = occurrences(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = small(written(hits.select(F.col("doc_key").alias("key")).distinct(), "contaminated"))
    return _keyed(docs).join(gone, "key", "left_anti").select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mix(docs)


STAGES = [
    ("language ID", language_stage),
    ("near-dedup", near_dedup_stage),
    ("substring dedup", span_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: A trained network and minhashes decide in it, which SQL can't express; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{i + 1}")
    return docs
