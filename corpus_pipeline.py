"""From raw documents to token ids: stages that each write what the next one reads.

Stages hand on the five columns of documents and drop further ones. Null and empty texts are clean, equal to each other
for the near-copy stage, and encoded as no ids; null ids are ids like others, the last. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.llm import bpe, decontaminate, linededup, simhash, toxicity
from carelake.llm.common import small, table, written
from carelake.llm.queries import WORD_BPE, held_out

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents that score so much are rejected.
TOXIC_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC_FROM; fitted on labels that are not held out."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out())
    return toxicity.score(docs, model, keep=tuple(COLUMNS)).where(F.col("score") < TOXIC_FROM).select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that stand elsewhere before; n_chars follows where a text has changed."""
    short = linededup.dedup_lines(docs, ("lang", "source", "n_chars"))
    n_chars = F.when(F.col("removed_chunks") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return short.withColumn("n_chars", n_chars).select(COLUMNS)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents that are not among `gone` (doc_id, text_key)."""
    gone = small(written(gone.distinct(), "gone")).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"))
    same = docs["doc_id"].eqNullSafe(F.col("gone_id")) & (F.xxhash64(docs["text"]) == F.col("gone_key"))
    return docs.join(gone, same, "left_anti")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (two bits over three words): that with the smallest id, ids before none."""
    kept = _without(docs, simhash.surplus(docs))
    if docs.groupBy("doc_id", F.xxhash64("text")).count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "text"])  # rows alike in both: the first of its group may be there twice
    return kept.select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.select("doc_id", "text_key")).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids; a word that its ids don't decode to fails the stage."""
    return bpe.encode_decode(docs, bpe.read_spec(spark, WORD_BPE), keep=tuple(COLUMNS), arrays=True, decoded=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("encode", encode),
]

#: Toxicity is a fitted model and encoding is no SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from the documents table on, each one's result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
