"""The corpus pipeline: five stages over the documents, each written and read again by the next.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``docs``, whatever further
ones there are and however they are called. In each stage a null text counts as empty, a null id names no other
document (it is never a copy, and never labelled), very long texts are read whole, and an empty table gives an
empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import bpe, decontam, jaccard, secrets, toxicity
from gaugeworks.llm.queries import tokenizer_path
from gaugeworks.llm.store import materialise, small_or_shuffled


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose neighbours vote for toxic (score of 0.5 and more) go. Repeated rows are judged alike; a text
    that shares no word with a labelled one has the base rate; without labels all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject(docs, toxicity.fit(docs, labels))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents one row with the least id stays, also where that id repeats; a document
    without words is a group of its own, and rows without an id stay."""
    judged = materialise(jaccard.near_duplicates(docs).select("doc_id", "component_id"), "judged")
    gone = materialise(judged.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    again = materialise(judged.where("component_id = doc_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    kept = docs.join(small_or_shuffled(gone, 8), "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return kept
    many = small_or_shuffled(again, 8)
    once = kept.join(many, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return kept.join(many, "doc_id", "left_anti").select(*docs.columns).unionAll(once)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one word in twenty or more lies in benchmark windows go; repeated rows are judged alike."""
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets, and n_chars, if there, follows; every document stays, repeated rows too."""
    out = secrets.redact(docs)
    if "n_chars" in docs.columns:
        changed = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(changed))
    return out.select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token_ids of every document left; a null or empty text has no tokens."""
    return bpe.encode(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("BPE encoding and decoding", encoding_stage),
]
#: Neighbour votes and components have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.split()[0])
    return docs
