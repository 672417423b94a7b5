"""The driver tables as the engine's inputs: scores with labels, 8x8 maps, hashes, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators.integrity import sign_hash
from gaugeworks.operators.pooled import pixels


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with labels: an error event is anomalous, its type the defect type, its user the object."""
    e = read(spark, sf_dir, "events")
    split = F.when(F.pmod("user_id", F.lit(3)) == 0, "validation").otherwise("test")
    return e.select("event_id", "user_id", "event_type", F.col("value").alias("score"), (F.col("event_type") == "error").cast("int").alias("label"), split.alias("split"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores at bench scale: a returned line is anomalous."""
    x = read(spark, sf_dir, "lineitem")
    return x.select("l_orderkey", "l_linenumber", "l_shipmode" if "l_shipmode" in x.columns else "l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("label"), F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 2).alias("score"))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "source", F.col("toxic").alias("label"), F.col("n_chars").cast("double").alias("score"))


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as row-major 8x8 maps: labels of five and more count as anomalous images."""
    v = read(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.col("label").alias("category"), (F.col("label") >= 5).cast("int").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("map"))


def truth() -> Column:
    """The ground truth of a cell: anomalous images, upper half, a value over 0.1."""
    return (F.col("label") == 1) & (F.col("_pos") < 32) & (F.col("_value") > 0.1)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(maps(spark, sf_dir), "vec_id", "map", truth(), ("label", "category"))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps(spark, sf_dir).select("vec_id", "category", sign_hash(F.col("map")).alias("bits"))
