"""Seeded selections and partitions of a table by hash rank, alike in every engine.

A global rank is taken without one task holding all rows: ids fall into ranges of their hash (its
first hex digits), a window ranks within a range, and the ranges' counts are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.columns import seeded


def ranked(df: DataFrame, id: str, seed: int | str, by: tuple[str, ...] = (), into: str = "rank") -> DataFrame:
    """``df`` with the 1-based seeded rank of its rows, within ``by``."""
    own = df.withColumn("_h", seeded(seed, F.col(id))).withColumn("_r", F.substring("_h", 1, 2))
    before = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    counts = own.groupBy(*by, "_r").agg(F.count("*").alias("_c")).select(*by, "_r", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_b"))
    inside = Window.partitionBy(*by, "_r").orderBy("_h", id)
    return own.join(counts, [*by, "_r"]).withColumn(into, (F.row_number().over(inside) + F.col("_b")).cast("long")).drop("_h", "_r", "_b")


def first_of(df: DataFrame, id: str, n: int, seed: int | str) -> DataFrame:
    """``n`` rows in seeded order; larger n contain smaller ones."""
    return df.orderBy(seeded(seed, F.col(id)), id).limit(n)


def carve(train: DataFrame, id: str, fraction: float, seed: int | str, least: int = 1, label: str | None = None) -> DataFrame:
    """``train`` with split "train" or "validation": max(least, round-half-even(fraction n)) validation rows.
    With ``label``, an anomalous row stops the query."""
    own = ranked(train, id, seed)
    if label:
        own = own.withColumn(label, F.when(F.col(label) == 1, F.raise_error(F.lit("anomalous row in a training split")).cast("int")).otherwise(F.col(label)))
    n = train.agg(F.greatest(F.lit(least), F.bround(F.count("*") * F.lit(float(fraction)))).cast("long").alias("_n"))
    return own.crossJoin(F.broadcast(n)).withColumn("split", F.when(F.col("rank") <= F.col("_n"), "validation").otherwise("train")).drop("_n", "rank")


def ensure_validation(df: DataFrame, id: str, split: str, fraction: float, seed: int | str) -> DataFrame:
    """``df`` as it is when it has validation rows, else with some carved from its training rows."""
    if not df.where(F.col(split) == "validation").isEmpty():
        return df
    rest = df.where(F.col(split) != "train")
    cut = carve(df.where(F.col(split) == "train").drop(split), id, fraction, seed).withColumnRenamed("split", split)
    return rest.unionByName(cut)


def folds(df: DataFrame, id: str, k: int, seed: int | str) -> DataFrame:
    """``df`` with fold 0 to k - 1, sizes differing by one at most."""
    return ranked(df, id, seed).withColumn("fold", F.pmod(F.col("rank") - 1, F.lit(k)).cast("int")).drop("rank")


def cluster_fold(cluster: Column, k: int, seed: int | str) -> Column:
    """The fold of a whole cluster, from its hash alone."""
    return F.pmod(F.conv(F.substring(seeded(seed, cluster), 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int")


def draws(df: DataFrame, id: str, n_draws: int, size: int, seed: int | str) -> DataFrame:
    """``n_draws`` seeded samples of ``size`` rows without replacement, with the column draw.

    A draw takes its rows of least hash. Only rows whose hash lies below a generous bound go on to be ranked, so a draw's
    window holds about ``size`` rows; should the bound have left a draw too few, all rows are ranked."""
    n = df.count()
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("draw").cast("string"), F.lit(":"), F.col(id).cast("string")), 256)
    own = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1)))).withColumn("_h", h)
    likely = (size + 6.0 * size**0.5 + 20.0) / max(n, 1)
    if likely < 0.5:
        few = own.where(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") < int(likely * 2**32)).persist()
        enough = few.groupBy("draw").agg(F.count("*").alias("_n")).where(F.col("_n") >= size).count() == n_draws
        own = few if enough else own
    w = Window.partitionBy("draw").orderBy("_h", id)
    return own.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= size).drop("_r", "_h")


def listing_digest(df: DataFrame, id: str, by: tuple[str, ...]) -> DataFrame:
    """Count and digest of the set of ids of each group: a sum of hashes, so no list is gathered."""
    part = lambda k: F.conv(F.substring(F.sha2(F.col(id).cast("string"), 256), k, 8), 16, 10).cast("long")
    own = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(part(1)).alias("_a"), F.bit_xor(part(9)).alias("_b"))
    return own.select(*by, "n", F.left(F.sha2(F.concat_ws(":", "n", "_a", "_b"), 256), F.lit(16)).alias("digest"))
