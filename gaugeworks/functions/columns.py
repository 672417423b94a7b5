"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(score: Column) -> Column:
    """``score`` as double; a NaN or infinite value stops the query."""
    s = score.cast("double")
    bad = F.isnan(s) | (F.abs(s) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("non-finite score")).cast("double")).otherwise(s)


def binary(label: Column) -> Column:
    """``label`` as int; a value other than 0 and 1 stops the query."""
    y = label.cast("int")
    return F.when(y.isin(0, 1), y).otherwise(F.raise_error(F.concat(F.lit("label not in {0,1}: "), F.coalesce(label.cast("string"), F.lit("null")))).cast("int"))


def seeded(seed: int | str, id: Column) -> Column:
    """The seeded order of an id: one fixed order for every engine and every partitioning."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), id.cast("string")), 256)


def uniform(seed: int | str, id: Column) -> Column:
    """A seeded draw in [0, 1) for an id."""
    return F.conv(F.substring(seeded(seed, id), 1, 8), 16, 10).cast("double") / 4294967296.0


def above(score: Column, threshold: Column | float) -> Column:
    """The strict decision: a score equal to the threshold is no alarm."""
    return score > (threshold if isinstance(threshold, Column) else F.lit(float(threshold)))


def share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def decision(ok: Column, score: Column, threshold: Column) -> Column:
    return F.when(~ok, "refused").when(score > threshold, "anomalous").otherwise("normal")


def relative_id(path: Column, root: str) -> Column:
    start = root.rstrip("/") + "/"
    return F.when(path.startswith(start), F.substr(path, F.lit(len(start) + 1))).otherwise(path)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def target_size(width: Column, height: Column, mode: str, long_side: int | None = None, short_side: int | None = None) -> tuple[Column, Column]:
    """Output size; scaled lengths are rounded half to even and are one at least."""
    if mode == "none":
        return width, height
    if mode == "square":
        return F.lit(long_side), F.lit(long_side)
    scale = F.lit(float(long_side)) / F.greatest(width, height) if long_side else F.lit(float(short_side)) / F.least(width, height)
    side = lambda n: F.greatest(F.lit(1), F.bround(n * scale).cast("int"))
    return side(width), side(height)


def top_fraction_mean(values: Column, fraction: float) -> Column:
    """Mean of the largest max(1, round-half-even(fraction * n)) values."""
    n = F.greatest(F.lit(1), F.bround(F.size(values) * F.lit(float(fraction))).cast("int"))
    top = F.slice(F.sort_array(values, False), F.lit(1), n)
    return F.aggregate(top, F.lit(0.0), lambda s, x: s + x) / n


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


#: Rules from a map of scores to one score.
AGGREGATIONS = {
    "max": lambda m: F.array_max(m),
    "mean": mean_of,
    "top_0.1": lambda m: top_fraction_mean(m, 0.001),
    "top_1": lambda m: top_fraction_mean(m, 0.01),
    "top_5": lambda m: top_fraction_mean(m, 0.05),
}
