"""The profile of a data set in one pass: counts, regions, sizes and light at three levels of grouping at once.

Each map is one row with the areas of its regions; a map's rows are one for each region (one without an area if it has none), of
which the first also speaks for the map. One grouping-sets aggregate then serves category, split and type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.columns import mean_of
from gaugeworks.operators.rasters import REGION, _regions


def profile(maps: DataFrame, category: str, split: str, kind: str, label: str, values: str, mask: str, height: int, width: int) -> DataFrame:
    """(level, category, split, kind): maps, anomalous ones and those with marked cells; regions, their number for each marked map,
    low percentiles, median and maximum of their areas and shares of the map; mean, deviation and range of the maps' means.

    Levels: "category", "split" (of a category), "kind" (of a split). Columns beyond a level are null."""
    areas = F.transform(F.pandas_udf(_regions, REGION)(F.col(mask), F.lit(height), F.lit(width)), lambda r: r["area"])
    own = maps.select(F.col(category).alias("category"), F.col(split).alias("split"), F.col(kind).alias("kind"), F.col(label).alias("_y"), mean_of(F.col(values)).alias("_m"), areas.alias("_a"))
    rows = own.select("category", "split", "kind", "_y", "_m", F.posexplode_outer("_a").alias("_k", "_area"))
    first = F.coalesce(F.col("_k"), F.lit(0)) == 0
    of_map = lambda c: F.when(first, c)
    area, marked = F.col("_area").cast("double"), F.count_if(first & F.col("_area").isNotNull())
    quantile = lambda q: F.percentile(area, F.lit(q))
    out = rows.groupingSets([["category"], ["category", "split"], ["category", "split", "kind"]], "category", "split", "kind").agg(
        F.grouping_id().alias("_g"),
        F.count_if(first).alias("n"),
        F.count_if(first & (F.col("_y") == 1)).alias("n_anomalous"),
        marked.alias("n_marked"),
        F.count("_area").alias("n_regions"),
        F.try_divide(F.count("_area"), marked).alias("regions_per_map"),
        *(quantile(q).alias(n) for q, n in ((0.01, "area_p1"), (0.05, "area_p5"), (0.5, "area_median"))),
        F.max(area).alias("area_max"),
        (quantile(0.5) / (height * width)).alias("share_median"),
        F.avg(of_map(F.col("_m"))).alias("light_mean"),
        F.stddev_pop(of_map(F.col("_m"))).alias("light_sd"),
        F.min(of_map(F.col("_m"))).alias("light_least"),
        F.max(of_map(F.col("_m"))).alias("light_most"),
    )
    level = F.when(F.col("_g") == 3, "category").when(F.col("_g") == 1, "split").otherwise("kind")
    return out.select(level.alias("level"), *(c for c in out.columns if c != "_g"))
