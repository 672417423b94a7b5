"""Queries on patch memories, profiles, fusion and the image-level branch; see :mod:`gaugeworks.plans.catalog`."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import fusion, global_branch, grids, patch_memory, profile
from gaugeworks.plans import tables as T
from gaugeworks.plans.catalog import CELLS, MAPS, query, rounded
from gaugeworks.plans.catalog_models import REGIONS, masked
from gaugeworks.plans.catalog_studies import unit

# --- patches -----------------------------------------------------------------------------------


@query(
    f"WITH {MAPS} SELECT vec_id, CAST(p AS INT) AS patch, round(list_max(v), 6) AS high, round(list_sum(v) / 9, 6) AS mean FROM (SELECT vec_id, p, "
    "list_transform(range(9), lambda k: map[1 + greatest(0, least(7, p // 8 + k // 3 - 1)) * 8 + greatest(0, least(7, p % 8 + k % 3 - 1))]) AS v FROM (SELECT vec_id, map, unnest(range(64)) AS p FROM m))"
)
def patch_features(spark, d):
    p = patch_memory.patches(T.maps(spark, d), "vec_id", "map", 8, 8)
    return rounded(p.select("vec_id", "patch", F.array_max("v").alias("high"), (F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / 9).alias("mean")))


@query()
def patch_memory_scores(spark, d):
    """Every image's farthest patch from a bank of 100 that covers the patches of all normals."""
    p = patch_memory.patches(T.maps(spark, d), "vec_id", "map", 8, 8, keep=("label",))
    bank = patch_memory.k_centre(p.where("label = 0"), ("vec_id", "patch"), "v", 100, seed=1)
    return rounded(patch_memory.scores(patch_memory.nearest(p.select("vec_id", "patch", "v"), bank, "v"), "vec_id"))


# --- profile -----------------------------------------------------------------------------------

KIND = "CASE WHEN label = 0 THEN 'good' WHEN vec_id % 2 = 0 THEN 'pit' ELSE 'crack' END"


@query(
    f"WITH RECURSIVE {CELLS}, {REGIONS}, i AS (SELECT vec_id, category, CASE vec_id % 3 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' ELSE 'train' END AS split, {KIND} AS kind, label, list_sum(map) / 64 AS light, coalesce(n, 0) AS n FROM m LEFT JOIN (SELECT vec_id, count(*) AS n FROM r GROUP BY vec_id) USING (vec_id)), "
    "j AS (SELECT category, split, kind, CAST(area AS DOUBLE) AS area FROM i JOIN r USING (vec_id)), "
    "a AS (SELECT category, split, kind, grouping(split) + grouping(kind) AS g, count(*) AS n, count(*) FILTER (label = 1) AS n_anomalous, count(*) FILTER (n > 0) AS n_marked, CAST(sum(n) AS BIGINT) AS n_regions, round(sum(n) / nullif(count(*) FILTER (n > 0), 0), 6) AS regions_per_map, "
    "round(avg(light), 6) AS light_mean, round(stddev_pop(light), 6) AS light_sd, round(min(light), 6) AS light_least, round(max(light), 6) AS light_most FROM i GROUP BY GROUPING SETS ((category), (category, split), (category, split, kind))), "
    "b AS (SELECT category, split, kind, grouping(split) + grouping(kind) AS g, round(quantile_cont(area, 0.01), 6) AS area_p1, round(quantile_cont(area, 0.05), 6) AS area_p5, round(median(area), 6) AS area_median, max(area) AS area_max, round(median(area) / 64, 6) AS share_median FROM j GROUP BY GROUPING SETS ((category), (category, split), (category, split, kind))) "
    "SELECT CASE a.g WHEN 2 THEN 'category' WHEN 1 THEN 'split' ELSE 'kind' END AS level, a.category, a.split, a.kind, n, n_anomalous, n_marked, n_regions, regions_per_map, area_p1, area_p5, area_median, area_max, share_median, light_mean, light_sd, light_least, light_most "
    "FROM a LEFT JOIN b ON a.g = b.g AND a.category = b.category AND a.split IS NOT DISTINCT FROM b.split AND a.kind IS NOT DISTINCT FROM b.kind"
)
def category_profile(spark, d):
    own = masked(spark, d).withColumn("split", F.expr("CASE vec_id % 3 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' ELSE 'train' END")).withColumn("kind", F.expr(KIND))
    return rounded(profile.profile(own, "category", "split", "kind", "label", "map", "mask", 8, 8))


# --- fusion ------------------------------------------------------------------------------------


def components(spark, d):
    """Two models' maps: the map and its mirror image, which scatters more."""
    m = T.maps(spark, d)
    other = F.transform(F.reverse("map"), lambda x: x * 1.5 + 0.1)
    return m.select("vec_id", "label", F.explode(F.array(F.struct(F.lit("a").alias("component"), F.col("map").alias("v")), F.struct(F.lit("b").alias("component"), other.alias("v")))).alias("x")).select("vec_id", "label", "x.*")


def levels(spark, d):
    return fusion.tail_levels(components(spark, d).where("label = 0").select("component", F.explode("v").alias("value")), "component", "value", 512)


TAIL = (
    "cm AS (SELECT vec_id, label, 'a' AS component, map AS v FROM m UNION ALL SELECT vec_id, label, 'b', list_transform(list_reverse(map), lambda x: x * 1.5::DOUBLE + 0.1::DOUBLE) FROM m), "
    "vc AS (SELECT component, unnest(v) AS x FROM cm WHERE label = 0), en AS (SELECT component, min(x) AS lo, max(x) AS hi FROM vc GROUP BY component), "
    "hb AS (SELECT component, lo, hi, CAST(least(floor((x - lo) / ((hi - lo) / 512)), 511) AS INT) AS b, count(*) AS n FROM vc JOIN en USING (component) GROUP BY ALL), "
    "tl AS (SELECT component, lo, hi, b, sum(n) OVER (PARTITION BY component ORDER BY b DESC) / sum(n) OVER (PARTITION BY component) AS t FROM hb), "
    "lv AS (SELECT component, " + ", ".join(f"coalesce(min(lo + b * ((hi - lo) / 512)) FILTER (t <= {q}), max(hi)) AS q{k}" for k, q in enumerate(fusion.TAILS)) + " FROM tl GROUP BY component), "
    "sc AS (SELECT component, unnest(['p95', 'p99', 'z']) AS kind, unnest([0, 0, q3]) AS off, unnest([q1, q0, greatest((q2 - q3 - (q4 - q3)) / 1.349, 1e-9)]) AS scale FROM lv)"
)


@query(f"WITH {MAPS}, {TAIL} SELECT kind, component, round(off, 6) AS \"offset\", round(scale, 6) AS scale FROM sc")
def fusion_scales(spark, d):
    at = levels(spark, d)
    out = None
    for kind in fusion.SCALES:
        one = fusion.scales(at, "component", kind).select(F.lit(kind).alias("kind"), "component", "offset", "scale")
        out = one if out is None else out.unionAll(one)
    return rounded(out)


SPOTS = (
    "gr AS (SELECT vec_id, pos, least(1.0::DOUBLE, greatest(0.0::DOUBLE, value + 0.5)) AS g FROM c), "
    "nb AS (SELECT unnest([0, 0, 0, 1, -1]) AS i, unnest([0, 1, -1, 0, 0]) AS j), "
    "er AS (SELECT a.vec_id, a.pos, min(b.g) AS g FROM gr a, nb JOIN gr b ON b.vec_id = a.vec_id AND b.pos // 8 = a.pos // 8 + i AND b.pos % 8 = a.pos % 8 + j GROUP BY ALL), "
    "op AS (SELECT a.vec_id, a.pos, max(b.g) AS g FROM er a, nb JOIN er b ON b.vec_id = a.vec_id AND b.pos // 8 = a.pos // 8 + i AND b.pos % 8 = a.pos % 8 + j GROUP BY ALL), "
    "pk AS (SELECT gr.vec_id, gr.pos FROM gr JOIN op USING (vec_id, pos) WHERE gr.g - op.g > 0.1 AND gr.g > 0.7), "
    "sp AS (SELECT DISTINCT c.vec_id, c.pos FROM c JOIN pk ON pk.vec_id = c.vec_id AND abs(pk.pos // 8 - c.pos // 8) <= 1 AND abs(pk.pos % 8 - c.pos % 8) <= 1), "
    "fc AS (SELECT vec_id, kind, pos, max((x - off) / scale) AS x FROM (SELECT vec_id, component, unnest(range(64)) AS pos, unnest(v) AS x FROM cm) JOIN sc USING (component) GROUP BY ALL), "
    "dm AS (SELECT vec_id, kind, fc.pos, CASE WHEN sp.pos IS NULL THEN x ELSE x * 0.5::DOUBLE END AS x FROM fc LEFT JOIN sp USING (vec_id, pos))"
)


@query(f"WITH {CELLS}, {TAIL}, {SPOTS} SELECT vec_id, kind, round(max(x) - median(x), 6) AS score FROM dm GROUP BY vec_id, kind")
def fused_scores(spark, d):
    """The peak over its own background of the larger of two scaled maps, highlights damped, under each of three scales."""
    at, parts = levels(spark, d).cache(), components(spark, d)
    spots = unit(spark, d).select("vec_id", fusion.highlights(1, 0.1, 0.7)("map", F.lit(8), F.lit(8)).alias("spots"))
    out = None
    for kind in fusion.SCALES:
        one = fusion.fused(parts, "vec_id", "component", "v", fusion.scales(at, "component", kind), "max", spots, 0.5, "sub-median", components=2)
        one = one.select("vec_id", F.lit(kind).alias("kind"), F.array_max("map").alias("score"))
        out = one if out is None else out.unionAll(one)
    return rounded(out)


# --- image-level branch ------------------------------------------------------------------------


def layered(spark, d):
    return T.maps(spark, d).select("vec_id", "label", F.slice("map", 1, 24).alias("l1"), F.slice("map", 25, 40).alias("l2"))


@query()
def global_branch_scores(spark, d):
    """Gaussian and neighbour scores of every image, standardised by the normals that were not fitted on."""
    own = layered(spark, d)
    train, val = own.where("label = 0 AND vec_id % 3 <> 0"), own.where("label = 0 AND vec_id % 3 = 0").select("vec_id")
    g = global_branch.gaussian_scores(own, train, "vec_id", ("l1", "l2"))
    n = global_branch.neighbour_scores(own, train, "vec_id", ("l1", "l2"), exclude_self=True)
    each = [global_branch.standardised(s, s.join(val, "vec_id")).withColumnRenamed("score", c) for s, c in ((g, "gaussian"), (n, "neighbours"))]
    return rounded(each[0].join(each[1], "vec_id"))


# --- experiment grids --------------------------------------------------------------------------

BASE = {"brand": "Brand#11", "size": "7"}


def planned(spark, d):
    """A sweep over the brands and sizes of parts, on every region."""
    axes = T.read(spark, d, "part").select(F.explode(F.array(F.struct(F.lit("brand").alias("axis"), F.col("p_brand").alias("value")), F.struct(F.lit("size").alias("axis"), F.col("p_size").cast("string").alias("value")))).alias("x")).select("x.*")
    return grids.sweep(axes, "axis", "value", T.read(spark, d, "region"), "r_name", BASE, (0, 1, 2), "CAST(settings['size'] AS INT) <= 40")


GRID = (
    "ax AS (SELECT DISTINCT 'brand' AS a, p_brand AS v FROM part WHERE p_brand <> 'Brand#11' UNION SELECT DISTINCT 'size', CAST(p_size AS VARCHAR) FROM part WHERE p_size <> 7), "
    "vr AS (SELECT 'sweep' AS \"group\", a || '=' || v AS variant, CASE a WHEN 'brand' THEN v ELSE 'Brand#11' END AS brand, CASE a WHEN 'size' THEN v ELSE '7' END AS size, 0 AS seed FROM ax UNION ALL SELECT 'reference', 'base', 'Brand#11', '7', unnest([0, 1, 2])), "
    "pl AS (SELECT \"group\", r_name AS category, r_regionkey, seed, variant, substr(sha256('brand=' || brand || ',category=' || r_name || ',seed=' || seed || ',size=' || size), 1, 12) AS digest FROM vr, region WHERE CAST(size AS INT) <= 40)"
)


@query(f"WITH {GRID} SELECT \"group\", category, CAST(seed AS INT) AS seed, variant, digest FROM pl WHERE r_regionkey <> 0")
def experiment_plan(spark, d):
    """What is left of the sweep when the runs of one region are in the registry."""
    runs = planned(spark, d)
    done = runs.join(T.read(spark, d, "region").where("r_regionkey = 0").select(F.col("r_name").alias("category")), "category")
    return grids.unfinished(runs, done).drop("settings")


@query(
    "WITH v AS (SELECT 'size=' || (l_suppkey % 23) AS variant, l_linenumber % 3 AS category, l_discount AS o, l_tax AS t, l_quantity AS q FROM lineitem), g AS (SELECT variant, category, count(*) AS n, avg(o) AS o, avg(t) AS t, var_samp(t) AS s, avg(q) AS q FROM v GROUP BY ALL), "
    "p AS (SELECT a.variant, a.category, a.o - b.o AS og, a.t - b.t AS dt, abs(a.t - b.t) > 0.5 * sqrt(a.s / a.n + b.s / b.n) AS sig, a.q AS q FROM g a JOIN g b ON b.category = a.category AND b.variant = 'size=0' WHERE a.variant <> 'size=0'), "
    "z AS (SELECT variant, count(*) AS categories, count(*) FILTER (og > 0) AS improved, min(og) AS worst, count(*) FILTER (sig AND dt > 0) AS better, count(*) FILTER (sig AND dt < 0) AS worse, max(q) AS cost FROM p GROUP BY variant) "
    "SELECT variant, categories, improved, round(worst, 6) AS worst, better, worse, round(cost, 6) AS cost, CASE WHEN improved >= 1 AND worst >= -0.01 AND better >= 1 AND worse = 0 THEN CASE WHEN cost < 25.8 THEN 'adopted' ELSE 'accuracy only' END ELSE 'not adopted' END AS verdict FROM z"
)
def sweep_decision(spark, d):
    """The decision on each variant from its paired differences to the base on three categories."""
    v = T.read(spark, d, "lineitem").select(F.concat(F.lit("size="), (F.col("l_suppkey") % 23).cast("string")).alias("variant"), (F.col("l_linenumber") % 3).alias("category"), "l_discount", "l_tax", "l_quantity")
    g = v.groupBy("variant", "category").agg(F.count("*").alias("n"), F.avg("l_discount").alias("o"), F.avg("l_tax").alias("t"), F.var_samp("l_tax").alias("s"), F.avg("l_quantity").alias("q"))
    b = g.where("variant = 'size=0'").select("category", *(F.col(c).alias(f"{c}0") for c in ("n", "o", "t", "s")))
    p = g.where("variant <> 'size=0'").join(F.broadcast(b), "category")  # a row for each category
    p = p.select("variant", "category", (F.col("o") - F.col("o0")).alias("do"), (F.col("t") - F.col("t0")).alias("dt"), "q", F.expr("abs(t - t0) > 0.5D * sqrt(s / n + s0 / n0)").alias("sig"))
    return rounded(grids.decided(p, "variant", "do", "dt", "sig", "q", 25.8, least=1))
