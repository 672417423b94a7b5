"""Queries on maps, vectors and studies; see :mod:`gaugeworks.plans.catalog`."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions import columns as C
from gaugeworks.functions.kernels import PERTURBATIONS
from gaugeworks.operators import injections, neighbours, pooled, predictions, ranking, rasters, splits, statistics, studies, thresholds
from gaugeworks.plans import tables as T
from gaugeworks.plans.catalog import AUROC, CELLS, EVENTS, KTH, MAPS, ORACLE, VAL, query, rounded

REGIONS = "g AS (SELECT vec_id, pos, value FROM c WHERE truth), k AS (SELECT vec_id, pos, pos AS root FROM g UNION SELECT k.vec_id, g.pos, k.root FROM k JOIN g ON g.vec_id = k.vec_id AND abs(g.pos // 8 - k.pos // 8) <= 1 AND abs(g.pos % 8 - k.pos % 8) <= 1), l AS (SELECT vec_id, pos, min(root) AS region FROM k GROUP BY ALL), r AS (SELECT vec_id, region, count(*) AS area, min(pos // 8) AS top, min(pos % 8) AS \"left\", max(pos // 8) + 1 AS bottom, max(pos % 8) + 1 AS \"right\" FROM l GROUP BY ALL)"


def masked(spark, d):
    m = T.maps(spark, d)
    at = F.transform("map", lambda x, i: (F.col("label") == 1) & (i < 32) & (x > 0.1))
    return m.withColumn("mask", at)


def found(spark, d):
    return rasters.regions(masked(spark, d), "vec_id", "mask", 8, 8)


@query(f"WITH RECURSIVE {CELLS}, {REGIONS} SELECT vec_id, CAST(region AS INT) AS region, CAST(area AS INT) AS area, CAST(top AS INT) AS top, CAST(\"left\" AS INT) AS \"left\", CAST(bottom AS INT) AS bottom, CAST(\"right\" AS INT) AS \"right\" FROM r")
def connected_regions(spark, d):
    return found(spark, d).drop("cells")


CONTRAST = (
    "ring AS (SELECT DISTINCT l.vec_id, l.region, c.pos, c.value FROM l JOIN c ON c.vec_id = l.vec_id AND NOT c.truth AND abs(c.pos // 8 - l.pos // 8) + abs(c.pos % 8 - l.pos % 8) <= 4), "
    "z AS (SELECT vec_id, region, area, least(bottom - top, \"right\" - \"left\") AS extent, 2 * sqrt(area / pi()) AS diameter, abs(i.m - o.m) AS contrast FROM r "
    "JOIN (SELECT l.vec_id, l.region, avg(value) AS m FROM l JOIN c USING (vec_id, pos) GROUP BY ALL) i USING (vec_id, region) LEFT JOIN (SELECT vec_id, region, avg(value) AS m FROM ring GROUP BY ALL) o USING (vec_id, region))"
)


def measured(spark, d):
    return rasters.measured(masked(spark, d), "vec_id", "mask", "map", 8, 8)


@query(f"WITH RECURSIVE {CELLS}, {REGIONS}, {CONTRAST} SELECT vec_id, CAST(region AS INT) AS region, CAST(area AS INT) AS area, round(diameter, 6) AS diameter, round(contrast, 6) AS contrast FROM z")
def region_contrast(spark, d):
    return rounded(measured(spark, d).select("vec_id", "region", "area", "diameter", "contrast"))


def _p(column, name, *levels):
    return ", ".join(f"round(quantile_cont({column}, {q / 100}), 6) AS {name}_{'median' if q == 50 else f'p{q}'}" for q in levels)


@query(f"WITH RECURSIVE {CELLS}, {REGIONS}, {CONTRAST} SELECT count(*) AS n_regions, count(DISTINCT vec_id) AS n_images, round(count(*)::DOUBLE / count(DISTINCT vec_id), 6) AS regions_per_image, CAST(max(area) AS DOUBLE) AS area_px_max, round(max(area / 64.0::DOUBLE), 6) AS area_fraction_max, {_p('CAST(area AS DOUBLE)', 'area_px', 1, 5, 50)}, {_p('area / 64.0::DOUBLE', 'area_fraction', 1, 5, 50)}, {_p('diameter', 'diameter_px', 1, 5, 50)}, {_p('CAST(extent AS DOUBLE)', 'min_extent', 1, 50)}, {_p('contrast', 'local_contrast', 5, 50)} FROM z")
def summarize_regions(spark, d):
    return rounded(rasters.region_summary(measured(spark, d), "vec_id", 64))


PRO = "q AS (SELECT value, sum(CASE WHEN region IS NULL THEN 0.0 ELSE 1.0 / (area * (SELECT count(*) FROM r)) END) AS w, count(*) FILTER (region IS NULL) AS neg FROM c LEFT JOIN l USING (vec_id, pos) LEFT JOIN r USING (vec_id, region) GROUP BY value), p AS (SELECT CAST(sum(neg) OVER o AS DOUBLE) / (SELECT sum(neg) FROM q) AS fpr, sum(w) OVER o AS pro FROM q WINDOW o AS (ORDER BY value DESC)), f AS (SELECT fpr, max(pro) AS pro FROM p GROUP BY fpr), z AS (SELECT fpr AS x1, pro AS y1, coalesce(lag(fpr) OVER (ORDER BY fpr), 0) AS x0, coalesce(lag(pro) OVER (ORDER BY fpr), 0) AS y0 FROM f)"


@query(f"WITH RECURSIVE {CELLS}, {REGIONS}, {PRO}, lim AS (SELECT unnest([0.05, 0.3]) AS m) SELECT CAST(m AS DOUBLE) AS fpr_limit, round(sum(CASE WHEN x0 < m THEN (least(x1, m) - x0) * (y0 + CASE WHEN x1 > m THEN y0 + coalesce((y1 - y0) / nullif(x1 - x0, 0), 0) * (m - x0) ELSE y1 END) / 2 ELSE 0 END) / m, 6) AS au_pro FROM z, lim GROUP BY m")
def au_pro(spark, d):
    return rounded(rasters.au_pro(T.cells(spark, d), found(spark, d), "vec_id", (0.05, 0.3)))


@query(f"WITH RECURSIVE {CELLS}, {REGIONS}, t AS (SELECT quantile_cont(value, 0.9) AS t FROM c WHERE NOT truth), s AS (SELECT vec_id, region, area, avg(CAST(value > t AS DOUBLE)) AS share FROM l JOIN r USING (vec_id, region) JOIN c USING (vec_id, pos), t GROUP BY ALL) SELECT CAST((area >= 2)::INT + (area >= 4)::INT + (area >= 8)::INT AS INT) AS size_bin, count(*) AS n, round(avg(share), 6) AS mean_overlap, round(avg(CAST(share >= 0.3 AS DOUBLE)), 6) AS found FROM s GROUP BY 1")
def region_size_study(spark, d):
    return rounded(studies.region_size_study(found(spark, d), T.cells(spark, d), "vec_id", 0.1, (2, 4, 8)))


@query(f"WITH RECURSIVE {CELLS}, {REGIONS}, s AS (SELECT long_side, 2.0 * sqrt(area / 3.141592653589793) * long_side / 640.0 AS x FROM r, (SELECT unnest([320, 448, 640, 960]) AS long_side)) SELECT long_side, round(median(x), 6) AS median_diameter, round(avg(CAST(x < 2.0 AS DOUBLE)), 6) AS lost, CASE WHEN avg(CAST(x < 2.0 AS DOUBLE)) > 0.25 THEN 'reject' WHEN avg(CAST(x < 2.0 AS DOUBLE)) > 0.05 THEN 'marginal' ELSE 'accept' END AS verdict FROM s GROUP BY long_side")
def resolution_impact(spark, d):
    return rounded(studies.resolution_impact(found(spark, d), 640, 480, least=2.0))


@query(f"WITH RECURSIVE {CELLS}, {REGIONS}, s AS (SELECT long_side, avg(CAST(2.0 * sqrt(area / 3.141592653589793) * long_side / 640.0 < 2.0 AS DOUBLE)) AS lost FROM r, (SELECT unnest([320, 448, 640, 960]) AS long_side) GROUP BY 1) SELECT coalesce(min(long_side) FILTER (lost <= 0.05), max(long_side)) AS long_side, min(long_side) FILTER (lost <= 0.05) IS NULL AS tiled FROM s")
def recommend_resolution(spark, d):
    return studies.recommend(studies.resolution_impact(found(spark, d), 640, 480, least=2.0))


def blur_sql(sigma: str) -> str:
    """CTE bl (vec_id, sigma, pos, x): maps blurred along rows, then columns, mirrored at the edges, for the widths of ``sigma``."""
    return (
        f"sg AS (SELECT unnest({sigma})::DOUBLE AS sigma), wr AS (SELECT sigma, CAST(greatest(1, floor(3 * sigma + 0.5)) AS INT) AS r FROM sg WHERE sigma > 0), "
        "wo AS (SELECT sigma, unnest(range(-r, r + 1)) AS o, r FROM wr), wk AS (SELECT sigma, o, exp(-0.5 * (o / sigma) * (o / sigma)) AS k FROM wo), wn AS (SELECT sigma, o, k / sum(k) OVER (PARTITION BY sigma) AS k FROM wk), "
        "ax AS (SELECT sigma, i, CASE WHEN abs(i + o) > 7 THEN 14 - abs(i + o) ELSE abs(i + o) END AS j, sum(k) AS k FROM wn, range(8) AS g(i) GROUP BY ALL), "
        "b1 AS (SELECT vec_id, sigma, i AS row, pos % 8 AS col, sum(value * k) AS x FROM c JOIN ax ON ax.j = pos // 8 GROUP BY ALL), "
        "bl AS (SELECT vec_id, b1.sigma, row * 8 + i AS pos, sum(x * k) AS x FROM b1 JOIN ax ON ax.sigma = b1.sigma AND ax.j = col GROUP BY ALL UNION ALL SELECT vec_id, sigma, pos, value FROM c, sg WHERE sigma = 0)"
    )


@query(f"WITH {CELLS}, {blur_sql('[1.0]')} SELECT vec_id, list(round(x, 6) ORDER BY pos) AS map FROM bl GROUP BY vec_id")
def smoothed_maps(spark, d):
    return T.maps(spark, d).select("vec_id", rasters.smooth(1.0, 6)("map", F.lit(8), F.lit(8)).alias("map"))


@query()
def native_maps(spark, d):
    return T.maps(spark, d).select("vec_id", rasters.postprocess(16, 16, 12, 20, 1.0)("map", F.lit(8), F.lit(8)).alias("map"))


@query()
def mask_rules(spark, d):
    rule = rasters.mask_rule(0.1, 0.25, closing=1, erosion=0, least=2, mark=True)
    return T.maps(spark, d).select("vec_id", rule("map", F.lit(8), F.lit(8)).alias("mask"))


@query()
def perturbation_grid(spark, d):
    name = F.explode(F.array(*map(F.lit, PERTURBATIONS))).alias("name")
    severity = F.explode(F.sequence(F.lit(0), F.lit(5))).alias("severity")
    m = T.maps(spark, d).select("vec_id", "map", name).select("vec_id", "map", "name", severity)
    return m.select("vec_id", "name", "severity", F.array_max(rasters.perturbed_by(1)("map", F.lit(8), F.lit(8), "name", "severity")).alias("score"))


@query()
def synthetic_dataset(spark, d):
    """For every image a synthetic one of 16 x 16: its pattern by category, and for an anomalous one a defect by id."""
    m = T.maps(spark, d).select("vec_id", "label", F.element_at(F.array(*map(F.lit, injections.PATTERNS)), (F.col("category") % 3 + 1).cast("int")).alias("pattern"), F.when(F.col("label") == 1, F.element_at(F.array(*map(F.lit, injections.DEFECTS)), (F.pmod("vec_id", F.lit(6)) + 1).cast("int"))).alias("kind"))
    made = m.withColumn("x", injections.injected(16, 16, 3)("vec_id", injections.patterned(16, 16, 3)("vec_id", "pattern"), "kind"))
    return made.select("vec_id", "label", "pattern", "kind", "x.map", "x.mask")


@query(f"WITH {MAPS} SELECT vec_id, CASE WHEN label = 1 THEN ['pit', 'scratch', 'contamination', 'bubble', 'crack', 'chip'][vec_id % 6 + 1] END AS kind, true AS exact, label = 1 AS changed FROM m")
def injected_defects(spark, d):
    """Defects blended into the given anomalous maps: whether the mask is just what changed, and whether anything did."""
    kind = F.when(F.col("label") == 1, F.element_at(F.array(*map(F.lit, injections.DEFECTS)), (F.pmod("vec_id", F.lit(6)) + 1).cast("int")))
    m = T.maps(spark, d).withColumn("kind", kind).withColumn("x", injections.injected(8, 8, 5)("vec_id", "map", "kind"))
    differs = F.zip_with("map", "x.map", lambda a, b: a != b)
    return m.select("vec_id", "kind", (differs == F.col("x.mask")).alias("exact"), F.exists("x.mask", lambda t: t).alias("changed"))


@query(f"WITH {MAPS}, s AS (SELECT vec_id, map, list_sort(map) AS o FROM m) SELECT vec_id, round(list_max(list_transform(range(1, 65), lambda i: greatest(map[i], map[65 - i] / 2))), 6) AS fused, round(o[60] + 0.85 * (o[61] - o[60]), 6) AS p95 FROM s")
def map_fusion(spark, d):
    m = T.maps(spark, d)
    other = F.transform(F.reverse("map"), lambda x: x / 2.0)
    return rounded(m.select("vec_id", F.array_max(rasters.fuse(F.col("map"), other, "max")).alias("fused"), rasters.percentile_of(F.col("map"), 95.0).alias("p95")))


# --- vectors -----------------------------------------------------------------------------------


def normals(spark, d):
    return T.maps(spark, d).where("label = 0")


BANK = "b AS (SELECT * FROM m WHERE label = 0), n AS (SELECT m.vec_id, m.label, b.vec_id AS neighbour, sqrt(list_sum(list_transform(list_zip(m.map, b.map), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS distance FROM m, b WHERE m.vec_id <> b.vec_id), o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(distance, 9), neighbour) AS r FROM n)"


@query(f"WITH {MAPS}, {BANK} SELECT vec_id, CAST(r AS INT) AS rank, neighbour, round(distance, 6) AS distance FROM o WHERE r <= 3")
def knn_join(spark, d):
    return rounded(neighbours.knn_join(T.maps(spark, d), normals(spark, d), 3, "vec_id", "map", exclude_self=True))


@query(f"WITH {MAPS}, {BANK}, e AS (SELECT vec_id, label, round(distance, 9) AS score FROM o WHERE r = 1), f AS (SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM e GROUP BY score) SELECT round({AUROC}, 6) AS auroc, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM (SELECT *, sum(neg) OVER (ORDER BY score) AS cn FROM f)")
def train_proximity(spark, d):
    near = neighbours.knn_join(T.maps(spark, d), normals(spark, d), 1, "vec_id", "map", exclude_self=True)
    own = near.join(T.maps(spark, d).select("vec_id", "label"), "vec_id").withColumn("distance", F.round("distance", 9))
    return rounded(ranking.roc_auc(own, "label", "distance"))


query(ORACLE["knn_join"], "knn_join_all")(knn_join)
query(ORACLE["train_proximity"], "train_proximity_all")(train_proximity)


@query(f"WITH {MAPS}, v AS (SELECT * FROM m WHERE label = 0), n AS (SELECT a.vec_id, min(sqrt(list_sum(list_transform(list_zip(a.map, b.map), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY 1) SELECT round(max(d), 6) AS guard_limit FROM n")
def shading_guard_limit(spark, d):
    v = normals(spark, d)
    return rounded(neighbours.knn_join(v, v, 1, "vec_id", "map", exclude_self=True).agg(F.max("distance").alias("guard_limit")))


query(ORACLE["shading_guard_limit"], "shading_guard_limit_all")(shading_guard_limit)


@query(f"WITH {MAPS}, s AS (SELECT vec_id, label, list_sum(map) / 64 AS x FROM m), t AS (SELECT avg(x) AS mu, greatest(stddev_samp(x), 1e-6) AS sd FROM s WHERE label = 0) SELECT vec_id, round(abs(x - mu) / sd, 6) AS score FROM s, t")
def mean_intensity_scorer(spark, d):
    m = T.maps(spark, d)
    return rounded(predictions.build("mean_intensity", "map").fit(m.where("label = 0"), "train").transform(m).select("vec_id", "score"))


@query("SELECT vec_id, round(CAST(('0x' || substr(sha256('11:' || CAST(vec_id AS VARCHAR)), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0, 6) AS score FROM embeddings")
def random_scorer(spark, d):
    m = T.maps(spark, d)
    return rounded(predictions.build("random", "map", id="vec_id", seed=11).fit(m.where("label = 0"), "train").transform(m).select("vec_id", "score"))


@query(f"WITH {CELLS}, b AS (SELECT vec_id, label, CAST(least(greatest(floor((value + 3.0) * (64 / 6.0::DOUBLE)), 0), 63) AS INT) AS bin FROM c), o AS (SELECT vec_id, bin, count(*) / 64.0 AS p FROM b GROUP BY ALL), g AS (SELECT bin, count(*) / (64.0 * (SELECT count(*) FROM m WHERE label = 0)) AS q FROM b WHERE label = 0 GROUP BY bin), x AS (SELECT vec_id, bin, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM (SELECT vec_id, bin FROM m, (SELECT unnest(range(64)) AS bin)) LEFT JOIN o USING (vec_id, bin) LEFT JOIN g USING (bin)) SELECT vec_id, round(sum(CASE WHEN p + q > 0 THEN 0.5 * (p - q) * (p - q) / (p + q) ELSE 0 END), 6) AS score FROM x GROUP BY vec_id")
def histogram_scorer(spark, d):
    m = T.maps(spark, d)
    return rounded(predictions.build("histogram", "map").fit(m.where("label = 0"), "train").transform(m).select("vec_id", "score"))


@query()
def pca_scorer(spark, d):
    m = T.maps(spark, d)
    return predictions.build("pixel_pca", "map", components=8).fit(m.where("label = 0"), "train").transform(m.select("vec_id", "map")).drop("map")


@query()
def gaussian_scorer(spark, d):
    mean, cov, _ = neighbours.ledoit_wolf(T.maps(spark, d).where("label = 0"), "map")
    return neighbours.mahalanobis(T.maps(spark, d).select("vec_id", "map"), "map", mean, cov).drop("map")


@query()
def memory_bank_scorer(spark, d):
    chosen = neighbours.coreset(normals(spark, d), "vec_id", "map", 50, seed=1)
    near = neighbours.knn_join(T.maps(spark, d), chosen, 1, "vec_id", "map", exclude_self=True)
    return near.select("vec_id", F.col("distance").alias("score"), F.col("neighbour").alias("nearest_normal"))


def patches(spark, d):
    m = T.maps(spark, d)
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.struct(r.alias("patch"), F.slice("map", r * 8 + 1, 8).alias("v")))
    return m.select("vec_id", "label", F.explode(rows).alias("p")).select("vec_id", "label", "p.patch", "p.v", (F.col("vec_id") * 8 + F.col("p.patch")).alias("key"))


@query()
def reweighted_scores(spark, d):
    p = patches(spark, d)
    memory = p.where("label = 0").select(F.col("key").alias("bank_id"), "v")
    near = neighbours.knn_join(p.select("key", "v"), memory, 1, "key", "v", "bank_id", exclude_self=True, per=8)
    best = near.join(p, "key").select("vec_id", "patch", "neighbour", "distance", "v")
    return neighbours.reweighted(best, memory, "vec_id", "v", "patch", per=8)


@query()
def density_subsample(spark, d):
    return neighbours.density_subsample(T.maps(spark, d), "vec_id", "map", 0.25)


# --- studies -----------------------------------------------------------------------------------


@query(f"WITH {EVENTS}, {VAL}, {KTH.format(a=0.05)} SELECT CASE WHEN grouping(event_type) = 1 THEN 'all' ELSE event_type END AS event_type, count(*) AS n, round(avg(CAST(score > threshold AS DOUBLE)) FILTER (label = 0), 6) AS fpr, round(avg(CAST(score > threshold AS DOUBLE)) FILTER (label = 1), 6) AS recall FROM t, th GROUP BY GROUPING SETS ((), (event_type))")
def by_condition(spark, d):
    e = T.events(spark, d)
    at = thresholds.ranked_threshold(e.where("split = 'validation' AND label = 0"), "score", 0.05).select("threshold")
    own = e.where("split = 'test'").crossJoin(F.broadcast(at))
    return rounded(studies.by_condition(own, "label", "score", "event_type", F.col("threshold")))


@query("WITH x AS (SELECT n_regionkey, n_nationkey, avg(c_acctbal) AS m FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) SELECT n_regionkey, round(avg(m), 6) AS macro, count(*) AS groups FROM x GROUP BY n_regionkey")
def macro_mean(spark, d):
    x = T.read(spark, d, "customer").join(T.read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rounded(studies.nested_mean(x, "c_acctbal", ("n_nationkey",), ("n_regionkey",)))


@query("SELECT l_returnflag, l_linenumber, round(avg(l_discount), 6) AS mean, round(stddev_samp(l_discount), 6) AS sd, count(l_discount) AS n FROM lineitem GROUP BY ALL")
def aggregate_seeds(spark, d):
    return rounded(studies.seed_summary(T.read(spark, d, "lineitem"), "l_discount", ("l_returnflag", "l_linenumber")))


@query("SELECT substr(sha256('brand=' || p_brand || ',type=' || p_type), 1, 12) AS \"group\", list_sort(list(DISTINCT CAST(p_size AS VARCHAR))) AS seeds, count(*) AS n FROM part GROUP BY p_brand, p_type")
def group_runs(spark, d):
    p = T.read(spark, d, "part")
    spec = F.create_map(F.lit("type"), F.col("p_type"), F.lit("brand"), F.col("p_brand"), F.lit("seed"), F.col("p_size").cast("string"))
    return studies.group_runs(p.withColumn("spec", spec), "seed", "spec")


@query("SELECT c_custkey, o_orderkey, o_orderstatus FROM (SELECT o_custkey AS c_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def upsert_latest(spark, d):
    o = T.read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    return studies.latest(o, ("c_custkey",), "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def resumable_work_list(spark, d):
    return studies.undone(T.read(spark, d, "customer").select("c_custkey"), T.read(spark, d, "orders").where("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "c_custkey"), ("c_custkey",))


@query("SELECT name, severity FROM (SELECT DISTINCT event_type AS name FROM events), (SELECT unnest([0, 1, 2, 3, 4, 5]) AS severity)")
def severity_grid(spark, d):
    """Every event type, as a perturbation's name, at every severity."""
    return studies.severity_grid(T.read(spark, d, "events").select(F.col("event_type").alias("name")).distinct(), "name", range(6))


@query(f"WITH {EVENTS} SELECT round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS class_f1, round(2.0 * p / (p + n), 6) AS reject_all_f1, 2.0 * tp / (2 * tp + fp + fn) > 2.0 * p / (p + n) AS passes FROM (SELECT count(*) FILTER (label = 1 AND score > 20) AS tp, count(*) FILTER (label = 0 AND score > 20) AS fp, count(*) FILTER (label = 1 AND score <= 20) AS fn, count(*) FILTER (label = 1) AS p, count(*) AS n FROM e)")
def proxy_gate(spark, d):
    return rounded(studies.proxy_gate(T.events(spark, d), "label", "score", F.lit(20.0)))


@query(f"WITH {MAPS}, s AS (SELECT vec_id, label, list_sum(map) / 64 AS mean, list_max(map) AS high FROM m), g AS (SELECT min(mean) AS a, max(mean) AS b, min(high) AS c, max(high) AS e FROM s WHERE label = 0) SELECT vec_id, array_to_string(list_filter([CASE WHEN mean < a OR mean > b THEN 'mean' END, CASE WHEN high < c OR high > e THEN 'high' END], lambda x: x IS NOT NULL), ',') AS reasons, mean >= a AND mean <= b AND high >= c AND high <= e AS ok FROM s, g")
def input_guards(spark, d):
    s = T.maps(spark, d).select("vec_id", "label", C.mean_of(F.col("map")).alias("mean"), F.array_max("map").alias("high"))
    limits = studies.guard_limits(s.where("label = 0"), ("mean", "high"))
    return studies.guard_check(s, limits, ("mean", "high")).select("vec_id", F.array_join("reasons", ",").alias("reasons"), "ok")


@query("WITH c AS (SELECT event_type AS category, user_id % 2 AS half, rule, avg(CAST((value > rule * 10.0) = (event_type = 'error') AS DOUBLE)) AS s FROM events, (SELECT unnest([1, 2, 5, 10]) AS rule) GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY category, half ORDER BY s DESC, rule DESC) AS r FROM c) SELECT b.category, b.half, b.rule, round(b.s, 6) AS chosen_on, round(c.s, 6) AS scored_on FROM b JOIN c ON c.category = b.category AND c.rule = b.rule AND c.half = 1 - b.half WHERE r = 1")
def threshold_transfer(spark, d):
    e = T.read(spark, d, "events").withColumn("rule", F.explode(F.array(*map(F.lit, (1, 2, 5, 10)))))
    right = ((F.col("value") > F.col("rule") * 10.0) == (F.col("event_type") == "error")).cast("double")
    c = e.groupBy(F.col("event_type").alias("category"), F.pmod("user_id", F.lit(2)).alias("half"), "rule").agg(F.avg(right).alias("s"))
    return rounded(studies.threshold_transfer(c, "rule", "half", "category", "s").select("category", "half", "rule", "chosen_on", "scored_on"))


@query("WITH c AS (SELECT vec_id, label, unnest(embedding) AS value FROM embeddings), p AS (SELECT vec_id, t AS threshold, count(*) FILTER (CAST(value AS DOUBLE) > t) AS above, count(*) AS cells FROM c, (SELECT unnest([CAST(0.0 AS DOUBLE), CAST(0.1 AS DOUBLE), CAST(0.2 AS DOUBLE)]) AS t) GROUP BY ALL), r AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('4:' || CAST(vec_id AS VARCHAR)), vec_id) AS k FROM embeddings), d AS (SELECT resample, floor(CAST(('0x' || substr(sha256('4:' || resample || ':' || k), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0 * (SELECT count(*) FROM r)) + 1 AS k, count(*) AS weight FROM r, range(20) AS g(resample) GROUP BY ALL) SELECT CAST(resample AS INT) AS resample, threshold, round(CAST(sum(weight * above) AS DOUBLE) / sum(weight * cells), 6) AS share FROM p JOIN r USING (vec_id) JOIN d USING (k) GROUP BY resample, threshold")
def reweighted_bootstrap(spark, d):
    m = T.maps(spark, d)
    p = m.select("vec_id", F.explode(F.array(*map(F.lit, (0.0, 0.1, 0.2)))).alias("threshold"), "map")
    p = p.select("vec_id", "threshold", F.size(F.filter("map", lambda x: x > F.col("threshold"))).alias("above"), F.size("map").alias("cells"))
    return rounded(studies.bootstrap_areas(p, statistics.resample_weights(m, "vec_id", 20, 4), "vec_id"))


@query("SELECT doc_id, regexp_extract(source, '([a-z]+)([0-9]+)', 1) AS family, CAST(regexp_extract(source, '([a-z]+)([0-9]+)', 2) AS INT) AS number FROM documents")
def parse_names(spark, d):
    x = T.read(spark, d, "documents")
    return x.select("doc_id", F.regexp_extract("source", "([a-z]+)([0-9]+)", 1).alias("family"), F.regexp_extract("source", "([a-z]+)([0-9]+)", 2).cast("int").alias("number"))


@query("SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus")
def split_summary(spark, d):
    o = T.read(spark, d, "orders")
    return o.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.count_distinct("o_custkey").alias("customers"))


@query("WITH s AS (SELECT p_partkey AS id, p_size * 100 AS w, CAST(p_partkey % 700 + 50 AS INT) AS h FROM part) SELECT id, CAST(greatest(1, round_even(w * (640.0::DOUBLE / greatest(w, h)), 0)) AS INT) AS width, CAST(greatest(1, round_even(h * (640.0::DOUBLE / greatest(w, h)), 0)) AS INT) AS height FROM s")
def target_size(spark, d):
    s = T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 100).alias("w"), (F.pmod("p_partkey", F.lit(700)) + 50).cast("int").alias("h"))
    w, h = C.target_size(F.col("w"), F.col("h"), "aspect", long_side=640)
    return s.select("id", w.alias("width"), h.alias("height"))


@query(f"WITH {EVENTS}, n AS (SELECT *, (row_number() OVER (ORDER BY sha256('8:' || CAST(event_id AS VARCHAR)), event_id) - 1) % 4 AS fold FROM e WHERE label = 0), s AS (SELECT fold, avg(score) AS mu, stddev_samp(score) AS sd, count(*) AS n FROM n GROUP BY fold), g AS (SELECT a.fold, sum(b.mu * b.n) / sum(b.n) AS mu FROM s a JOIN s b ON a.fold <> b.fold GROUP BY a.fold) SELECT CAST(fold AS INT) AS fold, count(*) AS n, round(avg(abs(score - mu)), 6) AS mean_deviation FROM n JOIN g USING (fold) GROUP BY fold")
def crossfit_scores(spark, d):
    n = splits.folds(T.events(spark, d).where("label = 0"), "event_id", 4, 8)
    own = n.groupBy("fold").agg(F.sum("score").alias("s"), F.count("*").alias("c"))
    whole = own.agg(F.sum("s").alias("ts"), F.sum("c").alias("tc"))
    rest = own.crossJoin(F.broadcast(whole)).select("fold", ((F.col("ts") - F.col("s")) / (F.col("tc") - F.col("c"))).alias("mu"))
    return rounded(n.join(F.broadcast(rest), "fold").groupBy("fold").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("score") - F.col("mu"))).alias("mean_deviation")))


@query("WITH w AS (SELECT l_shipmode AS category, CAST(avg(l_tax) FILTER (l_returnflag = 'R') AS DOUBLE) AS a, CAST(avg(l_tax) FILTER (l_returnflag = 'N') AS DOUBLE) AS b FROM (SELECT l_suppkey % 10 AS l_shipmode, * FROM lineitem) GROUP BY 1) SELECT count(*) FILTER (a > b) AS wins, count(*) FILTER (a < b) AS losses, round(avg(a - b), 6) AS mean_gain FROM w")
def pivot_wins(spark, d):
    x = T.read(spark, d, "lineitem").withColumn("category", F.pmod("l_suppkey", F.lit(10)))
    w = x.groupBy("category").pivot("l_returnflag", ["R", "N"]).agg(F.avg("l_tax"))
    return rounded(w.agg(F.count_if(F.col("R") > F.col("N")).alias("wins"), F.count_if(F.col("R") < F.col("N")).alias("losses"), F.avg(F.col("R") - F.col("N")).alias("mean_gain")))


@query("SELECT user_id, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY user_id")
def latency_percentiles(spark, d):
    p = lambda q: F.percentile("value", F.lit(q))
    return rounded(T.read(spark, d, "events").groupBy("user_id").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99")))
