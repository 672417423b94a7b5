"""Queries of studies, predictions and photometric operators; see :mod:`gaugeworks.plans.catalog`."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions import columns as C
from gaugeworks.operators import calibration, photometric, predictions, ranking, rasters, screens, splits, studies, thresholds
from gaugeworks.plans import tables as T
from gaugeworks.plans.catalog import AUROC, BOOT, CELLS, EVENTS, KTH, MAPS, TWO_SIDED, VAL, boot_sql, query, rounded
from gaugeworks.plans.catalog_models import REGIONS, blur_sql, found

# --- calibration -------------------------------------------------------------------------------

DRAWN = (
    "n AS (SELECT * FROM e WHERE label = 0 AND split = 'validation'), t AS (SELECT * FROM e WHERE split = 'test'), "
    "dr AS (SELECT size, draw, score FROM (SELECT size, draw, score, row_number() OVER (PARTITION BY size, draw ORDER BY sha256('5:' || size || ':' || draw || ':' || event_id), event_id) AS r "
    "FROM n, (SELECT unnest([20, 40]) AS size), range(10) AS g(draw)) WHERE r <= size UNION ALL SELECT (SELECT count(*) FROM n), 0, score FROM n), "
    "rk AS (SELECT *, row_number() OVER (PARTITION BY size, draw ORDER BY score DESC) AS q, count(*) OVER (PARTITION BY size, draw) AS n FROM dr), "
    "cut AS (SELECT size, draw, 'rank' AS rule, target AS requested_fpr, score AS threshold, greatest(k, 1) / (n + 1)::DOUBLE AS effective_fpr, k >= 1 AS target_met "
    "FROM (SELECT *, CAST(floor(target * (n + 1) + 1e-9) AS INT) AS k FROM rk, (SELECT CAST(unnest([0.02, 0.05]) AS DOUBLE) AS target)) WHERE q = greatest(k, 1) "
    "UNION ALL SELECT size, draw, 'sigma3', NULL, avg(score) + 3 * stddev_samp(score), NULL, NULL FROM dr GROUP BY size, draw "
    "UNION ALL SELECT size, draw, 'mad3', NULL, median(score) + 3 * 1.4826 * mad(score), NULL, NULL FROM dr GROUP BY size, draw), "
    "pt AS (SELECT size, draw, rule, requested_fpr, threshold, effective_fpr, target_met, avg(CAST(t.score > threshold AS DOUBLE)) FILTER (label = 0) AS fpr, avg(CAST(t.score > threshold AS DOUBLE)) FILTER (label = 1) AS recall FROM cut, t GROUP BY ALL)"
)


def points(spark, d):
    e = T.events(spark, d)
    pool = e.where("split = 'validation' AND label = 0")
    return calibration.calibration_study(pool, e.where("split = 'test'"), "event_id", "label", "score", (20, 40), (0.02, 0.05), 10, 5)


@query(f"WITH {EVENTS}, {DRAWN} SELECT CAST(size AS BIGINT) AS size, CAST(draw AS INT) AS draw, rule, requested_fpr, round(threshold, 6) AS threshold, round(effective_fpr, 6) AS effective_fpr, target_met, round(fpr, 6) AS fpr, round(recall, 6) AS recall FROM pt")
def calibration_points(spark, d):
    out = points(spark, d).select(F.col("size").cast("long").alias("size"), "draw", "rule", "requested_fpr", "threshold", "effective_fpr", "target_met", "fpr", "recall")
    return rounded(out)


@query(f"WITH {EVENTS}, {DRAWN} SELECT rule, requested_fpr, CAST(size AS BIGINT) AS size, count(*) AS draws, round(avg(CAST(target_met AS DOUBLE)), 6) AS target_met_share, round(median(effective_fpr), 6) AS effective_fpr, " + ", ".join(f"round(quantile_cont({c}, {q}), 6) AS {c}_{n}" for c in ("fpr", "recall") for q, n in ((0.5, "median"), (0.05, "p05"), (0.95, "p95"))) + " FROM pt GROUP BY ALL")
def calibration_summary(spark, d):
    return rounded(calibration.summarize_calibration(points(spark, d)).withColumn("size", F.col("size").cast("long")))


SOURCES = (
    "nt AS (SELECT * FROM e WHERE label = 0 AND split = 'test'), nv AS (SELECT * FROM e WHERE label = 0 AND split = 'validation'), s AS (SELECT count(*) // 2 AS n FROM nt), "
    "ha AS (SELECT draw, event_id, score, row_number() OVER (PARTITION BY draw ORDER BY sha256('5:test:' || draw || ':' || event_id), event_id) AS r FROM nt, range(6) AS g(draw)), "
    "hv AS (SELECT draw, event_id, score, row_number() OVER (PARTITION BY draw ORDER BY sha256('5:pool:' || draw || ':' || event_id), event_id) AS r FROM nv, range(6) AS g(draw)), "
    "cal AS (SELECT 'test half' AS source, draw, score FROM ha, s WHERE r <= n UNION ALL SELECT 'validation', draw, score FROM hv, s WHERE r <= n), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY source, draw ORDER BY score DESC) AS q, count(*) OVER (PARTITION BY source, draw) AS m FROM cal), "
    "cut AS (SELECT source, draw, target, k, score AS threshold FROM (SELECT *, CAST(floor(target * (m + 1) + 1e-9) AS INT) AS k FROM o, (SELECT CAST(unnest([0.02, 0.1]) AS DOUBLE) AS target)) WHERE q = k), "
    "f AS (SELECT source, cut.draw, target, k, avg(CAST(ha.score > threshold AS DOUBLE)) AS fpr FROM cut JOIN ha ON ha.draw = cut.draw, s WHERE r > n GROUP BY ALL), "
    "rc AS (SELECT source, draw, target, avg(CAST(e.score > threshold AS DOUBLE)) AS recall FROM cut, e WHERE e.split = 'test' AND e.label = 1 GROUP BY ALL)"
)


@query(f"WITH {EVENTS}, {SOURCES} SELECT source, target AS requested_fpr, CAST((SELECT n FROM s) AS BIGINT) AS n_calibration, CAST(max(k) AS INT) AS rank_k, round(max(k) / ((SELECT n FROM s) + 1.0::DOUBLE), 6) AS bound, round(avg(fpr), 6) AS fpr_mean, round(stddev_samp(fpr) / sqrt(count(*)), 6) AS fpr_mc_se, round(quantile_cont(fpr, 0.05), 6) AS fpr_p05, round(quantile_cont(fpr, 0.95), 6) AS fpr_p95, round(avg(recall), 6) AS recall_mean, count(*) AS draws FROM f JOIN rc USING (source, draw, target) WHERE (SELECT n FROM s) BETWEEN 10 AND (SELECT count(*) FROM nv) GROUP BY source, target")
def calibration_source(spark, d):
    e = T.events(spark, d)
    return rounded(calibration.calibration_source_study(e.where("split = 'validation' AND label = 0"), e.where("split = 'test'"), "event_id", "label", "score", (0.02, 0.1), 6, 5))


# --- aggregation rules -------------------------------------------------------------------------


def runs(spark, d):
    """Two fitting seeds: the second one's maps grow towards the last cell."""
    m = T.maps(spark, d).withColumn("seed", F.explode(F.array(F.lit(0), F.lit(1))))
    split = F.when(F.pmod("vec_id", F.lit(3)) == 0, "validation").otherwise("test")
    return m.withColumn("map", F.transform("map", lambda x, i: x * (1.0 + F.col("seed") * i / 64.0))).withColumn("split", split)


def rules():
    return {"max": F.array_max("map"), "mean": F.round(C.mean_of(F.col("map")), 9), "top_5": F.round(C.top_fraction_mean(F.col("map"), 0.05), 9)}


RUNS = (
    "rn AS (SELECT vec_id, label, seed, CASE WHEN vec_id % 3 = 0 THEN 'validation' ELSE 'test' END AS split, list_transform(range(1, 65), lambda i: map[i] * (1.0::DOUBLE + seed * (i - 1) / 64.0::DOUBLE)) AS map FROM m, (SELECT unnest([0, 1]) AS seed)), "
    "ls AS (SELECT vec_id, label, seed, split, unnest(['max', 'mean', 'top_5']) AS rule, unnest([list_max(map), round(list_sum(map) / 64, 9), round(list_sum(list_reverse_sort(map)[1:3]) / 3, 9)]) AS score FROM rn), "
    "fo AS (SELECT rule, seed, score, sum(label) AS pos, count(*) - sum(label) AS neg FROM ls WHERE split = 'test' GROUP BY ALL), "
    "cu AS (SELECT *, sum(neg) OVER (PARTITION BY rule, seed ORDER BY score) AS cn, sum(pos) OVER (PARTITION BY rule, seed ORDER BY score DESC) AS tp, sum(neg) OVER (PARTITION BY rule, seed ORDER BY score DESC) AS fp FROM fo), "
    "au AS (SELECT rule, seed, sum(pos * (cn - neg / 2.0)) / (sum(pos) * sum(neg)) AS auroc, sum(pos * tp / (tp + fp)) / sum(pos) AS ap FROM cu GROUP BY ALL), "
    "vo AS (SELECT *, row_number() OVER (PARTITION BY rule, seed ORDER BY score DESC) AS q, count(*) OVER (PARTITION BY rule, seed) AS n FROM ls WHERE split = 'validation' AND label = 0), "
    "th AS (SELECT rule, seed, score AS threshold FROM vo WHERE q = greatest(1, CAST(floor(0.05 * (n + 1) + 1e-9) AS INT))), "
    "op AS (SELECT rule, seed, avg(CAST(score > threshold AS DOUBLE)) FILTER (label = 1) AS recall, avg(CAST(score > threshold AS DOUBLE)) FILTER (label = 0) AS fpr FROM ls JOIN th USING (rule, seed) WHERE split = 'test' GROUP BY ALL)"
)


@query(f"WITH {MAPS}, {RUNS} SELECT rule, round(avg(auroc), 6) AS auroc_mean, round(stddev_samp(auroc), 6) AS auroc_std, round(avg(ap), 6) AS ap_mean, round(avg(recall), 6) AS recall_mean, round(avg(fpr), 6) AS fpr_mean, count(*) AS n_seeds FROM au JOIN op USING (rule, seed) GROUP BY rule")
def aggregation_study(spark, d):
    return rounded(calibration.aggregation_study(runs(spark, d), rules(), "vec_id", "seed", "label", "split", 0.05))


@query(
    f"WITH {MAPS}, {RUNS}, rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256('3:' || vec_id), vec_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM (SELECT DISTINCT vec_id, label FROM ls WHERE split = 'test')), "
    "dr AS (SELECT label, resample, floor(CAST(('0x' || substr(sha256('3:' || resample || ':' || label || ':' || k), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0 * n) + 1 AS k, count(*) AS w FROM rk, range(20) AS g(resample) GROUP BY ALL), "
    "wt AS (SELECT resample, vec_id, w FROM dr JOIN rk USING (label, k) UNION ALL SELECT -1, vec_id, 1 FROM rk), "
    "fd AS (SELECT resample, rule, seed, score, coalesce(sum(w) FILTER (label = 1), 0) AS pos, coalesce(sum(w) FILTER (label = 0), 0) AS neg FROM ls JOIN wt USING (vec_id) WHERE split = 'test' GROUP BY ALL), "
    "ax AS (SELECT resample, rule, seed, sum(pos * (cn - neg / 2.0)) / (sum(pos) * sum(neg)) AS a FROM (SELECT *, sum(neg) OVER (PARTITION BY resample, rule, seed ORDER BY score) AS cn FROM fd) GROUP BY ALL), "
    "mn AS (SELECT resample, rule, avg(a) AS a FROM ax GROUP BY ALL), gp AS (SELECT o.resample, o.rule, o.a - b.a AS d FROM mn o JOIN mn b ON b.resample = o.resample AND b.rule = 'max' WHERE o.rule <> 'max') "
    "SELECT rule, round(max(d) FILTER (resample < 0), 6) AS difference, round(quantile_cont(d, 0.025) FILTER (resample >= 0), 6) AS low, round(quantile_cont(d, 0.975) FILTER (resample >= 0), 6) AS high FROM gp GROUP BY rule"
)
def aggregation_differences(spark, d):
    return rounded(calibration.aggregation_differences(runs(spark, d).where("split = 'test'"), rules(), "max", "vec_id", "seed", "label", 20, 3))


COMPARED = "cp AS (SELECT o.vec_id % 2 AS category, o.rule, o.vec_id, o.label, o.score AS a, r.score AS b FROM ls o JOIN ls r ON r.vec_id = o.vec_id AND r.seed = o.seed AND r.split = o.split AND r.rule = 'max' WHERE o.rule <> 'max' AND o.split = 'test' AND o.seed = 0), " + boot_sql("cp", 20, 3, "vec_id", "category, rule", "category, label")
HOLM = f"mc AS (SELECT category, rule, {BOOT}, {TWO_SIDED} AS p FROM bo GROUP BY category, rule), ho AS (SELECT *, round(least(1.0, max(s) OVER (ORDER BY p, key)), 6) AS p_holm FROM (SELECT *, category || '|' || rule AS key, (count(*) OVER () - row_number() OVER (ORDER BY p, category || '|' || rule) + 1) * p AS s FROM mc))"


@query(f"WITH {MAPS}, {RUNS}, {COMPARED}, {HOLM} SELECT category, rule, auroc_a, auroc_b, difference, low, high, p_value, n_resamples, p_holm, p_holm <= 0.05 AS rejected FROM ho")
def method_comparisons(spark, d):
    own = calibration.long_scores(runs(spark, d).where("split = 'test' AND seed = 0"), rules(), ("vec_id", "label")).withColumn("category", F.pmod("vec_id", F.lit(2)))
    return rounded(calibration.method_comparisons(own, "category", "rule", "vec_id", "label", "score", "max", 20, 3))


@query(f"WITH {MAPS}, s AS (SELECT vec_id, label, category, list_sum(map) / 64 AS mean FROM m), g AS (SELECT min(mean) AS a, max(mean) AS b FROM s WHERE label = 0) SELECT category, label, count(*) AS n, round(avg(CAST(mean < a OR mean > b AS DOUBLE)), 6) AS refused FROM s, g GROUP BY ALL")
def guards_by_condition(spark, d):
    s = T.maps(spark, d).select("vec_id", "label", "category", C.mean_of(F.col("map")).alias("mean"))
    limits = studies.guard_limits(s.where("label = 0"), ("mean",))
    return rounded(calibration.guards_by_condition(studies.guard_check(s, limits, ("mean",)), "category", "label"))


# --- predictions -------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) WHERE p % 7 = 3")
def subset_positions(spark, d):
    o = T.read(spark, d, "orders").select("o_orderkey", "o_custkey")
    at = spark.range(o.count()).where("id % 7 = 3").withColumnRenamed("id", "position")
    return predictions.subset(o, "o_orderkey", at)


@query("SELECT event_type, 'field' AS split, count(*) AS n FROM events GROUP BY event_type")
def rename_split(spark, d):
    return predictions.rename_split(T.events(spark, d), "field").groupBy("event_type", "split").agg(F.count("*").alias("n"))


@query("SELECT user_id % 5 AS line, list_sort(list(DISTINCT event_type)) AS defect_types FROM events GROUP BY 1")
def defect_types(spark, d):
    return predictions.defect_types(T.events(spark, d).withColumn("line", F.pmod("user_id", F.lit(5))), "event_type", ("line",))


@query(f"WITH {EVENTS} SELECT event_id, label, round(score / 2 + user_id, 6) AS score FROM e")
def with_scores(spark, d):
    e = T.events(spark, d).select("event_id", "label", "score", "user_id")
    new = e.select("event_id", (F.col("score") / 2 + F.col("user_id")).alias("score"))
    return rounded(predictions.with_scores(e.drop("user_id"), new, "event_id"))


@query(f"WITH {MAPS} SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 64 WHEN label = 0 THEN 0 ELSE len(list_filter(map, lambda x: x > 0.1)) END AS cells FROM m")
def prediction_masks(spark, d):
    m = T.maps(spark, d)
    override = F.when(F.pmod("vec_id", F.lit(5)) == 0, F.array_repeat(F.lit(True), 64))
    mask = predictions.masks(override, F.when(F.col("label") == 1, "path"), F.transform("map", lambda x: x > 0.1), F.size("map"))
    return m.select("vec_id", F.size(F.filter(mask, lambda x: x)).cast("long").alias("cells"))


@query(f"WITH {EVENTS}, h AS (SELECT split, sha256(event_id || '|' || label || '|' || printf('%.10f', score)) AS x FROM e), g AS (SELECT split, count(*) AS n, sum(('0x' || substr(x, 1, 8))::BIGINT) AS a, sum(('0x' || substr(x, 9, 8))::BIGINT) AS b FROM h GROUP BY split) SELECT split, n, substr(sha256(n || ':' || a || ':' || b), 1, 16) AS digest FROM g")
def prediction_digest(spark, d):
    return predictions.prediction_digest(T.events(spark, d), "event_id", "label", "score", ("split",))


@query("SELECT event_type FROM events WHERE event_id % 1000 = 7 GROUP BY event_type")
def check_listing(spark, d):
    e = T.events(spark, d)
    recorded = splits.listing_digest(e.where("event_id % 1000 <> 7"), "event_id", ("event_type",))
    return predictions.check_listing(e, "event_id", ("event_type",), recorded).select("event_type")


# --- light -------------------------------------------------------------------------------------


@query(f"WITH {MAPS}, x AS (SELECT category, unnest(map) AS x FROM m) SELECT category, n_images, round(least_mean, 6) AS least_mean, round(greatest_mean, 6) AS greatest_mean, round(mean, 6) AS mean, round(std, 6) AS std, round(p1, 6) AS p1, round(p99, 6) AS p99 FROM (SELECT category, count(*) AS n_images, min(list_sum(map) / 64) AS least_mean, max(list_sum(map) / 64) AS greatest_mean FROM m GROUP BY 1) JOIN (SELECT category, avg(x) AS mean, stddev_pop(x) AS std, quantile_cont(x, 0.01) AS p1, quantile_cont(x, 0.99) AS p99 FROM x GROUP BY 1) USING (category)")
def split_statistics(spark, d):
    return rounded(photometric.split_statistics(T.maps(spark, d), "map", ("category",)))


def unit(spark, d):
    """Maps squeezed into 0 to 1."""
    return T.maps(spark, d).withColumn("map", F.transform("map", lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x + 0.5))))


UNIT = MAPS + ", w AS (SELECT vec_id, label, list_transform(map, lambda x: least(1.0::DOUBLE, greatest(0.0::DOUBLE, x + 0.5))) AS map FROM m), s AS (SELECT vec_id, map, list_sum(map) / 64 AS mu FROM w), v AS (SELECT *, sqrt(list_sum(list_transform(map, lambda x: (x - mu) * (x - mu))) / 64) AS sd FROM s)"


@query(f"WITH {UNIT} SELECT vec_id, round(list_max(map), 6) AS unit, round((list_max(map) - 0.456) / 0.224, 6) AS fixed, round((list_max(map) * (0.456 / greatest(mu, 0.001)) - 0.456) / 0.224, 6) AS gain, round((list_max(map) - mu) / greatest(sd, 0.001), 6) AS standardize FROM v")
def normalized_maps(spark, d):
    m = unit(spark, d)
    return rounded(m.select("vec_id", *(F.array_max(photometric.normalized(F.col("map"), mode)).alias(mode) for mode in ("unit", "fixed", "gain", "standardize"))))


@query(f"WITH {UNIT} SELECT vec_id, stops, round(list_sum(list_transform(map, lambda x: pow(least(1.0::DOUBLE, greatest(0.0::DOUBLE, x * pow(2.0, stops))), 1.0 / (1.0 + 0.15 * stops)))) / 64, 6) AS mean FROM w, (SELECT CAST(unnest([-1.0, 0.5, 2.0]) AS DOUBLE) AS stops)")
def exposure_shift(spark, d):
    m = unit(spark, d)
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("stops"), C.mean_of(photometric.exposed(F.col("map"), s)).alias("mean")) for s in (-1.0, 0.5, 2.0))))
    return rounded(m.select("vec_id", each.alias("x")).select("vec_id", "x.*"))


@query()
def relit_maps(spark, d):
    m = unit(spark, d).select("vec_id", photometric.relit(4)("map", F.lit(8), F.lit(8), "vec_id").alias("map"))
    return m.select("vec_id", photometric.normalized(F.col("map"), "flatfield", field=photometric.light_field()("map", F.lit(8), F.lit(8))).alias("map"))


@query()
def object_masks(spark, d):
    """Cells of an image that do not look like background, whose colours are taken from the borders of normal maps."""
    m = T.maps(spark, d)
    cells = m.select("vec_id", "label", F.posexplode("map").alias("pos", "a")).withColumn("b", F.abs("a")).withColumn("c", F.pmod(F.col("a") * 7, F.lit(1.0)))
    edge = cells.where("label = 0 AND (pos < 8 OR pos >= 56 OR pos % 8 IN (0, 7))")
    mean, inverse, cut = photometric.background(edge, ("a", "b", "c"))
    off = cells.select("vec_id", "pos", (photometric.distance(("a", "b", "c"), mean, inverse) > cut).cast("double").alias("x"))
    fore = off.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("f"))  # 64 cells
    mask = fore.select("vec_id", photometric.object_mask()("f", F.lit(8), F.lit(8)).alias("mask"))
    return mask.select("vec_id", "mask", photometric.on_grid(4, 4)(F.transform("mask", lambda x: x.cast("double")), F.lit(8), F.lit(8)).alias("grid"))


# --- screens -----------------------------------------------------------------------------------


LEVELS = "[" + ", ".join(str(1.0 - 0.36 * k / 10) for k in range(11)) + "]"


@query(f"WITH {CELLS}, n AS (SELECT value FROM c WHERE NOT truth), q AS (SELECT unnest(quantile_cont(value, {LEVELS})) AS t FROM n UNION SELECT max(value) + greatest(abs(max(value)), 1.0) * pow(2.0, -52) FROM c) SELECT DISTINCT round(t, 6) AS threshold FROM q")
def threshold_grid(spark, d):
    return rounded(screens.threshold_grid(T.cells(spark, d), "value", 0.3, 11)).distinct()


@query(f"WITH {CELLS}, r AS (SELECT unnest(['sigma', 'quantile']) AS rule, unnest([avg(value) + 3 * stddev_pop(value), quantile_cont(value, 0.999)]) AS threshold FROM c WHERE label = 0) SELECT rule, round(threshold, 6) AS threshold, round(count(*) FILTER (value > threshold AND truth) / nullif(count(*) FILTER (value > threshold), 0)::DOUBLE, 6) AS precision, round(count(*) FILTER (value > threshold AND truth) / count(*) FILTER (truth)::DOUBLE, 6) AS recall, round(2.0 * count(*) FILTER (value > threshold AND truth) / (count(*) FILTER (value > threshold) + count(*) FILTER (truth)), 6) AS f1 FROM c, r WHERE label = 1 GROUP BY rule, threshold")
def pixel_threshold_rules(spark, d):
    c = T.cells(spark, d)
    return rounded(screens.pixel_thresholds(c.where("label = 0"), c.where("label = 1"), "value", "truth"))


POOLS = "p AS (SELECT 'validation' AS pool, score FROM e WHERE label = 0 AND split = 'validation' UNION ALL SELECT 'early', score FROM e WHERE label = 0 AND split = 'validation' AND user_id % 2 = 0 UNION ALL SELECT 'both', score FROM e WHERE label = 0 AND split = 'validation'), o AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY score DESC) AS q, count(*) OVER (PARTITION BY pool) AS n FROM p), k AS (SELECT pool, n, CAST(floor(0.02 * (n + 1) + 1e-9) AS INT) AS k, score AS threshold FROM o WHERE q = greatest(1, CAST(floor(0.02 * (n + 1) + 1e-9) AS INT)))"


@query(f"WITH {EVENTS}, {POOLS}, x AS (SELECT pool, n, k, threshold, count(*) FILTER (label = 0 AND t.score > threshold) AS fa, count(*) FILTER (label = 0) AS m, avg(CAST(t.score > threshold AS DOUBLE)) FILTER (label = 1) AS recall FROM k, e AS t WHERE t.split = 'test' GROUP BY ALL) SELECT pool, n, round(threshold, 6) AS threshold, round(fa / m::DOUBLE, 6) AS fpr, round(recall, 6) AS recall, fa AS false_alarms, round(k / (n + 1)::DOUBLE * m, 6) AS expected, fa <= k / (n + 1)::DOUBLE * m + 2 * sqrt(k / (n + 1)::DOUBLE * m) AS within_bound FROM x")
def recalibration(spark, d):
    e = T.events(spark, d)
    pool = e.where("label = 0 AND split = 'validation'")
    return rounded(screens.recalibration({"validation": pool, "early": pool.where("user_id % 2 = 0"), "both": pool}, e.where("split = 'test'"), "label", "score", 0.02))


@query(f"WITH {MAPS}, b AS (SELECT vec_id, label, list_max(list_transform(list_filter(range(64), lambda i: i // 8 BETWEEN 1 AND 6 AND i % 8 BETWEEN 1 AND 6), lambda i: map[i + 1])) AS score FROM m), v AS (SELECT * FROM b WHERE label = 0), {KTH.format(a=0.05)} SELECT vec_id, round(score, 6) AS score, score > threshold AS flagged FROM b, th")
def border_masked_scores(spark, d):
    b = T.maps(spark, d).select("vec_id", "label", screens.inner_max(F.col("map"), 8, 8, 1).alias("score"))
    at = thresholds.ranked_threshold(b.where("label = 0"), "score", 0.05).select("threshold")
    return rounded(b.crossJoin(F.broadcast(at)).select("vec_id", "score", (F.col("score") > F.col("threshold")).alias("flagged")))


@query(f"WITH {EVENTS}, {VAL}, {KTH.format(a=0.05)}, s AS (SELECT * FROM t WHERE user_id % 4 = 1), f AS (SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM s GROUP BY score) SELECT (SELECT round({AUROC}, 6) FROM (SELECT *, sum(neg) OVER (ORDER BY score) AS cn FROM f)) AS auroc, CAST((SELECT sum(pos) FROM f) AS BIGINT) AS n_pos, CAST((SELECT sum(neg) FROM f) AS BIGINT) AS n_neg, round(avg(CAST(score > threshold AS DOUBLE)) FILTER (label = 0), 6) AS fpr, round(avg(CAST(score > threshold AS DOUBLE)) FILTER (label = 1), 6) AS recall FROM s, (SELECT threshold FROM th)")
def condition_subset(spark, d):
    e = T.events(spark, d)
    at = thresholds.ranked_threshold(e.where("split = 'validation' AND label = 0"), "score", 0.05)
    return rounded(screens.condition_metrics(e.where("split = 'test'"), F.col("user_id") % 4 == 1, "label", "score", at))


@query("SELECT p_partkey, CASE WHEN len(v) = 0 THEN 'base' ELSE array_to_string(v, ',') END AS variant FROM (SELECT p_partkey, list_filter([CASE WHEN p_brand <> 'Brand#11' THEN 'brand=' || p_brand END, CASE WHEN p_size <> 7 THEN 'size=' || p_size END], lambda x: x IS NOT NULL) AS v FROM part)")
def sweep_variants(spark, d):
    p = T.read(spark, d, "part")
    held = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"))
    return screens.sweep_labels(p.withColumn("settings", held), "settings", {"brand": "Brand#11", "size": "7"}).select("p_partkey", "variant")


@query(
    f"WITH RECURSIVE {CELLS}, {REGIONS}, s AS (SELECT long_side, avg(CAST(2.0 * sqrt(area / 3.141592653589793) * long_side / 640.0 < 2.0 AS DOUBLE)) AS lost FROM r, (SELECT unnest([320, 448, 640, 960]) AS long_side) GROUP BY 1), "
    "w AS (SELECT CAST(unnest([448, 960, 999]) AS INT) AS long_side) SELECT w.long_side, CASE WHEN lost > 0.25 THEN 'reject' WHEN lost > 0.05 THEN 'marginal' WHEN lost IS NOT NULL THEN 'accept' END AS verdict, coalesce(lost <= 0.05, false) AS accepted FROM w LEFT JOIN s ON s.long_side = w.long_side"
)
def transform_policy(spark, d):
    """Three configured sizes, one of which was not weighed, against the verdicts on the measured regions."""
    verdicts = studies.resolution_impact(found(spark, d), 640, 480, least=2.0).select("long_side", "verdict")
    each = [screens.transform_policy(verdicts, side) for side in (448, 960, 999)]
    return each[0].unionAll(each[1]).unionAll(each[2])


@query(
    f"WITH {MAPS}, {RUNS}, {COMPARED}, {HOLM}, cf AS (SELECT rule, CAST(count(*) FILTER (difference > 0) AS INT) AS wins, CAST(count(*) FILTER (difference <> 0) AS INT) AS n, avg(difference) AS gain, count(*) FILTER (high < 0) AS worse FROM ho GROUP BY rule), "
    "tl AS (SELECT *, coalesce(list_sum(list_transform(range(wins, n + 1), lambda i: gamma(n + 1.0) / gamma(i + 1.0) / gamma(n - i + 1.0))), 0) / pow(2.0, n) AS p FROM cf) "
    "SELECT rule, wins, n, round(gain, 6) AS mean_gain, worse, round(p, 6) AS sign_p, p <= 0.05 AND gain > 0 AND worse = 0 AS confirmed FROM tl"
)
def confirmation_rule(spark, d):
    return rounded(screens.confirmed(method_comparisons(spark, d), ("rule",)))


@query(f"WITH {CELLS}, {blur_sql('[0.0, 0.5, 1.0, 2.0]')}, s AS (SELECT c.label, sigma, round(max(x), 9) AS score FROM bl JOIN c USING (vec_id, pos) GROUP BY vec_id, c.label, sigma), f AS (SELECT sigma, score, sum(label) AS pos, count(*) - sum(label) AS neg FROM s GROUP BY ALL) SELECT sigma, round({AUROC}, 6) AS auroc, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM (SELECT *, sum(neg) OVER (PARTITION BY sigma ORDER BY score) AS cn FROM f) GROUP BY sigma")
def smoothing_sweep(spark, d):
    """AUROC of the maximum after smoothing by each of several widths."""
    m = T.maps(spark, d).select("label", "map", F.explode(F.array(*map(F.lit, (0.0, 0.5, 1.0, 2.0)))).alias("sigma"))
    swept = m.select("label", "sigma", F.round(F.array_max(rasters.smoothed_by()("map", F.lit(8), F.lit(8), "sigma")), 9).alias("score"))
    return rounded(ranking.roc_auc(swept, "label", "score", ("sigma",)))


@query()
def logistic_head(spark, d):
    m = T.maps(spark, d).select("vec_id", "label", F.array_max("map").alias("high"), C.mean_of(F.col("map")).alias("mean"), C.top_fraction_mean(F.col("map"), 0.05).alias("top"))
    model = screens.logistic_head(m.where("vec_id % 3 <> 0"), ("high", "mean", "top"), "label")
    return screens.head_scores(model, m).select("vec_id", "label", "score")


@query(
    "WITH s AS (SELECT p_partkey, CAST(p_partkey % 700 + 50 AS INT) AS n FROM part), g AS (SELECT *, CASE WHEN n <= 224 THEN 0 ELSE CAST(ceil((n - 192) / 160.0) AS INT) END AS gaps FROM s), "
    "k AS (SELECT *, unnest(range(gaps + 1)) AS k FROM g), w AS (SELECT *, CASE WHEN gaps = 0 THEN 0 ELSE CAST(round_even(k * (n - 192)::DOUBLE / gaps, 0) AS INT) END AS start FROM k), "
    "c AS (SELECT *, (start + 192 + lead(start) OVER o) // 2 AS cut FROM w WINDOW o AS (PARTITION BY p_partkey ORDER BY k)) "
    "SELECT p_partkey, start, CASE WHEN gaps = 0 THEN n ELSE start + 192 END AS stop, coalesce(CAST(lag(cut) OVER o AS INT), 0) AS own_from, coalesce(CAST(cut AS INT), n) AS own_to FROM c WINDOW o AS (PARTITION BY p_partkey ORDER BY k)"
)
def tile_windows(spark, d):
    """Windows of 192 cells with overlaps of 16 over axes of many lengths."""
    s = T.read(spark, d, "part").select("p_partkey", F.explode(rasters.tile_windows((F.col("p_partkey") % 700 + 50).cast("int"), 192, 16)).alias("w"))
    return s.select("p_partkey", "w.*")
