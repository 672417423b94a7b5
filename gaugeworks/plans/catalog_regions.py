"""Queries on regions of interest, overlap states, component trees, nearest hashes and cross-fitting; see
:mod:`gaugeworks.plans.catalog`."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import calibration, component_tree, crossfit, focus, integrity, overlap, rasters, splits, statistics
from gaugeworks.plans import tables as T
from gaugeworks.plans.catalog import CELLS, HASHES, MAPS, query, rounded
from gaugeworks.plans.catalog_models import PRO, REGIONS, found, masked
from gaugeworks.session import cut

# --- regions of interest -----------------------------------------------------------------------

#: Margins that reach one, two and four cells on maps of 8 x 8.
MARGINS = (0.1, 0.2, 0.35)
RADII = (1, 2, 4)


def fore_cells(spark, d):
    """Cells with fore: no background, as the borders of normal maps show it."""
    c = T.cells(spark, d)
    return focus.foreground(c, c.where("label = 0"), ("value",), "pos", 8, 8, quantile=0.9)


def ringed(spark, d):
    """Maps with their object mask, rings, marked cells and the share of border cells taken for an object."""
    flat = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda s: s[c])  # noqa: E731  64 cells
    on_edge = (F.col("pos") < 8) | (F.col("pos") >= 56) | (F.col("pos") % 8).isin(0, 7)
    own = fore_cells(spark, d).groupBy("vec_id", "label", "category").agg(flat("value").alias("map"), flat("fore").alias("fore"), flat("truth").alias("marked"), F.avg(F.when(on_edge, F.col("fore").cast("double"))).alias("border"))
    split = F.when(F.pmod("vec_id", F.lit(3)) == 0, "validation").otherwise("test")
    ring = focus.rings(MARGINS)(F.transform("fore", lambda x: x.cast("double")), F.lit(8), F.lit(8))
    return own.withColumn("split", split).withColumn("ring", ring)


FORE = CELLS + (
    ", bd AS (SELECT value FROM c WHERE label = 0 AND (pos < 8 OR pos >= 56 OR pos % 8 IN (0, 7))), b1 AS (SELECT avg(value) AS mu, var_samp(value) + 0.001::DOUBLE AS s FROM bd), "
    "b2 AS (SELECT value, (value - mu) * (value - mu) / s AS q FROM bd, b1), b3 AS (SELECT avg(value) AS mu, var_samp(value) + 0.001::DOUBLE AS s FROM b2 WHERE q <= (SELECT quantile_cont(q, 0.95) FROM b2)), "
    "b4 AS (SELECT mu, s, (SELECT quantile_cont((value - mu) * (value - mu) / s, 0.9) FROM bd) AS cut FROM b3), "
    "fo AS (SELECT c.*, (value - mu) * (value - mu) / s > cut AS fore, CASE WHEN vec_id % 3 = 0 THEN 'validation' ELSE 'test' END AS split FROM c, b4), "
    "di AS (SELECT a.vec_id, a.pos, min((a.pos // 8 - b.pos // 8) * (a.pos // 8 - b.pos // 8) + (a.pos % 8 - b.pos % 8) * (a.pos % 8 - b.pos % 8)) AS q FROM fo a JOIN fo b ON b.vec_id = a.vec_id AND b.fore GROUP BY ALL), "
    "ri AS (SELECT fo.*, CASE WHEN q IS NULL THEN 0 ELSE (q > 1)::INT + (q > 4)::INT + (q > 16)::INT END AS ring FROM fo LEFT JOIN di USING (vec_id, pos)), "
    "ma AS (SELECT unnest([0, 1, 2]) AS k, unnest([CAST(0.1 AS DOUBLE), CAST(0.2 AS DOUBLE), CAST(0.35 AS DOUBLE)]) AS margin), "
    "ro AS (SELECT vec_id, label, split, k, margin, list_reverse_sort(list(value)) AS o FROM ri, ma WHERE ring <= k GROUP BY ALL), "
    "ts AS (SELECT *, len(o) AS cells, o[1] AS high, CAST(greatest(1, round_even(len(o) * 0.05::DOUBLE, 0)) AS INT) AS n FROM ro), "
    "sc AS (SELECT vec_id, label, split, margin, cells, high, list_sum(o[1:n]) / n AS top FROM ts)"
)


@query(f"WITH {FORE} SELECT vec_id, margin, CAST(cells AS INT) AS cells, round(high, 6) AS high, round(top, 6) AS top FROM sc")
def roi_scores(spark, d):
    return rounded(focus.margin_scores(ringed(spark, d), "vec_id", "map", "ring", MARGINS))


@query(
    f"WITH {FORE}, w0 AS (SELECT vec_id, label, split, list_reverse_sort(list(value)) AS o FROM fo GROUP BY ALL), "
    "ls AS (SELECT vec_id, label, split, unnest(['max', 'top']) AS rule, unnest([o[1], round(list_sum(o[1:3]) / 3, 9)]) AS score FROM w0 "
    "UNION ALL SELECT vec_id, label, split, 'roi ' || margin || unnest([' max', ' top']), unnest([high, round(top, 9)]) FROM sc), "
    "fl AS (SELECT rule, score, sum(label) AS pos, count(*) - sum(label) AS neg FROM ls WHERE split = 'test' GROUP BY ALL), "
    "au AS (SELECT rule, sum(pos * (cn - neg / 2.0)) / (sum(pos) * sum(neg)) AS auroc FROM (SELECT *, sum(neg) OVER (PARTITION BY rule ORDER BY score) AS cn FROM fl) GROUP BY rule), "
    "vo AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY score DESC) AS q, count(*) OVER (PARTITION BY rule) AS n FROM ls WHERE split = 'validation' AND label = 0), "
    "th AS (SELECT rule, score AS threshold FROM vo WHERE q = greatest(1, CAST(floor(0.05 * (n + 1) + 1e-9) AS INT))) "
    "SELECT rule, round(auroc, 6) AS auroc, round(avg(CAST(score > threshold AS DOUBLE)) FILTER (label = 1), 6) AS recall, round(avg(CAST(score > threshold AS DOUBLE)) FILTER (label = 0), 6) AS fpr FROM ls JOIN th USING (rule) JOIN au USING (rule) WHERE split = 'test' GROUP BY rule, auroc"
)
def roi_study(spark, d):
    """Scores over the whole map and within each margin, at thresholds of their own from validation normals."""
    own = ringed(spark, d).withColumn("seed", F.lit(0))
    rules = {n: F.round(c, 9) if n.endswith("top") else c for n, c in focus.rules(F.col("map"), F.col("ring"), MARGINS).items()}
    out = calibration.aggregation_study(own, rules, "vec_id", "seed", "label", "split", 0.05)
    return rounded(out.select("rule", F.col("auroc_mean").alias("auroc"), F.col("recall_mean").alias("recall"), F.col("fpr_mean").alias("fpr")))


@query(
    f"WITH {FORE}, pa AS (SELECT vec_id, label, split, margin, avg(CAST(ring <= k AS DOUBLE)) AS part, avg(CAST(ring <= k AS DOUBLE)) FILTER (truth) AS covered, avg(CAST(fore AS DOUBLE)) FILTER (pos < 8 OR pos >= 56 OR pos % 8 IN (0, 7)) AS border FROM ri, ma GROUP BY ALL) "
    "SELECT margin, round(median(part) FILTER (split = 'validation'), 6) AS region_validation, round(median(part) FILTER (split = 'test'), 6) AS region_test, round(median(covered) FILTER (label = 1), 6) AS inside_median, "
    "round(avg(CAST(covered >= 0.999 AS DOUBLE)) FILTER (label = 1 AND covered IS NOT NULL), 6) AS fully_inside, count(covered) FILTER (label = 1) AS n_marked, round(median(border) FILTER (label = 0), 6) AS border_median, round(max(border) FILTER (label = 0), 6) AS border_max FROM pa GROUP BY margin"
)
def roi_checks(spark, d):
    return rounded(focus.assumption_checks(ringed(spark, d), "label", "split", "ring", "marked", "border", MARGINS))


# --- overlap states ----------------------------------------------------------------------------

AREAS = "SELECT CAST(m AS DOUBLE) AS fpr_limit, round(sum(CASE WHEN x0 < m THEN (least(x1, m) - x0) * (y0 + CASE WHEN x1 > m THEN y0 + coalesce((y1 - y0) / nullif(x1 - x0, 0), 0) * (m - x0) ELSE y1 END) / 2 ELSE 0 END) / m + greatest(0, m - max(x1)) * max_by(y1, x1) / m, 6) AS au_pro"
SAMPLED = (
    "ng AS (SELECT value, row_number() OVER (ORDER BY substr(sha256('3:' || vec_id || ':' || pos), 1, 15), value) AS r FROM c LEFT JOIN l USING (vec_id, pos) WHERE region IS NULL), "
    "q AS (SELECT value, sum(w) AS w, sum(n) AS neg FROM (SELECT value, 1.0::DOUBLE / (area * (SELECT count(*) FROM r)) AS w, 0 AS n FROM c JOIN l USING (vec_id, pos) JOIN r USING (vec_id, region) UNION ALL SELECT value, 0, 1 FROM ng WHERE r <= 5000) GROUP BY value), "
)


@query(
    f"WITH RECURSIVE {CELLS}, {REGIONS}, {SAMPLED} {PRO[PRO.index('p AS (') :]}, lim AS (SELECT unnest([0.05, 0.3]) AS m), e AS ({AREAS} FROM z, lim GROUP BY m) "
    "SELECT fpr_limit, au_pro, n_regions, n_negatives, sampled, round(sqrt(fpr_limit * (1 - fpr_limit) / sampled * (1 - sampled / n_negatives)), 6) AS fpr_error "
    "FROM e, (SELECT count(*) AS n_negatives, least(5000, count(*)) AS sampled FROM ng), (SELECT count(*) AS n_regions FROM r)"
)
def au_pro_sampled(spark, d):
    """The overlap area from the merged states of two halves of the maps, each with 5,000 of its negative cells at most."""
    c, f = T.cells(spark, d), found(spark, d)
    halves = [overlap.state(c.where(p), f.where(p), "vec_id", size=5_000, seed=3) for p in ("vec_id % 2 = 0", "vec_id % 2 <> 0")]
    return rounded(overlap.areas(overlap.merged(halves, 5_000), (0.05, 0.3)))


GRID = [round(-0.3 + 0.03 * k, 2) for k in range(30)]
RESAMPLED = (
    "rk AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('6:' || vec_id), vec_id) AS k FROM m), "
    "dr AS (SELECT resample, floor(CAST(('0x' || substr(sha256('6:' || resample || ':' || k), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0 * (SELECT count(*) FROM rk)) + 1 AS k, count(*) AS weight FROM rk, range(20) AS g(resample) GROUP BY ALL), "
    "wt AS (SELECT resample, vec_id, weight FROM dr JOIN rk USING (k)), "
    "cl AS (SELECT c.vec_id, c.value, CASE WHEN region IS NULL THEN 1 ELSE 0 END AS neg, CASE WHEN region IS NULL THEN 0 ELSE 1.0::DOUBLE / area END AS part FROM c LEFT JOIN l USING (vec_id, pos) LEFT JOIN r USING (vec_id, region)), "
    f"th AS (SELECT unnest({GRID})::DOUBLE AS t), "
    "pt AS (SELECT resample, t, sum(weight * neg) FILTER (value >= t) / sum(weight * neg) AS fpr, coalesce(sum(weight * part) FILTER (value >= t), 0) / sum(weight * part) AS pro FROM cl JOIN wt USING (vec_id), th GROUP BY resample, t), "
    "fp AS (SELECT resample, fpr, max(pro) AS pro FROM pt GROUP BY resample, fpr), z AS (SELECT resample, fpr AS x1, pro AS y1, coalesce(lag(fpr) OVER w, 0) AS x0, coalesce(lag(pro) OVER w, 0) AS y0 FROM fp WINDOW w AS (PARTITION BY resample ORDER BY fpr))"
)


@query(f"WITH RECURSIVE {CELLS}, {REGIONS}, {RESAMPLED}, lim AS (SELECT unnest([0.1, 0.3]) AS m) SELECT CAST(resample AS INT) AS resample, {AREAS[7:]} FROM z, lim GROUP BY resample, m")
def au_pro_bootstrap(spark, d):
    """The overlap area of each of 20 resamples of the maps, from one tabulation."""
    table = overlap.tabulated(T.cells(spark, d), found(spark, d), "vec_id", GRID)
    weights = statistics.resample_weights(T.maps(spark, d).select("vec_id"), "vec_id", 20, 6)
    return rounded(overlap.bootstrap(table, weights, "vec_id", len(GRID), 20, (0.1, 0.3)))


# --- rules from component trees ----------------------------------------------------------------

RULES = [component_tree.Rule(low, high, least, mark) for low in (0.15, 0.25) for high in (None, 0.3) for least in (1, 3) for mark in (0.0, 0.9)]
SUBSETS = {"all": "true", "regular": "vec_id % 4 = 1", "defective": "label = 1"}


@query(
    f"WITH RECURSIVE {CELLS}, lo AS (SELECT unnest([0.15, 0.25])::DOUBLE AS low), g AS (SELECT low, vec_id, pos, value FROM c, lo WHERE value > low), "
    "k AS (SELECT low, vec_id, pos, pos AS root FROM g UNION SELECT k.low, k.vec_id, g.pos, k.root FROM k JOIN g ON g.low = k.low AND g.vec_id = k.vec_id AND abs(g.pos // 8 - k.pos // 8) <= 1 AND abs(g.pos % 8 - k.pos % 8) <= 1), "
    "l AS (SELECT low, vec_id, pos, min(root) AS region FROM k GROUP BY ALL), r AS (SELECT low, vec_id, region, count(*) AS area, max(value) AS peak FROM l JOIN g USING (low, vec_id, pos) GROUP BY ALL), "
    "ru AS (SELECT low, CASE WHEN hi THEN 0.3::DOUBLE ELSE low END AS high, least, mark FROM lo, (SELECT unnest([true, false]) AS hi), (SELECT unnest([1, 3]) AS least), (SELECT unnest([0.0, 0.9])::DOUBLE AS mark)), "
    "kp AS (SELECT DISTINCT low, high, least, vec_id, pos FROM (SELECT DISTINCT low, high, least FROM ru) JOIN r USING (low) JOIN l USING (low, vec_id, region) WHERE peak > high AND area >= least), "
    "ct AS (SELECT low, high, least, c.vec_id, c.label, count(kp.pos) FILTER (truth) AS tp, count(kp.pos) FILTER (NOT truth) AS fp, count(*) FILTER (truth AND kp.pos IS NULL) AS fn, max(value) AS peak, arg_max(truth, (value, -c.pos)) AS spot FROM c CROSS JOIN (SELECT DISTINCT low, high, least FROM ru) "
    "LEFT JOIN kp USING (low, high, least, vec_id, pos) GROUP BY ALL), "
    "mk AS (SELECT low, high, least, mark, vec_id, label, tp + CAST(m AND spot AS INT) AS tp, fp + CAST(m AND NOT spot AS INT) AS fp, fn - CAST(m AND spot AS INT) AS fn, tp + fp > 0 OR m AS hit FROM (SELECT *, mark > 0 AND ct.tp + ct.fp = 0 AND peak > mark * low AS m FROM ct JOIN ru USING (low, high, least))), "
    "su AS (SELECT *, unnest(list_filter(['all', CASE WHEN vec_id % 4 = 1 THEN 'regular' END, CASE WHEN label = 1 THEN 'defective' END], lambda x: x IS NOT NULL)) AS subset FROM mk) "
    "SELECT low, high, CAST(least AS INT) AS least, mark, subset, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(coalesce(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 0), 6) AS segf1, "
    "round(coalesce(2.0 * count(*) FILTER (hit AND label = 1) / nullif(2 * count(*) FILTER (hit AND label = 1) + count(*) FILTER (hit AND label = 0) + count(*) FILTER (NOT hit AND label = 1), 0), 0), 6) AS classf1, "
    "round(count(*) FILTER (hit AND label = 0) / greatest(1, count(*) FILTER (label = 0)), 6) AS normals_flagged FROM su GROUP BY low, high, least, mark, subset"
)
def mask_rule_sweep(spark, d):
    """Sixteen rules on three overlapping subsets of the maps, from one tree a map."""
    return rounded(component_tree.evaluate(masked(spark, d), "map", "mask", "label", RULES, SUBSETS, 8, 8))


# --- nearest hashes ----------------------------------------------------------------------------


def split_hashes(spark, d):
    """Hashes with a split; in each third of the ids some lowest bits are turned, so that near ones exist."""
    h = T.hashes(spark, d)
    turned = F.expr("bits ^ (shiftleft(1L, CAST(vec_id % 9 AS INT)) - 1)")
    split = F.expr("CASE vec_id % 3 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' ELSE 'train' END")
    both = F.array(F.struct("vec_id", "bits"), F.struct((F.col("vec_id") + 1_000_000).alias("vec_id"), turned.alias("bits")))
    return h.select("category", F.explode(both).alias("x")).select("x.vec_id", "category", "x.bits").withColumn("split", split)


SPLIT_HASHES = HASHES + (
    ", x AS (SELECT *, CASE vec_id % 3 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' ELSE 'train' END AS split FROM (SELECT vec_id, category, bits FROM h UNION ALL SELECT vec_id + 1000000, category, xor(bits, (1::BIGINT << CAST(vec_id % 9 AS INT)) - 1) FROM h)), "
    "t AS (SELECT * FROM x WHERE split = 'train')"
)


@query(f"WITH {SPLIT_HASHES}, p AS (SELECT x.vec_id, t.vec_id AS neighbour, CAST(bit_count(xor(x.bits, t.bits)) AS INT) AS distance FROM x JOIN t ON x.vec_id <> t.vec_id) SELECT vec_id, neighbour, distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS r FROM p) WHERE r = 1")
def nearest_hashes(spark, d):
    """For each hash the nearest of the training set, itself left out."""
    x = cut(split_hashes(spark, d))  # read as queries and as bank
    return integrity.hamming_nearest(x, x.where("split = 'train'"), "vec_id", "bits", exclude_self=True)


@query(
    f"WITH {SPLIT_HASHES}, p AS (SELECT x.category, x.split, x.vec_id, CAST(min(bit_count(xor(x.bits, t.bits))) AS INT) AS d FROM x JOIN t ON x.category = t.category AND x.vec_id <> t.vec_id GROUP BY ALL), "
    "b AS (SELECT category, count(*) AS n_train, round(median(d), 6) AS train_median, quantile_cont(CAST(d AS DOUBLE), 0.01) AS threshold, count(*) FILTER (d = 0) AS train_equal FROM p WHERE split = 'train' GROUP BY category) "
    "SELECT category, n_train, train_median, round(threshold, 6) AS threshold, train_equal, "
    + ", ".join(f"count(*) FILTER (split = '{s}') AS {s}_n, round(median(d) FILTER (split = '{s}'), 6) AS {s}_median, count(*) FILTER (split = '{s}' AND d < threshold) AS {s}_below, count(*) FILTER (split = '{s}' AND d = 0) AS {s}_equal" for s in ("validation", "test"))
    + " FROM p JOIN b USING (category) WHERE split <> 'train' GROUP BY ALL"
)
def cross_split_hashes(spark, d):
    return rounded(integrity.cross_split_audit(split_hashes(spark, d), "vec_id", "bits", "split", ("category",)))


# --- cross-fitting -----------------------------------------------------------------------------


def folded_normals(spark, d):
    """Cells of the training normals with their fold."""
    c = T.cells(spark, d).where("label = 0 AND vec_id % 3 = 2")
    return c.join(splits.folds(c.select("vec_id").distinct(), "vec_id", 4, 8), "vec_id")


OOF = (
    "tr AS (SELECT vec_id, (row_number() OVER (ORDER BY sha256('8:' || vec_id), vec_id) - 1) % 4 AS fold FROM m WHERE label = 0 AND vec_id % 3 = 2), "
    "tc AS (SELECT c.vec_id, fold, pos, value FROM c JOIN tr USING (vec_id)), "
    "mo AS (SELECT f AS fold, pos, avg(value) AS mu, greatest(stddev_pop(value), 1e-6) AS sd FROM tc, (SELECT unnest([0, 1, 2, 3]) AS f) WHERE fold <> f GROUP BY ALL), "
    "oo AS (SELECT vec_id, tc.fold, max((value - mu) / sd) AS score FROM tc JOIN mo USING (fold, pos) GROUP BY ALL)"
)


@query(f"WITH {CELLS}, {OOF} SELECT vec_id, CAST(fold AS INT) AS fold, round(score, 5) AS score FROM oo")
def out_of_fold_scores(spark, d):
    return rounded(crossfit.out_of_fold_scores(folded_normals(spark, d), "vec_id", "fold"), 5)


@query(
    f"WITH {CELLS}, {OOF}, wh AS (SELECT pos, avg(value) AS mu, greatest(stddev_pop(value), 1e-6) AS sd FROM tc GROUP BY pos), "
    "sc AS (SELECT vec_id, label, vec_id % 3 AS s, round(max((value - mu) / sd), 7) AS score FROM c JOIN wh USING (pos) WHERE vec_id % 3 < 2 GROUP BY ALL), "
    "po AS (SELECT 'validation' AS source, score FROM sc WHERE s = 0 AND label = 0 UNION ALL SELECT 'out of fold', round(score, 7) FROM oo UNION ALL SELECT 'pooled', score FROM sc WHERE s = 0 AND label = 0 UNION ALL SELECT 'pooled', round(score, 7) FROM oo), "
    "rk AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC) AS q, count(*) OVER (PARTITION BY source) AS n FROM po), "
    "th AS (SELECT source, n, greatest(1, CAST(floor(0.02 * (n + 1) + 1e-9) AS INT)) AS k, score AS threshold FROM rk WHERE q = greatest(1, CAST(floor(0.02 * (n + 1) + 1e-9) AS INT))) "
    "SELECT source, n, k, round(k / (n + 1), 6) AS bound, round(threshold, 5) AS threshold, count(*) FILTER (label = 0 AND score > threshold) AS fp, round(avg(CAST(score > threshold AS DOUBLE)) FILTER (label = 0), 6) AS fpr, round(avg(CAST(score > threshold AS DOUBLE)) FILTER (label = 1), 6) AS recall FROM th, sc WHERE s = 1 GROUP BY ALL"
)
def crossfit_calibration(spark, d):
    """Thresholds from validation normals, from out-of-fold training normals, and from both; the tail p of each is tested apart."""
    c, train = T.cells(spark, d), folded_normals(spark, d)
    held = crossfit.scores(c.where("vec_id % 3 < 2"), train, "vec_id").join(T.maps(spark, d).select("vec_id", "label"), "vec_id").withColumn("score", F.round("score", 7))
    oof = crossfit.out_of_fold_scores(train, "vec_id", "fold").select(F.round("score", 7).alias("score"))
    val = held.where("label = 0 AND vec_id % 3 = 0").select("score")
    pools = {"validation": val, "out of fold": oof, "pooled": val.unionAll(oof)}
    out = crossfit.thresholds_of_pools(pools, held.where("vec_id % 3 = 1"), "label", "score", 0.02).drop("tail_p")
    return rounded(out.withColumn("threshold", F.round("threshold", 5)))
