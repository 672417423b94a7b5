"""Registered queries with their DuckDB twins. Floats are rounded to six decimals on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions import columns as C
from gaugeworks.operators import integrity, pooled, ranking, splits, statistics, thresholds
from gaugeworks.plans import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# common table expressions of the twins
EVENTS = "e AS (SELECT event_id, user_id, event_type, value AS score, CAST(event_type = 'error' AS INT) AS label, CASE WHEN user_id % 3 = 0 THEN 'validation' ELSE 'test' END AS split FROM events)"
VAL = "v AS (SELECT * FROM e WHERE split = 'validation' AND label = 0), t AS (SELECT * FROM e WHERE split = 'test')"
LINES = "e AS (SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'R' AS INT) AS label, round(l_extendedprice * (1 - l_discount), 2) AS score FROM lineitem)"
DOCS = "e AS (SELECT d.doc_id, lang, source, toxic AS label, CAST(n_chars AS DOUBLE) AS score FROM documents d JOIN labels USING (doc_id))"
MAPS = "m AS (SELECT vec_id, label AS category, CAST(label >= 5 AS INT) AS label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS map FROM embeddings)"
CELLS = MAPS + ", c AS (SELECT vec_id, category, label, pos, value, label = 1 AND pos < 32 AND value > 0.1 AS truth FROM (SELECT vec_id, category, label, unnest(range(64)) AS pos, unnest(map) AS value FROM m))"
HASHES = MAPS + """, h AS (SELECT vec_id, category, CAST(list_sum(list_transform(range(64), lambda i: CASE WHEN map[i + 1] > list_sort(map[2:64])[32] THEN CASE WHEN i = 63 THEN CAST(-9223372036854775808 AS HUGEINT) ELSE CAST(1 AS HUGEINT) << CAST(i AS INT) END ELSE CAST(0 AS HUGEINT) END)) AS BIGINT) AS bits FROM m)"""
FOLD = "f AS (SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM e GROUP BY score)"
AUROC = "sum(pos * (cn - neg / 2.0)) / (sum(pos) * sum(neg))"


def seeded_sql(seed: object, id: str) -> str:
    return f"sha256('{seed}:' || CAST({id} AS VARCHAR))"


# --- ranking -----------------------------------------------------------------------------------


@query(f"WITH {LINES}, {FOLD} SELECT round({AUROC}, 6) AS auroc, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM (SELECT *, sum(neg) OVER (ORDER BY score) AS cn FROM f)")
def roc_auc(spark, d):
    return rounded(ranking.roc_auc(T.lines(spark, d), "label", "score"))


@query(f"WITH {DOCS}, f AS (SELECT lang, score, sum(label) AS pos, count(*) - sum(label) AS neg FROM e GROUP BY lang, score) SELECT lang, round(sum(pos * (cn - neg / 2.0)) / nullif(sum(pos) * sum(neg), 0), 6) AS auroc, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM (SELECT *, sum(neg) OVER (PARTITION BY lang ORDER BY score) AS cn FROM f) GROUP BY lang")
def roc_auc_by_group(spark, d):
    return rounded(ranking.roc_auc(T.labelled_documents(spark, d), "label", "score", ("lang",)))


@query(f"WITH {LINES}, {FOLD} SELECT round(sum(pos * ctp / (ctp + cfp)) / (SELECT sum(pos) FROM f), 6) AS average_precision FROM (SELECT pos, CAST(sum(pos) OVER w AS DOUBLE) AS ctp, CAST(sum(neg) OVER w AS DOUBLE) AS cfp FROM f WINDOW w AS (ORDER BY score DESC))")
def average_precision(spark, d):
    return rounded(ranking.average_precision(T.lines(spark, d), "label", "score"))


@query(f"WITH {LINES}, {FOLD}, r AS (SELECT score, 2.0 * ctp / (ctp + cfp + p) AS f1 FROM (SELECT score, CAST(sum(pos) OVER w AS DOUBLE) AS ctp, CAST(sum(neg) OVER w AS DOUBLE) AS cfp, (SELECT CAST(sum(pos) AS DOUBLE) FROM f) AS p FROM f WINDOW w AS (ORDER BY score DESC))), b AS (SELECT * FROM r ORDER BY f1 DESC, score DESC LIMIT 1) SELECT round(f1, 6) AS f1, round(coalesce((score + (SELECT max(score) FROM f WHERE score < b.score)) / 2.0, score - 1.0), 6) AS threshold FROM b")
def f1_max(spark, d):
    return rounded(ranking.f1_max(T.lines(spark, d), "label", "score"))


@query(f"WITH {DOCS}, {FOLD} SELECT round(score, 6) AS score, round(ctp / (SELECT sum(pos) FROM f), 6) AS tpr, round(cfp / (SELECT sum(neg) FROM f), 6) AS fpr, round(ctp / (ctp + cfp), 6) AS precision FROM (SELECT score, CAST(sum(pos) OVER w AS DOUBLE) AS ctp, CAST(sum(neg) OVER w AS DOUBLE) AS cfp FROM f WINDOW w AS (ORDER BY score DESC))")
def pr_roc_curve(spark, d):
    return rounded(ranking.curve(T.labelled_documents(spark, d), "label", "score"))


@query(f"WITH {DOCS}, {FOLD}, p AS (SELECT cfp / (SELECT sum(neg) FROM f) AS x, ctp / (SELECT sum(pos) FROM f) AS y FROM (SELECT CAST(sum(pos) OVER w AS DOUBLE) AS ctp, CAST(sum(neg) OVER w AS DOUBLE) AS cfp FROM f WINDOW w AS (ORDER BY score DESC))), q AS (SELECT x, max(y) AS y FROM p GROUP BY x) SELECT round(sum((x - px) * (y + py) / 2.0), 6) AS area FROM (SELECT x, y, lag(x) OVER (ORDER BY x) AS px, lag(y) OVER (ORDER BY x) AS py FROM q)")
def trapezoid(spark, d):
    pts = ranking.curve(T.labelled_documents(spark, d), "label", "score").groupBy("fpr").agg(F.max("tpr").alias("tpr"))
    return rounded(ranking.trapezoid(pts, "fpr", "tpr"))


@query(f"WITH {EVENTS} SELECT CAST(count(*) FILTER (label = 1 AND score > 100) AS BIGINT) AS tp, CAST(count(*) FILTER (label = 0 AND score > 100) AS BIGINT) AS fp, CAST(count(*) FILTER (label = 1 AND score <= 100) AS BIGINT) AS fn, CAST(count(*) FILTER (label = 0 AND score <= 100) AS BIGINT) AS tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(fp / (fp + tn), 6) AS fpr FROM e")
def confusion_at_threshold(spark, d):
    return rounded(ranking.confusion(T.events(spark, d), "label", "score", 100.0))


@query("WITH e AS (SELECT l_linestatus, l_shipdate, CAST(l_returnflag = 'R' AS INT) AS label, l_quantity AS score FROM lineitem) SELECT l_linestatus, round(avg(CAST(score <= 25 AS DOUBLE)), 6) AS escape_rate, count(*) AS n FROM e WHERE label = 1 GROUP BY l_linestatus")
def escape_rate_by_defect(spark, d):
    x = T.read(spark, d, "lineitem").select("l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_quantity").alias("score"))
    return rounded(ranking.escape_rate(x, "label", "score", "l_linestatus", 25.0))


# --- thresholds --------------------------------------------------------------------------------

KTH = "k AS (SELECT count(*) AS n, CAST(floor({a} * (count(*) + 1) + 1e-9) AS INT) AS k FROM v), th AS (SELECT score AS threshold, k, n FROM (SELECT score, row_number() OVER (ORDER BY score DESC) AS r FROM v), k WHERE r = greatest(k, 1))"


@query(f"WITH {EVENTS}, {VAL}, {KTH.format(a=0.01)} SELECT round(threshold, 6) AS threshold, k, n, round(greatest(k, 1) / (n + 1), 6) AS effective, k >= 1 AS met FROM th")
def conformal_threshold(spark, d):
    v = T.events(spark, d).where("split = 'validation' AND label = 0")
    return rounded(thresholds.ranked_threshold(v, "score", 0.01))


@query(f"WITH {DOCS}, v AS (SELECT * FROM e WHERE label = 0), k AS (SELECT lang, count(*) AS n, CAST(floor(0.05 * (count(*) + 1) + 1e-9) AS INT) AS k FROM v GROUP BY lang) SELECT lang, round(score, 6) AS threshold, k, n, round(greatest(k, 1) / (n + 1), 6) AS effective, k >= 1 AS met FROM (SELECT lang, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC) AS r FROM v) JOIN k USING (lang) WHERE r = greatest(k, 1)")
def conformal_threshold_by_group(spark, d):
    v = T.labelled_documents(spark, d).where("label = 0")
    return rounded(thresholds.ranked_threshold(v, "score", 0.05, ("lang",), least_n=1))


@query(f"WITH {EVENTS}, {VAL}, {KTH.format(a=0.05)} SELECT round(threshold, 6) AS threshold, k, n, round(greatest(k, 1) / (n + 1), 6) AS effective, k >= 1 AS met FROM th")
def percentile_threshold(spark, d):
    v = T.events(spark, d).where("split = 'validation' AND label = 0")
    return rounded(thresholds.percentile_threshold(v, "score", 95.0))


@query(f"WITH {EVENTS}, {VAL} SELECT round(avg(score) + 3.0 * stddev_samp(score), 6) AS threshold FROM v")
def sigma_threshold(spark, d):
    return rounded(thresholds.sigma_threshold(T.events(spark, d).where("split = 'validation' AND label = 0"), "score", 3.0))


@query(f"WITH {EVENTS}, {VAL} SELECT round(median(score) + 3.0 * 1.4826 * median(abs(score - (SELECT median(score) FROM v))), 6) AS threshold FROM v")
def mad_threshold(spark, d):
    return rounded(thresholds.mad_threshold(T.events(spark, d).where("split = 'validation' AND label = 0"), "score", 3.0))


@query(f"WITH {EVENTS}, {VAL}, {KTH.format(a=0.01)} SELECT CAST(count(*) FILTER (label = 1 AND score > threshold) AS BIGINT) AS tp, CAST(count(*) FILTER (label = 0 AND score > threshold) AS BIGINT) AS fp, CAST(count(*) FILTER (label = 1 AND score <= threshold) AS BIGINT) AS fn, CAST(count(*) FILTER (label = 0 AND score <= threshold) AS BIGINT) AS tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(fp / (fp + tn), 6) AS fpr FROM t, th")
def operating_point(spark, d):
    e = T.events(spark, d)
    at = thresholds.ranked_threshold(e.where("split = 'validation' AND label = 0"), "score", 0.01)
    return rounded(thresholds.operating_point(e.where("split = 'test'"), "label", "score", at))


@query(f"WITH {EVENTS}, {VAL}, b AS (SELECT min(score) AS lo, max(score) AS hi FROM v) SELECT event_id, round((score - lo) / (hi - lo), 6) AS scaled FROM t, b")
def score_normalizer(spark, d):
    e = T.events(spark, d)
    n = thresholds.ScoreNormalizer().fit(e.where("split = 'validation' AND label = 0"), "score", "validation")
    return rounded(n.transform(e.where("split = 'test'"), "score").select("event_id", "scaled"))


@query(f"WITH {EVENTS}, {VAL}, {KTH.format(a=0.01)} SELECT event_type, CASE WHEN score <= 0.5 THEN 'refused' WHEN score > threshold THEN 'anomalous' ELSE 'normal' END AS decision, count(*) AS n FROM t, th GROUP BY ALL")
def three_way_decision(spark, d):
    e = T.events(spark, d)
    at = thresholds.ranked_threshold(e.where("split = 'validation' AND label = 0"), "score", 0.01).select("threshold")
    own = e.where("split = 'test'").crossJoin(F.broadcast(at))
    return own.groupBy("event_type", C.decision(F.col("score") > 0.5, F.col("score"), F.col("threshold")).alias("decision")).agg(F.count("*").alias("n"))


@query("SELECT n, round(1.0 / (n + 1), 6) AS least_rate, CAST(floor(0.01 * (n + 1) + 1e-9) AS INT) AS k FROM (SELECT l_linestatus, count(*) AS n FROM lineitem GROUP BY 1)")
def calibration_resolution(spark, d):
    n = T.read(spark, d, "lineitem").groupBy("l_linestatus").agg(F.count("*").alias("n"))
    return rounded(n.select("n", thresholds.least_rate(F.col("n")).alias("least_rate"), thresholds.conformal_rank(0.01, F.col("n")).alias("k")))


# --- splits ------------------------------------------------------------------------------------


@query(f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {seeded_sql(7, 'doc_id')}, doc_id) <= greatest(4, round_even((SELECT count(*) FROM documents) * 0.2, 0)) THEN 'validation' ELSE 'train' END AS split FROM documents")
def carve_validation(spark, d):
    return splits.carve(T.read(spark, d, "documents").select("doc_id"), "doc_id", 0.2, 7, 4)


@query(f"SELECT doc_id, CAST((row_number() OVER (ORDER BY {seeded_sql(3, 'doc_id')}, doc_id) - 1) % 5 AS INT) AS fold FROM documents")
def k_folds(spark, d):
    return splits.folds(T.read(spark, d, "documents").select("doc_id"), "doc_id", 5, 3)


@query(f"SELECT event_id FROM events ORDER BY {seeded_sql(0, 'event_id')}, event_id LIMIT 150")
def limit_split(spark, d):
    return splits.first_of(T.read(spark, d, "events").select("event_id"), "event_id", 150, 0)


@query("SELECT user_id, CAST(('0x' || substr(sha256('9:' || CAST(user_id AS VARCHAR)), 1, 8))::BIGINT % 2 AS INT) AS fold FROM (SELECT DISTINCT user_id FROM events)")
def cluster_folds(spark, d):
    return T.read(spark, d, "events").select("user_id").distinct().select("user_id", splits.cluster_fold(F.col("user_id"), 2, 9).alias("fold"))


@query("SELECT source, count(*) AS n, substr(sha256(concat_ws(':', count(*), CAST(sum(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT) AS BIGINT), bit_xor(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 9, 8))::BIGINT))), 1, 16) AS digest FROM documents GROUP BY source")
def split_listing(spark, d):
    return splits.listing_digest(T.read(spark, d, "documents"), "doc_id", ("source",))


# --- integrity ---------------------------------------------------------------------------------

TEXTS = "x AS (SELECT doc_id, source, sha256(text) AS h FROM documents)"


def _texts(spark, d):
    return T.read(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))


@query(f"WITH {TEXTS}, o AS (SELECT h, source, min(doc_id) AS id FROM x GROUP BY h, source) SELECT a.id AS a, b.id AS b, a.source AS split_a, b.source AS split_b FROM o a JOIN o b ON a.h = b.h AND a.source < b.source")
def splits_disjoint(spark, d):
    return integrity.crossing_pairs(_texts(spark, d), "h", "source", "doc_id")


@query(f"WITH {TEXTS}, f AS (SELECT h, min(doc_id) AS first FROM x GROUP BY h HAVING count(*) > 1) SELECT first, doc_id AS again FROM x JOIN f USING (h) WHERE doc_id <> first")
def duplicates_within(spark, d):
    return integrity.repeats(_texts(spark, d), "h", "doc_id")


@query(f"WITH {HASHES} SELECT vec_id, bits FROM h")
def sign_hash(spark, d):
    return T.hashes(spark, d).select("vec_id", "bits")


@query(f"WITH {HASHES}, x AS (SELECT vec_id, bits FROM h UNION ALL SELECT vec_id + 1000000, xor(bits, (1::BIGINT << CAST(vec_id % 20 AS INT)) - 1) FROM h) SELECT a.vec_id AS a, b.vec_id AS b, CAST(bit_count(xor(a.bits, b.bits)) AS INT) AS distance FROM x a JOIN x b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.bits, b.bits)) <= 14")
def near_duplicates_hamming(spark, d):
    """Hashes with a copy of each in which 0 to 19 of the lowest bits are turned."""
    h = T.hashes(spark, d).select("vec_id", "bits")
    turned = F.expr("bits ^ (shiftleft(1L, CAST(vec_id % 20 AS INT)) - 1)")
    both = F.array(F.struct("vec_id", "bits"), F.struct((F.col("vec_id") + 1_000_000).alias("vec_id"), turned.alias("bits")))
    return integrity.hamming_pairs(h.select(F.explode(both).alias("x")).select("x.*"), "vec_id", "bits", 14)


@query(f"WITH {HASHES}, p AS (SELECT a.category, bit_count(xor(a.bits, b.bits)) AS d FROM h a JOIN h b ON a.category = b.category AND a.vec_id < b.vec_id) SELECT category, count(*) AS pairs, CAST(min(d) AS INT) AS least, round(quantile_cont(CAST(d AS DOUBLE), 0.01), 6) AS threshold FROM p GROUP BY category")
def phash_threshold(spark, d):
    """A row for each category, over all its pairs."""
    return rounded(integrity.distance_percentile_by(T.hashes(spark, d), "category", "bits", 1.0))


query(ORACLE["phash_threshold"], "phash_threshold_all")(phash_threshold)


@query(f"WITH {TEXTS}, r AS (SELECT count(*) - count(DISTINCT h) AS n FROM x), c AS (SELECT h FROM x GROUP BY h HAVING count(DISTINCT source) > 1) SELECT 'duplicates' AS rule, n = 0 AS ok, n || ' repeated rows' AS detail FROM r UNION ALL SELECT 'disjoint', count(*) = 0, count(*) || ' shared contents' FROM c")
def leak_audit(spark, d):
    x = _texts(spark, d)
    a = integrity.report("duplicates", integrity.repeats(x, "h", "doc_id"), "first", "again", "repeated rows")
    b = integrity.report("disjoint", integrity.crossing(x, "h", "source").withColumn("s", F.array_join("splits", ",")), "h", "s", "shared contents")
    return integrity.audit(a, b).select("rule", "ok", "detail")


@query(f"WITH {CELLS} SELECT vec_id FROM m WHERE label = 1 AND vec_id NOT IN (SELECT vec_id FROM c WHERE truth AND value > 0.3)")
def masks_present(spark, d):
    marked = T.cells(spark, d).where("truth AND value > 0.3").select("vec_id").distinct().withColumn("mask", F.lit(True))
    return integrity.masks_present(T.maps(spark, d).select("vec_id", "label").join(marked, "vec_id", "left"), "label", "mask", "vec_id")


# --- pooled aggregates -------------------------------------------------------------------------

HIST = "b AS (SELECT CAST(least(greatest(floor((value + 0.6) / (1.2 / 256)), 0), 255) AS INT) AS bin, count(*) FILTER (truth) AS pos, count(*) FILTER (NOT truth) AS neg FROM c GROUP BY 1)"


@query(f"WITH {CELLS}, {HIST} SELECT * FROM b")
def pixel_histogram(spark, d):
    return pooled.histogram(T.cells(spark, d), -0.6, 0.6, 256)


@query(f"WITH {CELLS}, {HIST} SELECT round({AUROC}, 6) AS auroc, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM (SELECT *, sum(neg) OVER (ORDER BY bin) AS cn FROM b)")
def pixel_auroc(spark, d):
    return rounded(pooled.histogram_auroc(pooled.histogram(T.cells(spark, d), -0.6, 0.6, 256)))


@query(f"WITH {CELLS}, {HIST}, w AS (SELECT bin, sum(pos + neg) OVER (ORDER BY bin DESC) AS tail, (SELECT sum(pos + neg) FROM b) AS n FROM b) SELECT round(coalesce(min(-0.6 + bin * (1.2 / 256)), 0.6), 6) AS threshold FROM w WHERE tail <= 0.01 * n")
def pixel_quantile(spark, d):
    return rounded(pooled.tail_threshold(pooled.histogram(T.cells(spark, d), -0.6, 0.6, 256), 0.01, -0.6, 0.6, 256))


@query(f"WITH {CELLS}, s AS (SELECT avg(value) + 2.0 * stddev_pop(value) AS t FROM c WHERE label = 0) SELECT CAST(count(*) FILTER (value > t AND truth) AS BIGINT) AS tp, CAST(count(*) FILTER (value > t AND NOT truth) AS BIGINT) AS fp, CAST(count(*) FILTER (value <= t AND truth) AS BIGINT) AS fn, CAST(count(*) FILTER (value <= t AND NOT truth) AS BIGINT) AS tn, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(tp / (tp + fp + fn), 6) AS iou FROM c, s")
def segmentation_metrics(spark, d):
    c = T.cells(spark, d)
    t = thresholds.sigma_threshold(c.where("label = 0"), "value", 2.0, sample=False)
    return rounded(pooled.overlap(c.crossJoin(F.broadcast(t)), F.col("threshold")))


@query(f"WITH {MAPS} SELECT category, round(min(list_min(map)), 6) AS low, round(max(list_max(map)), 6) AS high FROM m GROUP BY category")
def raw_range(spark, d):
    return rounded(pooled.range_of(T.maps(spark, d), "map", ("category",)))


@query(f"WITH {CELLS}, s AS (SELECT pos, avg(value) AS mean, greatest(stddev_pop(value), 1e-6) AS sd FROM c WHERE label = 0 GROUP BY pos) SELECT vec_id, round(max((value - mean) / sd), 6) AS zmax FROM c JOIN s USING (pos) GROUP BY vec_id")
def location_zmax(spark, d):
    c = T.cells(spark, d)
    return rounded(pooled.location_zmax(c, pooled.location_statistics(c.where("label = 0")), "vec_id"))


@query(f"WITH {CELLS}, v AS (SELECT * FROM c WHERE label = 0), s AS (SELECT pos, sum(value) AS t, sum(value * value) AS q, count(*) AS n FROM v GROUP BY pos) SELECT vec_id, round(max((value - (t - value) / (n - 1)) / greatest(sqrt(greatest((q - value * value) / (n - 1) - ((t - value) / (n - 1)) * ((t - value) / (n - 1)), 0)), 1e-6)), 6) AS zmax FROM v JOIN s USING (pos) GROUP BY vec_id")
def leave_one_out_zmax(spark, d):
    v = T.cells(spark, d).where("label = 0")
    return rounded(pooled.leave_one_out_zmax(v, pooled.location_statistics(v), "vec_id"))


@query(f"WITH {MAPS} SELECT vec_id, round(list_max(map), 6) AS \"max\", round(list_sum(map) / 64, 6) AS mean, round(list_sum(list_reverse_sort(map)[1:3]) / 3, 6) AS top_5 FROM m")
def map_aggregation(spark, d):
    return rounded(T.maps(spark, d).select("vec_id", *(C.AGGREGATIONS[r](F.col("map")).alias(r) for r in ("max", "mean", "top_5"))))


@query(f"WITH {MAPS}, s AS (SELECT category, vec_id, list_sum(map) / 64 AS x FROM m), g AS (SELECT CAST(category >= 5 AS INT) AS other, avg(x) AS mean, var_samp(x) AS var FROM s GROUP BY 1) SELECT round((b.mean - a.mean) / sqrt((a.var + b.var) / 2), 6) AS cohens_d, round(sqrt(b.var) / sqrt(a.var), 6) AS sd_ratio, round(b.mean - a.mean, 6) AS delta FROM g a, g b WHERE a.other = 0 AND b.other = 1")
def lighting_shift(spark, d):
    s = T.maps(spark, d).select("label", C.mean_of(F.col("map")).alias("x"))
    g = lambda y, p: s.where(F.col("label") == y).agg(F.avg("x").alias(f"m{p}"), F.var_samp("x").alias(f"v{p}"))
    own = g(0, "a").crossJoin(F.broadcast(g(1, "b")))  # one row each
    return rounded(own.select(F.try_divide(F.col("mb") - F.col("ma"), F.sqrt((F.col("va") + F.col("vb")) / 2)).alias("cohens_d"), F.try_divide(F.sqrt("vb"), F.sqrt("va")).alias("sd_ratio"), (F.col("mb") - F.col("ma")).alias("delta")))


# --- statistics --------------------------------------------------------------------------------


@query("WITH p AS (SELECT p_brand, count(*) AS n, 1.0 / (1 + count(*) % 97) AS p FROM part GROUP BY p_brand) SELECT p_brand, round(p, 6) AS p, round(least(1.0, max(s) OVER (ORDER BY p, p_brand)), 6) AS p_holm, least(1.0, max(s) OVER (ORDER BY p, p_brand)) <= 0.05 AS rejected FROM (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, p_brand) + 1) * p AS s FROM p)")
def holm_bonferroni(spark, d):
    p = T.read(spark, d, "part").groupBy("p_brand").agg((1.0 / (1 + F.count("*") % 97)).alias("p"))
    return rounded(statistics.holm(p, "p", "p_brand"))


def normal_tail_sql(z: str) -> str:
    """Two-sided normal tail of a z-score from 0 on, by Simpson's rule up to z + 10 in 4,000 steps of 1 / 400."""
    return f"list_sum(list_transform(range(4001), lambda i: (CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5 * ({z} + i / 400.0) * ({z} + i / 400.0)))) * 2 / 1200.0 / sqrt(2 * pi())"


@query(
    f"WITH {EVENTS}, {VAL}, b AS (SELECT score, 0 AS y FROM v UNION ALL SELECT score, 1 FROM t WHERE label = 0), f AS (SELECT score, sum(y) AS pos, count(*) - sum(y) AS neg FROM b GROUP BY score), "
    "u AS (SELECT sum(pos * (cn - neg / 2.0)) AS u, CAST(sum(pos) AS DOUBLE) AS p, CAST(sum(neg) AS DOUBLE) AS n, CAST(sum((pos + neg) * (pos + neg) * (pos + neg) - (pos + neg)) AS DOUBLE) AS ties FROM (SELECT *, sum(neg) OVER (ORDER BY score) AS cn FROM f)), "
    "z AS (SELECT u / (p * n) AS auroc, greatest(abs(u - p * n / 2) - 0.5, 0) / sqrt(p * n / 12 * (p + n + 1 - ties / ((p + n) * (p + n - 1)))) AS z FROM u) "
    f"SELECT round(auroc, 6) AS auroc, (SELECT round(median(score) FILTER (y = 0), 6) FROM b) AS median_a, (SELECT round(median(score) FILTER (y = 1), 6) FROM b) AS median_b, round({normal_tail_sql('z')}, 6) AS p_value FROM z"
)
def normal_shift(spark, d):
    e = T.events(spark, d).where("label = 0")
    return rounded(statistics.normal_shift(e.where("split = 'validation'"), e.where("split = 'test'"), "score").drop("z", "n_a", "n_b"))


WEIGHTS = "r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('1:' || CAST(doc_id AS VARCHAR)), doc_id) AS k FROM labels), d AS (SELECT resample, floor(CAST(('0x' || substr(sha256('1:' || resample || ':' || k), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0 * (SELECT count(*) FROM r)) + 1 AS k, count(*) AS weight FROM r, range(50) AS g(resample) GROUP BY ALL)"


@query(f"WITH {WEIGHTS}, w AS (SELECT resample, sum(weight * quality) / sum(weight) AS m FROM d JOIN r USING (k) JOIN labels USING (doc_id) GROUP BY resample) SELECT (SELECT round(avg(quality), 6) FROM labels) AS estimate, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM w")
def bootstrap_ci(spark, d):
    x = T.read(spark, d, "labels")
    return rounded(statistics.bootstrap_mean(x.withColumn("quality", F.col("quality").cast("double")), "doc_id", "quality", 50, seed=1).select("estimate", "low", "high"))


@query(f"WITH {EVENTS}, n AS (SELECT * FROM e WHERE label = 0 AND split = 'validation'), s AS (SELECT draw, score FROM (SELECT draw, score, row_number() OVER (PARTITION BY draw ORDER BY sha256('5:' || draw || ':' || event_id), event_id) AS r FROM n, range(20) AS g(draw)) WHERE r <= 99), k AS (SELECT draw, score AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY draw ORDER BY score DESC) AS q FROM s) WHERE q = 5) SELECT draw, round(threshold, 6) AS threshold, round(avg(CAST(t.score > threshold AS DOUBLE)), 6) AS fpr FROM k, e AS t WHERE t.split = 'test' AND t.label = 0 GROUP BY ALL")
def calibration_study(spark, d):
    e = T.events(spark, d).where("label = 0")
    s = splits.draws(e.where("split = 'validation'"), "event_id", 20, 99, 5)
    t = thresholds.ranked_threshold(s, "score", 0.05, ("draw",)).select(F.col("draw").cast("long").alias("draw"), "threshold")
    test = e.where("split = 'test'").crossJoin(F.broadcast(t))  # one row for each draw
    return rounded(test.groupBy("draw", "threshold").agg(F.avg((F.col("score") > F.col("threshold")).cast("double")).alias("fpr")))


def boot_sql(rows: str, n: int, seed: int, id: str, by: str = "", draw: str = "label") -> str:
    """CTEs up to bo: both AUROCs and their difference for each resample (-1: as it is) of ``rows`` (by, id, label, a, b)."""
    by, text = by and f"{by}, ", "".join(f" || {c} || ':'" for c in draw.split(", ") if c)
    part, of, using = (f"PARTITION BY {draw} " if draw else ""), (f"{draw}, " if draw else ""), ", ".join(x for x in (draw, id) if x)
    return (
        f"rk AS (SELECT *, row_number() OVER ({part}ORDER BY sha256('{seed}:' || {id}), {id}) AS k, count(*) OVER ({part}) AS n FROM (SELECT DISTINCT {of}{id} FROM {rows})), "
        f"dr AS (SELECT {of}resample, floor(CAST(('0x' || substr(sha256('{seed}:' || resample || ':'{text} || k), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0 * n) + 1 AS k, count(*) AS w FROM rk, range({n}) AS g(resample) GROUP BY ALL), "
        f"wt AS (SELECT resample, w, r.* FROM (SELECT {of}{id}, resample, w FROM dr JOIN rk USING ({of}k)) JOIN {rows} r USING ({using})), "
        f"ar AS (SELECT resample, {by}label, w, unnest(['a', 'b']) AS arm, unnest([a, b]) AS s FROM wt UNION ALL SELECT -1, {by}label, 1, unnest(['a', 'b']), unnest([a, b]) FROM {rows}), "
        f"fd AS (SELECT resample, {by}arm, s, coalesce(sum(w) FILTER (label = 1), 0) AS pos, coalesce(sum(w) FILTER (label = 0), 0) AS neg FROM ar GROUP BY ALL), "
        f"ax AS (SELECT resample, {by}arm, sum(pos * (cn - neg / 2.0)) / nullif(sum(pos) * sum(neg), 0) AS auroc FROM (SELECT *, sum(neg) OVER (PARTITION BY resample, {by}arm ORDER BY s) AS cn FROM fd) GROUP BY resample, {by}arm), "
        f"bo AS (SELECT resample, {by}max(auroc) FILTER (arm = 'a') AS auroc_a, max(auroc) FILTER (arm = 'b') AS auroc_b, max(auroc) FILTER (arm = 'a') - max(auroc) FILTER (arm = 'b') AS d FROM ax GROUP BY resample{', ' + by[:-2] if by else ''})"
    )


TWO_SIDED = "least(1.0, 2.0 * (least(count(*) FILTER (resample >= 0 AND d <= 0), count(*) FILTER (resample >= 0 AND d >= 0)) + 1) / (count(d) FILTER (resample >= 0) + 1))"
BOOT = f"round(max(auroc_a) FILTER (resample < 0), 6) AS auroc_a, round(max(auroc_b) FILTER (resample < 0), 6) AS auroc_b, round(max(d) FILTER (resample < 0), 6) AS difference, round(quantile_cont(d, 0.025) FILTER (resample >= 0), 6) AS low, round(quantile_cont(d, 0.975) FILTER (resample >= 0), 6) AS high, round({TWO_SIDED}, 6) AS p_value, count(d) FILTER (resample >= 0) AS n_resamples"


@query(f"WITH {DOCS}, x AS (SELECT doc_id, label, score AS a, CAST(doc_id % 97 AS DOUBLE) AS b FROM e), {boot_sql('x', 50, 2, 'doc_id')} SELECT {BOOT} FROM bo")
def paired_bootstrap(spark, d):
    x = T.labelled_documents(spark, d).withColumn("other", F.pmod("doc_id", F.lit(97)).cast("double"))
    return rounded(statistics.paired_bootstrap(x, "doc_id", "label", "score", "other", 50, seed=2))


@query(f"WITH {EVENTS}, x AS (SELECT user_id, label, score AS a, CAST(event_id % 97 AS DOUBLE) AS b FROM e), {boot_sql('x', 20, 2, 'user_id', draw='')} SELECT {BOOT} FROM bo")
def cluster_bootstrap(spark, d):
    x = T.events(spark, d).withColumn("other", F.pmod("event_id", F.lit(97)).cast("double"))
    return rounded(statistics.paired_bootstrap(x, "event_id", "label", "score", "other", 20, seed=2, cluster="user_id"))


@query(
    "WITH x AS (SELECT abs(l_discount - l_tax) AS m, CAST(l_discount > l_tax AS INT) AS up FROM lineitem WHERE l_discount - l_tax <> 0), g AS (SELECT m, count(*) AS t, sum(up) AS up FROM x GROUP BY m), "
    "k AS (SELECT *, sum(t) OVER (ORDER BY m) - (t - 1) / 2.0 AS r FROM g), s AS (SELECT CAST(sum(t) AS DOUBLE) AS n, sum(up * r) AS w, CAST(sum(t * t * t - t) AS DOUBLE) AS ties FROM k), "
    "q AS (SELECT n, least(w, n * (n + 1) / 2 - w) AS w, sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS sd FROM s), z AS (SELECT n, w, (n * (n + 1) / 4 - w) / sd AS z FROM q) "
    f"SELECT CAST(n AS BIGINT) AS n, round(w, 6) AS statistic, round({normal_tail_sql('z')}, 6) AS p_value FROM z"
)
def wilcoxon_signed_rank(spark, d):
    return rounded(statistics.one_row(spark, statistics.wilcoxon(T.read(spark, d, "lineitem"), "l_discount", "l_tax")))


@query()
def exact_tails(spark, d):
    c = operating_point(spark, d).first()
    return statistics.one_row(spark, {"upper_bound": statistics.binomial_upper_bound(c.fp, c.fp + c.tn), "exceedance_p": statistics.exceedance_p(c.fp, c.fp + c.tn, 100, 1), "sign_test_p": statistics.sign_test(c.tp, c.tp + c.fp)})
