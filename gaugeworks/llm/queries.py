"""The registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import bpe, decontam, html, jaccard, negatives, pieces, pii, ranking, secrets, tokencount, toxicity, urls, vectors
from gaugeworks.llm import spans as S


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.contamination(docs, items).select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        decontam.items_digest(F.col("_items")).alias("items_sha256"),
        decontam.is_contaminated().alias("contaminated"),
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe.encode(docs, tokenizer_path(), digests=True)


def _span_report(found: DataFrame, column: str, kinds: list[str], base: int) -> DataFrame:
    spans = F.col(column)
    return found.select(
        "doc_id",
        *(S.count_kind(spans, k).alias(f"n_{kinds[k]}") for k in range(base)),
        F.sha2(S.described(S.of_kinds(spans, base), kinds), 256).alias("base_sha256"),
        S.described(spans, kinds).alias("spans"),
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return _span_report(pii.find(docs), "pii", pii.KINDS, pii.BASE)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return _span_report(secrets.find(docs), "secrets", [r.kind for r in secrets.RULES], secrets.BASE)


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return tokencount.count_tokens(docs, tokencount.piece_scores(tokenizer_path("piece_bpe_32k.model")))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return urls.judge(pages, urls.mine(pages, labels))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels))
    value = F.col("_toxicity.score")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), value.alias("score"), (value >= 0.5).cast("int").alias("predicted"), F.col("_toxicity.evidence").alias("evidence"))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3_pii that a SQL twin can express."""
    return op3_pii(spark, sf_dir).drop("spans")


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8_secrets that a SQL twin can express."""
    return op8_secrets(spark, sf_dir).drop("spans")


def url_written_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and the rule's verdict of every page."""
    judged = urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), [])
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


def op6_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pieces.encode(docs, tokenizer_path("piece_bpe_32k.model"), digests=True)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return ranking.search(docs, items)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


QUERIES = {"op13_hard_negatives": op13_hard_negatives, "op12_lexical_search": op12_lexical_search, "op11_sentencepiece": op11_sentencepiece, "op6_embedding_join": op6_embedding_join, "op10_jaccard_join": op10_jaccard_join, "op1_html": op1_html, "op2_token_counts": op2_token_counts, "op3_pii": op3_pii, "op4_url_filter": op4_url_filter, "op5_toxicity": op5_toxicity, "op8_secrets": op8_secrets, "op7_decontamination": op7_decontamination, "op9_bpe": op9_bpe, "pii_base": pii_base, "secrets_base": secrets_base, "url_written_rules": url_written_rules}


def _spans_sql(kinds: dict[str, tuple[str, str]]) -> str:
    """Counts and digest of the matches of each kind's pattern for which its condition on ``s`` holds."""
    rows = ", ".join(f"('{kind}', {no}, '{pattern}')" for no, (kind, (pattern, _)) in enumerate((k, (p.replace("'", "''"), c)) for k, (p, c) in kinds.items()))
    tests = " ".join(f"WHEN '{kind}' THEN {test}" for kind, (_, test) in kinds.items())
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{kind}') AS BIGINT) AS n_{kind}" for kind in kinds)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
k(kind, no, pattern) AS (VALUES {rows}),
x AS (SELECT r, kind, no, regexp_extract_all(t, pattern) AS m, string_split_regex(t, pattern) AS g FROM d, k),
y AS (SELECT r, kind, no, m, g, unnest(range(1, len(m) + 1)) AS i FROM x WHERE len(m) > 0),
z AS (SELECT r, kind, no, m[i] AS s, list_sum(list_transform(g[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda v: length(v))), 0) AS a FROM y),
q AS (SELECT *, regexp_replace(s, '[^0-9]', '', 'g') AS digits FROM z),
f AS (SELECT r, kind, no, CAST(a AS BIGINT) AS a, CAST(a + length(s) AS BIGINT) AS b FROM q WHERE CASE kind {tests} END),
c AS (SELECT r, {counts}, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, no) AS named FROM f GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in kinds)}, sha256(coalesce(named, '')) AS base_sha256 FROM d LEFT JOIN c USING (r)"""


_LUHN = "list_sum(list_transform(range(1, length(digits) + 1), lambda p: CASE WHEN p % 2 = 1 THEN CAST(digits[-p] AS INT) WHEN CAST(digits[-p] AS INT) > 4 THEN 2 * CAST(digits[-p] AS INT) - 9 ELSE 2 * CAST(digits[-p] AS INT) END)) % 10 = 0"
_EITHER_CASE = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "(password|passwd|secret|token|api_?key)")

ORACLE = {
    "pii_base": _spans_sql({
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_max(list_transform(string_split(s, '.'), lambda p: CASE WHEN length(ltrim(p, '0')) > 3 THEN 999 ELSE CAST('0' || ltrim(p, '0') AS INT) END)) <= 255"),
        "card": (r"[0-9]([ -]?[0-9])+", f"length(digits) BETWEEN 14 AND 19 AND {_LUHN}"),
        "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "length(digits) BETWEEN 10 AND 15"),
    }),
    "secrets_base": _spans_sql({
        "assign": (_EITHER_CASE + r"""["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", r"""length(regexp_extract(s, '[:=] *["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6"""),
        "access": ("AKIA[A-Z0-9]+", "length(s) >= 20"),
        "hex": ("[0-9a-f]{24,}", "true"),
    }),
    "url_written_rules": r"""
WITH u AS (SELECT page_id, row_number() OVER () AS r, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
k(rule, verdict) AS (VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')),
p AS (SELECT rule, verdict, string_split(rule, '/')[1] AS h, substr(rule, length(string_split(rule, '/')[1]) + 1) AS start FROM k),
b AS (SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM u JOIN p ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, start) GROUP BY r)
SELECT page_id, host, path, rule, verdict FROM u LEFT JOIN b USING (r)""",
    "op6_embedding_join": r"""
WITH RECURSIVE u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
v AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM u
      WHERE label IS NOT NULL AND e IS NOT NULL AND NOT list_contains(list_transform(e, lambda x: x IS NULL OR NOT isfinite(x)), true) AND list_sum(list_transform(e, lambda x: abs(x))) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT m.vec_id, CAST((SELECT count(*) FROM l WHERE l.a = m.vec_id) AS BIGINT) AS n_links, c.component_id, m.vec_id = c.component_id AS kept
FROM embeddings m JOIN c ON c.a = m.vec_id""",
    "op10_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM documents JOIN m ON m.a = documents.doc_id LEFT JOIN n ON n.doc_id = documents.doc_id""",
    "op12_lexical_search": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
a AS (SELECT q, item_id, t, count(*) AS times FROM (SELECT q, item_id, unnest(w) AS t FROM i) GROUP BY ALL),
n AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0),
f AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight FROM (SELECT t, count(*) AS df FROM p GROUP BY t), n),
m AS (SELECT r, doc_id, 75 + (25 * len(w) * docs) // terms AS m FROM d, n WHERE len(w) > 0),
s AS (SELECT q, item_id, r, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM a JOIN f USING (t) JOIN p USING (t) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 20""",
    "op13_hard_negatives": r"""
WITH u AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
s AS (SELECT a.r, a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM u a JOIN u b ON len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0),
p AS (SELECT r, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS k FROM s WHERE label = own AND vec_id <> anchor_id),
n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY r, k ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
      FROM p JOIN s USING (r) WHERE k <= 5 AND label <> own AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    "op7_decontamination": r"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT item_id, least(13, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) AS gram FROM iw WHERE len(w) > 0),
d AS (SELECT r, k, unnest(range(1, len(w) - k + 2)) AS p, w FROM dw, (SELECT DISTINCT k FROM g) WHERE len(w) >= k),
h AS (SELECT DISTINCT r, p, d.k, item_id FROM d JOIN g ON g.k = d.k AND g.gram = array_to_string(w[p:p + d.k - 1], ' ')),
n AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM h) GROUP BY r),
i AS (SELECT r, count(s) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN n USING (r) LEFT JOIN i USING (r)""",
}
