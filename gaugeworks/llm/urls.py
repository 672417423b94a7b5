"""URL filtering: written rules first, then association rules mined from labelled URLs.

A written rule names a host (its subdomains included) and the start of a path; the longest that
fits decides. Other URLs are judged by rules that Spark's FP-growth mines from the labelled
pages: every URL becomes a transaction of tokens (host labels and suffixes, path parts, query keys, scheme,
file extension), a labelled page adds its label, and of the rules "tokens -> block" those stay that hold
on ``LEAST_PAGES`` labelled pages and the share ``MIN_SUPPORT``, whose confidence keeps a lower bound (Wilson, 95 %) of
``MIN_CONFIDENCE`` and a lift of ``MIN_LIFT`` over the share of bad pages, and that improve on every rule with fewer
of the same tokens. They are matched through an inverted index from token to rules. Without a rule that
fits, the URL is allowed. :func:`held_out_quality` tells what the mined rules are worth on pages they never saw.

The rules are bounded by the minimum support: at most (tokens of a URL / support) tokens can be
frequent at all, whatever the number of pages, and the tests above are made before rules leave the executors.
Null URLs and URLs without "://" have an empty host and path and fit no written rule; very long URLs are
read whole; repeated rows are judged alike, and count as often as they are labelled; pages without label, or
with a null one, teach nothing; a page labelled both ways is bad; rules of equal confidence give one verdict;
empty tables give no rules or no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: verdict by host and path, longest first by :func:`written`.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
MIN_SUPPORT, LEAST_PAGES, MIN_CONFIDENCE, MIN_LIFT = 0.002, 8, 0.5, 1.5
BLOCK, ALLOW = "label=block", "label=allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL; runs of digits count as one token."""
    h, p = host(url), path(url)
    labels = F.split(h, r"\.")
    suffix = F.when(F.size(labels) > 1, F.concat(F.lit("site="), F.array_join(F.slice(labels, -2, 2), ".")))
    parts = F.filter(F.split(F.regexp_replace(p, "[0-9]+", "0"), "/"), lambda x: x != "")
    query = F.regexp_extract_all(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1))
    own = F.concat(
        F.transform(F.filter(labels, lambda x: x != ""), lambda x: F.concat(F.lit("host="), x)),
        F.array(suffix, F.concat(F.lit("scheme="), F.regexp_extract(url, r"\A([A-Za-z]+)://", 1)), F.when(url.contains("#"), F.lit("fragment"))),
        F.transform(parts, lambda x: F.concat(F.lit("path="), x)),
        F.transform(query, lambda x: F.concat(F.lit("key="), x)),
    )
    return F.coalesce(F.array_distinct(F.array_compact(own)), F.array().cast("array<string>"))


@dataclass(frozen=True)
class Mined:
    tokens: frozenset[str]
    confidence: float
    support: float


def mine(pages: DataFrame, labels: DataFrame, url: str = "url", id: str = "page_id", label_id: str = "doc_id", bad: Column | None = None, min_support: float = MIN_SUPPORT, least_pages: int = LEAST_PAGES, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> list[Mined]:
    """Pruned rules from token sets to ``block``, from every labelled page."""
    from pyspark.ml.fpm import FPGrowth

    bad = (F.col("quality") == 0) | (F.col("toxic") == 1) if bad is None else bad
    known = labels.select(F.col(label_id).alias("_id"), bad.alias("_bad")).where("_bad IS NOT NULL").groupBy("_id").agg(F.max("_bad").alias("_bad"))
    own = pages.select(F.col(id).alias("_id"), F.col(url).cast("string").alias("_url")).where("_url IS NOT NULL").join(known, "_id")
    rows = own.select(F.concat(tokens(F.col("_url")), F.array(F.when(F.col("_bad"), BLOCK).otherwise(ALLOW))).alias("items"))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.array_contains("items", BLOCK).cast("int")).alias("bad")).first()
    if not size.n or not size.bad:
        return []
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, least_pages / size.n), minConfidence=min_confidence).fit(rows)
    sets = model.associationRules.where(F.array_contains("consequent", BLOCK))
    pages_met = F.col("support") * size.n / F.col("confidence")
    sets = sets.where((wilson(F.col("confidence"), pages_met) >= min_confidence) & (F.col("confidence") >= min_lift * size.bad / size.n))
    found = [Mined(frozenset(r.antecedent), r.confidence, r.support) for r in sets.select("antecedent", "confidence", "support").collect()]
    return prune(found)


def wilson(share: Column, n: Column) -> Column:
    """Lower end of the 95 % score interval of a share among ``n``."""
    z = 1.96
    return (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def held_out_quality(pages: DataFrame, labels: DataFrame, id: str = "page_id", label_id: str = "doc_id", fold: int = 0, folds: int = 5, **options) -> DataFrame:
    """One row (n, n_bad, n_blocked, n_right) over the labelled pages of one fold by hash, under rules mined from the others."""
    inside = lambda c: F.pmod(F.xxhash64(c), F.lit(folds)) == fold
    bad = options.get("bad", (F.col("quality") == 0) | (F.col("toxic") == 1))
    mined = mine(pages, labels.where(~inside(label_id)), id=id, label_id=label_id, **options)
    truth = labels.where(inside(label_id)).select(F.col(label_id).alias("_id"), bad.alias("_bad")).where("_bad IS NOT NULL").groupBy("_id").agg(F.max("_bad").alias("_bad"))
    judged = judge(pages, mined, rules={}, id=id).select(F.col(id).alias("_id"), (F.col("verdict") == "block").alias("_blocked")).join(truth, "_id")
    count = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)
    return judged.agg(F.count("*").alias("n"), count(F.col("_bad"), "n_bad"), count(F.col("_blocked"), "n_blocked"), count(F.col("_bad") & F.col("_blocked"), "n_right"))


def prune(rules: list[Mined]) -> list[Mined]:
    """Without those that a rule with fewer of the same tokens matches in confidence."""
    kept: dict[frozenset[str], Mined] = {}
    for r in sorted(rules, key=lambda r: (len(r.tokens), sorted(r.tokens))):
        parts = [frozenset()] if not r.tokens else [r.tokens - {t} for t in r.tokens]
        stack, better, seen = parts, False, set()
        while stack and not better:
            s = stack.pop()
            if s and s not in seen:
                seen.add(s)
                better = s in kept and kept[s].confidence >= r.confidence
                stack += [s - {t} for t in s]
        if not better:
            kept[r.tokens] = r
    return list(kept.values())


class Index:
    """Written rules by host and mined rules by token."""

    def __init__(self, rules: dict[str, str], mined: list[Mined]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in sorted(rules.items(), key=lambda x: (-len(x[0]), x[0])):
            own, slash, rest = rule.partition("/")
            self.by_host.setdefault(own, []).append((slash + rest, rule, verdict))
        self.mined = mined
        self.posting: dict[str, list[int]] = {}
        for i, r in enumerate(mined):
            for t in r.tokens:
                self.posting.setdefault(t, []).append(i)

    def written(self, own: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits and its verdict."""
        best, at = None, 0
        while True:
            for start, rule, verdict in self.by_host.get(own[at:], ()):
                if path.startswith(start):
                    if best is None or len(rule) > len(best[0]):
                        best = (rule, verdict)
                    break
            at = own.find(".", at) + 1
            if not at:
                return best

    def judge(self, tokens: list[str]) -> tuple[str, float | None]:
        """Verdict of the mined rules and the confidence of the best that fits."""
        met: dict[int, int] = {}
        for t in tokens:
            for i in self.posting.get(t, ()):
                met[i] = met.get(i, 0) + 1
        fit = [self.mined[i].confidence for i, n in met.items() if n == len(self.mined[i].tokens)]
        return ("block", max(fit)) if fit else ("allow", None)


def judge(pages: DataFrame, mined: list[Mined], rules: dict[str, str] = RULES, id: str = "page_id", url: str = "url") -> DataFrame:
    """``id``, host, path, rule, verdict and confidence of every page; no shuffle."""
    u = F.col(url).cast("string")
    src = pages.select(F.col(id).alias("i"), host(u).alias("h"), path(u).alias("p"), tokens(u).alias("t"))
    held = pages.sparkSession.sparkContext.broadcast(Index(rules, mined))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            rows = []
            for h, p, t in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                fit = index.written(h, p)
                rows.append((*fit, None) if fit else (None, *index.judge(t)))
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cols], ["i", "host", "path", "rule", "verdict", "confidence"])

    kind = src.schema["i"].dataType.simpleString()
    return src.select("i", F.col("h").alias("host"), F.col("p").alias("path"), "t").mapInArrow(run, f"i {kind}, host string, path string, rule string, verdict string, confidence double").withColumnRenamed("i", id)
