"""Secret scanning through a trigram inverted index, with DataFrame functions only.

From the literal parts of each rule's regular expression a Boolean trigram query is derived: an
OR of clauses, each an AND of trigrams that every match of one alternative contains. Postings
(trigram, text digest) are made for the trigrams the rules ask for; the clauses' postings are
intersected by one aggregation, and only the candidates are verified by the expression itself.
A rule with an alternative without trigrams (long hex runs) scans every text.

Candidates are kept by a 64-bit digest of the text, so copies meet once, and two texts of one
digest could only add candidates. They are written to the shared folder, counted, and broadcast
only while they fit ``store.BROADCAST_BYTES``; otherwise the join is a shuffle, which AQE splits
at a hot digest. Null and empty texts have no spans; very long texts are scanned whole; repeated
rows are judged alike; other columns pass through (one named like the result is replaced).
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm import spans as S
from gaugeworks.llm.store import materialise, small_or_shuffled, unused


@dataclass(frozen=True)
class Rule:
    """``keep(match, group)`` decides on a match; ``pattern`` must suit Java and Python alike."""

    kind: str
    pattern: str
    group: int = 0
    keep: Callable[[Column, Column], Column] | None = None


RULES = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, lambda m, g: F.length(g) >= 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, lambda m, g: F.length(m) >= 20),
    # whole runs of 24 and more: what remains of [0-9a-f]+ after the length rule
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}"),
    Rule("github", r"(?<![A-Za-z0-9_])gh[oprsu]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
]
BASE = 3
#: Alternatives held while a pattern is expanded, and members of a character class that is.
MOST_ALTERNATIVES, MOST_MEMBERS = 128, 6


def _runs(items) -> list[tuple[str, ...]]:
    """Alternatives of a parsed pattern, each as literal runs with unknown text between them."""
    gap = [("", "")]
    whole: list[tuple[str, ...]] = [("",)]
    for code, arg in items:
        if code is op.LITERAL:
            own = [(chr(arg),)]
        elif code is op.IN:
            chars = [chr(a) for c, a in arg if c is op.LITERAL]
            plain = all(c is op.LITERAL for c, _ in arg) and len(chars) <= MOST_MEMBERS
            own = [(c,) for c in chars] if plain else gap
        elif code is op.BRANCH:
            own = [r for branch in arg[1] for r in _runs(branch)]
        elif code is op.SUBPATTERN:
            own = _runs(arg[3])
        elif code in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, inner = arg
            inner = _runs(inner)
            if (least, most) == (0, 1):
                own = [("",), *inner]
            elif least == most == 1:
                own = inner
            elif least and len(inner) == 1 and len(inner[0]) == 1 and least * len(inner[0][0]) <= 64:
                own = [(inner[0][0] * least,) if least == most else (inner[0][0] * least, "")]
            else:
                own = [(*r, "") for r in inner] if least else gap
        elif code in (op.ASSERT, op.ASSERT_NOT, op.AT):
            own = [("",)]
        else:
            own = gap
        if len(whole) * len(own) > MOST_ALTERNATIVES:
            own = gap
        whole = list(dict.fromkeys((*a[:-1], a[-1] + b[0], *b[1:]) for a in whole for b in own))
    return whole


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Clauses of lower-cased trigrams, one of which holds in every match's text; None: no such query."""
    clauses = set()
    for runs in _runs(parser.parse(pattern)):
        own = frozenset(r.lower()[i : i + 3] for r in runs for i in range(len(r) - 2))
        if not own:
            return None
        clauses.add(own)
    return sorted((c for c in clauses if not any(d < c for d in clauses)), key=sorted)


def _digest(text: str) -> Column:
    return F.xxhash64(F.col(text).cast("string"))


def postings(docs: DataFrame, trigrams: list[str], text: str = "text") -> DataFrame:
    """The inverted index for ``trigrams``: (trigram, digest of a text that holds it)."""
    low = docs.select(_digest(text).alias("_digest"), F.lower(F.col(text).cast("string")).alias("_low"))
    met = F.array_compact(F.array(*(F.when(F.col("_low").contains(t), F.lit(t)) for t in trigrams)))
    return low.select("_digest", F.explode(met).alias("trigram"))


def candidates(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> tuple[DataFrame, list[str]]:
    """Digests of texts with the kinds whose trigram query they satisfy, and the kinds that scan fully."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    terms = [
        (t, kind, n, 1 << k, (1 << len(clause)) - 1)
        for kind, clauses in queries.items()
        for n, clause in enumerate(clauses or [])
        for k, t in enumerate(sorted(clause))
    ]
    full = [kind for kind, clauses in queries.items() if clauses is None]
    spark = docs.sparkSession
    asked = spark.createDataFrame(terms, "trigram string, kind string, clause int, bit long, want long")
    index = postings(docs, sorted({t[0] for t in terms}), text)
    met = (
        index.join(F.broadcast(asked), "trigram")  # as many rows as the rules have trigrams
        .groupBy("_digest", "kind", "clause", "want")
        .agg(F.bit_or("bit").alias("have"))
        .where("have = want")
    )
    return met.groupBy("_digest").agg(F.collect_set("kind").alias("_kinds")), full


def find(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES, into: str = "secrets") -> DataFrame:
    """``docs`` with ``into``: spans by start, then kind (an index into ``rules``)."""
    digest, kinds = unused("digest", docs), unused("kinds", docs)
    found, full = candidates(docs, rules, text)
    found = materialise(found, "candidates").withColumnsRenamed({"_digest": digest, "_kinds": kinds})
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    columns = []
    for k, r in enumerate(rules):
        keep = (lambda m, g, s, f=r.keep: f(m, g)) if r.keep else None
        own = S.spans(t, r.pattern, k, keep, r.group)
        columns.append(own if r.kind in full else F.when(F.array_contains(kinds, r.kind), own).otherwise(S.no_spans()))
    held = docs.withColumn(digest, _digest(text)).join(small_or_shuffled(found, 96), digest, "left")
    return held.withColumn(into, S.in_order(*columns)).drop(digest, kinds)


def redact(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by its kind in brackets."""
    into = unused("secrets", docs)
    found = find(docs, text, rules, into)
    return found.withColumn(text, S.redact(F.col(text), F.col(into), [r.kind for r in rules])).drop(into)
