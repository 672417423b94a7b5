"""Personal data: regular expressions propose spans, validators confirm them, context scores them.

DataFrame functions only. The base kinds (email, ip, card, phone) are decided by their pattern
and validator; the further kinds (iban by mod-97, ssn) also need a score of ``LEAST``, to which
words near the span contribute. Null and empty texts have no spans; rows are judged one by one
(repeated rows alike), in one pass whatever their length; other columns pass through, except
that a column named like the result is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm import spans as S

KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE = 4
#: Score of a confirmed span without context, what a context word nearby adds, and what is needed.
SCORE, CONTEXT, LEAST, NEAR = [0.9, 0.6, 0.8, 0.7, 0.8, 0.3], 0.3, 0.5, 40
CONTEXT_WORDS = [
    "e-?mail|mail|contact|contacto|courriel",
    "ip|host|server|address|adresse",
    "card|visa|credit|karte|carte|tarjeta|payment",
    "tel|phone|call|mobile|telefon|fax|appel|llam",
    "iban|account|bank|konto|compte|cuenta",
    "ssn|social|security|insurance|taxpayer",
]
# A start lies at the head of a run of local characters or right after the last match: any other
# start in the run would share its end, so the matches are those of the plain pattern, found in linear time.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# Whole runs of digits joined by single separators, 14 to 19 digits long.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"


def luhn(match: Column) -> Column:
    """The checksum of the digits in ``match``: every second from the right counts double."""
    digits = F.split(F.reverse(F.regexp_replace(match, "[^0-9]", "")), "")

    def weigh(x: Column, i: Column) -> Column:
        d = x.cast("int")
        return F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.transform(digits, weigh), F.lit(0), lambda s, d: s + d) % 10 == 0


def mod97(match: Column) -> Column:
    """The remainder rule of account numbers: first four characters last, letters as two digits."""
    plain = F.regexp_replace(match, " ", "")
    turned = F.split(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4))), "")

    def step(r: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (r * 100 + code - 55) % 97).otherwise((r * 10 + code - 48) % 97)

    return F.aggregate(turned, F.lit(0), step) == 1


def score(before: Column, kind: int) -> Column:
    """The base score of ``kind``, raised by one of its context words in the ``NEAR`` characters ``before`` a span."""
    return F.lit(SCORE[kind]) + F.when(before.rlike(rf"(?i)\b(?:{CONTEXT_WORDS[kind]})"), CONTEXT).otherwise(0.0)


def find(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with ``into``: its spans by start, then kind (see :data:`KINDS`)."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    n_digits = lambda m: F.length(F.regexp_replace(m, "[^0-9]", ""))
    only = lambda test, found: F.when(test, found).otherwise(S.no_spans())
    return docs.withColumn(
        into,
        S.in_order(
            only(t.contains("@"), S.spans(t, EMAIL, 0)),
            S.spans(t, IP, 1, lambda m, _, b: m.rlike(rf"^{PART}(?:\.{PART}){{3}}$")),
            S.spans(t, CARD, 2, lambda m, _, b: luhn(m)),
            only(t.contains("+"), S.spans(t, PHONE, 3, lambda m, _, b: n_digits(m).between(10, 15))),
            S.spans(t, IBAN, 4, lambda m, _, b: mod97(m) & (score(b, 4) >= LEAST), near=NEAR),
            only(t.contains("-"), S.spans(t, SSN, 5, lambda m, _, b: score(b, 5) >= LEAST, near=NEAR)),
        ),
    )


def scored(docs: DataFrame, text: str = "text", found: str = "pii", into: str = "pii_scored") -> DataFrame:
    """Spans of :func:`find` as struct<start, end, kind, score> with the kinds' names."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))

    def one(s: Column) -> Column:
        before = F.substr(t, F.greatest(s["start"] - NEAR, F.lit(0)) + 1, F.least(s["start"], F.lit(NEAR)))
        value = F.lit(None).cast("double")
        for k in range(len(KINDS)):
            value = F.when(s["kind"] == k, F.least(score(before, k), F.lit(1.0))).otherwise(value)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(F.array(*map(F.lit, KINDS)), s["kind"]).alias("kind"), value.alias("score"))

    return docs.withColumn(into, F.transform(found, one))
