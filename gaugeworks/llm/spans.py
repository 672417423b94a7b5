"""Spans of regular-expression matches as array columns, with DataFrame functions only.

A span is ``struct<start, kind, end>``: code points, end exclusive, kind an index into the
caller's list of kinds. Every function works inside one row, so nothing is shuffled and a long
text costs one pass per expression.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,kind:int,end:int>>"


def no_spans() -> Column:
    return F.array().cast(SPAN)


#: Matches whose spans are gathered in one inner array; the inner ones are joined at the end.
BLOCK = 256


def spans(text: Column, pattern: str, kind: int, keep: Callable[[Column, Column, Column], Column] | None = None, group: int = 0, near: int = 0) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` for which ``keep(match, group, before)`` holds,
    ``before`` being the ``near`` characters in front of the match.

    The gaps that ``split`` leaves and the matches alternate, so their lengths add up to offsets. Spans
    grow in arrays of ``BLOCK``, so the work is linear in the matches.
    """
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    own = F.zip_with(F.split(text, pattern, -1), match, lambda g, m: F.struct(g.alias("g") if near else F.length(g).alias("g"), m.alias("m")))
    if group:
        own = F.zip_with(own, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x, p: F.struct(x["g"].alias("g"), x["m"].alias("m"), p.alias("p")))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + (F.length(x["g"]) if near else x["g"])
        end = begin + F.coalesce(F.length(x["m"]), F.lit(0))
        good = x["m"].isNotNull()
        before = F.right(F.concat(acc["tail"], x["g"]), F.lit(near)) if near else F.lit("")
        if keep:
            good = good & keep(x["m"], x["p"] if group else x["m"], before)
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        tail = F.right(F.concat(acc["tail"], x["g"], F.coalesce(x["m"], F.lit(""))), F.lit(near)) if near else F.lit("")
        return F.struct(end.alias("at"), tail.alias("tail"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), acc["tail"].alias("tail"), no_spans().alias("out"))
        return F.aggregate(part, start, step, lambda r: F.struct(r["at"].alias("at"), r["tail"].alias("tail"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def whole(o: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.size(o), F.lit(BLOCK)), lambda at: F.slice(o, at, F.lit(BLOCK)))
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.aggregate(parts, start, block, lambda acc: F.flatten(acc["out"]))

    return F.get(F.transform(F.array(own), whole), F.lit(0))  # a lambda variable: matched once


def in_order(*columns: Column) -> Column:
    """All spans by start, then kind."""
    return F.array_sort(F.concat(*columns))


def described(found: Column, kinds: list[str]) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kinds(found: Column, below: int) -> Column:
    return F.filter(found, lambda s: s["kind"] < below)


def count_kind(found: Column, kind: int) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def redact(text: Column, found: Column, kinds: list[str]) -> Column:
    """``text`` with every span replaced by its kind in brackets; overlapping spans become one."""
    names = F.array(*map(F.lit, kinds))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        more = F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.get(names, s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, more).otherwise(acc["out"]).alias("out"))

    done = lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(found) > 0, F.aggregate(found, start, step, done)).otherwise(text)
