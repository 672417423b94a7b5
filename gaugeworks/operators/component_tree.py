"""Mask rules by the dozen from one tree of each map's components.

The regions of a map above all thresholds form a tree: cells are taken from the highest value down, each joining the
regions next to it. A cell's region above ``low`` is its highest ancestor above ``low``, whose area and peak the tree holds; so
hysteresis (low, high) and a least area are look-ups, and all rules follow from one pass instead of one labelling each.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.columns import share


@dataclass(frozen=True)
class Rule:
    """Regions above ``low`` that reach above ``high`` (low itself if None) and hold ``least`` cells; with ``mark``, a map left
    empty whose peak exceeds ``mark`` times low gets that one cell."""

    low: float
    high: float | None = None
    least: int = 1
    mark: float = 0.0


class Tree:
    """parent, area and peak of the 8-connected regions that each cell closes."""

    def __init__(self, image: np.ndarray):
        h, w = image.shape
        self.value = image.astype(np.float64).ravel()
        n = len(self.value)
        self.parent = np.arange(n)
        self.area = np.ones(n, np.int64)
        self.peak = self.value.copy()
        up, done = list(range(n)), np.zeros((h + 2, w + 2), bool)

        def top(c: int) -> int:
            while up[c] != c:
                up[c] = up[up[c]]
                c = up[c]
            return c

        for p in np.argsort(-self.value, kind="stable").tolist():
            i, j = divmod(p, w)
            for a in (i - 1, i, i + 1):
                for b in (j - 1, j, j + 1):
                    if done[a + 1, b + 1]:
                        r = top(a * w + b)
                        if r != p:
                            self.parent[r] = up[r] = p
                            self.area[p] += self.area[r]
                            self.peak[p] = max(self.peak[p], self.peak[r])
            done[i + 1, j + 1] = True

    def regions(self, low: float) -> np.ndarray:
        """For each cell the one that stands for its region above ``low``; meaningless at or below it."""
        at = np.where(self.value[self.parent] > low, self.parent, np.arange(len(self.parent)))
        while True:
            further = at[at]
            if (further == at).all():
                return at
            at = further

    def mask(self, rule: Rule) -> np.ndarray:
        at = self.regions(rule.low)
        high = rule.low if rule.high is None else rule.high
        found = (self.value > rule.low) & (self.peak[at] > high) & (self.area[at] >= rule.least)
        if rule.mark and not found.any() and self.value.max() > rule.mark * rule.low:
            found[int(self.value.argmax())] = True
        return found


COUNTED = "array<struct<rule:int,tp:long,fp:long,fn:long,flagged:boolean>>"


def counted(rules: Sequence[Rule], height: int, width: int):
    """From (map, mask): each rule's hits, false alarms and misses in cells, and whether it flags the map."""

    @F.pandas_udf(COUNTED)
    def run(values: pd.Series, truth: pd.Series) -> pd.Series:
        out = []
        for v, t in zip(values, truth, strict=True):
            tree, t = Tree(np.asarray(v, float).reshape(height, width)), np.asarray(t, bool)
            rows = []
            for k, rule in enumerate(rules):
                m = tree.mask(rule)
                rows.append({"rule": k, "tp": int((m & t).sum()), "fp": int((m & ~t).sum()), "fn": int((~m & t).sum()), "flagged": bool(m.any())})
            out.append(rows)
        return pd.Series(out)

    return run


def evaluate(maps: DataFrame, values: str, truth: str, label: str, rules: Sequence[Rule], subsets: dict[str, str], height: int, width: int) -> DataFrame:
    """One row for each rule and subset of maps: cells pooled (segf1), maps (classf1), and the share of normal maps flagged; ``subsets``
    are conditions by name. A map may belong to several subsets; its counts are worked out once."""
    member = F.array_compact(F.array(*(F.when(F.expr(c), F.lit(n)) for n, c in subsets.items())))
    each = maps.select(F.col(label).alias("_y"), member.alias("_in"), F.explode(counted(rules, height, width)(values, truth)).alias("x"))
    each = each.select("_y", F.explode("_in").alias("subset"), "x.*")
    y, hit = F.col("_y") == 1, F.col("flagged")
    own = each.groupBy("rule", "subset").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), F.count_if(y & hit).alias("ip"), F.count_if(~y & hit).alias("ifp"), F.count_if(y & ~hit).alias("ifn"), F.count_if(~y).alias("normals"))
    named = [F.when(F.col("rule") == k, F.struct(F.lit(float(r.low)).alias("low"), F.lit(float(r.low if r.high is None else r.high)).alias("high"), F.lit(r.least).alias("least"), F.lit(float(r.mark)).alias("mark"))) for k, r in enumerate(rules)]
    f1 = lambda a, b, c: F.coalesce(share(2 * F.col(a), 2 * F.col(a) + F.col(b) + F.col(c)), F.lit(0.0))
    return own.select(F.coalesce(*named).alias("r"), "*").select("r.*", "subset", "tp", "fp", "fn", f1("tp", "fp", "fn").alias("segf1"), f1("ip", "ifp", "ifn").alias("classf1"), share(F.col("ifp"), F.greatest(F.col("normals"), F.lit(1))).alias("normals_flagged"))
