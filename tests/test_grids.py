"""Sweeps with inherited settings and the decision over their results."""

import hashlib

from pyspark.sql import functions as F

from gaugeworks.operators import grids


def test_inheritance_and_digests(spark):
    row = spark.range(1).select(
        grids.inherited(grids.held({"a": "1", "b": "2"}), grids.held({"b": "3", "c": "4"})).alias("m"),
        grids.digest(F.create_map(F.lit("z"), F.lit("1"), F.lit("a"), F.lit("2"))).alias("x"),
        grids.digest(F.create_map(F.lit("a"), F.lit("2"), F.lit("z"), F.lit("1"))).alias("y"),
    ).first()
    assert row.m == {"a": "1", "b": "3", "c": "4"}
    assert row.x == row.y == hashlib.sha256(b"a=2,z=1").hexdigest()[:12]


def test_sweep_resumes(spark):
    axes = spark.createDataFrame([("k", "1"), ("k", "2"), ("k", "9"), ("r", "x"), ("r", "y"), ("r", "y")], "axis string, value string")
    cats = spark.createDataFrame([("c",), ("d",), ("d",)], "category string")
    runs = grids.sweep(axes, "axis", "value", cats, "category", {"k": "1", "r": "x"}, (5, 6), "CAST(settings['k'] AS INT) < 9").cache()
    got = sorted((r.group, r.category, r.seed, r.variant) for r in runs.collect())
    assert got == sorted([("reference", c, s, "base") for c in "cd" for s in (5, 6)] + [("sweep", c, 5, v) for c in "cd" for v in ("k=2", "r=y")])
    assert runs.select("digest").distinct().count() == len(got)
    left = grids.unfinished(runs, runs.where("category = 'c' AND variant <> 'r=y'"))
    assert sorted((r.category, r.variant) for r in left.collect()) == [("c", "r=y"), ("d", "base"), ("d", "base"), ("d", "k=2"), ("d", "r=y")]
    assert grids.unfinished(runs, runs).count() == 0 and grids.unfinished(runs, runs.limit(0)).count() == len(got)


def test_decision_by_hand(spark):
    base = [(0.1, 0.02, True, 1.0), (0.2, 0.03, True, 2.0), (-0.005, -0.01, False, 1.0)]
    change = lambda k, *row: [row if i == k else r for i, r in enumerate(base)]
    cases = {
        "adopted": base,
        "accuracy only": change(0, 0.1, 0.02, True, 9.0),
        "one gain": change(0, -0.001, 0.02, True, 1.0),
        "a loss": change(2, -0.02, -0.01, False, 1.0),
        "one sure": change(1, 0.2, 0.03, False, 2.0),
        "sure loss": change(2, -0.005, -0.01, True, 1.0),
        "no figures": [(None, None, None, None)] * 3,
    }
    df = spark.createDataFrame([(v, *r) for v, rows in cases.items() for r in rows], "v string, o double, d double, s boolean, c double")
    got = {r.v: r.verdict for r in grids.decided(df, "v", "o", "d", "s", "c", 5.0).collect()}
    assert got == {v: v if v in ("adopted", "accuracy only") else "not adopted" for v in cases}
