"""Queries against their twins on tables where equal numbers may still differ."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from gaugeworks.functions import kernels as K
from gaugeworks.operators import integrity
from gaugeworks.plans import catalog, catalog_models  # noqa: F401  (fills the catalog)


def test_smoothed_maps_keep_the_sign_of_zero(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(4, 64)) * 0.2
    x[1] = 0.0
    x[1, 27] = -1e-6  # blurred, each cell rounds to -0
    d = str(tmp_path)
    spark.createDataFrame([(i, v.tolist(), i) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").coalesce(1).write.parquet(f"{d}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet/*.parquet'")
    got = {r.vec_id: [repr(v) for v in r.map] for r in catalog.QUERIES["smoothed_maps"](spark, d).collect()}
    want = {i: [repr(v) for v in m] for i, m in con.execute(catalog.ORACLE["smoothed_maps"]).fetchall()}
    assert "-0.0" in want[1] and got == want


def test_rounding_is_that_of_duckdb():
    x = [0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, -1e-9, 0.0, -0.0, 1e300, 4503599627370497.0, 0.0123455, -0.0000005]
    for places in (0, 6):
        want = [duckdb.execute(f"SELECT round(?::DOUBLE, {places})", [v]).fetchone()[0] for v in x if abs(v) < 1e200]
        assert [repr(float(v)) for v in K.half_away(np.array([v for v in x if abs(v) < 1e200]), places)] == [repr(v) for v in want]


def test_far_hashes_leave_the_plan_small(spark, monkeypatch):
    """Queries 20 bits and more from a bank of 4,000: no list of values within a radius is written into the plan."""
    rng = np.random.default_rng(5)
    bank = rng.integers(-(2**63), 2**63 - 1, 4000)
    asked = np.concatenate([~bank[:40], rng.integers(-(2**63), 2**63 - 1, 360), bank[:3]])
    widths, array = [], F.array
    monkeypatch.setattr(F, "array", lambda *c: (widths.append(len(c)), array(*c))[1])
    frame = lambda h, first: spark.createDataFrame([(first + i, int(x)) for i, x in enumerate(h)], "id long, bits long")
    got = {r.id: (r.neighbour, r.distance) for r in integrity.hamming_nearest(frame(asked, 10_000), frame(bank, 0), "id", "bits").collect()}
    d = np.bitwise_count((asked[:, None] ^ bank).view(np.uint64)).astype(int)
    assert got == {10_000 + i: (int(row.argmin()), int(row.min())) for i, row in enumerate(d)}
    assert max(widths, default=0) < 100


def test_nearest_hashes_over_blocks(spark):
    rng = np.random.default_rng(6)
    h = np.concatenate([rng.integers(-(2**63), 2**63 - 1, 500), rng.integers(0, 40, 200)])
    df = spark.createDataFrame([(i, int(x), i % 2) for i, x in enumerate(h)], "id long, bits long, g int")
    for own in (False, True):
        whole, parts = ({r.id: (r.neighbour, r.distance) for r in integrity.hamming_nearest(df, df, "id", "bits", ("g",), own, *n).collect()} for n in ((), (70, 30)))
        assert whole == parts and len(whole) == 700
