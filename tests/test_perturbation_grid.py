import zlib

import numpy as np
import pytest

from gaugeworks.functions import kernels as K
from gaugeworks.plans import catalog, catalog_models  # noqa: F401


def test_grid_of_all_maps_kinds_and_severities(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=(6, 64))
    d = str(tmp_path / "maps")
    rows = [(i, x[i].tolist(), 2 * i) for i in range(6)]  # labels below five are normal
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{d}/embeddings.parquet")
    rng = lambda k, s: np.random.default_rng([1, zlib.crc32(k.encode()), s])
    want = {(i, k, s): pytest.approx(K.perturb(x[i].reshape(8, 8), k, s, rng(k, s)).max()) for i in range(6) for k in K.PERTURBATIONS for s in range(6)}
    got = catalog.QUERIES["perturbation_grid"](spark, d).collect()
    assert {(r.vec_id, r.name, r.severity): r.score for r in got} == want and len(got) == len(want)
