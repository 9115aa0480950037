"""Nearest neighbours over blocks that meet by tiles, against all pairs."""

import numpy as np

from quarrymill.operators import retrieval as R


def test_neighbours_over_many_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 8)
    monkeypatch.setattr(R, "SIDE", 2)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 5))
    rows = spark.createDataFrame([(k, [float(y) for y in v]) for k, v in enumerate(x)], "id long, v array<double>")
    found = R.knn(rows, "id", "v", rows.where("id % 3 = 0").withColumnsRenamed({"id": "query_id", "v": "vector"}), 4)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    sims = np.round(unit @ unit.T, 6)
    expected = {(q, int(c), r) for q in range(0, 90, 3) for r, c in enumerate(sorted((c for c in range(90) if c != q), key=lambda c: (-sims[q, c], c))[:4], 1)}
    assert {(r["query_id"], r["id"], r["rank"]) for r in found.collect()} == expected
    # both sides meet under a key of tiles of both kinds, whose size does not depend on how many blocks there are
    assert "q_tile" in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and "c_tile" in plan
