"""Recall of the approximate searches over the stated queries, id % 50 = 0."""

import pytest

from sparkloom.operators import search
from sparkloom.plans import registry



@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall(spark, sf):
    v = registry.vectors(registry.Tables(spark, f"/root/testdata/{sf}")).cache()
    assigned, centroids, probes = registry.ivf_index(v)
    assigned = assigned.cache()
    ids = lambda df: {r["id"] for r in df.collect()}
    asked = v.where("id % 50 = 0").orderBy("id").collect()
    shares = {"ivf": [], "two_phase": []}
    for r in asked:
        q = [float(x) for x in r["embedding"]]
        exact = ids(search.knn(v, q, 10))
        shares["ivf"].append(len(exact & ids(search.ivf_search(v, assigned, centroids, q, 10, probes))) / 10)
        shares["two_phase"].append(len(exact & ids(search.two_phase_knn(v, q, 10, registry.KEPT))) / 10)
    assert len(asked) == 10 and all(sum(x) / len(x) >= 0.9 for x in shares.values()), shares
