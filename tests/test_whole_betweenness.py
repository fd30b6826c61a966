"""Node betweenness sums over every node of the grid."""

import numpy as np

from spanweave.operators import kernels
from spanweave.plans import derived, queries

D = "/root/testdata/sf0.001"


def test_node_betweenness_takes_every_source(spark):
    g = derived.part_grid(spark, D).local()
    want = sum(kernels.brandes(g, s)[1] for s in range(g.n))
    got = {r.node_id: r.score for r in queries.QUERIES["c1_node_betweenness"](spark, D).collect()}
    np.testing.assert_allclose([got[i] for i in g.ids.tolist()], want, rtol=1e-9, atol=1e-6)  # queries round to six places
