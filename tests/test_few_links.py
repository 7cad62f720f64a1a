"""Components by one task and by joins."""

import random

from emberline.operators import graph


def test_few_links_are_followed_as_many_are(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 540)] + [(600, 600), (None, 3)]
    for kind, as_ in (("long", lambda x: x), ("string", lambda x: None if x is None else f"é{x}")):
        edges = spark.createDataFrame([(as_(a), as_(b)) for a, b in pairs], f"a {kind}, b {kind}").repartition(5)
        by_joins = sorted(map(tuple, graph.components(edges).collect()))
        assert sorted(map(tuple, graph.components(edges, few=1000).collect())) == by_joins and len(by_joins) > 300
        assert sorted(map(tuple, graph.components(edges, few=10).collect())) == by_joins  # more than few
    assert graph.components(edges.limit(0), few=1000).count() == 0
