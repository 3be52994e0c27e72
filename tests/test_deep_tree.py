from blockloom.operators import tree


def test_walk_reaches_every_level(spark):
    rows = [(i, i - 1 if i else None, 0) for i in range(23)]
    nodes = spark.createDataFrame(rows, "node_id long, parent_id long, ordinal int").coalesce(1)
    assert sorted((r.node_id, r.depth, len(r.path)) for r in tree.walk(nodes).collect()) == [(i, i, i + 1) for i in range(23)]
