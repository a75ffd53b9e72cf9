"""Whole jobs of the graph operators."""

from inkfold.operators import graph


def test_label_propagation_settles_past_20_rounds(spark):
    """Along a path of falling weights the first label goes one node further each round."""
    path = [(i, i + 1, 100 - i) for i in range(21)]
    got = graph.label_propagation(spark.createDataFrame(path, "a bigint, b bigint, weight bigint"))
    assert {r.community for r in got.collect()} == {0}
