from graphs import made, mapping

from arcweave.operators import traversal


def test_a_root_that_is_reached_over_many_levels(spark):
    """The root reaches all others in one arc and is reached back over 30."""
    root, n = 100, 30
    pairs = [(root, v) for v in range(n)] + [(v, v + 1) for v in range(n - 1)] + [(n - 1, root)]
    g = made(spark, [(u, v, 1.0, k) for k, (u, v) in enumerate(pairs)])
    assert mapping(traversal.strongly_connected_components(g, 2), value="component") == dict.fromkeys([*range(n), root], root)
