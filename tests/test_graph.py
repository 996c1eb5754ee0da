import pytest

from lodestore.operators import graph


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "node string, parent string")


def test_chains(spark):
    pairs = [(f"n{i}", f"n{i - 1}" if i % 20 else None) for i in range(60)] + [("x", "gone")]
    e = edges(spark, pairs)
    parent = dict(pairs)
    heads = spark.createDataFrame([("n19",), ("n45",), ("n40",), ("x",)], "node string")
    want = set()
    for h in ("n19", "n45", "n40", "x"):
        n, d = h, 0
        while n:
            want.add((h, n, d))
            n, d = parent.get(n), d + 1
    assert {tuple(r) for r in graph.chain(e, heads).collect()} == want
    for limit in (1, 3, 4, 100):
        assert {tuple(r) for r in graph.chain(e, heads, limit).collect()} == {w for w in want if w[2] < limit}
    got = {r.node: (r.root, r.depth) for r in graph.roots(edges(spark, pairs[:-1])).collect()}
    assert got == {f"n{i}": (f"n{i - i % 20}", i % 20) for i in range(60)}


@pytest.mark.parametrize("n", [1, 3])
def test_circles_are_told(spark, n):
    e = edges(spark, [(f"c{i}", f"c{(i + 1) % n}") for i in range(n)] + [("a", "c0"), ("b", None)])
    with pytest.raises(graph.Circle):
        graph.roots(e)
    with pytest.raises(graph.Circle):
        graph.chain(e, spark.createDataFrame([("c0",)], "node string"))
