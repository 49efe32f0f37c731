"""Components, bridges and nodes on cycles against plain versions."""

import random

from locuspark.operators import graphs


def reachable(edges, start):
    seen, todo = {start}, [start]
    while todo:
        x = todo.pop()
        for a, b in edges:
            for p, q in ((a, b), (b, a)):
                if p == x and q not in seen:
                    seen.add(q)
                    todo.append(q)
    return seen


def plain(edges):
    """(components, nodes on cycles, components among these): an edge is on a cycle if its ends stay connected without it."""
    edges = sorted({(min(e), max(e)) for e in edges if e[0] != e[1]})
    nodes = {x for e in edges for x in e}
    parts = {x: min(reachable(edges, x)) for x in nodes}
    cyclic = {x for e in edges if e[1] in reachable([f for f in edges if f != e], e[0]) for x in e}
    inside = [e for e in edges if set(e) <= cyclic]
    return parts, cyclic, {x: min(reachable(inside, x)) for x in cyclic}


rng = random.Random(6)
GRAPHS = {
    "chain": [(i, i + 1) for i in range(40)],
    "cycle": [(i, (i + 1) % 30) for i in range(30)],
    "two cycles on a bridge": [(i, (i + 1) % 5) for i in range(5)] + [(10 + i, 10 + (i + 1) % 4) for i in range(4)] + [(2, 20), (20, 21), (21, 11), (3, 50), (50, 51)],
    "cycles that touch, a direct bridge, tails": [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 2), (4, 5), (5, 6), (6, 7), (7, 5), (9, 0), (8, 9), (1, 1), (1, 0)],
    "star": [(0, i) for i in range(1, 30)],
    "forest": [(rng.randrange(i // 20 * 20, i) if i % 20 else i + 1000, i) for i in range(1, 60)],
    "random": [(rng.randrange(50), rng.randrange(50)) for _ in range(48)],
}


def test_cycles_and_components(spark):
    """All graphs in one table, apart from each other."""
    edges, parts, cyclic, inside = [], {}, set(), {}
    for k, graph in enumerate(GRAPHS.values()):
        own = [(10_000 * k + a, 10_000 * k + b) for a, b in graph]
        found = plain(own)
        edges += own + own[:3]
        parts |= found[0]
        cyclic |= found[1]
        inside |= found[2]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    assert {r["node"]: r["component"] for r in graphs.components(df).collect()} == parts
    got = {r["node"]: r["component"] for r in graphs.cycle_components(df).collect()}
    assert set(got) == cyclic and got == inside


def test_no_edges(spark):
    none = spark.createDataFrame([], "u string, v string")
    assert graphs.components(none).count() == 0 and graphs.cycle_components(none).count() == 0
