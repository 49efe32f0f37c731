"""Graphs as tables of edges: spanning forests, components, bridges, nodes on cycles.

All loops double what they see, so rounds grow with the logarithm of the nodes, also on long chains.  A bridge is found
by labels: every edge outside the spanning forest has a random label, and a forest edge is covered by the edges outside
whose labels, taken together by exclusive or over one side of it, don't cancel.  The sums over sides are differences
along a tour of the forest.  Labels have 128 bits, so a covered edge is taken for a bridge with odds of 2^-128.

Rows: loops and repeated edges count for nothing; null ends are left out; an empty table has no nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuspark.storage import release, written


def plain_edges(edges: DataFrame) -> DataFrame:
    """u < v, id: each edge once, numbered."""
    rows = edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    return written(rows.withColumn("id", F.monotonically_increasing_id()), "graph")


def _settled(up: DataFrame) -> DataFrame:
    """(c, top): the end of each chain of (c, top), by doubling."""
    while True:
        far = up.select(F.col("c").alias("_c"), F.col("top").alias("_t"))
        step = written(up.join(far, F.col("top") == F.col("_c"), "left").select("c", F.coalesce("_t", "top").alias("top"), (F.coalesce("_t", "top") != F.col("top")).alias("moved")), "graph")
        release(up)
        if step.filter("moved").isEmpty():
            return step.select("c", "top")
        up = step.select("c", "top")


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids of a forest's edges, components: node, root) from plain_edges().

    In each round every component takes its first edge to another one, and what hangs together becomes one.  Numbers of
    edges differ, so picks make no circle but of two components that take the same edge.
    """
    nodes = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node"))).distinct()
    placed = written(nodes.select("node", F.col("node").alias("root")), "graph")
    forest: list[DataFrame] = []
    while True:
        a, b = (placed.select(F.col("node").alias(f"_{x}"), F.col("root").alias(f"c{x}")) for x in "uv")
        across = written(edges.join(a, F.col("u") == F.col("_u")).join(b, F.col("v") == F.col("_v")).filter("cu <> cv").select("id", "cu", "cv"), "graph")
        if across.isEmpty():
            ids = reduce(DataFrame.union, forest).distinct() if forest else edges.select("id").limit(0)
            return written(ids, "forest"), placed
        both = across.select(F.col("cu").alias("c"), F.col("cv").alias("other"), "id").union(across.select(F.col("cv").alias("c"), F.col("cu").alias("other"), "id"))
        picks = written(both.groupBy("c").agg(F.min(F.struct("id", "other")).alias("x")).select("c", "x.id", "x.other"), "graph")
        forest.append(picks.select("id"))
        back = picks.select(F.col("c").alias("_c"), F.col("id").alias("_id"))
        up = picks.join(back, F.col("other") == F.col("_c")).select("c", F.when((F.col("id") == F.col("_id")) & (F.col("c") < F.col("other")), F.col("c")).otherwise(F.col("other")).alias("top"))
        tops = _settled(written(up, "graph"))
        placed = written(placed.join(tops, F.col("root") == F.col("c"), "left").select("node", F.coalesce("top", "root").alias("root")), "graph")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node with an edge to another."""
    _, placed = spanning_forest(plain_edges(edges))
    least = placed.groupBy("root").agg(F.min("node").alias("component"))
    return placed.join(least, "root").select("node", "component")


def _tour(tree: DataFrame, values: DataFrame, roots: DataFrame) -> DataFrame:
    """id, src, dst, left, x, y: arcs of the trees' tours with how many arcs follow, and the values that do, taken together."""
    arcs = tree.select("id", F.col("u").alias("src"), F.col("v").alias("dst")).union(tree.select("id", F.col("v").alias("src"), F.col("u").alias("dst")))
    arcs = written(arcs, "graph")
    around = W.partitionBy("src").orderBy("dst")
    whole = around.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    follows = arcs.select(F.col("src").alias("_at"), F.col("dst").alias("_from"), F.coalesce(F.lead("dst").over(around), F.first("dst").over(whole)).alias("to"))
    # After an arc into a node comes the arc to the neighbour behind the one it came from.  A tour is cut before its first arc.
    entered = W.partitionBy("dst")
    heads = arcs.join(roots, F.col("src") == F.col("node")).groupBy("root").agg(F.min(F.struct("src", "dst")).alias("h")).select(F.col("h.src").alias("_hs"), F.col("h.dst").alias("_hd"))
    rows = arcs.withColumn("_first", F.min("src").over(entered) == F.col("src")).join(values, F.col("dst") == F.col("node"), "left")
    rows = rows.join(follows, (F.col("dst") == F.col("_at")) & (F.col("src") == F.col("_from"))).join(heads, (F.col("dst") == F.col("_hs")) & (F.col("to") == F.col("_hd")), "left")
    own = lambda c: F.when(F.col("_first"), F.coalesce(c, F.lit(0).cast("bigint"))).otherwise(F.lit(0).cast("bigint")).alias(c)
    goes = F.when(F.col("_hs").isNull(), F.struct(F.col("dst").alias("src"), F.col("to").alias("dst"))).alias("next")
    state = written(rows.select("id", "src", "dst", goes, F.lit(1).cast("bigint").alias("left"), own("x"), own("y")), "tour")
    while not state.filter("next is not null").isEmpty():
        far = state.select(F.struct("src", "dst").alias("_k"), F.col("next").alias("_next"), F.col("left").alias("_left"), F.col("x").alias("_x"), F.col("y").alias("_y"))
        more = lambda c: F.coalesce(f"_{c}", F.lit(0).cast("bigint"))
        step = state.join(far, F.col("next") == F.col("_k"), "left").select("id", "src", "dst", F.col("_next").alias("next"), (F.col("left") + more("left")).alias("left"), F.col("x").bitwiseXOR(more("x")).alias("x"), F.col("y").bitwiseXOR(more("y")).alias("y"))
        earlier, state = state, written(step, "tour")
        release(earlier)
    return state


def bridges(edges: DataFrame, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(edges as u, v, id; ids of those that lie on no cycle)."""
    numbered = plain_edges(edges)
    ids, roots = spanning_forest(numbered)
    tree = numbered.join(ids, "id", "left_semi")
    others = numbered.join(ids, "id", "left_anti")
    label = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), "u", "v")
    ends = others.select(F.explode(F.array("u", "v")).alias("node"), label(1).alias("x"), label(2).alias("y"))
    values = written(ends.groupBy("node").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")), "graph")
    arcs = _tour(tree, values, roots)
    # Between an edge's two arcs the tour goes over one side of it.
    side = arcs.groupBy("id").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    return numbered, side.filter("x = 0 and y = 0").select("id")


def on_cycles(edges: DataFrame) -> DataFrame:
    """node: all that lie on some cycle."""
    numbered, single = bridges(edges)
    return numbered.join(single, "id", "left_anti").select(F.explode(F.array("u", "v")).alias("node")).distinct()


def cycle_components(edges: DataFrame) -> DataFrame:
    """node, component: nodes on cycles, by what hangs together among them; also over bridges between two of them."""
    kept = written(on_cycles(edges), "graph")
    inside = edges.join(kept.withColumnRenamed("node", "u"), "u", "left_semi").join(kept.withColumnRenamed("node", "v"), "v", "left_semi")
    return components(inside)
