"""Typing by components of the graph of what reads tell: alleles that fit a component best have its votes.

A node is a variant that mates support, or that they contradict; an edge joins what a mate tells one after the other
along the gene.  Nodes on no cycle tell nothing apart: all mates there say the same.  What is left falls into components;
each is searched by itself for its best sets of alleles, and these vote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuspark.operators import beam, graphs
from locuspark.operators.typing import numbered
from locuspark.storage import written

#: Alleles of a set, and sets of a component that are searched.
COPIES, TOP = 3, 100
MATE = ["sample", "gene", "pair_id", "mate"]


def read_nodes(evidence: DataFrame, catalogue: DataFrame) -> DataFrame:
    """MATE, variant, sign, node, pos: what each mate tells of the catalogue's variants; nodes of samples and genes are apart."""
    known = catalogue.select(F.col("ref").alias("gene"), F.col("id").alias("variant"), "pos")
    rows = evidence.select("sample", F.col("ref").alias("gene"), "pair_id", "mate", F.col("variant_id").alias("variant"), "sign").distinct()
    name = F.concat_ws("|", "sample", "gene", "variant", F.col("sign").cast("string"))
    return rows.join(known, ["gene", "variant"]).select(*MATE, "variant", "sign", "pos", name.alias("node"))


def neighbours(nodes: DataFrame, *, least: int = 1) -> DataFrame:
    """u, v, weight: nodes that mates tell one after the other, at least so often."""
    along = W.partitionBy(*MATE).orderBy("pos", "variant")
    pairs = nodes.select(F.col("node").alias("u"), F.lead("node").over(along).alias("v")).filter("v is not null")
    return pairs.groupBy("u", "v").agg(F.count("*").alias("weight")).filter(F.col("weight") >= least)


def votes(evidence: DataFrame, catalogue: DataFrame, *, copies: int = COPIES, top: int = TOP, least: int = 1) -> DataFrame:
    """sample, gene, allele, votes: in how many of the components' best sets an allele stands, as often as it does.

    evidence: long form; catalogue: ref, id, pos, allele.  A component's best sets are those of the least cost among the
    top ones of ``copies`` alleles.  Genes without a cycle have no votes.
    """
    nodes = written(read_nodes(evidence, catalogue), "component-nodes")
    placed = graphs.cycle_components(written(neighbours(nodes, least=least).select("u", "v"), "component-edges"))
    inside = written(nodes.join(placed, "node").select("sample", "gene", F.col("component").alias("part"), F.concat_ws("|", "pair_id", "mate").alias("read"), "variant", "sign"), "component-reads")
    table = catalogue.filter(F.size("allele") > 0).select(F.col("ref").alias("gene"), F.col("id").alias("variant"), "allele")
    carriers, names = numbered(table)
    # A component takes a gene's place in the search; its name holds sample and gene.
    parts = written(inside.select("sample", "gene", "part").distinct(), "component-parts")
    own = parts.select("gene", "part").join(carriers, "gene").select(F.col("part").alias("gene"), "variant", "members")
    sizes = parts.join(names.groupBy("gene").agg(F.count("*").cast("int").alias("size")), "gene").select(F.col("part").alias("gene"), "size")
    told = inside.select("sample", F.col("part").alias("gene"), "read", "variant", "sign", F.lit(1).cast("bigint").alias("n"))
    rows, groups = beam.dealt(beam.classes(told, own, sizes))
    problems = written(groups.select("sample", "gene", F.lit(0).alias("branch"), F.lit(copies).alias("cn"), F.lit(True).alias("mixed")), "component-problems")
    found = beam.search(rows, groups, problems, None, top)
    best = found.withColumn("_least", F.min("cost").over(W.partitionBy("sample", "gene"))).filter("cost = _least")
    each = best.select("sample", F.col("gene").alias("part"), F.explode("members").alias("a"))
    return each.join(parts, ["sample", "part"]).join(names, ["gene", "a"]).groupBy("sample", "gene", "allele").agg(F.count("*").alias("votes"))
