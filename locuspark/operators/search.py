"""The allele search as DataFrame operators: mismatch counts, beams of one and two members, EM steps.

locuspark.operators.typing solves whole groups; these forms spread a single large group over the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def mismatches(evidence: DataFrame, carriers: DataFrame, alleles: DataFrame) -> DataFrame:
    """gene, read, allele, k: disagreements of every read with every allele of its gene.

    Sparse: an allele that none of a read's variants touch disagrees with all its positives, so only carriers are joined
    and the rest is a constant.  evidence: gene, read, variant, sign; carriers: gene, variant, allele.
    """
    base = evidence.groupBy("gene", "read").agg(F.count_if("sign").alias("_p"))
    delta = evidence.join(carriers, ["gene", "variant"]).groupBy("gene", "read", "allele").agg(F.sum(F.when(F.col("sign"), -1).otherwise(1)).alias("_d"))
    return base.join(alleles.select("gene", "allele").distinct(), "gene").join(delta, ["gene", "read", "allele"], "left").select("gene", "read", "allele", (F.col("_p") + F.coalesce("_d", F.lit(0))).alias("k"))


def beam_one(k: DataFrame, top: int, by: str = "gene") -> DataFrame:
    """by, rank, allele, cost: alleles by summed mismatches."""
    sums = k.groupBy(by, "allele").agg(F.sum("k").alias("cost"))
    return sums.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy("cost", "allele"))).filter(F.col("rank") <= top)


def beam_two(k: DataFrame, top: int, by: str = "gene", read: str = "read") -> DataFrame:
    """by, rank, a, b, cost, own, share_a, share_b: pairs by summed least mismatches, own sums and evenness.

    The first members are the best alleles.  A read's counts are gathered in one row, as many as its gene has alleles,
    and its pairs are summed where they are made, so what is shuffled is pairs of alleles and not of reads.
    """
    first = beam_one(k, top, by).select(by, "allele", F.lit(True).alias("first"))
    marked = k.select(by, read, "allele", "k").join(first, [by, "allele"], "left").withColumn("first", F.coalesce("first", F.lit(False)))
    each = marked.groupBy(by, read).agg(F.collect_list(F.struct("allele", "k", "first")).alias("_all"))
    of = lambda x: F.transform("_all", lambda y: F.struct(x["allele"].alias("a"), x["k"].alias("ka"), y["allele"].alias("b"), y["k"].alias("kb")))
    both = each.select(by, F.explode(F.filter("_all", lambda x: x["first"])).alias("_x"), "_all").select(by, F.inline(of(F.col("_x"))))
    both = both.withColumn("_l", F.least("a", "b")).withColumn("_h", F.greatest("a", "b"))
    swap = F.col("a") != F.col("_l")
    tie = F.col("ka") == F.col("kb")
    wins = F.when(tie, 0.5).when((F.col("ka") < F.col("kb")) != swap, 1.0).otherwise(0.0)
    sums = both.groupBy(by, "_l", "_h", "a").agg(F.sum(F.least("ka", "kb")).alias("cost"), F.sum(F.col("ka") + F.col("kb")).alias("own"), F.avg(wins).alias("share_a"))
    pairs = sums.groupBy(by, F.col("_l").alias("a"), F.col("_h").alias("b")).agg(F.min("cost").alias("cost"), F.min("own").alias("own"), F.round(F.min("share_a"), 12).alias("share_a"))
    pairs = pairs.withColumn("share_b", F.round(1 - F.col("share_a"), 12))
    order = ["cost", "own", F.round(F.abs(F.col("share_a") - F.col("share_b")), 12), "a", "b"]
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= top)


def select_best(beam: DataFrame, least: float, by: str = "gene") -> DataFrame:
    """The first rank whose members' shares are all enough; the first of all where none is."""
    ok = F.least("share_a", "share_b") >= least
    return beam.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(F.when(ok, 0).otherwise(1), "rank"))).filter("_r = 1").drop("_r")


def em_steps(members: DataFrame, read: str, allele: str, steps: int) -> DataFrame:
    """allele, p after a fixed number of plain EM steps from even shares; members has a row for each (read, allele)."""
    pairs = members.select(read, allele).distinct()
    total = pairs.select(allele).distinct().agg(F.count("*").alias("_n"))
    p = pairs.select(allele).distinct().crossJoin(F.broadcast(total)).select(allele, (F.lit(1.0) / F.col("_n")).alias("p"))  # one row
    for _ in range(steps):
        weight = F.col("p") / F.sum("p").over(W.partitionBy(read))
        sums = pairs.join(p, allele).withColumn("_w", weight).groupBy(allele).agg(F.sum("_w").alias("_s"))
        p = sums.crossJoin(F.broadcast(sums.agg(F.sum("_s").alias("_t")))).select(allele, (F.col("_s") / F.col("_t")).alias("p"))  # one row
    return p


def mixed_groups(df: DataFrame, by: list[str], pos: str, value: str, copies: int) -> DataFrame:
    """by, mixed: whether at some position a second value has more than 1/(2 copies) of the support.

    Values with a support of 3 or less don't count, nor do positions with under 20 in all or shares of a tenth or less.
    """
    counts = df.groupBy(*by, pos, value).agg(F.count("*").alias("n")).filter("n > 3")
    w = W.partitionBy(*by, pos)
    shares = counts.withColumn("_t", F.sum("n").over(w)).filter("_t >= 20").withColumn("_s", F.col("n") / F.col("_t")).filter("_s > 0.1")
    second = shares.withColumn("_r", F.row_number().over(w.orderBy(F.desc("n"), value))).filter("_r = 2")
    evidence = second.filter(F.col("_s") > 1 / (2 * copies)).select(*by).distinct().withColumn("_m", F.lit(True))
    return df.select(*by).distinct().join(evidence, by, "left").select(*by, F.coalesce("_m", F.lit(False)).alias("mixed"))
