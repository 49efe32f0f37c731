"""Shares of alleles by expectation-maximisation, for all samples and genes at once.

Reads with the same list of candidates are one row with a weight.  A round takes two plain steps, extrapolates along
them, and takes a third; a (sample, gene) whose shares hardly move any more leaves the table, so the number of jobs is that
of the rounds of the slowest group, whatever the number of groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuspark.operators.beam import GROUP
from locuspark.storage import release, written

ROUNDS, TOLERANCE = 300, 1e-4


def candidates(reads: DataFrame, carriers: DataFrame) -> DataFrame:
    """sample, gene, members, w: reads by the alleles that most of their mates allow, those of both or else of either.

    A mate allows the alleles with all that it supports and none of what it contradicts; one that supports nothing allows
    none.  reads: as_pairs() rows; carriers: gene, variant, members (numbers).
    """
    side = lambda name, mate, sign: F.transform(name, lambda v: F.struct(F.lit(mate).alias("mate"), v.alias("variant"), F.lit(sign).alias("sign")))
    sides = F.concat(side("lpv", 0, True), side("rpv", 1, True), side("lnv", 0, False), side("rnv", 1, False))
    told = reads.select("sample", F.col("backbone").alias("gene"), F.col("pair_id").alias("read"), F.inline(F.array_distinct(sides)))
    mate = [*GROUP, "read", "mate"]
    need = told.filter("sign").groupBy(*mate).agg(F.count("*").alias("_need"))
    met = told.join(carriers, ["gene", "variant"]).select(*mate, "sign", F.explode("members").alias("a"))
    fits = met.groupBy(*mate, "a").agg(F.count_if("sign").alias("_p"), F.count_if(~F.col("sign")).alias("_q")).filter("_q = 0 and _p > 0")
    allowed = fits.join(need, mate).filter("_p = _need").groupBy(*GROUP, "read", "a").agg(F.count("*").alias("_c"))
    best = allowed.withColumn("_m", F.max("_c").over(W.partitionBy(*GROUP, "read"))).filter("_c = _m")
    lists = best.groupBy(*GROUP, "read").agg(F.sort_array(F.collect_list("a")).alias("members"))
    return lists.groupBy(*GROUP, "members").agg(F.count("*").cast("double").alias("w"))


def _step(rows: DataFrame, state: DataFrame, given: str, made: str) -> DataFrame:
    """state with the shares that given leads to."""
    met = rows.join(state.select(*GROUP, F.col(given).alias("_p"), "lengths"), GROUP)
    whole = F.aggregate("members", F.lit(0.0), lambda t, a: t + F.get("_p", a))
    part = F.transform("members", lambda a: F.struct(a.alias("a"), (F.col("w") * F.get("_p", a) / F.col("_whole") / F.get("lengths", a)).alias("x")))
    sums = met.withColumn("_whole", whole).filter("_whole > 0").select(*GROUP, F.inline(part)).groupBy(*GROUP, "a").agg(F.sum("x").alias("x"))
    out = sums.groupBy(*GROUP).agg(F.map_from_entries(F.collect_list(F.struct("a", "x"))).alias("_m"), F.sum("x").alias("_t"))
    shares = F.transform("lengths", lambda _, a: F.coalesce(F.try_element_at("_m", a), F.lit(0.0)) / F.col("_t"))
    return state.join(out, GROUP).withColumn(made, shares).drop("_m", "_t")


def shares(rows: DataFrame, lengths: DataFrame, *, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """sample, gene, p: shares by number of allele.

    rows: from candidates(), written; lengths: gene, lengths (by number; what an allele gets of a read is divided by its
    own).  The step that turns out smaller than the tolerance isn't taken any more.
    """
    start = rows.select(*GROUP).distinct().join(lengths, "gene").withColumn("_one", F.transform("lengths", lambda _: F.lit(1.0)))
    state = written(_step(rows, start, "_one", "p").select(*GROUP, "lengths", "p"), "em")
    done: list[DataFrame] = []
    zipped = lambda a, b, f: F.zip_with(a, b, f)
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda t, x: t + x * x)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda t, x: t + x)
    for _ in range(rounds):
        once = _step(rows, state, "p", "p1")
        twice = _step(rows, once, "p1", "p2")
        twice = twice.withColumn("_slope", zipped("p1", "p", lambda x, y: x - y))
        twice = twice.withColumn("_bend", zipped(zipped("p2", "p1", lambda x, y: x - y), "_slope", lambda x, y: x - y))
        stride = F.sqrt(F.try_divide(square("_slope"), square("_bend")))
        moves = zipped("_slope", "_bend", lambda s, b: F.struct(s.alias("s"), b.alias("b")))
        far = zipped("p", moves, lambda x, m: F.greatest(x + 2 * F.col("_stride") * m["s"] + F.col("_stride") * F.col("_stride") * m["b"], F.lit(0.0)))
        ahead = twice.withColumn("_stride", stride).withColumn("_far", F.when(square("_bend") > 0, far).otherwise(F.col("p"))).select(*GROUP, "lengths", "p", "_far")
        moved = _step(rows, ahead, "_far", "_new")
        settled: Column = total(zipped("_new", "p", lambda x, y: F.abs(x - y))) <= tolerance
        made = written(moved.select(*GROUP, "lengths", "p", "_new", settled.alias("settled")), "em")
        release(state)
        done.append(made.filter("settled").select(*GROUP, "p"))
        state = made.filter("not settled").select(*GROUP, "lengths", F.col("_new").alias("p"))
        if state.isEmpty():
            return reduce(DataFrame.unionByName, done)
    return reduce(DataFrame.unionByName, [*done, state.select(*GROUP, "p")])


def copies_of(found: DataFrame, copies: DataFrame) -> DataFrame:
    """sample, gene, cn, members: each allele by share takes its rounded number of copies, one at least, until cn are given."""
    ranked = found.join(copies, GROUP).withColumn("_o", F.array_sort(F.filter(F.transform("p", lambda x, a: F.struct((-x).alias("less"), a.alias("a"))), lambda x: x["less"] < 0)))
    wanted = F.transform("_o", lambda x: F.array_repeat(x["a"], F.greatest(F.lit(1), F.rint(-x["less"] * F.col("cn")).cast("int"))))
    return ranked.select(*GROUP, "cn", F.slice(F.flatten(wanted), F.lit(1), F.col("cn")).alias("members"))
