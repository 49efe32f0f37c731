"""The allele search as tables: sets of any number of alleles for all samples and genes at once.

Reads that disagree with the alleles in the same way are one row with a weight; from its counts the least one is taken
off, since every set pays it.  A set costs the sum of its members' least counts.  One more member saves something only on
rows that the set doesn't explain yet, so a step sums what is saved over these rows, and not every read with every pair
of sets and alleles.  A step's sets are cut twice: by cost, then by cost, the members' own sums and the evenness of their
shares.  Shares are whole numbers (of the least common multiple of all ties), so that no order of summing matters.

A problem is (sample, gene, branch); problems that have all their members leave the loop.  The rows of a large group are
dealt over several tasks and meet a copy of its sets in each, so a group may have any number of reads.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuspark.storage import written

GROUP = ["sample", "gene"]
PROBLEM = [*GROUP, "branch"]
#: Rows of a group that one task takes.
SPLIT = 20_000
#: A position's values count from so much support on, in all and each, and from this share.
LEAST_AT, LEAST_VALUE, LEAST_SHARE = 20, 3, 0.1
LEAST_SUPPORT, SIGN_SHARE = 3, 0.2


# --- evidence -------------------------------------------------------------------------------------------------


def long_evidence(reads: DataFrame) -> DataFrame:
    """sample, gene, read, variant, sign, n from as_pairs() rows with one place: what both mates tell, n times."""
    side = lambda names, sign: F.transform(F.concat(*names), lambda v: F.struct(v.alias("variant"), F.lit(sign).alias("sign")))
    rows = reads.select("sample", F.col("backbone").alias("gene"), F.col("pair_id").alias("read"), F.inline(F.concat(side(["lpv", "rpv"], True), side(["lnv", "rnv"], False))))
    return rows.groupBy(*GROUP, "read", "variant", "sign").agg(F.count("*").alias("n"))


def corrected(evidence: DataFrame) -> DataFrame:
    """evidence without signs that lack support, and without variants that hardly any read tells."""
    sums = evidence.groupBy(*GROUP, "variant").agg(F.sum(F.when(F.col("sign"), F.col("n")).otherwise(0)).alias("_p"), F.sum("n").alias("_t"))
    own = F.when(F.col("sign"), F.col("_p")).otherwise(F.col("_t") - F.col("_p"))
    return evidence.join(sums, [*GROUP, "variant"]).filter((F.col("_t") >= LEAST_SUPPORT) & (own / F.col("_t") >= SIGN_SHARE)).drop("_p", "_t")


def two_values(evidence: DataFrame, places: DataFrame, copies: DataFrame) -> DataFrame:
    """sample, gene of groups with several copies in which some position shows two values as a mixture would.

    places: gene, variant, pos, typ, val; deletions don't count.  A position needs a value that some read supports.
    """
    at = evidence.join(places.filter("typ <> 'deletion'"), ["gene", "variant"])
    counts = at.groupBy(*GROUP, "pos", "val", "sign").agg(F.sum("n").alias("n"))
    w = W.partitionBy(*GROUP, "pos")
    counts = counts.withColumn("_seen", F.max("sign").over(w)).filter("_seen").filter(F.col("n") > LEAST_VALUE)
    shares = counts.withColumn("_t", F.sum("n").over(w)).filter(F.col("_t") >= LEAST_AT).withColumn("_s", F.col("n") / F.col("_t")).filter(F.col("_s") > LEAST_SHARE)
    second = shares.withColumn("_r", F.row_number().over(w.orderBy(F.desc("n"), "val", "sign"))).filter("_r = 2").groupBy(*GROUP).agg(F.max("_s").alias("_s"))
    return second.join(copies.filter("cn > 1"), GROUP).filter(F.col("_s") > 1 / (2 * F.col("cn"))).select(*GROUP)


# --- rows of equal counts -------------------------------------------------------------------------------------


def classes(evidence: DataFrame, carriers: DataFrame, sizes: DataFrame) -> DataFrame:
    """sample, gene, k, w, least: k counts disagreements with each member by number, the least taken off; w reads are alike.

    carriers: gene, variant, members (numbers from 0); sizes: gene, size.  Reads that tell the same are put together
    first, then those that disagree alike.
    """
    told = evidence.groupBy(*GROUP, "read").agg(F.sort_array(F.collect_list(F.struct("variant", "sign", "n"))).alias("told")).groupBy(*GROUP, "told").agg(F.count("*").alias("w"))
    told = written(told.withColumn("id", F.monotonically_increasing_id()), "beam-told")
    supports = F.aggregate("told", F.lit(0).cast("bigint"), lambda t, x: t + F.when(x["sign"], x["n"]).otherwise(0))
    each = told.select(*GROUP, "id", "w", supports.alias("_p"), F.inline("told")).withColumn("_d", F.when(F.col("sign"), -F.col("n")).otherwise(F.col("n")))
    touched = each.join(carriers, ["gene", "variant"], "left").select(*GROUP, "id", "w", "_p", "_d", F.explode_outer("members").alias("_a"))
    sums = touched.groupBy(*GROUP, "id", "w", "_p", "_a").agg(F.sum("_d").alias("_d"))
    sums = sums.groupBy(*GROUP, "id", "w", "_p").agg(F.map_from_entries(F.collect_list(F.when(F.col("_a").isNotNull(), F.struct("_a", "_d")))).alias("_m"))
    every = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.col("_p") + F.coalesce(F.try_element_at("_m", i), F.lit(0).cast("bigint")))
    rows = sums.join(sizes, "gene").select(*GROUP, "w", every.alias("k")).groupBy(*GROUP, "k").agg(F.sum("w").alias("w"))
    return rows.select(*GROUP, F.transform("k", lambda x: x - F.array_min("k")).alias("k"), "w", F.array_min("k").alias("least"))


def dealt(rows: DataFrame, split: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    """(classes with the task of their group, groups): groups: sample, gene, ways, base (cost of all sets), weight, totals."""
    rows = rows.groupBy(*GROUP, "k").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("least")).alias("base"))
    rows = written(rows, "beam-classes")
    sums = rows.groupBy(*GROUP).agg(F.ceil(F.count("*") / split).cast("int").alias("ways"), F.sum("base").alias("base"), F.sum("w").alias("weight"))
    own = rows.select(*GROUP, "w", F.posexplode("k").alias("a", "x")).groupBy(*GROUP, "a").agg(F.sum(F.col("w") * F.col("x")).alias("total"))
    own = own.groupBy(*GROUP).agg(F.transform(F.sort_array(F.collect_list(F.struct("a", "total"))), lambda x: x["total"]).alias("totals"))
    groups = written(sums.join(own, GROUP), "beam-groups")
    spread = rows.join(groups.select(*GROUP, "ways"), GROUP).select(*GROUP, "k", "w", F.pmod(F.xxhash64("k"), F.col("ways")).cast("int").alias("task"))
    return written(spread, "beam-dealt"), groups


# --- the loop -------------------------------------------------------------------------------------------------


def _met(rows: DataFrame, sets: DataFrame, groups: DataFrame) -> DataFrame:
    """Every row of a group beside every set of its problems; members has the set, least its least count."""
    spread = sets.join(groups.select(*GROUP, "ways"), GROUP).withColumn("task", F.explode(F.sequence(F.lit(0), F.col("ways") - 1))).drop("ways")
    return rows.join(spread, [*GROUP, "task"]).withColumn("each", F.transform("members", lambda m: F.get("k", m))).withColumn("least", F.array_min("each"))


def _extended(sets: DataFrame, allowed: DataFrame, rows: DataFrame, groups: DataFrame, top: Column) -> DataFrame:
    """The sets with one more of the allowed members, cut by cost to top or a fifth of them."""
    open_rows = _met(rows, sets.select(*PROBLEM, "members"), groups).filter("least > 0")
    saves = F.filter(F.transform("k", lambda x, a: F.struct(a.alias("a"), ((F.col("least") - x) * F.col("w")).alias("saved"))), lambda s: s["saved"] > 0)
    saved = open_rows.select(*PROBLEM, "members", F.inline(saves)).groupBy(*PROBLEM, "members", "a").agg(F.sum("saved").alias("saved"))
    both = sets.select(*PROBLEM, "members", "cost", top.alias("_top")).join(allowed, PROBLEM).join(saved, [*PROBLEM, "members", "a"], "left")
    more = both.select(*PROBLEM, "_top", F.array_sort(F.concat("members", F.array("a"))).alias("members"), (F.col("cost") - F.coalesce("saved", F.lit(0))).alias("cost"))
    more = more.groupBy(*PROBLEM, "_top", "members").agg(F.min("cost").alias("cost"))
    w = W.partitionBy(*PROBLEM)
    cut = more.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy("cost", "members")))
    return cut.filter(F.col("_r") <= F.greatest(F.col("_top"), F.floor(F.col("_n") / 5))).drop("_n", "_r")


def _ranked(sets: DataFrame, rows: DataFrame, groups: DataFrame, size: int) -> DataFrame:
    """problem, members, cost, own, parts (whole numbers of shares), rank: the first _top sets in order.

    Evenness only tells sets of equal cost and own sum apart, so shares are worked out for those that can be among the first.
    """
    own = F.aggregate("members", F.lit(0).cast("bigint"), lambda t, m: t + F.get("totals", m) + F.col("base"))
    summed = sets.join(groups.select(*GROUP, "totals", "base", "weight"), GROUP).select(*PROBLEM, "_top", "members", "cost", own.alias("own"), "weight")
    w = W.partitionBy(*PROBLEM)
    near = written(summed.withColumn("_r", F.rank().over(w.orderBy("cost", "own"))).filter(F.col("_r") <= F.col("_top")).drop("_r"), "beam-near")
    unit = math.lcm(*range(1, size + 1))
    met = _met(rows, near.select(*PROBLEM, "members"), groups)
    part = lambda j: F.sum(F.when(F.get("each", F.lit(j)) == F.col("least"), F.col("w") * F.lit(unit) / F.size(F.filter("each", lambda x: x == F.col("least")))).otherwise(0)).cast("bigint")
    parts = met.groupBy(*PROBLEM, "members").agg(*(part(j).alias(f"_{j}") for j in range(size))).select(*PROBLEM, "members", F.array(*(F.col(f"_{j}") for j in range(size))).alias("parts"))
    uneven = F.aggregate("parts", F.lit(0).cast("bigint"), lambda t, x: t + F.abs(x * size - F.col("weight") * unit))
    found = near.join(parts, [*PROBLEM, "members"]).withColumn("rank", F.row_number().over(w.orderBy("cost", "own", uneven, "members")))
    return found.filter(F.col("rank") <= F.col("_top")).select(*PROBLEM, "members", "cost", "own", F.transform("parts", lambda x: x / (F.col("weight") * unit)).alias("share"), "rank")


def search(rows: DataFrame, groups: DataFrame, problems: DataFrame, allowed: DataFrame | None, top: int) -> DataFrame:
    """problem, cn, members, cost, own, share, rank (from 1) of the best sets.

    rows, groups: from dealt(); problems: sample, gene, branch, cn, mixed, written; allowed: problem, step (from 1), a:
    the members that a step may add, by default all.  Groups that aren't mixed have one member, cn times.
    """
    if allowed is None:
        every = problems.join(groups.select(*GROUP, "totals"), GROUP).select(*PROBLEM, F.explode(F.sequence(F.lit(0), F.size("totals") - 1)).alias("a"))
        of_step = lambda step: every
    else:
        of_step = lambda step: allowed.filter(F.col("step") == step).select(*PROBLEM, "a")
    first = problems.join(groups.select(*GROUP, "totals", "base"), GROUP).join(of_step(1), PROBLEM)
    cost = F.get("totals", F.col("a")) + F.col("base")
    first = first.select(*PROBLEM, "cn", "mixed", F.array("a").alias("members"), cost.alias("cost"), cost.alias("own"), F.array(F.lit(1.0)).alias("share"))
    first = first.withColumn("rank", F.row_number().over(W.partitionBy(*PROBLEM).orderBy("cost", "members"))).filter(F.col("rank") <= top)
    sets = written(first, "beam-sets")
    columns = [*PROBLEM, "cn", "members", "cost", "own", "share", "rank"]
    n = F.col("cn")
    same = sets.filter("not mixed").select(*PROBLEM, "cn", F.array_repeat(F.get("members", F.lit(0)), n).alias("members"), "cost", (F.col("own") * n).alias("own"), F.array_repeat(F.lit(1.0) / n, n).alias("share"), "rank")
    done = [same, sets.filter("mixed and cn = 1").select(columns)]
    most = problems.filter("mixed").agg(F.max("cn")).first()[0] or 1
    for step in range(2, most + 1):
        active = sets.filter("mixed").filter(F.col("cn") >= step)
        cut = written(_extended(active, of_step(step), rows, groups, F.lit(top)), "beam-cut")
        sets = written(_ranked(cut, rows, groups, step).join(problems, PROBLEM), "beam-sets")
        done.append(sets.filter(F.col("cn") == step).select(columns))
    return reduce(DataFrame.unionByName, done)
