"""Best sets of alleles for each gene and sample, from the reads' evidence.

A read and an allele disagree on k of the n variants that the read tells; the likelihood depends on k alone, so the
search works with whole numbers: the best member of a set has the least k, and a set's value follows from the sum
of least ks.  All groups, (sample, gene), are searched in the same tables (beam, em); jobs grow with the copies of a
gene, not with the groups, and a group may have any number of reads.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuspark.operators import beam, em
from locuspark.operators.beam import GROUP, PROBLEM
from locuspark.storage import written

HIT, MISS = math.log10(0.999), math.log10(0.001)
TOP_N = 600
LEAST_READS = 100
#: Genes that are never taken for homozygous.
ALWAYS_MIXED = ("2DL1S1", "2DL5")


@dataclass
class Setting:
    top_n: int = TOP_N
    correct: bool = True
    rank_share: float = 0.9
    exon_share: float = 1.0


RESULT = "sample string, gene string, cn int, n_reads bigint, rank int, value double, alleles array<string>, share array<double>, chosen boolean"


def numbered(variants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gene, variant, members) and (gene, allele, a): what carries each variant, by sorted alleles' numbers from 0."""
    names = variants.select("gene", F.explode("allele").alias("allele")).distinct()
    names = written(names.select("gene", "allele", (F.row_number().over(W.partitionBy("gene").orderBy("allele")) - 1).alias("a")), "alleles")
    each = variants.select("gene", "variant", F.explode("allele").alias("allele")).join(names, ["gene", "allele"])
    return written(each.groupBy("gene", "variant").agg(F.sort_array(F.collect_set("a")).alias("members")), "carriers"), names


def exon_groups(variants: DataFrame, names: DataFrame) -> DataFrame:
    """gene, g, members: alleles with the same variants in exons, numbered in the order of their first allele."""
    exon = variants.filter("in_exon").select("gene", "variant", F.explode("allele").alias("allele"))
    held = names.join(exon, ["gene", "allele"], "left").groupBy("gene", "a").agg(F.sort_array(F.collect_set("variant")).alias("held"))
    groups = held.groupBy("gene", "held").agg(F.sort_array(F.collect_list("a")).alias("members"))
    return groups.select("gene", "held", "members", (F.row_number().over(W.partitionBy("gene").orderBy(F.get("members", F.lit(0)))) - 1).alias("g"))


def value_of(cost: Column, told: Column) -> Column:
    """The log10 likelihood of a summed mismatch count."""
    return cost * MISS + (told - cost) * HIT


def near_best(found: DataFrame, keys: list[str], share: float) -> Column:
    """Whether a set is the first one, or its value, scaled, reaches the first one's; found has rank from 1 and value."""
    best = F.max(F.when(F.col("rank") == 1, F.col("value"))).over(W.partitionBy(*keys))
    return (F.col("rank") == 1) | (F.col("value") * share >= best)


def _exon_first(used: DataFrame, variants: DataFrame, names: DataFrame, rows: DataFrame, groups: DataFrame, problems: DataFrame, setting: Setting) -> DataFrame:
    """Types groups of alleles that have the same exon variants first, then alleles within the best sets of groups."""
    of_gene = written(exon_groups(variants, names), "exon-groups")
    exon = variants.filter("in_exon").select("gene", "variant").distinct()
    told = used.join(exon, ["gene", "variant"], "left_semi")
    told = written(beam.corrected(told) if setting.correct else told, "exon-evidence")
    by_group = of_gene.select("gene", "g", F.explode("held").alias("variant")).groupBy("gene", "variant").agg(F.sort_array(F.collect_list("g")).alias("members"))
    e_rows, e_groups = beam.dealt(beam.classes(told, by_group, of_gene.groupBy("gene").agg(F.count("*").cast("int").alias("size"))))
    seen = told.groupBy(*GROUP).agg(F.sum("n").alias("told"))
    with_exons = written(problems.join(seen.select(*GROUP), GROUP, "left_semi"), "exon-problems")
    first = beam.search(e_rows, e_groups, with_exons, None, setting.top_n).join(seen, GROUP)
    first = first.withColumn("value", value_of(F.col("cost"), F.col("told")))
    first = written(first.withColumn("_near", near_best(first, PROBLEM, setting.exon_share)).filter("_near"), "exon-sets")
    branches = problems.drop("branch").join(first.select(*GROUP, F.col("rank").alias("branch"), F.col("members").alias("_sets")), GROUP)
    steps = branches.select(*PROBLEM, F.posexplode("_sets").alias("_step", "g"))
    allowed = steps.join(of_gene.select("gene", "g", "members"), ["gene", "g"]).select(*PROBLEM, (F.col("_step") + 1).alias("step"), F.explode("members").alias("a"))
    # Without a word on exons any allele may stand at any place.
    others = problems.join(seen.select(*GROUP), GROUP, "left_anti")
    free = others.join(names.select("gene", "a"), "gene").select(*PROBLEM, F.explode(F.sequence(F.lit(1), "cn")).alias("step"), "a")
    every = written(branches.drop("_sets").unionByName(others), "exon-branches")
    found = beam.search(rows, groups, every, written(allowed.unionByName(free), "exon-allowed"), max(1, setting.top_n // 5))
    one = found.groupBy(*GROUP, "cn", "members").agg(F.first("cost").alias("cost"), F.first("own").alias("own"), F.first("share").alias("share"))
    uneven = F.round(F.aggregate("share", F.lit(0.0), lambda t, x: t + F.abs(x - 1 / F.col("cn"))), 12)
    return one.withColumn("rank", F.row_number().over(W.partitionBy(*GROUP).orderBy("cost", "own", uneven, "members")))


def type_alleles(reads: DataFrame, variants: DataFrame, copies: DataFrame, strategy: str = "full", setting: Setting | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """RESULT: near-optimal sets of every (sample, gene) with copies; chosen marks the call.

    reads: as_pairs() rows; variants: catalogue rows (ref, pos, typ, val, id, allele, in_exon); copies: sample, gene, cn;
    lengths: allele, length, for the EM; alleles that it lacks are an error.  strategy: full, exonfirst, em or report.
    """
    setting = setting or Setting()
    if strategy not in ("full", "exonfirst", "em", "report"):
        raise NotImplementedError(strategy)
    wanted = written(copies.filter("cn > 0").select("sample", "gene", F.col("cn").cast("int").alias("cn")), "copies")
    unique = reads.filter("multiple = 1").join(wanted.select("sample", F.col("gene").alias("backbone")), ["sample", "backbone"], "left_semi")
    unique = written(unique.select("sample", "backbone", "pair_id", "lpv", "lnv", "rpv", "rnv"), "unique")
    counted = wanted.join(unique.groupBy("sample", F.col("backbone").alias("gene")).agg(F.count("*").alias("n_reads")), GROUP, "left").withColumn("n_reads", F.coalesce("n_reads", F.lit(0).cast("bigint")))
    known = variants.filter(F.size("allele") > 0).select(F.col("ref").alias("gene"), F.col("id").alias("variant"), "pos", "typ", "val", "allele", F.coalesce("in_exon", F.lit(False)).alias("in_exon"))
    carriers, names = numbered(known)
    listed = names.groupBy("gene").agg(F.transform(F.sort_array(F.collect_list(F.struct("a", "allele"))), lambda x: x["allele"]).alias("names"))
    shown = lambda members: F.transform(members, lambda a: F.get("names", a))
    if strategy in ("em", "report"):
        of_name = F.lit(1.0) if lengths is None else F.coalesce("length", F.raise_error(F.concat(F.lit("no length of "), "allele")).cast("int")).cast("double")
        sized = names if lengths is None else names.join(lengths.select("allele", "length"), "allele", "left")
        sizes = sized.groupBy("gene").agg(F.transform(F.sort_array(F.collect_list(F.struct("a", of_name.alias("size")))), lambda x: x["size"]).alias("lengths"))
        p = em.shares(written(em.candidates(unique, carriers), "em-rows"), written(sizes, "em-lengths"))
        given = em.copies_of(p, wanted).join(listed, "gene").select(*GROUP, shown("members").alias("alleles"))
        rows = counted.join(given, GROUP, "left")
        none = F.array().cast("array<string>")
        return rows.select(*GROUP, "cn", "n_reads", F.lit(0).alias("rank"), F.lit(0.0).alias("value"), F.coalesce("alleles", none).alias("alleles"), F.array().cast("array<double>").alias("share"), F.lit(True).alias("chosen"))
    told = written(beam.long_evidence(unique), "told")
    used = written(beam.corrected(told), "used") if setting.correct else told
    rows, groups = beam.dealt(beam.classes(used, carriers, names.groupBy("gene").agg(F.count("*").cast("int").alias("size"))))
    differs = beam.two_values(used, known.select("gene", "variant", "pos", "typ", "val"), wanted).withColumn("_two", F.lit(True))
    mixed = (F.col("cn") <= 1) | F.col("_two").isNotNull() | reduce_or([F.contains("gene", F.lit(x)) for x in ALWAYS_MIXED])
    problems = wanted.join(groups.select(*GROUP), GROUP, "left_semi").join(differs, GROUP, "left")
    problems = written(problems.select(*GROUP, F.lit(0).alias("branch"), "cn", mixed.alias("mixed")), "problems")
    if strategy == "exonfirst":
        found = _exon_first(used, known, names, rows, groups, problems, setting)
    else:
        found = beam.search(rows, groups, problems, None, setting.top_n)
    sums = used.groupBy(*GROUP).agg(F.sum("n").alias("told"))
    by_copies = F.when(F.col("mixed"), F.lit(1)).otherwise(F.col("cn"))
    valued = found.drop("branch").join(problems.select(*GROUP, "mixed"), GROUP).join(sums, GROUP).withColumn("value", by_copies * value_of(F.col("cost"), F.col("told")))
    enough = F.forall("share", lambda x: x >= 1 / (2 * F.col("cn")))
    first = F.row_number().over(W.partitionBy(*GROUP).orderBy(F.when(enough, 0).otherwise(1), "rank")) == 1
    kept = valued.withColumn("chosen", first).withColumn("_near", near_best(valued, GROUP, setting.rank_share)).filter("_near or chosen")
    kept = kept.join(listed, "gene").select(*GROUP, (F.col("rank") - 1).alias("rank"), "value", shown("members").alias("alleles"), "share", "chosen")
    # Without evidence or alleles the call says so much of the gene as there are copies.
    blank = F.array_repeat(F.concat(F.split_part("gene", F.lit("*"), F.lit(1)), F.lit("*")), F.col("cn"))
    none = counted.join(problems.select(*GROUP), GROUP, "left_anti").select(*GROUP, "cn", "n_reads", F.lit(0).alias("rank"), F.lit(0.0).alias("value"), blank.alias("alleles"), F.array().cast("array<double>").alias("share"), F.lit(True).alias("chosen"))
    return counted.join(kept, GROUP).select(none.columns).unionByName(none)


def reduce_or(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def warnings(result: DataFrame) -> DataFrame:
    """sample, gene, warning for genes with few reads."""
    return result.filter("chosen").filter(F.col("n_reads") < LEAST_READS).select("sample", "gene", F.concat(F.lit("few reads: "), "n_reads").alias("warning"))


def calls(result: DataFrame) -> DataFrame:
    """name, alleles joined by _, warnings: one row for each sample."""
    few = F.when(F.col("n_reads") < LEAST_READS, F.concat_ws(":", "gene", F.lit("few reads")))
    by = result.filter("chosen").groupBy(F.col("sample").alias("name"))
    return by.agg(F.array_join(F.array_sort(F.flatten(F.collect_list("alleles"))), "_").alias("alleles"), F.array_join(F.array_sort(F.collect_list(few)), ";").alias("warnings"))


def possible_sets(result: DataFrame) -> DataFrame:
    """gene, rank, value and the alleles in columns 1..n of each near-optimal set; n is that of the largest set."""
    most = result.agg(F.max(F.size("alleles"))).first()[0] or 0
    return result.select("sample", "gene", "rank", "value", *(F.get("alleles", F.lit(i)).alias(str(i + 1)) for i in range(most)))
