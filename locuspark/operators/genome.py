"""Figures about alleles, genes and their variants: lengths, counts, versions, positions, repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuspark.operators.alignment import without_backbone

BASES = ("A", "T", "C", "G")
#: Segments of a repeat search, and how far apart they begin.
SEGMENT, STEP = 400, 100
FLANK = 200


def described(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, mean, std, min, p25, median, p75, max of a whole-number column."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.percentile(v, 0.25).alias("p25"), F.median(v).alias("median"), F.percentile(v, 0.75).alias("p75"), F.max(v).alias("max"))


def allele_lengths(msa: DataFrame) -> DataFrame:
    """gene, allele, length without gaps, backbones left out."""
    return without_backbone(msa).select("gene", "allele", F.length(F.regexp_replace("seq", "-", "")).alias("length"))


def resolution_counts(names: DataFrame, by: list[str], field: Column, levels: tuple[int, ...] = (3, 5, 7)) -> DataFrame:
    """by, and how many names have at least so many digits."""
    return names.groupBy(*by).agg(*(F.count_if(F.length(field) >= n).alias(f"at_least_{n}") for n in levels))


def share_within(df: DataFrame, by: list[str], part: str, value: str) -> DataFrame:
    """by, part, value summed, and its share of the group; 0 of nothing is null."""
    sums = df.groupBy(*by, part).agg(F.sum(value).alias(value))
    return sums.withColumn("share", F.try_divide(F.col(value), F.sum(value).over(W.partitionBy(*by))))


def possible_set_means(possible: DataFrame, sample: str = "sample") -> DataFrame:
    """gene, cn, mean_sets: how many possible sets a sample has, averaged by (gene, cn), by gene and by cn (null: all)."""
    of_sample = possible.groupBy(sample, "gene").agg(F.count("*").alias("_sets"), F.avg("cn").alias("cn"))
    levels = [[F.col("gene"), F.col("cn")], [F.col("gene")], [F.col("cn")]]
    return of_sample.groupingSets(levels, F.col("gene"), F.col("cn")).agg(F.grouping_id().alias("level"), F.avg("_sets").alias("mean_sets"))


def novel_means(found: DataFrame, skipped: str = "skip", sample: str = "sample") -> DataFrame:
    """gene, mean_per_allele, mean_per_sample of variants that weren't skipped, over all called alleles and their samples."""
    by_allele = found.groupBy(sample, "gene", "allele").agg(F.count_if(~F.col(skipped)).alias("_n"))
    by_sample = by_allele.groupBy(sample, "gene").agg(F.sum("_n").alias("_s"), F.count("*").alias("_k"))
    return by_sample.groupBy("gene").agg((F.sum("_s") / F.sum("_k")).alias("mean_per_allele"), F.avg("_s").alias("mean_per_sample"))


def version_totals(old: DataFrame, new: DataFrame, exon_only: Column | None = None) -> DataFrame:
    """gene (null: all), alleles of two versions by kind, what the new one adds, and exon-only names that it has lost.

    old, new: gene, allele.  Genes are those of the old version.
    """
    exon = F.col("allele").endswith("e") if exon_only is None else exon_only
    both = old.select("gene", "allele", exon.alias("exon")).distinct().withColumn("_old", F.lit(True)).join(new.select("gene", "allele", exon.alias("exon")).distinct().withColumn("_new", F.lit(True)), ["gene", "allele", "exon"], "full_outer")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    kept = both.join(old.select("gene").distinct(), "gene", "left_semi")
    out = kept.rollup("gene").agg(
        count(F.col("_old") & F.col("exon")).alias("old_exon"), count(F.col("_old") & ~F.col("exon")).alias("old_full"),
        count(F.col("_new") & F.col("exon")).alias("new_exon"), count(F.col("_new") & ~F.col("exon")).alias("new_full"),
        count(F.col("_old") & F.col("_new").isNull() & F.col("exon")).alias("exon_gone"),
    )
    return out.select("*", (F.col("old_exon") + F.col("old_full")).alias("old_total"), (F.col("new_exon") + F.col("new_full")).alias("new_total"), (F.col("new_exon") - F.col("old_exon")).alias("exon_more"), (F.col("new_full") - F.col("old_full")).alias("full_more"))


def variable_positions(columns: DataFrame, by: list[str], *, gaps: bool = True) -> DataFrame:
    """by, pos where a group's members differ; without gaps, where their bases do.  columns: by, pos, base of each member."""
    rows = columns if gaps else columns.filter(F.col("base").isin(*BASES))
    return rows.groupBy(*by, "pos").agg(F.min("base").alias("_a"), F.max("base").alias("_b")).filter("_a <> _b").select(*by, "pos")


def between_groups(columns: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """pos, source: where members of a and of b differ among themselves, and where only a and b differ (between)."""
    of = lambda *names: variable_positions(columns.filter(F.col(by).isin(*names)), []).select("pos")
    of_a, of_b = of(a), of(b)
    between = of(a, b).subtract(of_a).subtract(of_b)
    return of_a.withColumn("source", F.lit(a)).union(of_b.withColumn("source", F.lit(b))).union(between.withColumn("source", F.lit("between")))


def dissimilarity(columns: DataFrame, by: str, member: str) -> DataFrame:
    """a, b, positions: for each pair of groups the positions at which only the two differ; groups are few, as genes are.

    A position tells two groups apart if each has one base there and the bases differ.
    """
    one = columns.groupBy(by, "pos").agg(F.min("base").alias("_a"), F.max("base").alias("_b"), F.countDistinct(member).alias("_n")).filter("_a = _b").select(by, "pos", F.col("_a").alias("base"))
    left, right = one.select(F.col(by).alias("a"), "pos", F.col("base").alias("x")), one.select(F.col(by).alias("b"), "pos", F.col("base").alias("y"))
    return left.join(right, "pos").filter("a < b").groupBy("a", "b").agg(F.count_if(F.col("x") != F.col("y")).alias("positions"))


def split_keeping(text: Column, separator: str) -> Column:
    """Pieces of text, each but the first with the separator that it was cut at."""
    pieces = F.split(text, rf"\Q{separator}\E", -1)
    return F.transform(pieces, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit(separator), x)))


def exon_and_intron_positions(sequences: DataFrame, exons: DataFrame) -> DataFrame:
    """gene, allele, exon and intron: 0-based positions of a sequence that aren't gaps, inside and outside its gene's exons."""
    spans = exons.groupBy("gene").agg(F.collect_list(F.struct("start", "end")).alias("_e"))
    chars = sequences.select("gene", "allele", F.posexplode(F.split("seq", "")).alias("pos", "_c")).filter("_c <> '-'")
    inside = F.coalesce(F.exists("_e", lambda e: (F.col("pos") >= e["start"]) & (F.col("pos") < e["end"])), F.lit(False))
    return chars.join(spans, "gene", "left").withColumn("_in", inside).groupBy("gene", "allele").agg(F.array_sort(F.collect_list(F.when(F.col("_in"), F.col("pos")))).alias("exon"), F.array_sort(F.collect_list(F.when(~F.col("_in"), F.col("pos")))).alias("intron"))


def flanked_exons(blocks: DataFrame, length: int = FLANK) -> DataFrame:
    """gene, start, end of exons with so many bases on both sides, joined where they meet, within the gene."""
    from locuspark.operators.series import merged_intervals

    whole = blocks.groupBy("gene").agg(F.max("end").alias("_l"))
    return merged_intervals(blocks.filter("type = 'exon'").join(whole, "gene"), ["gene"], "start", "end", flank=length, low=F.lit(0), high=F.col("_l"))


def variants_by_region(positions: DataFrame, blocks: DataFrame) -> DataFrame:
    """gene, region, n, share: variants in each kind of block.  positions: gene, pos; blocks: gene, type, start, end."""
    from locuspark.operators.sets import range_join

    held = range_join(positions, blocks.select("gene", F.col("type").alias("region"), "start", "end"), ["gene"], "pos", "start", "end")
    return share_within(held.groupBy("gene", "region").agg(F.count("*").alias("n")), ["gene"], "region", "n")


def shared_segments(a: DataFrame, b: DataFrame, *, segment: int = SEGMENT, step: int = STEP) -> DataFrame:
    """name, pos, found: whether the segment of a's sequence at pos lies somewhere in any of b's; a, b: name, seq.

    Every place of b gives its segment's hash, so segments meet by an equi-join; texts are compared where hashes agree.
    Segments begin every step as long as more than step bases are left; the last ones are shorter, and are tried
    against b's places by their own lengths.
    """
    pieces = a.select("name", F.explode(F.sequence(F.lit(0), F.length("seq") - step - 1, F.lit(step))).alias("pos"), "seq").filter(F.length("seq") > step)
    pieces = pieces.select("name", "pos", F.substring("seq", F.col("pos") + 1, F.lit(segment)).alias("_s")).withColumn("_n", F.length("_s"))
    lengths = pieces.select("_n").distinct()
    places = b.join(F.broadcast(lengths), F.length("seq") >= F.col("_n")).select("seq", "_n", F.explode(F.sequence(F.lit(1), F.length("seq") - F.col("_n") + 1)).alias("_at"))
    there = places.select("_n", F.substring("seq", F.col("_at"), F.col("_n")).alias("_s")).distinct()
    hit = pieces.join(there, ["_n", "_s"], "left_semi").select("name", "pos").withColumn("found", F.lit(True))
    return pieces.select("name", "pos").join(hit, ["name", "pos"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
