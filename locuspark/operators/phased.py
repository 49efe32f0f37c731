"""Typing from phased genotypes: each haplotype is the allele whose variants differ least from what it shows.

What a haplotype shows speaks for the alleles that have it, and what it doesn't show of the catalogue speaks against
those that do, so the distance is the size of a symmetric difference: shown + carried - 2 x both.  Only what is both
shown and carried is joined; the rest are counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A deletion's place in the catalogue is looked for from so far before its row's position (from 1) on, at so many places.
BEFORE, PLACES = 4, 10
HAPLOTYPE = ["chrom", "sample", "haplotype"]


def haplotypes(vcf: DataFrame) -> DataFrame:
    """chrom, sample, haplotype: all that the genotypes tell of, also those that show nothing."""
    return vcf.select("chrom", "sample", F.posexplode(F.split("gt", "[/|]")).alias("haplotype", "_g")).select(*HAPLOTYPE).distinct()


def shown_alternatives(vcf: DataFrame) -> DataFrame:
    """chrom, sample, haplotype, pos, ref, alt of phased genotypes: the alternative that each haplotype has."""
    rows = vcf.filter(F.contains("gt", F.lit("|"))).select("chrom", "sample", "pos", "ref", F.split("alt", ",").alias("_alts"), F.posexplode(F.split("gt", r"\|")).alias("haplotype", "_g"))
    rows = rows.withColumn("_i", F.col("_g").try_cast("int")).filter("_i > 0")
    return rows.select(*HAPLOTYPE, "pos", F.upper("ref").alias("ref"), F.upper(F.get("_alts", F.col("_i") - 1)).alias("alt"))


def atomised(rows: DataFrame) -> DataFrame:
    """rows with pos, ref, alt cut into single bases and pure insertions and deletions.

    A row whose one allele begins or ends with the other one stays.  Of any other the bases that stand over each other are
    single rows where they differ, and what the longer allele has more is a row of its own behind them, anchored by N.
    """
    n, m = F.length("ref"), F.length("alt")
    pure = F.startswith("alt", "ref") | F.endswith("alt", "ref") | F.startswith("ref", "alt") | F.endswith("ref", "alt")
    both = F.least(n, m)
    piece = lambda pos, ref, alt: F.struct(pos.alias("pos"), ref.alias("ref"), alt.alias("alt"))
    singles = F.transform(F.sequence(F.lit(0), both - 1), lambda i: piece(F.col("pos") + i, F.substring("ref", i + 1, F.lit(1)), F.substring("alt", i + 1, F.lit(1))))
    singles = F.filter(singles, lambda x: x["ref"] != x["alt"])
    rest = lambda c, size: F.concat(F.lit("N"), F.substring(c, both + 1, size))
    more = F.when(n == m, F.array().cast("array<struct<pos:int,ref:string,alt:string>>")).otherwise(F.array(piece(F.col("pos") + both - 1, rest("ref", n), rest("alt", m))))
    whole = F.array(piece(F.col("pos"), F.col("ref"), F.col("alt")))
    return rows.select(*[c for c in rows.columns if c not in ("pos", "ref", "alt")], F.inline(F.when((n == 1) & (m == 1) | ((n != m) & pure), whole).otherwise(F.concat(singles, more))))


def catalogue_ids(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """chrom, sample, haplotype, variant: the catalogue's variants that atomised rows are.

    Deletions needn't stand at the same place in both: the first of the places around that the catalogue has counts.
    Insertions, and what the catalogue doesn't have, are left out.
    """
    n, m = F.length("ref"), F.length("alt")
    key = [F.col("ref").alias("chrom"), F.col("pos").alias("at"), F.col("id").alias("variant")]
    singles = rows.filter((n == 1) & (m == 1)).select(*HAPLOTYPE, (F.col("pos") - 1).alias("at"), F.col("alt").alias("val"))
    singles = singles.join(catalogue.filter("typ = 'single'").select(*key, "val"), ["chrom", "at", "val"]).select(*HAPLOTYPE, "variant")
    deletions = rows.filter(n > m).select(*HAPLOTYPE, "pos", (n - m).alias("del_len")).distinct()
    places = deletions.withColumn("at", F.explode(F.sequence(F.col("pos") - BEFORE, F.col("pos") - BEFORE + PLACES - 1)))
    met = places.join(catalogue.filter("typ = 'deletion'").select(*key, "del_len"), ["chrom", "at", "del_len"])
    first = met.groupBy(*HAPLOTYPE, "pos", "del_len").agg(F.min_by("variant", F.struct("at", "variant")).alias("variant"))
    return singles.unionByName(first.select(*HAPLOTYPE, "variant")).distinct()


def nearest_alleles(shown: DataFrame, everyone: DataFrame, catalogue: DataFrame) -> DataFrame:
    """chrom, sample, haplotype, allele, distance: the least symmetric difference, the first name where several have it.

    everyone: haplotypes; shown: from catalogue_ids(); alleles are those that the catalogue names for the haplotype's gene.
    """
    carriers = catalogue.select(F.col("ref").alias("chrom"), F.col("id").alias("variant"), F.explode("allele").alias("allele")).distinct()
    carried = carriers.groupBy("chrom", "allele").agg(F.count("*").alias("_c"))
    n = shown.groupBy(*HAPLOTYPE).agg(F.count("*").alias("_n"))
    both = shown.join(carriers, ["chrom", "variant"]).groupBy(*HAPLOTYPE, "allele").agg(F.count("*").alias("_b"))
    rows = everyone.join(n, HAPLOTYPE, "left").join(carried, "chrom").join(both, [*HAPLOTYPE, "allele"], "left")
    distance = F.coalesce("_n", F.lit(0)) + F.col("_c") - 2 * F.coalesce("_b", F.lit(0))
    best = rows.groupBy(*HAPLOTYPE).agg(F.min(F.struct(distance.alias("distance"), F.col("allele").alias("allele"))).alias("_x"))
    return best.select(*HAPLOTYPE, "_x.allele", "_x.distance")


def phased_typing(vcf: DataFrame, catalogue: DataFrame) -> DataFrame:
    """chrom, sample, haplotype, allele, distance from a VCF's rows as read_vcf gives them."""
    return nearest_alleles(catalogue_ids(atomised(shown_alternatives(vcf)), catalogue), haplotypes(vcf), catalogue)


def merged_calls(typed: DataFrame) -> DataFrame:
    """sample, alleles of all genes and haplotypes, sorted and joined by _."""
    return typed.groupBy("sample").agg(F.array_join(F.array_sort(F.collect_list("allele")), "_").alias("alleles"))
