"""Candidate new variants of called alleles, from the reads that fit each allele best."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEAST_READS = 3


def read_groups(mismatches: DataFrame, *, sample: str = "sample") -> DataFrame:
    """sample, gene, pair_id, alleles: the called alleles that fit a read best, sorted, all that tie.

    mismatches: sample, gene, pair_id, allele, k of the called alleles.
    """
    w = W.partitionBy(sample, "gene", "pair_id")
    best = mismatches.withColumn("_m", F.min("k").over(w)).filter("k = _m")
    return best.groupBy(sample, "gene", "pair_id").agg(F.array_sort(F.collect_set("allele")).alias("alleles"))


def assigned_reads(mismatches: DataFrame, *, sample: str = "sample") -> DataFrame:
    """sample, gene, pair_id, allele of reads that one called allele fits better than all others."""
    return read_groups(mismatches, sample=sample).filter(F.size("alleles") == 1).select(sample, "gene", "pair_id", F.col("alleles")[0].alias("allele"))


def site_bases(mates: DataFrame, assigned: DataFrame, sites: DataFrame) -> DataFrame:
    """sample, gene, allele, pos, base, n: bases that an allele's own reads show at the sites; deleted ones don't count.

    mates: sample, pair_id, ref, piece and seq as decoded (with the read's bases); a pair's mates that overlap at a site
    show one base, the left one's.  sites: gene, pos.
    """
    from locuspark.operators.sets import range_join

    pieces = mates.select("sample", "pair_id", "mate", F.col("ref").alias("gene"), F.inline("piece")).filter("typ in ('match', 'single')")
    spans = pieces.select("sample", "pair_id", "mate", "gene", "typ", "val", F.col("pos").alias("first"), (F.col("pos") + F.col("length")).alias("last")).join(assigned.withColumnRenamed("allele", "_allele"), ["sample", "gene", "pair_id"])
    met = range_join(sites.select("gene", "pos", "reference").distinct(), spans, ["gene"], "pos", "first", "last")
    shown = met.select("sample", "gene", F.col("_allele").alias("allele"), "pair_id", "mate", "pos", F.when(F.col("typ") == "single", F.col("val")).otherwise(F.col("reference")).alias("base"))
    one = shown.groupBy("sample", "gene", "allele", "pair_id", "pos").agg(F.min_by("base", "mate").alias("base"))
    return one.groupBy("sample", "gene", "allele", "pos", "base").agg(F.count("*").alias("n"))


REGISTRY = ["variant_id", "ref", "pos", "typ", "val", "sample"]


def registry(variants: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """REGISTRY and n: how many mates of each sample show each new variant.

    A variant's id is its content, so registries of other samples or earlier runs (known) are merged by adding rows up;
    a sample that is in both is taken from variants alone, so that a run may be repeated.
    """
    fresh = variants.filter("novel and variant_id is not null").groupBy(*REGISTRY).agg(F.count("*").alias("n"))
    if known is None:
        return fresh
    return known.join(variants.select("sample").distinct(), "sample", "left_anti").select(*REGISTRY, "n").unionByName(fresh)


def cohort_variants(registered: DataFrame) -> DataFrame:
    """variant_id, ref, pos, typ, val, samples, n, most: new variants by how many samples show them, and the most reads of one."""
    return registered.groupBy(*REGISTRY[:-1]).agg(F.count_distinct("sample").alias("samples"), F.sum("n").alias("n"), F.max("n").alias("most"))


def discovered(mates: DataFrame, evidence: DataFrame, variants: DataFrame, catalogue: DataFrame, called: DataFrame, backbone: DataFrame, sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, new sequences): all steps from the reads of called alleles to alleles with new singles put in.

    mates: decoded reads; evidence: long form; variants: the reads' variants with ids (sample, ref, variant_id, typ, pos,
    val); called: sample, gene, allele; backbone: gene, seq without gaps; sequences: allele, seq.  Of any number of samples:
    a new variant has one id in all of them, and counts are kept by sample.
    """
    from locuspark.storage import written

    assigned = written(assigned_reads(mismatch_counts(evidence, catalogue, called)), "novel-assigned")
    counts = written(confusion(evidence, assigned, catalogue), "novel-counts")
    known = catalogue.select(F.col("id").alias("variant_id"), "typ", "pos", "val")
    fresh = variants.filter("novel").select("variant_id", "typ", "pos", "val").distinct()
    every = known.unionByName(fresh)
    wanted = counts.filter((F.col("novel") >= LEAST_READS) | (F.col("fp") >= LEAST_READS) | (F.col("fn") >= LEAST_READS))
    sites = wanted.join(every, "variant_id").select("gene", "pos").distinct().join(backbone, "gene").select("gene", "pos", F.substring("seq", F.col("pos") + 1, F.lit(1)).alias("reference"))
    found = written(candidates(counts, every, site_bases(mates, assigned, sites), backbone), "novel-candidates")
    return found, applied(found, sequences)


def mismatch_counts(evidence: DataFrame, catalogue: DataFrame, called: DataFrame) -> DataFrame:
    """sample, gene, pair_id, allele, k: disagreements of each read with each called allele of its gene."""
    carriers = catalogue.select(F.col("ref").alias("gene"), F.col("id").alias("variant_id"), F.explode("allele").alias("allele")).withColumn("_has", F.lit(True))
    rows = evidence.select("sample", F.col("ref").alias("gene"), "pair_id", "sign", "variant_id").join(called.select("sample", "gene", "allele").distinct(), ["sample", "gene"])
    rows = rows.join(carriers, ["gene", "variant_id", "allele"], "left").withColumn("_has", F.coalesce("_has", F.lit(False)))
    return rows.groupBy("sample", "gene", "pair_id", "allele").agg(F.count_if(F.col("sign") != F.col("_has")).alias("k"))


def confusion(evidence: DataFrame, assigned: DataFrame, catalogue: DataFrame) -> DataFrame:
    """sample, gene, allele, variant_id, tp, fp, fn, tn, novel: how the allele's own reads see each variant."""
    known = catalogue.select(F.col("ref").alias("gene"), F.col("id").alias("variant_id"), "allele").withColumnRenamed("allele", "_alleles")
    rows = evidence.withColumnRenamed("ref", "gene").join(assigned, ["sample", "gene", "pair_id"]).join(known, ["gene", "variant_id"], "left")
    has, new = F.coalesce(F.array_contains("_alleles", F.col("allele")), F.lit(False)), F.col("_alleles").isNull()
    sign = F.col("sign")
    return rows.groupBy("sample", "gene", "allele", "variant_id").agg(F.count_if(sign & has).alias("tp"), F.count_if(sign & ~has & ~new).alias("fp"), F.count_if(~sign & has).alias("fn"), F.count_if(~sign & ~has).alias("tn"), F.count_if(sign & new).alias("novel"))


def candidates(counts: DataFrame, variants: DataFrame, site: DataFrame, backbone: DataFrame | None = None) -> DataFrame:
    """Variants seen at least LEAST_READS times as new, wrongly present or wrongly absent, that lead at their site.

    variants: variant_id, typ, pos, val; site: base counts of the allele's reads as sample, gene, allele, pos, base, n.
    Insertions and deletions are reported but can't be applied.
    """
    kind = F.when(F.col("novel") >= LEAST_READS, "novel").when(F.col("fp") >= LEAST_READS, "fp").when(F.col("fn") >= LEAST_READS, "fn")
    rows = counts.withColumn("kind", kind).filter("kind is not null").join(variants, "variant_id")
    if backbone is not None:
        ref = backbone.select("gene", F.col("seq").alias("_seq"))
        rows = rows.join(ref, "gene", "left").withColumn("alt", F.when(F.col("kind") == "fn", F.substring("_seq", F.col("pos") + 1, F.lit(1))).otherwise(F.col("val"))).drop("_seq")
    else:
        rows = rows.withColumn("alt", F.col("val"))
    best = site.groupBy("sample", "gene", "allele", "pos").agg(F.max("n").alias("_max"))
    alt = site.select("sample", "gene", "allele", "pos", F.col("base").alias("alt"), F.col("n").alias("alt_depth"))
    rows = rows.join(best, ["sample", "gene", "allele", "pos"]).join(alt, ["sample", "gene", "allele", "pos", "alt"], "left")
    return rows.withColumn("alt_depth", F.coalesce("alt_depth", F.lit(0))).filter(F.col("alt_depth") >= F.col("_max")).withColumn("applies", F.col("typ") == "single").drop("_max")


def applied(found: DataFrame, sequences: DataFrame) -> DataFrame:
    """sample, name, seq: alleles with their candidate singles put in; the name tells positions and bases."""
    singles = found.filter("applies").groupBy("sample", "gene", "allele").agg(F.sort_array(F.collect_set(F.struct("pos", "alt"))).alias("_v"))
    seq = F.aggregate("_v", F.col("seq"), lambda s, v: F.overlay(s, v["alt"], v["pos"] + 1, F.lit(1)))
    name = F.concat_ws("-", "allele", F.array_join(F.transform("_v", lambda v: F.concat(v["pos"].cast("string"), v["alt"])), "-"))
    return singles.join(sequences.select("allele", "seq"), "allele").select("sample", "gene", name.alias("name"), seq.alias("seq"))
