"""Typing by genotype dosages: which combinations of known alleles carry the variants that a sample shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuspark.operators.sets import combinations_with_replacement

WILD = ("<NON_REF>", ".")


def oriented(calls: DataFrame, panel: DataFrame) -> DataFrame:
    """calls met with the panel's variants: the panel's ref and alt, and flag SAME or OPP (ref and alt are swapped).

    calls: sample, gene, pos, ref, alt, dosage; panel: gene, pos, ref, alt.  A call whose alt is a wild card fits a panel
    variant by its ref alone, on either side.  Sides meet on (gene, pos), of which a panel has a handful each.
    """
    p = panel.select("gene", "pos", F.col("ref").alias("p_ref"), F.col("alt").alias("p_alt")).distinct()
    both = calls.join(p, ["gene", "pos"])
    wild = F.col("alt").isin(*WILD)
    same = (F.col("ref") == F.col("p_ref")) & ((F.col("alt") == F.col("p_alt")) | wild)
    opposite = (F.col("ref") == F.col("p_alt")) & ((F.col("alt") == F.col("p_ref")) | wild)
    exact = (F.col("ref") == F.col("p_ref")) & (F.col("alt") == F.col("p_alt"))
    met = both.withColumn("flag", F.when(same, "SAME").when(opposite, "OPP")).filter("flag is not null")
    # A call that fits a panel variant exactly isn't tried against others.
    best = met.withColumn("_exact", exact)
    from pyspark.sql import Window as W

    held = best.withColumn("_any", F.max("_exact").over(W.partitionBy("sample", "gene", "pos", "ref", "alt")))
    return held.filter("_exact or not _any").select("sample", "gene", "pos", "p_ref", "p_alt", "flag", "dosage")


def allele_vectors(panel: DataFrame, variants: DataFrame) -> DataFrame:
    """gene, allele, dose: an allele's 0 or 1 at each of the variants in order of their position, turned where flag is OPP.

    panel: gene, allele, pos, ref, alt, dose; variants: gene, pos, p_ref, p_alt, flag.
    """
    v = variants.select("gene", "pos", F.col("p_ref").alias("ref"), F.col("p_alt").alias("alt"), "flag").distinct()
    rows = panel.join(v, ["gene", "pos", "ref", "alt"]).withColumn("_d", F.when(F.col("flag") == "OPP", 1 - F.col("dose")).otherwise(F.col("dose")))
    return rows.groupBy("gene", "allele").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "ref", "alt", F.col("_d").cast("int").alias("d")))), lambda x: x["d"]).alias("dose"))


def same_vectors(vectors: DataFrame, by: list[str], name: str, vector: str, separator: str = "-") -> DataFrame:
    """by, vector, name: names with equal vectors are one, joined in sorted order."""
    return vectors.groupBy(*by, vector).agg(F.array_join(F.array_sort(F.collect_list(name)), separator).alias(name))


def summed_vectors(vectors: DataFrame, by: list[str], name: str, vector: str, copies: int) -> DataFrame:
    """by, name, vector of every multiset of so many members: names joined by /, vectors added up.

    Members are the distinct vectors of a gene; as many multisets are made as there are.
    """
    named = vectors.select(*by, F.struct(F.col(name).alias("n"), F.col(vector).alias("v")).alias("_m"))
    sets = combinations_with_replacement(named, by, "_m", copies)
    zero = F.transform(F.get("items", F.lit(0))["v"], lambda _: F.lit(0))
    total = F.aggregate("items", zero, lambda t, m: F.zip_with(t, m["v"], lambda x, y: x + y))
    return sets.select(*by, F.array_join(F.transform("items", lambda m: m["n"]), "/").alias(name), total.alias(vector))


def nearest_sets(samples: DataFrame, sets: DataFrame, by: list[str], name: str, vector: str, sample: str = "sample") -> DataFrame:
    """sample, by, name, distance, known: sets with the least summed difference; at 0 the sample's sets are known.

    Names of sets that tie are joined by -or- where known, by -OR- where not.
    """
    from locuspark.operators.sets import nearest_with_ties

    s = samples.select(sample, *by, F.col(vector).alias("_seen"))
    apart = F.aggregate(F.zip_with("_seen", vector, lambda a, b: F.abs(a - b)), F.lit(0).cast("double"), lambda t, x: t + x)
    met = s.join(sets, by).select(sample, *by, name, apart.alias("distance"))
    best = nearest_with_ties(met, [sample, *by], "distance").groupBy(sample, *by, "distance").agg(F.array_sort(F.collect_list(name)).alias("_names"))
    known = F.col("distance") == 0
    return best.select(sample, *by, F.when(known, F.array_join("_names", "-or-")).otherwise(F.array_join("_names", "-OR-")).alias(name), "distance", known.alias("known"))
