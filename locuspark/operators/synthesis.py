"""Made-up samples for evaluation: haplotypes and alleles drawn by seeded hashes, so a seed always gives the same cohort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def drawn(seed: int, *keys: Column | str, out_of: Column) -> Column:
    """A whole number from 0 to out_of - 1 that follows from seed and keys alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), out_of)


def two_haplotypes(samples: DataFrame, haplotypes: DataFrame, seed: int) -> DataFrame:
    """sample, copy (0, 1), hapID: two haplotypes for each sample, drawn with replacement.

    haplotypes: hapID, gene, n; a few dozen names, numbered in sorted order.
    """
    names = haplotypes.select("hapID").distinct()
    numbered = names.withColumn("_i", F.row_number().over(W.orderBy("hapID")) - 1).withColumn("_n", F.count("*").over(W.partitionBy()))
    copies = samples.select("sample", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    size = names.agg(F.count("*").alias("_size"))  # one row
    return copies.crossJoin(F.broadcast(size)).withColumn("_i", drawn(seed, "sample", "copy", out_of=F.col("_size"))).join(F.broadcast(numbered.select("_i", "hapID")), "_i").select("sample", "copy", "hapID")


def gene_copies(chosen: DataFrame, haplotypes: DataFrame) -> DataFrame:
    """sample, gene, cn: the genes of both haplotypes."""
    return chosen.join(haplotypes, "hapID").groupBy("sample", "gene").agg(F.sum("n").cast("int").alias("cn")).filter("cn > 0")


def sample_alleles(copies: DataFrame, alleles: DataFrame, seed: int) -> DataFrame:
    """sample, gene, allele, name: an allele for each copy, drawn with replacement; name counts an allele's own copies from 1."""
    w = W.partitionBy("gene").orderBy("allele")
    numbered = alleles.select("gene", "allele").distinct().withColumn("_i", F.row_number().over(w) - 1)
    sizes = numbered.groupBy("gene").agg(F.count("*").alias("_size"))
    rows = copies.join(sizes, "gene").select("sample", "gene", "_size", F.explode(F.sequence(F.lit(1), F.col("cn"))).alias("copy"))
    rows = rows.withColumn("_i", drawn(seed + 1, "sample", "gene", "copy", out_of=F.col("_size")).cast("int")).join(numbered, ["gene", "_i"])
    nth = F.row_number().over(W.partitionBy("sample", "allele").orderBy("copy"))
    return rows.select("sample", "gene", "allele", F.concat_ws("-", "allele", nth.cast("string")).alias("name"))


def answers(chosen: DataFrame, named: DataFrame) -> DataFrame:
    """id, haplos, alleles as a truth table has them: names joined by _, sorted."""
    haplos = chosen.groupBy("sample").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("copy", "hapID"))), lambda x: x["hapID"]), "_").alias("haplos"))
    names = named.groupBy("sample").agg(F.array_join(F.array_sort(F.collect_list("allele")), "_").alias("alleles"))
    return haplos.join(names, "sample", "left").select(F.col("sample").alias("id"), "haplos", F.coalesce("alleles", F.lit("")).alias("alleles"))


def with_new_singles(sequences: DataFrame, positions: DataFrame, seed: int, count: int) -> DataFrame:
    """allele, seq, changed: sequences with so many bases, drawn from the given positions, turned into another one.

    positions: allele, pos (0-based, no gaps).  changed lists position, old and new base in order.
    """
    order = F.xxhash64(F.lit(seed), "allele", "pos")
    picked = positions.withColumn("_r", F.row_number().over(W.partitionBy("allele").orderBy(order, "pos"))).filter(F.col("_r") <= count)
    base = F.substring("seq", F.col("pos") + 1, F.lit(1))
    others = F.array_remove(F.array(*map(F.lit, "ACGT")), F.col("_old"))
    new = F.get(others, drawn(seed + 1, "allele", "pos", out_of=F.size(others)).cast("int"))
    rows = picked.join(sequences.select("allele", "seq"), "allele").withColumn("_old", base).withColumn("_new", new)
    changes = rows.groupBy("allele").agg(F.sort_array(F.collect_list(F.struct("pos", F.col("_old").alias("old"), F.col("_new").alias("new")))).alias("changed"))
    seq = F.aggregate("changed", F.col("seq"), lambda s, c: F.overlay(s, c["new"], c["pos"] + 1, F.lit(1)))
    return sequences.select("allele", "seq").join(changes, "allele", "left").select("allele", F.coalesce(seq, F.col("seq")).alias("seq"), F.coalesce("changed", F.array().cast("array<struct<pos:int,old:string,new:string>>")).alias("changed"))
