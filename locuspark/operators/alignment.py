"""Aligned allele sequences: variants against a backbone, consensus, filling, left alignment, merging of blocks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuspark.functions.decoding import left_aligned
from locuspark.operators.sets import consensus, first_by_key


def is_backbone(allele: Column) -> Column:
    return allele.endswith("BACKBONE")


def without_backbone(msa: DataFrame) -> DataFrame:
    return msa.filter(~is_backbone(F.col("allele")))


def with_consensus_backbone(msa: DataFrame) -> DataFrame:
    """msa with a backbone of each column's most frequent base (gaps and unknown don't count)."""
    back = consensus(without_backbone(msa), ["gene"], F.col("seq"), ignore="-E").select("gene", F.concat("gene", F.lit("*BACKBONE")).alias("allele"), F.col("consensus").alias("seq"))
    return without_backbone(msa).select("gene", "allele", "seq").union(back)


def variants_of(msa: DataFrame) -> DataFrame:
    """gene, allele, typ, pos, val, del_len: differences of each allele from its gene's gapless-position backbone.

    Positions are those of the backbone without its gaps; adjacent inserted or deleted columns are one variant.
    """
    chars = lambda df, name: df.select("gene", "allele", F.posexplode(F.split("seq", "")).alias("col", name))
    back = chars(msa.filter(is_backbone(F.col("allele"))), "b").drop("allele")
    back = back.withColumn("pos", F.sum((F.col("b") != "-").cast("int")).over(W.partitionBy("gene").orderBy("col")) - (F.col("b") != "-").cast("int"))
    rows = chars(without_backbone(msa), "a").join(back, ["gene", "col"])
    kind = F.when((F.col("a") == "-") & (F.col("b") == "-"), None).when(F.col("a") == "E", "unknown").when(F.col("b") == "-", "insertion").when(F.col("a") == "-", "deletion").when(F.col("a") != F.col("b"), "single").otherwise("match")
    rows = rows.withColumn("typ", kind).filter("typ is not null")
    w = W.partitionBy("gene", "allele").orderBy("col")
    opens = F.coalesce(((F.col("typ") != F.lag("typ").over(w)) | (F.col("typ") == "single")).cast("int"), F.lit(1))
    rows = rows.withColumn("_o", opens).withColumn("_g", F.sum("_o").over(w)).filter("typ in ('insertion', 'deletion', 'single')")
    runs = rows.groupBy("gene", "allele", "_g", "typ").agg(F.min("pos").cast("int").alias("pos"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", "a"))), lambda x: x["a"]), "").alias("val"), F.count("*").cast("int").alias("n"))
    deletion = F.col("typ") == "deletion"
    return runs.select("gene", "allele", "typ", "pos", F.when(~deletion, F.col("val")).alias("val"), F.when(deletion, F.col("n")).alias("del_len"))


def variant_catalogue(differences: DataFrame) -> DataFrame:
    """Distinct variants with sorted alleles and ids hv0, hv1, ... in order of (ref, pos, type, value)."""
    from locuspark.operators.sets import numbered_rows

    rank = F.when(F.col("typ") == "insertion", 0).when(F.col("typ") == "single", 1).otherwise(2)
    rows = differences.groupBy(F.col("gene").alias("ref"), "pos", rank.alias("rank"), "typ", F.coalesce("val", F.lit("")).alias("_v"), F.coalesce("del_len", F.lit(0)).alias("_d")).agg(F.array_sort(F.collect_set("allele")).alias("allele"))
    rows = numbered_rows(rows, ["ref", "pos", "rank", "_v", "_d"], "_n")
    deletion = F.col("typ") == "deletion"
    return rows.select("ref", "pos", "typ", F.when(~deletion, F.col("_v")).alias("val"), F.when(deletion, F.col("_d")).alias("del_len"), F.concat(F.lit("hv"), F.col("_n")).alias("id"), F.when(deletion, F.col("_d")).when(F.col("typ") == "insertion", 0).otherwise(1).alias("length"), "allele")


def variant_frequencies(catalogue: DataFrame, msa: DataFrame) -> DataFrame:
    """id, freq: share of the gene's alleles that carry a variant."""
    n = without_backbone(msa).groupBy(F.col("gene").alias("ref")).agg(F.countDistinct("allele").alias("_n"))
    return catalogue.join(n, "ref").select("id", (F.size("allele") / F.col("_n")).alias("freq"))


def left_align(msa: DataFrame) -> DataFrame:
    """msa with each sequence's gaps moved left against a consensus backbone."""
    @F.pandas_udf("string")
    def align(ref: pd.Series, seq: pd.Series) -> pd.Series:
        return pd.Series([left_aligned(r, s) for r, s in zip(ref, seq, strict=True)])

    full = with_consensus_backbone(msa)
    back = full.filter(is_backbone(F.col("allele"))).select("gene", F.col("seq").alias("ref"))
    moved = without_backbone(full).join(back, "gene").select("gene", "allele", align("ref", "seq").alias("seq"))
    return with_consensus_backbone(moved)


def incomplete_exons(msa: DataFrame, blocks: DataFrame) -> DataFrame:
    """gene, allele of alleles with an unknown base inside an exon."""
    exons = blocks.filter("type = 'exon'").groupBy("gene").agg(F.collect_list(F.struct("start", "end")).alias("_e"))
    part = lambda e: F.contains(F.substring("seq", e["start"] + 1, e["end"] - e["start"]), F.lit("E"))
    return without_backbone(msa).join(exons, "gene").filter(F.exists("_e", part)).select("gene", "allele")


def filled_introns(msa: DataFrame) -> DataFrame:
    """msa without unknown bases: an exon-only allele takes the consensus of the full alleles that share its longest prefix.

    Prefixes of 7, 5 and 3 digits are tried, then the whole gene; the filled allele gets an e behind its name.
    """
    from locuspark.functions.alleles import allele_field

    rows = without_backbone(msa).withColumn("_full", ~F.contains("seq", F.lit("E")))
    full = rows.filter("_full")
    prefix = lambda n: allele_field(F.col("allele"), 7) if n == 7 else F.substring(allele_field(F.col("allele"), 7), 1, n)
    levels = [(7, 0), (5, 1), (3, 2), (0, 3)]
    keyed = lambda df: df.select("*", F.explode(F.array(*(F.struct(F.lit(i).alias("level"), prefix(n).alias("key")) for n, i in levels))).alias("_k")).select("*", "_k.level", "_k.key").drop("_k")
    majority = consensus(keyed(full), ["gene", "level", "key"], F.col("seq"))
    part = keyed(rows.filter(~F.col("_full")))
    best = first_by_key(part.join(majority, ["gene", "level", "key"]), ["gene", "allele"], [F.col("level")])
    chars = F.zip_with(F.split("seq", ""), F.split("consensus", ""), lambda a, b: F.when(a == "E", b).otherwise(a))
    return full.select("gene", "allele", "seq").union(best.select("gene", F.concat("allele", F.lit("e")).alias("allele"), F.array_join(chars, "").alias("seq")))


def merged_blocks(parts: DataFrame) -> DataFrame:
    """gene, allele, seq from (gene, idx, allele, seq): blocks side by side, gaps where an allele has no such block."""
    sizes = parts.groupBy("gene", "idx").agg(F.max(F.length("seq")).alias("_l"))
    spine = parts.select("gene", "allele").distinct().join(sizes, "gene").join(parts, ["gene", "idx", "allele"], "left")
    seq = F.coalesce("seq", F.repeat(F.lit("-"), F.col("_l")))
    return spine.groupBy("gene", "allele").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", seq.alias("s")))), lambda x: x["s"]), "").alias("seq"))


def same_sequences(a: DataFrame, b: DataFrame) -> bool:
    """Whether both have the same alleles with the same bases, gaps apart."""
    bare = lambda df: df.select("allele", F.regexp_replace("seq", "-", "").alias("seq"))
    return bare(a).exceptAll(bare(b)).isEmpty() and bare(b).exceptAll(bare(a)).isEmpty()


def regrouped(msa: DataFrame, mode: str) -> DataFrame:
    """Genes put together by mode: split, ab (2DL5A and B), ab_2dl1s1 (that and 2DL1 with 2DS1) or merge (all)."""
    pairs = {"KIR2DL5A": "KIR2DL5", "KIR2DL5B": "KIR2DL5"}
    known = {"split": {}, "ab": pairs, "ab_2dl1s1": pairs | {"KIR2DL1": "KIR2DL1S1", "KIR2DS1": "KIR2DL1S1"}}
    if mode == "merge":
        return msa.withColumn("gene", F.lit("KIR"))
    if mode not in known:
        raise NotImplementedError(mode)
    out = F.col("gene")
    for old, new in known[mode].items():
        out = F.when(F.col("gene") == old, new).otherwise(out)
    return msa.withColumn("gene", out)


def short_sequences(msa: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Alleles much shorter than their gene's longest."""
    n = F.length(F.regexp_replace("seq", "[-E]", ""))
    return msa.withColumn("_n", n).withColumn("_m", F.max("_n").over(W.partitionBy("gene"))).filter(F.col("_n") < threshold * F.col("_m")).select("gene", "allele")


def left_align_blocks(msa: DataFrame, blocks: DataFrame) -> DataFrame:
    """msa with gaps moved left within each block: blocks are cut out, aligned by themselves and put together again.

    blocks: gene, idx, start, end of 0-based half-open columns that cover the alignment.
    """
    parts = without_backbone(msa).join(blocks, "gene").select(F.concat_ws("/", "gene", F.col("idx").cast("string")).alias("gene"), "allele", F.substring("seq", F.col("start") + 1, F.col("end") - F.col("start")).alias("seq"))
    moved = without_backbone(left_align(parts)).select(F.regexp_extract("gene", "^(.*)/", 1).alias("gene"), F.regexp_extract("gene", "/([0-9]+)$", 1).cast("int").alias("idx"), "allele", "seq")
    return with_consensus_backbone(merged_blocks(moved))


def without_alleles(msa: DataFrame, out: DataFrame) -> DataFrame:
    return msa.join(out.select("gene", "allele"), ["gene", "allele"], "left_anti")
