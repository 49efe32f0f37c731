"""Command line: python -m locuspark {copynumber,type,novel,merge} ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from locuspark.operators import copynumber, novel, reads, typing
from locuspark.plans import pipeline
from locuspark.sources import alignments, bam, results, sinks
from locuspark.storage import written


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="locuspark")
    commands = top.add_subparsers(dest="command", required=True)
    cn = commands.add_parser("copynumber", help="copy numbers from depth tables, one for each sample")
    cn.add_argument("--depth", nargs="+", required=True, help="name=path of headerless gene, position, depth tables")
    cn.add_argument("--mode", default="p75", choices=["p75", "mean", "median"])
    cn.add_argument("--model", default="lcnd", choices=["lcnd", "kde"])
    cn.add_argument("--cohort", action="store_true")
    cn.add_argument("--assume-3dl3-diploid", action="store_true")
    cn.add_argument("--diploid-depth", help="JSON with mean and std of a diploid region's depth")
    cn.add_argument("--output", required=True)
    ty = commands.add_parser("type", help="alleles from alignment text")
    ty.add_argument("--sam", nargs="+", required=True, help="name=path of alignment text, or of a .bam file")
    ty.add_argument("--index", required=True, help="prefix of .snp, .link and .locus")
    ty.add_argument("--copynumber", required=True, help="table of sample, gene and cn")
    ty.add_argument("--strategy", default="full", choices=["full", "exonfirst", "em", "report"])
    ty.add_argument("--allele-fasta", help="sequences whose lengths normalise the EM")
    ty.add_argument("--top-n", type=int, default=typing.TOP_N)
    ty.add_argument("--output", required=True)
    no = commands.add_parser("novel", help="new variants of called alleles, over a cohort")
    no.add_argument("--sam", nargs="+", required=True, help="name=path of alignment text, or of a .bam file")
    no.add_argument("--index", required=True, help="prefix of .snp, .link and .locus")
    no.add_argument("--calls", required=True, help="table of name and alleles, as type writes it")
    no.add_argument("--backbone", required=True, help="sequences of the index's references")
    no.add_argument("--allele-fasta", required=True, help="sequences of the alleles on the same coordinates")
    no.add_argument("--registry", help="folder of an earlier run's registry, which is extended")
    no.add_argument("--output", required=True)
    me = commands.add_parser("merge", help="cohort tables from single ones")
    me.add_argument("--copynumber", nargs="+", required=True)
    me.add_argument("--output", required=True)
    return top


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _records(spark: SparkSession, path: str, sample: str):
    """Alignment text, or BAM by its name."""
    return bam.read_bam(spark, path, sample).drop("file") if path.endswith(".bam") else alignments.read_sam(spark, path, sample)


def _novel(spark: SparkSession, records, args: argparse.Namespace) -> None:
    known = alignments.catalogue(alignments.read_variants(spark, f"{args.index}.snp"), alignments.read_links(spark, f"{args.index}.link"), alignments.read_exons(spark, f"{args.index}.locus"))
    mates = written(reads.decoded(reads.mates(reads.read_pairs(records))), "mates")
    variants = written(reads.with_ids(reads.long_variants(mates), known), "read-variants")
    found = written(reads.evidence(mates, variants, known), "evidence")
    # An allele belongs to the reference whose variants name it.
    genes = known.select(F.col("ref").alias("gene"), F.explode("allele").alias("allele")).distinct()
    called = results.read_calls(spark, args.calls).select("sample", "allele").join(genes, "allele")
    backbone = alignments.read_fasta(spark, args.backbone).select(F.col("id").alias("gene"), "seq")
    sequences = alignments.read_fasta(spark, args.allele_fasta).select(F.col("id").alias("allele"), "seq")
    new, applied = novel.discovered(mates, found, variants, known, called, backbone, sequences)
    earlier = spark.read.parquet(args.registry) if args.registry else None
    written(novel.registry(variants, earlier), "registry").write.mode("overwrite").parquet(f"{args.output}.registry")
    sinks.write_table(new.drop("_v"), f"{args.output}.variant")
    sinks.write_fasta(applied.select(F.col("name").alias("allele"), "seq"), f"{args.output}.fa")


def main() -> None:
    args = arguments().parse_args()
    spark = SparkSession.builder.appName("locuspark").getOrCreate()
    named = lambda xs: [x.split("=", 1) for x in xs]
    if args.command == "copynumber":
        settings = pipeline.Settings(depth=args.mode, model=args.model, cohort=args.cohort, assume_reference_gene=args.assume_3dl3_diploid)
        if args.diploid_depth:
            region = spark.read.schema("mean DOUBLE, std DOUBLE").json(args.diploid_depth, multiLine=True).withColumnRenamed("std", "sd")
            settings.lcnd = copynumber.diploid_setting(region, settings.lcnd)
        depths = _union([alignments.read_depth(spark, path).withColumn("sample", F.lit(name)) for name, path in named(args.depth)])
        sinks.write_table(pipeline.copy_numbers(pipeline.gene_depths(depths, settings), settings).select("sample", "gene", "cn", "depth"), args.output)
    elif args.command == "type":
        records = _union([_records(spark, path, name) for name, path in named(args.sam)])
        catalogue = alignments.catalogue(alignments.read_variants(spark, f"{args.index}.snp"), alignments.read_links(spark, f"{args.index}.link"), alignments.read_exons(spark, f"{args.index}.locus"))
        copies = spark.read.schema("sample STRING, gene STRING, cn INT, depth DOUBLE").csv(args.copynumber, sep="\t", header=True)
        settings = pipeline.Settings(strategy=args.strategy, typing=typing.Setting(top_n=args.top_n))
        lengths = alignments.read_allele_lengths(spark, args.allele_fasta) if args.allele_fasta else None
        found = pipeline.typed(records, catalogue, copies, settings, lengths=lengths)
        sinks.write_table(typing.calls(found), f"{args.output}.allele")
        sinks.write_table(typing.possible_sets(found), f"{args.output}.possible")
    elif args.command == "novel":
        records = _union([_records(spark, path, name) for name, path in named(args.sam)])
        _novel(spark, records, args)
    else:
        tables = results.union_calls([results.read_copy_numbers(spark, path).withColumn("name", F.lit(name)) for name, path in named(args.copynumber)])
        sinks.write_table(sinks.copy_matrix(tables, [n for n, _ in named(args.copynumber)]), args.output)


if __name__ == "__main__":
    main()
