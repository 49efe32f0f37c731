"""Alignment text, depth, pileup and reference-index readers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locuspark import schemas

_FIXED = "qname STRING, flag INT, rname STRING, pos INT, mapq INT, cigar STRING, rnext STRING, pnext INT, tlen INT, seq STRING, qual STRING"


def _tsv(spark: SparkSession, path: str, schema: str, header: bool = False) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep="\t", header=header, quote="", comment=None)


def sam_records(lines: DataFrame, *more: str) -> DataFrame:
    """Records from text lines (column value): the fixed columns, tags NH (1 if absent), NM, MD and Zs, and the line itself.

    The first NH and the last NM of a line count.  more names columns of lines to keep.
    """
    parts = F.split("value", "\t")
    fixed = [parts[i].cast(f.split()[1].lower()).alias(f.split()[0]) for i, f in enumerate(_FIXED.split(", "))]
    number = lambda pattern: F.regexp_extract("value", pattern, 1).try_cast("int")
    text = lambda name: F.regexp_extract("value", rf"\t{name}:Z:([^\t]*)", 1).alias(name.lower())
    rows = lines.filter(~F.col("value").startswith("@") & (F.size(parts) >= 11))
    return rows.select(*more, *fixed, F.coalesce(number(r"NH:i:(\d+)"), F.lit(1)).alias("nh"), number(r".*\tNM:i:(\d+)").alias("nm"), text("MD"), text("Zs"), F.col("value").alias("sam"))


def read_sam(spark: SparkSession, path: str, sample: str | None = None, *, keep: list[str] | None = None) -> DataFrame:
    """Records of SAM text with a line number that rises within each file; keep names columns that path's folders have."""
    kept = keep or []
    records = sam_records(spark.read.text(path).select(*kept, "value", F.monotonically_increasing_id().alias("line")), *kept, "line")
    return records if sample is None else records.withColumn("sample", F.lit(sample))


def read_sam_header(spark: SparkSession, path: str, *, keep: list[str] | None = None) -> DataFrame:
    return spark.read.text(path).filter(F.col("value").startswith("@")).select(*(keep or []), "value")


def read_depth(spark: SparkSession, path: str) -> DataFrame:
    """Headerless gene, 1-based position, depth."""
    return _tsv(spark, path, schemas.DEPTH)


def read_pileup(spark: SparkSession, path: str) -> DataFrame:
    """ref, 0-based pos, depth, bases; positions without depth are left out."""
    return _tsv(spark, path, schemas.PILEUP).filter("depth > 0").select("ref", (F.col("pos") - 1).alias("pos"), "depth", "bases")


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """id, allele (array)."""
    return _tsv(spark, path, schemas.LINK).select("id", F.split("alleles", " ").alias("allele"))


def read_exons(spark: SparkSession, path: str) -> DataFrame:
    """ref, start, end: 0-based half-open exons from 1-based closed text."""
    rows = _tsv(spark, path, schemas.LOCUS).select("gene", F.explode(F.split(F.trim("exons"), r"\s+")).alias("e"))
    return rows.select(F.col("gene").alias("ref"), (F.split_part("e", F.lit("-"), F.lit(1)).cast("int") - 1).alias("start"), F.split_part("e", F.lit("-"), F.lit(2)).cast("int").alias("end"))


def type_rank(typ: Column) -> Column:
    return F.when(typ == "insertion", 0).when(typ == "single", 1).when(typ == "deletion", 2).otherwise(3)


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue without alleles: deletions have del_len, all others val."""
    rows = _tsv(spark, path, schemas.SNP)
    deletion = F.col("typ") == "deletion"
    size = F.expr("try_cast(val as int)")
    return rows.select("ref", "pos", "typ", F.when(~deletion, F.col("val")).alias("val"), F.when(deletion, size).alias("del_len"), "id", F.when(deletion, size).when(F.col("typ") == "insertion", 0).otherwise(1).alias("length"))


def catalogue(variants: DataFrame, links: DataFrame, exons: DataFrame, freq: DataFrame | None = None, *, min_freq: float = 0.1) -> DataFrame:
    """Variants with alleles (none: empty), in_exon, freq and ignore (rare singles aren't indexed)."""
    out = variants.join(links, "id", "left").withColumn("allele", F.coalesce("allele", F.array().cast("array<string>")))
    out = with_exon_flag(out, exons)
    out = out.join(freq, "id", "left") if freq is not None else out.withColumn("freq", F.lit(None).cast("double"))
    return out.withColumn("ignore", F.coalesce((F.col("typ") == "single") & (F.col("freq") < min_freq), F.lit(False)))


def with_exon_flag(variants: DataFrame, exons: DataFrame) -> DataFrame:
    """in_exon: starts inside an exon, or is a deletion that begins before one and reaches it.

    Both conditions say that [pos, pos+length] meets [start, end) for deletions, so exons are gathered by gene first: few for each.
    """
    by_gene = exons.groupBy("ref").agg(F.collect_list(F.struct("start", "end")).alias("_exons"))
    inside = lambda e: ((e["start"] <= F.col("pos")) & (F.col("pos") < e["end"])) | ((F.col("typ") == "deletion") & (F.col("pos") < e["start"]) & (F.col("pos") + F.col("del_len") >= e["start"]))
    return variants.join(by_gene, "ref", "left").withColumn("in_exon", F.coalesce(F.exists("_exons", inside), F.lit(False))).drop("_exons")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """id, seq: records are split at '>' by the text reader itself."""
    rows = spark.read.text(path, lineSep=">").filter(F.length(F.trim("value")) > 0)
    return rows.select(F.regexp_extract("value", r"^(\S+)", 1).alias("id"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "").alias("seq"))


def read_msa_set(spark: SparkSession, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(sequences, blocks) of all genes whose files are prefix.GENE.fa and prefix.GENE.json.

    sequences: gene, allele, seq with gaps; blocks: gene, idx, block, type, start, end, from the lengths in order.  Files
    with further dots in their name belong to other sets.
    """
    of_file = F.regexp_extract(F.replace(F.input_file_name(), F.lit("%2A"), F.lit("*")), r"([^./]+)\.(?:fa|json)$", 1)
    own = F.input_file_name().rlike(rf"{re.escape(prefix.rsplit('/', 1)[-1])}\.[^./]+\.(?:fa|json)$")
    text = spark.read.text(f"{prefix}.*.fa", lineSep=">").filter((F.length(F.trim("value")) > 0) & own)
    sequences = text.select(of_file.alias("gene"), F.regexp_extract("value", r"^(\S+)", 1).alias("allele"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "").alias("seq"))
    meta = spark.read.schema("blocks ARRAY<STRUCT<name: STRING, type: STRING, length: INT>>").json(f"{prefix}.*.json", multiLine=True).filter(own)
    ends = F.transform("blocks", lambda b, i: F.aggregate(F.slice("blocks", 1, i + 1), F.lit(0), lambda t, x: t + x["length"]))
    rows = meta.select(of_file.alias("gene"), F.posexplode(F.arrays_zip("blocks", ends.alias("ends"))).alias("idx", "_b"))
    return sequences, rows.select("gene", "idx", F.col("_b.blocks.name").alias("block"), F.col("_b.blocks.type").alias("type"), (F.col("_b.ends") - F.col("_b.blocks.length")).alias("start"), F.col("_b.ends").alias("end"))


def read_reads_and_variants(spark: SparkSession, path: str, *, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(reads in wide form, variants) from saved JSON of one sample or several; sample is the file's name up to its first dot.

    By default a file is one object, spread over lines at will, and one task's.  lines: every line is an object, so files are
    split; sample is that of the folder (sample=...) where sinks.write_reads_and_variants made one.
    """
    name = F.regexp_extract(F.input_file_name(), r"([^/.]+)[^/]*$", 1)
    if lines:
        found = spark.read.schema(f"sample STRING, {schemas.READS_JSON}").json(path)
        sample = F.coalesce("sample", name).alias("sample")
    else:
        found, sample = spark.read.schema(schemas.READS_JSON).json(path, multiLine=True), name.alias("sample")
    deletion = F.col("typ") == "deletion"
    variants = found.select(sample, F.inline("variants")).withColumn("del_len", F.when(deletion, F.col("val").try_cast("int"))).withColumn("val", F.when(~deletion, F.col("val")))
    return found.select(sample, F.inline("reads")), variants


def read_gene_annotation(spark: SparkSession, path: str, prefix: str = "KIR") -> DataFrame:
    """gene, release, chrom, start, end, strand from GTF text: each gene of the prefix in its latest release, once for each place.

    start is 0-based, end behind the last base; the release is the number behind the source's name, 0 without one.
    """
    p = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.size(p) >= 9))
    gene = F.coalesce(F.nullif(F.regexp_extract(p[8], 'gene_name "([^"]*)"', 1), F.lit("")), F.regexp_extract(p[8], 'gene_id "([^"]*)"', 1))
    rows = rows.filter(p[2] == "gene").select(gene.alias("gene"), F.coalesce(F.regexp_extract(p[1], r"([0-9.]+)$", 1).try_cast("double"), F.lit(0.0)).alias("release"), p[0].alias("chrom"), (p[3].cast("int") - 1).alias("start"), p[4].cast("int").alias("end"), p[6].alias("strand")).filter(F.col("gene").startswith(prefix)).distinct()
    from pyspark.sql import Window as W

    return rows.withColumn("_latest", F.max("release").over(W.partitionBy("gene"))).filter("release = _latest").drop("_latest")


def read_allele_lengths(spark: SparkSession, path: str) -> DataFrame:
    return read_fasta(spark, path).select(F.col("id").alias("allele"), F.length("seq").alias("length"))


def numbered_lines(lines: DataFrame) -> DataFrame:
    """Text lines (column value) with file and number, from 0 in each file, in the file's order.

    A file's lines are numbered within each split by their place there; the splits' counts, a row for each, are
    summed and joined, so no task has more than its split.
    """
    rows = lines.select("value", F.input_file_name().alias("file"), F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    splits = rows.groupBy("file", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    from pyspark.sql import Window as W

    starts = splits.select("file", "_part", "_first", F.coalesce(F.sum("_n").over(W.partitionBy("file").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return rows.join(starts, ["file", "_part"]).select("value", "file", (F.col("_base") + F.col("_at") - F.col("_first")).alias("number"), "_part")


def read_fastq_ids(spark: SparkSession, path: str) -> DataFrame:
    """Names of reads, gzip or not: header lines of four-line records."""
    return numbered_lines(spark.read.text(path)).filter("number % 4 = 0").select(F.regexp_extract("value", r"^@(\S+)", 1).alias("id"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, schemas.BED)


def flag_statistics(records: DataFrame, *by: str) -> DataFrame:
    """total, secondary and properly paired records."""
    has = lambda bit: F.col("flag").bitwiseAND(F.lit(bit)) != 0
    primary = ~has(256) & ~has(2048)
    return records.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(has(256)).alias("secondary"), F.count_if(has(2048)).alias("supplementary"), F.count_if(has(1024)).alias("duplicates"), F.count_if(~has(4)).alias("mapped"), F.count_if(primary & has(2) & ~has(4)).alias("properly_paired"))


def read_vcf(spark: SparkSession, path: str, samples: list[str] | None = None) -> DataFrame:
    """chrom, pos, ref, alt, filter, info (map), sample and gt: a row for each site and sample.

    Without names of samples those of the header are taken; without a header's line of columns there must be one column
    of genotypes at most, which is given under a null sample.
    """
    if samples is None:
        samples = vcf_samples(spark, path) or None
    if samples is None and not spark.read.text(path).filter(~F.col("value").startswith("#") & (F.size(F.split("value", "\t")) > 10)).isEmpty():
        raise ValueError(f"{path} has several samples and names none: give their names")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#"))
    p = F.split("value", "\t")
    gt = lambda i: F.split_part(F.get(p, F.lit(9 + i)), F.lit(":"), F.lit(1))
    each = F.array(*(F.struct(F.lit(n).cast("string").alias("sample"), gt(i).alias("gt")) for i, n in enumerate(samples or [None])))
    return rows.select(p[0].alias("chrom"), p[1].cast("int").alias("pos"), p[3].alias("ref"), p[4].alias("alt"), p[5].alias("qual"), p[6].alias("filter"), F.expr("str_to_map(split(value, '\\t')[7], ';', '=')").alias("info"), F.inline(each))


def vcf_samples(spark: SparkSession, path: str) -> list[str]:
    """The samples that a VCF's header names."""
    head = spark.read.text(path).filter(F.col("value").startswith("#CHROM")).first()
    return head["value"].split("\t")[9:] if head else []


def haplotype_variants(vcf: DataFrame) -> DataFrame:
    """chrom, sample, haplotype (from 0), pos, ref, alt of phased genotypes: what each haplotype carries.

    Alternatives of a site are told apart, and those of several bases are cut into single ones where ref is as long.
    """
    alleles = F.split("alt", ",")
    rows = vcf.filter(F.contains("gt", F.lit("|"))).select("chrom", "sample", "pos", "ref", alleles.alias("_alts"), F.posexplode(F.split("gt", r"\|")).alias("haplotype", "_g"))
    rows = rows.withColumn("_i", F.col("_g").try_cast("int")).filter("_i > 0").select("chrom", "sample", "haplotype", "pos", "ref", F.get("_alts", F.col("_i") - 1).alias("alt"))
    same = (F.length("ref") == F.length("alt")) & (F.length("ref") > 1)
    single = F.transform(F.sequence(F.lit(0), F.length("ref") - 1), lambda i: F.struct((F.col("pos") + i).alias("pos"), F.substring("ref", i + 1, F.lit(1)).alias("ref"), F.substring("alt", i + 1, F.lit(1)).alias("alt")))
    whole = F.array(F.struct("pos", "ref", "alt"))
    return rows.select("chrom", "sample", "haplotype", F.inline(F.when(same, F.filter(single, lambda v: v["ref"] != v["alt"])).otherwise(whole)))


def dosage(gt: Column) -> Column:
    """The sum of a genotype's allele numbers; null where any is unknown."""
    numbers = F.transform(F.split(gt, "[/|]"), lambda x: F.try_to_number(x, F.lit("99")))
    return F.when(~F.contains(gt, F.lit(".")), F.aggregate(numbers, F.lit(0).cast("decimal(10,0)"), lambda a, x: (a + x).cast("decimal(10,0)")).cast("int"))


def info_coverage(vcf: DataFrame, by: list[str]) -> DataFrame:
    """Mean depth weighted by the length of blocks with END and IDP."""
    rows = vcf.withColumn("_d", F.expr("try_cast(info['IDP'] as double)")).withColumn("_l", F.expr("try_cast(info['END'] as int)") - F.col("pos") + 1).filter("_d is not null and _l > 0")
    return rows.groupBy(*by).agg((F.sum(F.col("_d") * F.col("_l")) / F.sum("_l")).alias("depth"))
