"""Queries that write the driver's tables in the formats of the domain and read them back by this library's readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuspark.operators import copynumber, evaluate, phased, reads, typing
from locuspark.plans.engine import GENE, VARIANTS, alignment_text, catalogue
from locuspark.plans.registry import query, rounded
from locuspark.sources import alignments, bam, results, sinks
from locuspark.storage import new_folder


def _text(lines: DataFrame, name: str) -> str:
    """The path of a folder with the column value as text."""
    path = new_folder(lines.sparkSession, name)
    lines.select("value").write.text(path)
    return path


def _tabbed(df: DataFrame, name: str, *, sep: str = "\t", header: bool = False) -> str:
    path = new_folder(df.sparkSession, name)
    df.write.option("header", header).option("sep", sep).option("quote", "").csv(path)
    return path


@query("SELECT l_suppkey || '*BACKBONE' AS gene, count(*) AS n, CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS total, min(l_linenumber)::INTEGER AS first FROM lineitem GROUP BY l_suppkey")
def depth_file(t):
    rows = t("lineitem").select(F.concat(F.col("l_suppkey").cast("string"), F.lit("*BACKBONE")), "l_linenumber", F.col("l_quantity").cast("int"))
    found = alignments.read_depth(rows.sparkSession, _tabbed(rows, "depth"))
    return found.groupBy("gene").agg(F.count("*").alias("n"), F.sum("depth").alias("total"), F.min("pos").alias("first"))


@query("""WITH b AS (SELECT l_suppkey, l_linenumber, upper(['a', 'C', 'g', 'T', 'G'][l_orderkey % 5 + 1]) AS base FROM lineitem), s AS (SELECT l_suppkey, l_linenumber, base, count(*) AS n FROM b GROUP BY ALL)
SELECT 'r' || l_suppkey AS ref, CAST(l_linenumber - 1 AS INTEGER) AS pos, base, round(n / sum(n) OVER (PARTITION BY l_suppkey, l_linenumber), 9) AS share, CAST(sum(n) OVER (PARTITION BY l_suppkey, l_linenumber) AS BIGINT) AS depth FROM s""")
def pileup_file(t):
    base = F.get(F.array(*map(F.lit, "aCgTG")), (F.col("l_orderkey") % 5).cast("int"))
    # Starts with their quality, ends and inserted texts stand between the bases, as the format has them.
    shown = F.concat(F.when(F.col("l_orderkey") % 7 == 0, "^]").otherwise(""), base, F.when(F.col("l_orderkey") % 11 == 0, "+2AC").when(F.col("l_orderkey") % 13 == 0, "$").otherwise(""))
    rows = t("lineitem").groupBy(F.concat(F.lit("r"), "l_suppkey").alias("ref"), "l_linenumber").agg(F.array_join(F.sort_array(F.collect_list(F.struct("l_orderkey", shown.alias("s"))))["s"], "").alias("bases"), F.count("*").alias("depth"))
    path = _tabbed(rows.select("ref", "l_linenumber", F.lit("N"), "depth", "bases", F.repeat(F.lit("I"), F.col("depth").cast("int"))), "pileup")
    found = reads.pileup_ratios(alignments.read_pileup(rows.sparkSession, path))
    return rounded(found.select("ref", "pos", F.explode("ratios").alias("base", "share"), "depth"), "share", digits=9)


@query("""WITH p AS (SELECT p_partkey, 'g' || p_size % 5 AS ref, CASE p_partkey % 3 WHEN 0 THEN 'single' WHEN 1 THEN 'deletion' ELSE 'insertion' END AS typ, p_partkey % 97 AS pos, p_partkey % 4 + 1 AS size FROM part), x(start, stop) AS (VALUES (10, 20), (50, 60)),
m AS (SELECT *, EXISTS (SELECT 1 FROM x WHERE (pos >= start AND pos < stop) OR (typ = 'deletion' AND pos < start AND pos + size >= start)) AS in_exon FROM p)
SELECT ref, typ, in_exon, count(*) AS n, CAST(sum(CASE WHEN typ = 'deletion' THEN size END) AS BIGINT) AS deleted, count(*) FILTER (p_partkey % 2 = 0) AS linked, count(*) FILTER (typ = 'single' AND p_partkey % 10 = 0) AS ignored FROM m GROUP BY ALL""")
def index_files(t):
    part = t("part")
    k = F.col("p_partkey")
    typ = F.when(k % 3 == 0, "single").when(k % 3 == 1, "deletion").otherwise("insertion")
    ref = F.concat(F.lit("g"), F.col("p_size") % 5)
    spark, size = part.sparkSession, (k % 4 + 1).cast("string")
    ids = F.concat(F.lit("hv"), k.cast("string"))
    snp = _tabbed(part.select(ids, typ, ref, k % 97, F.when(typ == "deletion", size).when(typ == "single", "A").otherwise("GG")), "snp")
    link = _tabbed(part.filter("p_partkey % 2 = 0").select(ids, F.lit("a1 a2")), "link")
    locus = _tabbed(part.select(ref.alias("g")).distinct().select("g", F.col("g").alias("h"), F.lit(0), F.lit(100), F.lit(100), F.lit("11-20 51-60"), F.lit("+")), "locus")
    freq = part.select(ids.alias("id"), F.when(k % 10 == 0, 0.05).otherwise(0.5).alias("freq"))
    found = alignments.catalogue(alignments.read_variants(spark, snp), alignments.read_links(spark, link), alignments.read_exons(spark, locus), freq)
    # Written by the index writer and read once more.
    prefix = new_folder(spark, "index")
    sinks.write_index(found, prefix)
    again = alignments.catalogue(alignments.read_variants(spark, f"{prefix}.snp"), alignments.read_links(spark, f"{prefix}.link"), alignments.read_exons(spark, locus), freq)
    return again.groupBy("ref", "typ", "in_exon").agg(F.count("*").alias("n"), F.sum("del_len").alias("deleted"), F.count_if(F.size("allele") == 2).alias("linked"), F.count_if("ignore").alias("ignored"))


@query("SELECT event_type AS sample, 2 * count(*) AS total, 2 * count(*) AS mapped, 2 * count(*) AS paired, 1 AS headers, 2 * count(*) AS again FROM events GROUP BY event_type")
def sam_files(t):
    text = alignment_text(t("events"))
    spark, path, copy = text.sparkSession, new_folder(text.sparkSession, "sam"), new_folder(text.sparkSession, "sam")
    heads = text.select("sample").distinct().select("sample", F.lit("@HD\tVN:1").alias("value"))
    text.select("sample", "value").union(heads).write.partitionBy("sample").text(path)
    records = alignments.read_sam(spark, path, keep=["sample"])
    lines = records.select(F.col("sam").alias("l_sam"), F.lit(None).cast("string").alias("r_sam"), F.lit(1).alias("multiple"), "sample")
    sinks.write_sam(lines, copy, unique=True, keys=["sample"])
    again = alignments.read_sam(spark, copy, keep=["sample"]).groupBy("sample").agg(F.count("*").alias("again"))
    head = alignments.read_sam_header(spark, path, keep=["sample"]).groupBy("sample").agg(F.count("*").cast("int").alias("headers"))
    found = alignments.flag_statistics(records, "sample").select("sample", "total", "mapped", F.col("properly_paired").alias("paired"))
    return found.join(head, "sample").join(again, "sample")


# Three contigs, positions by part, pairs of which some aren't proper, some are duplicates and some have no place.
_BAM = """r AS (SELECT l_orderkey, l_linenumber, l_orderkey * 8 + l_linenumber AS k, CASE WHEN l_orderkey % 17 = 0 THEN '*' ELSE 'chr' || l_suppkey % 3 END AS rname, CASE WHEN l_orderkey % 17 = 0 THEN 0 ELSE l_partkey * 50 + l_linenumber END AS pos,
CASE WHEN l_orderkey % 17 = 0 THEN 4 WHEN l_orderkey % 5 = 0 THEN 65 WHEN l_orderkey % 7 = 0 THEN 1123 ELSE 99 END AS flag, CASE l_linenumber % 3 WHEN 0 THEN '30M' WHEN 1 THEN '10M5D20M' ELSE '4S20M2I4M' END AS cigar, CASE l_linenumber % 3 WHEN 0 THEN 30 WHEN 1 THEN 35 ELSE 24 END AS span FROM lineitem)"""
CONTIGS = [(f"chr{i}", 1 << 25) for i in range(3)]
SHARD_ROWS = 500_000


def _placed_reads(t) -> DataFrame:
    """Lines of alignment text (column sam) made from line items."""
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    none = o % 17 == 0
    cigar = F.when(n % 3 == 0, "30M").when(n % 3 == 1, "10M5D20M").otherwise("4S20M2I4M")
    fields = [
        F.concat(F.lit("q"), o * 8 + n), F.when(none, 4).when(o % 5 == 0, 65).when(o % 7 == 0, 1123).otherwise(99), F.when(none, "*").otherwise(F.concat(F.lit("chr"), F.col("l_suppkey") % 3)),
        F.when(none, 0).otherwise(F.col("l_partkey") * 50 + n), F.lit(60), F.when(none, "*").otherwise(cigar), F.lit("="), F.lit(7), F.lit(-40), F.substring(F.repeat(F.lit("ACGTN"), F.lit(6)), F.lit(1), F.lit(30)),
        F.repeat(F.lit("#"), F.lit(30)), F.concat(F.lit("NH:i:"), n), F.concat(F.lit("NM:i:"), o % 6), F.concat(F.lit("MD:Z:"), n, F.lit("A5")),
    ]
    return t("lineitem").select(F.concat_ws("\t", *(f.cast("string") for f in fields)).alias("sam"))


def _bam_folder(t) -> tuple:
    rows = _placed_reads(t)
    path = new_folder(rows.sparkSession, "bam")
    bam.write_bam(rows, path, CONTIGS, shards=4 + _lines(t) // SHARD_ROWS)
    return rows.sparkSession, path


def _lines(t) -> int:
    return t("lineitem").count()


@query(f"""WITH {_BAM} SELECT rname, flag, CASE WHEN rname = '*' THEN '*' ELSE cigar END AS cigar, CAST(l_linenumber AS INTEGER) AS nh, CAST(l_orderkey % 6 AS INTEGER) AS nm, count(*) AS n, CAST(sum(pos) AS BIGINT) AS places, CAST(sum(k) AS BIGINT) AS names, min(l_linenumber || 'A5') AS md, 'ACGTN' AS bases
FROM r GROUP BY ALL""")
def bam_file(t):
    spark, path = _bam_folder(t)
    # Small splits, so that readers begin inside files; larger ones for more rows, or there would be one for each 2,000 rows.
    found = bam.read_bam(spark, path, split=max(20_000, _lines(t) // 30))
    return found.groupBy("rname", "flag", "cigar", "nh", "nm").agg(F.count("*").alias("n"), F.sum(F.col("pos").cast("bigint")).alias("places"), F.sum(F.substring("qname", 2, 20).cast("bigint")).alias("names"), F.min("md").alias("md"), F.min(F.substring("seq", 1, 5)).alias("bases"))


@query(f"""WITH {_BAM}, m AS (SELECT *, rname = 'chr1' AND pos - 1 < 30000 AND pos - 1 + span > 19999 AS near, rname = 'chr2' AS decoy, flag // 2 % 2 = 0 AS loose FROM r WHERE flag // 1024 % 2 = 0)
SELECT 'region' AS form, rname, count(*) AS n, CAST(sum(k) AS BIGINT) AS names FROM m WHERE near GROUP BY rname UNION ALL SELECT 'loose', rname, count(*), CAST(sum(k) AS BIGINT) FROM m WHERE near OR decoy OR loose GROUP BY rname""")
def bam_regions(t):
    spark, path = _bam_folder(t)
    forms = {"region": bam.read_bam_regions(spark, path, "chr1:20,000-30,000"), "loose": bam.read_bam_regions(spark, path, "chr1:20,000-30,000", decoys="chr2", loose=True)}
    rows = [df.select(F.lit(name).alias("form"), "rname", F.substring("qname", 2, 20).cast("bigint").alias("k")) for name, df in forms.items()]
    return rows[0].union(rows[1]).groupBy("form", "rname").agg(F.count("*").alias("n"), F.sum("k").alias("names"))


@query("SELECT 'a' || p_partkey AS allele, CAST(length(replace(p_name, ' ', '')) AS INTEGER) AS length FROM part")
def fasta_file(t):
    rows = t("part").select(F.concat(F.lit("a"), "p_partkey").alias("allele"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("seq"))
    path = new_folder(rows.sparkSession, "fasta")
    sinks.write_fasta(rows, path)
    return alignments.read_allele_lengths(rows.sparkSession, path)


@query("SELECT 'e' || event_id || '/' || user_id AS id FROM events")
def fastq_file(t):
    rows = t("events").select(F.concat(F.lit("e"), "event_id", F.lit("/"), "user_id").alias("qname"), F.when(F.col("event_id") % 2 == 0, 16).otherwise(0).alias("flag"), F.lit("ACGTT").alias("seq"), F.lit("@IIII").alias("qual"))
    path = new_folder(rows.sparkSession, "fastq")
    sinks.write_fastq(rows, path)
    return alignments.read_fastq_ids(rows.sparkSession, path)


@query("SELECT CAST(o_custkey AS VARCHAR) AS sample, o_orderpriority AS allele, count(*) AS n FROM orders GROUP BY ALL")
def call_file(t):
    rows = t("orders").groupBy(F.col("o_custkey").cast("string").alias("name")).agg(F.array_sort(F.collect_list("o_orderpriority")).alias("alleles"))
    path = new_folder(rows.sparkSession, "calls")
    sinks.write_table(rows, path)
    return results.read_calls(rows.sparkSession, path).groupBy("sample", "allele").agg(F.count("*").alias("n"))


@query("SELECT o_custkey AS sample, o_orderpriority AS gene, CAST(count(*) AS INTEGER) AS cn FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 50 < 5 GROUP BY ALL")
def copy_files(t):
    rows = t("orders").filter("o_orderstatus = 'O' and o_custkey % 50 < 5").groupBy(F.col("o_custkey").cast("string").alias("name"), F.col("o_orderpriority").alias("gene")).agg(F.count("*").alias("cn"))
    spark = rows.sparkSession
    path = new_folder(spark, "copies")
    sinks.write_copy_matrix(rows, path)
    return results.read_copies_of(spark, path, "cn").filter("cn > 0").select(F.col("sample").cast("bigint").alias("sample"), "gene", "cn")


@query("""SELECT sample, gene, allele, regexp_replace(allele, '[^#$+=]', '', 'g') AS marks, regexp_replace(allele, '[#$+=]', '', 'g') AS clean FROM (SELECT CAST(s_suppkey AS VARCHAR) AS sample, unnest(['KIR2DL1', 'KIR2DL1', 'KIR3DL3']) AS gene,
unnest(['KIR2DL1*00' || s_suppkey % 7 || '$', 'KIR2DL1*01' || s_suppkey % 3, 'KIR3DL3*0' || s_nationkey || '#+']) AS allele FROM supplier)""")
def truth_file(t):
    s = F.col("s_suppkey")
    wide = t("supplier").select(s.alias("ID"), F.concat(F.lit("`KIR2DL1*00"), s % 7, F.lit("$;KIR2DL1*01"), s % 3).alias("KIR2DL1"), F.concat(F.lit("KIR3DL3*0"), "s_nationkey", F.lit("#+")).alias("KIR3DL3"))
    return results.read_truth_with_marks(wide.sparkSession, _tabbed(wide, "truth", sep=",", header=True))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS sample, 'call ' || s_nationkey || ' of ' || i AS line FROM supplier, range(2) t(i)")
def section_file(t):
    rows = t("supplier").select("s_suppkey", F.explode(F.array(F.concat(F.lit("Sample: "), "s_suppkey"), F.lit(""), *(F.concat(F.lit("call "), "s_nationkey", F.lit(f" of {i}")) for i in range(2)))).alias("value"))
    return results.read_sections(rows.sparkSession, _text(rows, "sections"))


@query("SELECT 'G' || l_returnflag AS gene, CAST(l_linenumber AS INTEGER) AS rank, CAST(sum(CAST(l_quantity AS INTEGER)) AS DOUBLE) AS value, CASE WHEN l_linenumber > 4 THEN 'a1_a2_a3' ELSE 'a1_a2' END AS alleles FROM lineitem GROUP BY l_returnflag, l_linenumber")
def possible_file(t):
    rows = t("lineitem").groupBy(F.lit("s").alias("sample"), F.concat(F.lit("G"), "l_returnflag").alias("gene"), F.col("l_linenumber").cast("int").alias("rank")).agg(F.sum(F.col("l_quantity").cast("int")).cast("double").alias("value"))
    names = F.when(F.col("rank") > 4, F.array(F.lit("a1"), F.lit("a2"), F.lit("a3"))).otherwise(F.array(F.lit("a1"), F.lit("a2")))
    path = new_folder(rows.sparkSession, "possible")
    sinks.write_table(typing.possible_sets(rows.withColumn("alleles", names)), path)
    return results.read_possible_sets(rows.sparkSession, path).select("gene", "rank", "value", F.array_join("alleles", "_").alias("alleles"))


@query("""SELECT 't1k' AS tool, 'G' || p_size % 5 AS gene, 'A' || i || '*' || p_partkey AS allele, count(*) AS n FROM part, range(1, 3) t(i) WHERE p_size % 20 + i > 5 GROUP BY ALL
UNION ALL SELECT 'ping', c, 'x' || p_partkey % 9 || CASE WHEN k = 1 THEN '.y' ELSE '' END, count(*) FROM part, (VALUES ('KIR2DL1', 0), ('KIR2DL1', 1), ('KIR3DL3', 0)) v(c, k) GROUP BY ALL
UNION ALL SELECT 'sakaue', 'G' || p_size % 5, 'b' || p_partkey % 11, count(*) FROM part GROUP BY ALL""")
def tool_files(t):
    part, k = t("part"), F.col("p_partkey").cast("string")
    spark, quality = part.sparkSession, F.col("p_size") % 20
    gene = F.concat(F.lit("G"), F.col("p_size") % 5)
    t1k = _tabbed(part.select(gene, F.lit(2), F.concat(F.lit("A1*"), k, F.lit(",B1*1")), F.lit(1.0), quality + 1, F.concat(F.lit("A2*"), k), F.lit(1.0), quality + 2), "t1k")
    x = F.concat(F.lit("x"), F.col("p_partkey") % 9)
    ping = _tabbed(part.select(k.alias("name"), F.concat(x, F.lit("+"), x, F.lit("_y other")).alias("KIR2DL1"), x.alias("KIR3DL3"), F.lit("null").alias("KIR2DP1")), "ping", sep=",", header=True)
    b = F.concat(F.lit("b"), F.col("p_partkey") % 11)
    novel = F.col("p_partkey") % 2 == 0
    sakaue = _tabbed(part.select(k.alias("id"), gene.alias("gene"), F.when(novel, F.concat(F.lit("Close_to_"), b, F.lit("-z-OR-y[score=1]"))).otherwise(F.concat(b, F.lit("-z-or-y"))).alias("alleles"), F.when(novel, "potentially_novel").otherwise("known").alias("type")), "sakaue", header=True)
    parts = [("t1k", results.read_t1k(spark, t1k)), ("ping", results.read_ping(spark, ping)), ("sakaue", results.read_sakaue(spark, sakaue))]
    counted = [df.groupBy(F.lit(name).alias("tool"), "gene", "allele").agg(F.count("*").alias("n")) for name, df in parts]
    return counted[0].union(counted[1]).union(counted[2])


@query("""WITH h AS (SELECT n_nationkey AS i, n_nationkey % 3 AS g1, n_nationkey % 2 AS g2 FROM nation), s AS (SELECT s_suppkey, s_nationkey AS a, (s_nationkey + s_suppkey % 2) % 25 AS b FROM supplier)
SELECT sample, gene, CAST(sum(n) AS INTEGER) AS cn FROM (SELECT CAST(s_suppkey AS VARCHAR) AS sample, unnest(['KIR1', 'KIR2']) AS gene, unnest([g1, g2]) AS n FROM s JOIN h ON i = a OR i = b) GROUP BY ALL""")
def haplotype_files(t):
    nation, k = t("nation"), F.col("n_nationkey")
    spark = nation.sparkSession
    table = _tabbed(nation.select(F.concat(F.lit("h"), k).alias("hap"), (k % 3).alias("KIR1"), (k % 2).alias("KIR2")), "haplotypes", header=True)
    b = (F.col("s_nationkey") + F.col("s_suppkey") % 2) % 25
    pairs = t("supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("h"), "s_nationkey", F.lit("+h"), b, F.lit("|h0+h0")).alias("haplotypes"))
    return results.read_copies_of(spark, _tabbed(pairs, "kpi", header=True), "kpi", table)


@query("SELECT CAST(c_custkey AS VARCHAR) AS name, 'r' || c_custkey || '.1.fq' AS r1, 'r' || c_custkey || '.2.fq' AS r2, CASE WHEN c_custkey % 3 = 0 THEN 'cn' || c_custkey END AS cnfile FROM customer")
def manifest_file(t):
    k = F.col("c_custkey").cast("string")
    rows = t("customer").select(k.alias("name"), F.concat(F.lit("r"), k, F.lit(".1.fq")).alias("r1"), F.concat(F.lit("r"), k, F.lit(".2.fq")).alias("r2"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("cn"), k)).otherwise("").alias("cnfile"))
    return results.read_manifest(rows.sparkSession, _tabbed(rows, "manifest", sep=",", header=True))


@query("SELECT 'chr' || n_regionkey AS ref, CAST(n_nationkey * 10 AS INTEGER) AS start, CAST(n_nationkey * 10 + 7 AS INTEGER) AS \"end\" FROM nation")
def bed_file(t):
    k = F.col("n_nationkey") * 10
    rows = t("nation").select(F.concat(F.lit("chr"), "n_regionkey"), k, k + 7)
    return alignments.read_bed(rows.sparkSession, _tabbed(rows, "bed"))


@query("""SELECT chrom, sample, count(*) AS n, CAST(sum(dosage) AS BIGINT) AS dosage, round(avg(depth), 4) AS depth FROM (SELECT 'g' || l_suppkey AS chrom, unnest(['s1', 's2']) AS sample, unnest([CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_linenumber % 2 + l_orderkey % 2 END, l_partkey % 3 + 1]) AS dosage, l_linenumber AS depth FROM lineitem) GROUP BY ALL""")
def vcf_file(t):
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    first = F.when(o % 5 == 0, "./.").otherwise(F.concat_ws("/", n % 2, o % 2))
    second = F.concat_ws("|", F.col("l_partkey") % 3, F.lit(1))
    lines = t("lineitem").select(F.concat_ws("\t", F.concat(F.lit("g"), "l_suppkey"), o, F.lit("."), F.lit("A"), F.lit("C"), F.lit("50"), F.lit("PASS"), F.concat(F.lit("IDP="), n, F.lit(";END="), o + 9), F.lit("GT:DP"), F.concat(first, F.lit(":9")), F.concat(second, F.lit(":8"))).alias("value"))
    spark = lines.sparkSession
    path = _text(lines.union(spark.createDataFrame([("##fileformat=VCFv4.2",), ("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2",)], "value string")), "vcf")
    found = alignments.read_vcf(spark, path, alignments.vcf_samples(spark, path))
    # Blocks have ten bases each, so that the weighted depth is the mean.
    depth = rounded(alignments.info_coverage(found, ["chrom", "sample"]), "depth", digits=4)
    return found.groupBy("chrom", "sample").agg(F.count("*").alias("n"), F.sum(alignments.dosage(F.col("gt"))).alias("dosage")).join(depth, ["chrom", "sample"])


@query("SELECT multiple, n, pv, nv, 10 AS variants FROM (SELECT CAST(event_id % 2 + 1 AS INTEGER) AS multiple, count(*) AS n, CAST(sum(event_id % 3) AS BIGINT) AS pv, count(*) AS nv FROM events GROUP BY ALL)")
def saved_reads(t):
    e = F.col("event_id")
    many = F.transform(F.filter(F.array(F.lit(1), F.lit(2)), lambda i: i <= e % 3), lambda i: F.concat(F.lit("hv"), i))
    empty = F.array().cast("array<string>")
    rows = t("events").select(F.lit("x").alias("l_sam"), F.lit("y").alias("r_sam"), (e % 2 + 1).cast("int").alias("multiple"), F.lit(GENE).alias("backbone"), many.alias("lpv"), F.array(F.lit("hv3")).alias("lnv"), empty.alias("rpv"), empty.alias("rnv"))
    spark = rows.sparkSession
    known = catalogue(spark).select("pos", "typ", "ref", "val", "id", "length", "allele", "freq", "ignore", "in_exon")
    path = new_folder(spark, "saved")
    sinks.write_reads_and_variants(rows, known, path)
    found, variants = alignments.read_reads_and_variants(spark, path, lines=True)
    counts = found.groupBy("multiple").agg(F.count("*").alias("n"), F.sum(F.size("lpv")).alias("pv"), F.sum(F.size("lnv")).alias("nv"))
    return counts.crossJoin(F.broadcast(variants.agg(F.count("*").cast("int").alias("variants"))))  # one row


@query("SELECT name, value FROM (VALUES ('base', '15.5'), ('base_dev', '0.08'), ('bins', '500')) v(name, value)")
def model_file(t):
    spark = t("region").sparkSession
    path = new_folder(spark, "model")
    sinks.write_model(spark.createDataFrame([(15.5, 0.08, 500)], "base double, base_dev double, bins int"), path)
    return results.read_model(spark, path).select("name", "value")


@query("SELECT allele, 2 * count(*) AS lines FROM (SELECT CASE WHEN user_id % 10 < 5 THEN 'G0' ELSE 'G1' END AS allele FROM events WHERE event_id % 4 = 0) GROUP BY allele")
def read_group_files(t):
    pairs = t("events").select(F.lit("s").alias("sample"), F.col("event_id").alias("pair_id"), F.concat(F.lit("l"), "event_id").alias("l_sam"), F.concat(F.lit("r"), "event_id").alias("r_sam"), F.when(F.col("user_id") % 10 < 5, "G0").otherwise("G1").alias("allele"))
    path = new_folder(pairs.sparkSession, "groups")
    sinks.write_read_groups(pairs.drop("allele"), pairs.filter("pair_id % 4 = 0"), path)
    found = pairs.sparkSession.read.text(path).filter(F.col("value").endswith(F.concat(F.lit("\tRG:Z:"), "rg")))
    return found.groupBy(F.col("rg").alias("allele")).agg(F.count("*").alias("lines"))


@query("""WITH d AS (SELECT l_suppkey AS sample, l_linenumber AS gene, CAST(sum(l_quantity) AS DOUBLE) AS depth FROM lineitem GROUP BY ALL) SELECT sample, CAST(gene AS INTEGER) AS gene, round(depth / max(CASE WHEN gene = 1 THEN depth END) OVER (PARTITION BY sample), 9) AS ratio FROM d""")
def depth_ratio(t):
    d = t("lineitem").groupBy(F.col("l_suppkey").alias("sample"), F.col("l_linenumber").cast("int").alias("gene")).agg(F.sum("l_quantity").alias("depth"))
    return rounded(results.depth_ratios(d, "sample", 1), "ratio", digits=9).drop("depth")


@query("SELECT CAST(p_partkey AS INTEGER) AS gene, round(abs(depth / 12.5 - cn), 9) AS off FROM (SELECT p_partkey, CAST(p_retailprice % 60 AS DOUBLE) AS depth, CAST(floor((p_retailprice % 60) / 12.5) AS INTEGER) AS cn FROM part) WHERE abs(depth / 12.5 - cn) > 0.25")
def far_copies(t):
    depth = (F.col("p_retailprice") % 60).cast("double")
    rows = t("part").select(F.col("p_partkey").cast("int").alias("gene"), depth.alias("depth"), F.floor(depth / 12.5).cast("int").alias("cn"))
    return rounded(evaluate.bad_copies(rows, F.lit(12.5)), "off", digits=9).select("gene", "off")


@query("SELECT 300 AS bins, 13.0::DOUBLE AS lower, 17.0::DOUBLE AS upper")
def diploid_bounds(t):
    spark = t("region").sparkSession
    found = copynumber.diploid_setting(spark.createDataFrame([(30.0, 4.0)], "mean double, sd double"))
    return spark.createDataFrame([(found.bins, found.lower, found.upper)], "bins int, lower double, upper double")


# A gene for each supplier, with the engine's ten variants and a deletion; its two haplotypes show an allele each, the first
# with one variant wrong.  Some rows aren't phased, some have several bases, some are a base and a deletion in one.
_GONE = (len(VARIANTS), 30, 2, (1, 3, 5))
_SITES = [(i, p, v, held) for i, p, v, held, _ in VARIANTS]


def _phased_rows(t) -> DataFrame:
    k = F.col("s_suppkey")
    shows = lambda i, held, h: (F.array_contains(F.array(*map(F.lit, held)), (k * (h + 1) + h) % 6) if held else F.lit(False)) != F.lit(h == 0) & (k % 11 == i)
    row = lambda pos, ref, alt, i, held: F.struct(F.lit(pos).alias("pos"), ref.alias("ref"), alt.alias("alt"), F.concat(shows(i, held, 0).cast("int"), F.when((k + i) % 13 == 0, "/").otherwise("|"), shows(i, held, 1).cast("int")).alias("gt"))
    rows = [row(p + 1, F.when(k % 4 == 0, "AA").otherwise("A"), F.when(k % 4 == 0, f"{v}A").otherwise(v), i, held) for i, p, v, held in _SITES]
    i, p, size, held = _GONE
    rows.append(row(p, F.repeat(F.lit("A"), F.lit(size + 1)), F.when(k % 3 == 0, "G").otherwise("A"), i, list(held)))
    return t("supplier").select(F.concat(F.lit("G"), "s_suppkey").alias("gene"), F.inline(F.array(*rows)))


@query(f"""WITH h(i, j) AS (VALUES {", ".join(f"({i}, {j})" for i, *_, held in [*_SITES, _GONE] for j in held)}), hap(h) AS (VALUES (0), (1)), site AS (SELECT unnest(range({len(_SITES) + 1})) AS i),
shown AS (SELECT s_suppkey AS k, h, i FROM supplier, hap, site WHERE (s_suppkey + i) % 13 <> 0 AND (EXISTS (SELECT 1 FROM h x WHERE x.i = site.i AND x.j = (s_suppkey * (hap.h + 1) + hap.h) % 6) <> (hap.h = 0 AND s_suppkey % 11 = site.i))),
al AS (SELECT j, count(*) AS c FROM h GROUP BY j), n AS (SELECT k, h, count(*) AS n FROM shown GROUP BY ALL), b AS (SELECT k, shown.h, j, count(*) AS b FROM shown JOIN h USING (i) GROUP BY ALL),
d AS (SELECT s_suppkey AS k, hap.h, al.j, coalesce(n, 0) + c - 2 * coalesce(b, 0) AS distance FROM supplier, hap, al LEFT JOIN n ON n.k = s_suppkey AND n.h = hap.h LEFT JOIN b ON b.k = s_suppkey AND b.h = hap.h AND b.j = al.j)
SELECT 'G' || k AS chrom, h AS haplotype, 'G' || k || '*00' || j AS allele, distance FROM d QUALIFY row_number() OVER (PARTITION BY k, h ORDER BY distance, j) = 1""")
def phased_typing(t):
    rows = _phased_rows(t)
    spark = rows.sparkSession
    lines = rows.select(F.concat_ws("\t", "gene", "pos", F.lit("."), "ref", "alt", F.lit("50"), F.lit("PASS"), F.lit("."), F.lit("GT"), "gt").alias("value"))
    heads = spark.range(1).select(F.lit("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1").alias("value"))
    vcf = alignments.read_vcf(spark, _text(lines.union(heads), "phased"))
    known = [F.struct(F.lit(p).alias("pos"), F.lit("single").alias("typ"), F.lit(v).alias("val"), F.lit(None).cast("int").alias("del_len"), F.lit(f"hv{i}").alias("id"), F.array(*map(F.lit, held)).cast("array<int>").alias("held")) for i, p, v, held in _SITES]
    i, p, size, held = _GONE
    known.append(F.struct(F.lit(p).alias("pos"), F.lit("deletion").alias("typ"), F.lit(None).cast("string").alias("val"), F.lit(size).alias("del_len"), F.lit(f"hv{i}").alias("id"), F.array(*map(F.lit, held)).alias("held")))
    table = t("supplier").select(F.concat(F.lit("G"), "s_suppkey").alias("ref"), F.inline(F.array(*known)))
    table = table.withColumn("allele", F.transform("held", lambda j: F.concat(F.col("ref"), F.lit("*00"), j.cast("string")))).drop("held")
    return phased.phased_typing(vcf, table).select("chrom", "haplotype", "allele", "distance")
