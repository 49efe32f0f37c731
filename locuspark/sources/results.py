"""Readers of calls, copy numbers, truth sets and other tools' results."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuspark import schemas


def _rows(spark: SparkSession, path: str, *, sep: str = "\t", schema: str | None = None, header: bool = True) -> DataFrame:
    reader = spark.read.option("header", header).option("sep", sep).option("encoding", "UTF-8")
    return (reader.schema(schema) if schema else reader).csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, r1, r2, cnfile; a missing cnfile column is null."""
    found = _rows(spark, path, sep=",")
    missing = {"name", "r1", "r2"} - set(found.columns)
    if missing:
        raise ValueError(f"manifest lacks {sorted(missing)}")
    cn = F.col("cnfile") if "cnfile" in found.columns else F.lit(None).cast("string")
    out = found.select("name", "r1", "r2", F.nullif(cn, F.lit("")).alias("cnfile"))
    if out.filter("r1 is null or r2 is null").limit(1).count():
        raise ValueError("every sample needs r1 and r2")
    return out


def read_copy_numbers(spark: SparkSession, path: str) -> DataFrame:
    """gene, cn: the first column is the gene, whatever its name."""
    found = _rows(spark, path)
    return found.select(F.col(found.columns[0]).alias("gene"), F.col("cn").cast("int").alias("cn"))


def read_copy_matrix(spark: SparkSession, path: str) -> DataFrame:
    """sample, gene, cn from wide cohort tables, each file with a header of its own.

    Samples may be many, so a header is a row that its file's lines are joined with, and not columns of a plan.
    """
    from locuspark.sources.alignments import numbered_lines

    lines = numbered_lines(spark.read.text(path).filter("value <> ''"))
    rows = lines.filter("number > 0").select("file", "value").join(lines.filter("number = 0").select("file", F.col("value").alias("head")), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = lambda text: next(csv.reader([text], delimiter="\t", escapechar="\\", doublequote=False))
        for batch in batches:
            for head, value in zip(batch["head"].to_pylist(), batch["value"].to_pylist(), strict=True):
                (_, *samples), (gene, *values) = cells(head), cells(value)
                shown = [v or None for v in values[: len(samples)]] + [None] * (len(samples) - len(values))
                yield pa.RecordBatch.from_arrays([pa.array(samples, pa.string()), pa.array([gene or None] * len(samples), pa.string()), pa.array(shown, pa.string())], names=["sample", "gene", "cn"])

    return rows.select("head", "value").mapInArrow(run, "sample string, gene string, cn string").withColumn("cn", F.col("cn").cast("int"))


def sample_id(text: Column) -> Column:
    """Two digits between dots, or the text itself."""
    found = F.regexp_extract(text, r"\.(\d{2})\.", 1)
    return F.when(found == "", text).otherwise(found)


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """sample, allele: one row for each called allele, sorted names."""
    found = _rows(spark, path)
    name = F.col("id") if "id" in found.columns else sample_id(F.col("name"))
    return found.select(name.alias("sample"), F.explode(F.array_sort(F.split("alleles", "_"))).alias("allele")).filter("allele <> ''")


def read_possible_sets(spark: SparkSession, path: str) -> DataFrame:
    """gene, rank, value, alleles from columns 1 to 9."""
    found = _rows(spark, path)
    numbered = [c for c in found.columns if c.isdigit()]
    return found.select(*[c for c in ("sample", "gene") if c in found.columns], F.col("rank").cast("int"), F.col("value").cast("double"), F.array_compact(F.array(*(F.col(f"`{c}`") for c in numbered))).alias("alleles"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """sample, allele with novelty marks."""
    found = _rows(spark, path, schema=schemas.TRUTH)
    return found.select(F.col("id").alias("sample"), F.explode(F.split("alleles", "_")).alias("allele")).filter("allele <> ''")


def read_wide_truth(spark: SparkSession, path: str) -> DataFrame:
    """sample, gene, allele from one column a gene with ; lists; a leading backquote goes."""
    found = _rows(spark, path, sep=",")
    genes = [c for c in found.columns if c != "ID"]
    long = found.unpivot(["ID"], genes, "gene", "cell").filter("cell is not null and cell <> ''")
    return long.select(F.col("ID").alias("sample"), "gene", F.explode(F.split(F.regexp_replace("cell", "^`", ""), ";")).alias("allele")).withColumn("allele", F.trim("allele")).filter("allele <> ''")


def read_sections(spark: SparkSession, path: str, mark: str = "Sample:") -> DataFrame:
    """sample, line from text in sections with a header line each, in splits of any size.

    Within a split the last header is carried down; what stands before a split's first header belongs to the last one
    of the splits before, of which there is a row for each.
    """
    from locuspark.sources.alignments import numbered_lines

    head = F.when(F.col("value").startswith(mark), F.trim(F.substring(F.col("value"), F.lit(len(mark) + 1), F.length("value"))))
    rows = numbered_lines(spark.read.text(path)).withColumn("_head", head)
    last = rows.filter("_head is not null").groupBy("file", "_part").agg(F.max_by("_head", "number").alias("_last"))
    every = rows.select("file", "_part").distinct().join(last, ["file", "_part"], "left")
    before = F.last("_last", ignorenulls=True).over(W.partitionBy("file").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.join(every.select("file", "_part", before.alias("_before")), ["file", "_part"])
    own = F.last("_head", ignorenulls=True).over(W.partitionBy("file", "_part").orderBy("number").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("sample", F.coalesce(own, F.col("_before")))
    return rows.filter(F.col("_head").isNull() & (F.trim("value") != "")).select("sample", F.col("value").alias("line"))


def read_haplotypes(spark: SparkSession, path: str) -> DataFrame:
    """hapID, gene, n from a wide table; a byte-order mark before the first name is ignored."""
    found = _rows(spark, path, sep=",")
    first, *genes = found.columns
    out = found.withColumnRenamed(first, "hapID")
    return out.unpivot(["hapID"], genes, "gene", "n").withColumn("n", F.col("n").cast("int"))


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """gene, level, threshold; NA is missing."""
    found = _rows(spark, path, sep=",")
    gene, *levels = found.columns
    out = found.unpivot([gene], levels, "level", "threshold").withColumnRenamed(gene, "gene")
    return out.withColumn("threshold", F.nullif("threshold", F.lit("NA")).cast("double")).filter("threshold is not null")


def read_t1k(spark: SparkSession, path: str, *, first_only: bool = True, least_quality: float = 5) -> DataFrame:
    """gene, allele: both columns stacked, quality above the least, the first or all of a comma list."""
    found = _rows(spark, path, schema=schemas.T1K, header=False)
    both = found.select("gene_name", F.inline(F.array(*(F.struct(F.col(f"allele_{i}").alias("a"), F.col(f"quality_{i}").alias("q")) for i in (1, 2)))))
    names = F.split("a", ",")
    return both.filter(F.col("q") > least_quality).select(F.col("gene_name").alias("gene"), F.explode(F.slice(names, 1, 1) if first_only else names).alias("allele")).filter("allele <> '.'")


def read_ping(spark: SparkSession, path: str) -> DataFrame:
    """sample, gene, allele: of each cell the first call, its copies split at +; null and failed go."""
    found = _rows(spark, path, sep=",")
    name, *genes = found.columns
    long = found.unpivot([name], genes, "gene", "cell").filter("cell is not null")
    calls = F.explode(F.split(F.split_part("cell", F.lit(" "), F.lit(1)), r"\+"))
    rows = long.select(F.col(name).alias("sample"), "gene", calls.alias("allele"))
    return rows.filter(~F.col("allele").rlike("null|failed") & (F.col("allele") != "")).withColumn("allele", F.regexp_replace("allele", "_", "."))


def read_ping_ratios(spark: SparkSession, path: str) -> DataFrame:
    """sample, gene, ratio from a wide table."""
    found = _rows(spark, path, sep=",")
    name, *genes = found.columns
    return found.unpivot([name], genes, "gene", "ratio").select(F.col(name).alias("sample"), "gene", F.col("ratio").cast("double").alias("ratio"))


def read_kpi(spark: SparkSession, result: str, haplotypes: str) -> DataFrame:
    """sample, gene, cn: gene counts of the first haplotype pair.

    A pair of the same haplotype counts once, as in the tool's own summary.
    """
    found = _rows(spark, result)
    pair = F.split(F.split_part("haplotypes", F.lit("|"), F.lit(1)), r"\+")
    rows = found.select(F.col(found.columns[0]).alias("sample"), F.explode(F.array_distinct(pair)).alias("hapID"))
    table = _rows(spark, haplotypes)
    first, *genes = table.columns
    counts = table.withColumnRenamed(first, "hapID").unpivot(["hapID"], genes, "gene", "n").withColumn("n", F.col("n").cast("int"))
    return rows.join(counts, "hapID").groupBy("sample", "gene").agg(F.sum("n").cast("int").alias("cn"))


def read_sakaue(spark: SparkSession, path: str) -> DataFrame:
    """sample, gene, copy, alternatives (array of alternatives, each an array of ambiguous names)."""
    found = _rows(spark, path, schema=schemas.SAKAUE)
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("alleles", "Close_to_", ""), r"\[[^\]]*\]", ""), "-OR-", "-or-")
    choices = F.split(F.when(F.col("type") == "potentially_novel", clean).otherwise(F.col("alleles")), "-or-")
    rows = found.select(F.col("id").alias("sample"), "gene", "type", F.explode(F.split(choices[0], "/")).alias("names"))
    return rows.select("sample", "gene", "type", F.split("names", "-").alias("ambiguous")).withColumn("allele", F.col("ambiguous")[0])


def depth_ratios(depths: DataFrame, sample: str = "sample", reference: str = "KIR3DL3") -> DataFrame:
    """depth over the reference gene's depth of the same sample."""
    from locuspark.operators.series import normalised_by_category

    return normalised_by_category(depths, [sample], "gene", reference, "depth")


def union_calls(tables: list[DataFrame]) -> DataFrame:
    """Cohort tables one below the other; columns that some lack are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def read_copies_of(spark: SparkSession, path: str, method: str, haplotypes: str | None = None) -> DataFrame:
    """sample, gene, cn from any method's result: answer or allele (counted names), cn (a wide cohort table), ping, sakauekir or kpi."""
    from locuspark.operators.evaluate import copies_from_alleles

    counted = lambda alleles: copies_from_alleles(alleles, "sample", "allele")
    if method == "answer":
        return counted(read_truth(spark, path))
    if method == "allele":
        return counted(read_calls(spark, path))
    if method == "cn":
        return read_copy_matrix(spark, path)
    if method == "ping":
        return read_ping_ratios(spark, path).select("sample", "gene", F.col("ratio").cast("int").alias("cn"))
    if method == "sakauekir":
        return read_copy_matrix(spark, path)
    if method == "kpi":
        if haplotypes is None:
            raise ValueError("kpi needs its table of haplotypes")
        return read_kpi(spark, path, haplotypes)
    raise NotImplementedError(method)


def read_truth_with_marks(spark: SparkSession, path: str) -> DataFrame:
    """sample, gene, allele, marks, clean: names of a wide truth table with their novelty marks, and without."""
    from locuspark.functions.alleles import without_marks

    a = F.col("allele")
    return read_wide_truth(spark, path).select("sample", "gene", "allele", F.regexp_replace(a, "[^#$+=]", "").alias("marks"), without_marks(a).alias("clean"))


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """A saved model's parameters as name and value, from one JSON object in each file."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", "map<string,string>").alias("_m"))
    return text.select("file", F.explode("_m").alias("name", "value"))


def long_read_alleles(fields: DataFrame, by: list[str], field: str) -> DataFrame:
    """by, alleles: names in free text such as KIR3DL3*00101(100.00%), joined by ~ where several lie side by side.

    Marks of novelty, scores and underscores go; of ambiguous names, joined by /, the first stays; sorted.
    """
    names = F.regexp_extract_all(F.col(field), F.lit("KIR[^~^(^+^#^$^=]*"), F.lit(0))
    rows = fields.filter(F.col(field).isNotNull()).select(*by, F.explode(names).alias("_a"))
    clean = F.split_part(F.replace("_a", F.lit("_"), F.lit("")), F.lit("/"), F.lit(1))
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(clean)).alias("alleles"))


def merged_haplotypes(haplotypes: DataFrame, sample: str, order: str) -> DataFrame:
    """sample, haplos, alleles: a sample's haplotypes, in order, as their sizes joined by + and their names joined by _."""
    rows = haplotypes.groupBy(sample).agg(F.sort_array(F.collect_list(F.struct(F.col(order), F.col("alleles")))).alias("_h"))
    sizes = F.transform("_h", lambda h: F.size(h["alleles"]).cast("string"))
    return rows.select(sample, F.array_join(sizes, "+").alias("haplos"), F.array_join(F.flatten(F.transform("_h", lambda h: h["alleles"])), "_").alias("alleles"))
