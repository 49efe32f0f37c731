"""From samples' alignment records to copy numbers and allele calls of a cohort."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuspark.operators import copynumber, reads, series, typing
from locuspark.operators.sets import range_join


@dataclass
class Settings:
    """depth: p75, mean or median; model: lcnd or kde; cohort: one fit for all samples; strategy: full, exonfirst or em."""

    depth: str = "p75"
    model: str = "lcnd"
    cohort: bool = False
    assume_reference_gene: bool = False
    strategy: str = "full"
    lcnd: copynumber.Lcnd = field(default_factory=copynumber.Lcnd)
    typing: typing.Setting = field(default_factory=typing.Setting)


def exon_depths(depths: DataFrame, exons: DataFrame) -> DataFrame:
    """Depth rows inside exons: 1-based positions against both bounds closed, so the base before an exon counts too.

    A position in two overlapping exons is there twice.
    """
    spans = exons.select("ref", "start", (F.col("end") + 1).alias("end"))
    return range_join(depths.withColumnRenamed("gene", "ref"), spans, ["ref"], "pos", "start", "end").withColumnRenamed("ref", "gene").drop("start", "end")


def gene_depths(depths: DataFrame, settings: Settings) -> DataFrame:
    """sample, gene, depth."""
    return series.group_depth(depths, ["sample", "gene"], "depth", settings.depth)


def copy_numbers(depths: DataFrame, settings: Settings) -> DataFrame:
    """sample, gene, depth, cn from gene_depths()."""
    by = [] if settings.cohort else ["sample"]
    if settings.model == "kde":
        return copynumber.kde_cut(depths, by)
    if settings.model != "lcnd":
        raise NotImplementedError(settings.model)
    if settings.assume_reference_gene:
        return copynumber.reference_gene_fit(depths, settings.lcnd, by=by)
    return copynumber.assign(depths, copynumber.fit(depths, by, "depth", settings.lcnd), by, "depth", settings.lcnd)


def per_gene_copy_numbers(depths: DataFrame, settings: Settings) -> DataFrame:
    """One fit for each gene over all samples."""
    return copynumber.assign(depths, copynumber.fit(depths, ["gene"], "depth", settings.lcnd), ["gene"], "depth", settings.lcnd)


def typed(records: DataFrame, catalogue: DataFrame, copies: DataFrame, settings: Settings, ratios: DataFrame | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """Near-optimal allele sets from alignment records; copies: sample, gene, cn; lengths: allele, length, for the EM."""
    wide, _ = reads.decode_reads(records, catalogue, ratios)
    return typing.type_alleles(wide, catalogue, copies, settings.strategy, settings.typing, lengths)
