"""Allele names as Column expressions: GENE*DIGITS with prefix resolutions of 3, 5 and 7 digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How gene names merge when only the merged name is known.
MERGED_GENES = {"KIR2DL1": "KIR2DL1S1", "KIR2DS1": "KIR2DL1S1", "KIR2DL5A": "KIR2DL5", "KIR2DL5B": "KIR2DL5", "KIR2DS3": "KIR2DS35", "KIR2DS5": "KIR2DS35"}
#: Marks of novelty behind the digits of a truth allele.
NOVEL_MARKS = "#$+="


def gene_name(allele: Column) -> Column:
    """What stands before the first star."""
    return F.split_part(allele, F.lit("*"), F.lit(1))


def allele_field(allele: Column, resolution: int) -> Column:
    """The digits of an allele at a resolution.

    '' without a star, 'new' where no digits follow it; 7 keeps everything, suffix letters too.
    """
    field = F.regexp_extract(allele, r"^\w+\*(\d+\w*)", 1)
    cut = field if resolution == 7 else F.substring(field, 1, resolution)
    return F.when(~F.contains(allele, F.lit("*")), "").when(field == "", "new").otherwise(cut)


def limited(allele: Column, resolution: int) -> Column:
    return F.concat(gene_name(allele), F.lit("*"), allele_field(allele, resolution))


def merged_gene(gene: Column) -> Column:
    """The merged gene's name, or the gene's own."""
    mapping = F.create_map(*[F.lit(x) for pair in MERGED_GENES.items() for x in pair])
    return F.coalesce(F.try_element_at(mapping, gene), gene)


def is_fusion(allele: Column) -> Column:
    """An e followed by a digit joins two genes' parts."""
    return allele.rlike(r"e\d")


def before_fusion(allele: Column) -> Column:
    return F.regexp_extract(allele, r"^(.*?)(?:e\d.*)?$", 1)


def digits(allele: Column) -> Column:
    """The leading digits of a field."""
    return F.regexp_extract(allele, r"^(\d*)", 1)


def truncated(allele: Column, n: int) -> Column:
    return F.substring(digits(allele), 1, n)


def without_marks(allele: Column) -> Column:
    return F.regexp_replace(allele, "[#$+=]", "")


def without_exon_suffix(allele: Column) -> Column:
    """A trailing e says that only exons are known."""
    return F.regexp_replace(allele, "e+$", "")
