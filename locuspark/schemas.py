"""Explicit schemas.  Sample ids are strings: '00' must survive."""

from __future__ import annotations

MANIFEST = "name STRING, r1 STRING, r2 STRING, cnfile STRING"
COPY_NUMBER = "gene STRING, cn INT, depth DOUBLE"
DEPTH = "gene STRING, pos INT, depth INT"
SNP = "id STRING, typ STRING, ref STRING, pos INT, val STRING"
LINK = "id STRING, alleles STRING"
LOCUS = "gene STRING, name STRING, first INT, last INT, length INT, exons STRING, strand STRING"
FREQ = "id STRING, freq DOUBLE"
VARIANT = "ref STRING, pos INT, typ STRING, val STRING, del_len INT, id STRING, length INT, allele ARRAY<STRING>, freq DOUBLE, ignore BOOLEAN, in_exon BOOLEAN"
READS_JSON = "variants ARRAY<STRUCT<pos: INT, typ: STRING, ref: STRING, val: STRING, id: STRING, length: INT, allele: ARRAY<STRING>, freq: DOUBLE, ignore: BOOLEAN, in_exon: BOOLEAN>>, reads ARRAY<STRUCT<l_sam: STRING, r_sam: STRING, multiple: INT, backbone: STRING, lpv: ARRAY<STRING>, lnv: ARRAY<STRING>, rpv: ARRAY<STRING>, rnv: ARRAY<STRING>>>"
READ_VARIANT = "read_id STRING, mate INT, sign BOOLEAN, variant_id STRING"
CALLS = "name STRING, alleles STRING, warnings STRING"
TRUTH = "id STRING, haplos STRING, alleles STRING, name STRING"
T1K = "gene_name STRING, num_alleles INT, allele_1 STRING, abundance_1 DOUBLE, quality_1 DOUBLE, allele_2 STRING, abundance_2 DOUBLE, quality_2 DOUBLE"
SAKAUE = "id STRING, gene STRING, alleles STRING, type STRING"
MSA = "gene STRING, allele STRING, seq STRING"
BLOCKS = "gene STRING, block STRING, type STRING, start INT, end INT"
PILEUP = "ref STRING, pos INT, ref_base STRING, depth INT, bases STRING, quals STRING"
BED = "ref STRING, start INT, end INT"
REGIONS = "ref STRING, start INT, end INT"
