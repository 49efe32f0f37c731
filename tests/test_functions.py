import pytest
from pyspark.sql import functions as F

from locuspark.functions import alleles, decoding, scalars


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "n", "want"), [("KIR2DL1*0030230", 7, "0030230"), ("KIR2DL1*0030230N", 7, "0030230N"), ("KIR2DL1*0030230", 5, "00302"), ("KIR2DL1*0030230", 3, "003"), ("KIR2DL1", 3, ""), ("KIR2DL1*", 5, "new"), ("KIR2DL1*unresolved", 7, "new")])
def test_allele_field(spark, name, n, want):
    assert one(spark, alleles.allele_field(F.lit(name), n)) == want


def test_names(spark):
    assert one(spark, alleles.gene_name(F.lit("KIR2DL1*003"))) == "KIR2DL1"
    assert one(spark, alleles.limited(F.lit("KIR2DL1*0030230"), 5)) == "KIR2DL1*00302"
    assert one(spark, alleles.merged_gene(F.lit("KIR2DS5"))) == "KIR2DS35" and one(spark, alleles.merged_gene(F.lit("KIR3DL1"))) == "KIR3DL1"
    assert one(spark, alleles.is_fusion(F.lit("KIR3DL1*00101e3DL1*03501"))) and one(spark, alleles.before_fusion(F.lit("00101e3DL1*03501"))) == "00101"
    assert one(spark, alleles.without_marks(F.lit("00301#$"))) == "00301"
    assert one(spark, alleles.without_exon_suffix(F.lit("KIR2DL1*00301e"))) == "KIR2DL1*00301"
    assert one(spark, alleles.truncated(F.lit("0030201N"), 5)) == "00302"


def test_scalars(spark):
    assert [one(spark, scalars.half_even(F.lit(x))) for x in (0.5, 1.5, 1.32, 2.5)] == [0, 2, 1, 2]
    assert [one(spark, scalars.right_closed_bin(F.lit(x), [0, 1, 4])) for x in (0.0, 1.0, 1.1, 4.0, 4.1)] == [0, 1, 2, 2, 0]
    assert one(spark, scalars.equal_width_bin(F.lit(10.0), 5, F.lit(10.0))) == 4
    assert one(spark, scalars.reverse_complement(F.lit("AACGT"))) == "ACGTT"
    assert one(spark, scalars.substituted(F.lit("AAAA"), F.lit(2), F.lit("T"))) == "AATA"
    assert one(spark, scalars.f1(F.lit(0.0), F.lit(0.0))) == 0


@pytest.mark.parametrize(
    ("ref", "seq", "want"),
    [("ACTACCACCACC", "ACTTCC---ACC", "ACT---TCCACC"), ("ACCATATATACC", "ACCATAT--ACC", "ACC--ATATACC"), ("ACCATATATACC", "ACCAT----ACC", "ACC----ATACC"), ("ACCGCCACCACC", "ACCTCC---ACC", "ACC---TCCACC"), ("ACCATATATTACC", "ACCATAT---ACC", "ACC--ATA-TACC")],
)
def test_left_alignment(ref, seq, want):
    assert decoding.left_aligned(ref, seq) == want


def test_decoding():
    pieces, head, tail = decoding.decode(1, "3S5M2D4M1I3M", "AAACCCCCGGGGTAAA", "2A2^GG4A2")
    assert (head, tail) == (3, 0)
    assert [(p.typ, p.pos, p.length, p.val) for p in pieces] == [("match", 0, 2, None), ("single", 2, 1, "C"), ("match", 3, 2, None), ("deletion", 5, 2, "2"), ("match", 7, 4, None), ("insertion", 11, 0, "T"), ("single", 11, 1, "A"), ("match", 12, 2, None)]
    pieces, *_ = decoding.decode(10, "1I9M", "A" * 10, "4A0G3")
    assert [(p.typ, p.pos) for p in pieces] == [("insertion", 9), ("match", 9), ("single", 13), ("single", 14), ("match", 15)]
    with pytest.raises(NotImplementedError):
        decoding.decode(1, "2M3N2M", "AAAA", "4")
    with pytest.raises(ValueError):
        decoding.decode(1, "4M", "AAAA", "5")


def test_pileup_and_gaps():
    assert decoding.pileup_bases("^]G^]G^KG") == ["G"] * 3
    assert decoding.pileup_bases("A$^]A*+2ACT-1NC") == ["A", "A", "*", "T", "C"]
    assert decoding.gaps("AT--ATC-C") == [(2, 2), (7, 1)]
    assert decoding.local_matches("ACGT", "AGGT") == 3
