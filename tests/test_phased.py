"""Typing from phased genotypes, and rows of several bases, against plain versions."""

import random

from locuspark.operators import phased
from locuspark.sources import alignments


def test_rows_are_cut(spark):
    rows = [(1, "A", "T"), (5, "AC", "AC"), (9, "ACG", "TCA"), (20, "ATT", "A"), (30, "TTTT", "C"), (40, "A", "AGG"), (50, "AC", "GTTT"), (60, "TTA", "A")]
    df = spark.createDataFrame([("g", *r) for r in rows], "chrom string, pos int, ref string, alt string")
    got = sorted((r["pos"], r["ref"], r["alt"]) for r in phased.atomised(df).collect())
    assert got == [(1, "A", "T"), (9, "A", "T"), (11, "G", "A"), (20, "ATT", "A"), (30, "NTTT", "N"), (30, "T", "C"), (40, "A", "AGG"), (50, "A", "G"), (51, "C", "T"), (51, "N", "NTT"), (60, "TTA", "A")]


def test_haplotypes_are_typed(spark, tmp_path):
    rng = random.Random(3)
    alleles = [f"g*{i}" for i in range(6)]
    catalogue, carried = [], {a: set() for a in alleles}
    for i in range(24):
        held = [a for a in alleles if rng.random() < 0.4] or ["g*0"]
        deletion = i % 4 == 0
        catalogue.append(("g", 100 + 40 * i, "deletion" if deletion else "single", None if deletion else "T", 3 if deletion else None, f"v{i}", held))
        for a in held:
            carried[a].add(i)
    lines, shown = ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb"], {(s, h): set() for s in "ab" for h in range(3)}
    truth = {key: rng.choice(alleles) for key in shown}
    for i in range(24):
        gts = []
        for s in "ab":
            has = [(i in carried[truth[s, h]]) != (rng.random() < 0.05) for h in range(3)]
            mark = "/" if i % 9 == 5 else "|"
            gts.append(mark.join("2" if x else "0" for x in has))
            for h in range(3):
                if has[h] and mark == "|":
                    shown[s, h].add(i)
        pos = 100 + 40 * i
        ref, alts = ("ATTT", "AT,A") if i % 4 == 0 else ("C", "G,T")
        lines.append("\t".join(["g", str(pos + (rng.randint(-5, 4) if i % 4 == 0 else 1)), ".", ref, alts, "9", "PASS", ".", "GT", *gts]))
    path = tmp_path / "x.vcf"
    path.write_text("\n".join(lines) + "\n")
    table = spark.createDataFrame(catalogue, "ref string, pos int, typ string, val string, del_len int, id string, allele array<string>")
    got = {(r["sample"], r["haplotype"]): (r["distance"], r["allele"]) for r in phased.phased_typing(alignments.read_vcf(spark, str(path)), table).collect()}
    assert got == {key: min((len(shown[key] ^ carried[a]), a) for a in alleles if carried[a]) for key in shown}
    merged = {r["sample"]: r["alleles"] for r in phased.merged_calls(phased.phased_typing(alignments.read_vcf(spark, str(path)), table)).collect()}
    assert merged == {s: "_".join(sorted(got[s, h][1] for h in range(3))) for s in "ab"}


def test_samples_without_names_are_refused(spark, tmp_path):
    import pytest

    path = tmp_path / "y.vcf"
    path.write_text("g\t1\t.\tA\tT\t9\tPASS\t.\tGT\t0|1\t1|1\n")
    with pytest.raises(ValueError, match="several samples"):
        alignments.read_vcf(spark, str(path))
