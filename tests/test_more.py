"""Readers over several splits, made-up cohorts, discovery of new variants, blocks, and what no query can show."""

import random

import pytest
from pyspark.sql import functions as F

from locuspark.operators import alignment, novel, reads, series, shapes, synthesis
from locuspark.plans import engine
from locuspark.sources import alignments, results


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_are_numbered_over_splits(spark, tmp_path, small_splits):
    for name, n in (("a", 900), ("b", 3), ("c", 0), ("d", 401)):
        (tmp_path / f"{name}.fq").write_text("".join(f"@{name}{i}\n@CGT{i}\n+\n@III\n" for i in range(n)))
    lines = spark.read.text(str(tmp_path))
    assert lines.rdd.getNumPartitions() > 5
    got = [r["id"] for r in alignments.read_fastq_ids(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(f"{f}{i}" for f, n in (("a", 900), ("b", 3), ("d", 401)) for i in range(n))


def test_sections_go_on_over_splits(spark, tmp_path, small_splits):
    want, text = [], ""
    rng = random.Random(1)
    for s in range(12):
        text += f"Sample: s{s}\n\n"
        for i in range(rng.choice([0, 1, 500])):
            text += f"line {i}\n"
            want.append((f"s{s}", f"line {i}"))
    (tmp_path / "x.txt").write_text("before any\n" + text)
    (tmp_path / "y.txt").write_text("Sample: t\nonly\n")
    got = [tuple(r) for r in results.read_sections(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([*want, (None, "before any"), ("t", "only")], key=str)


def test_msa_set(spark, tmp_path):
    for gene, seqs in (("KIR2DL1", {"KIR2DL1*001": "AC-GT", "KIR2DL1*BACKBONE": "ACTGT"}), ("KIR3DL3", {"KIR3DL3*002": "GGG"})):
        (tmp_path / f"index.{gene}.fa").write_text("".join(f">{a} x\n{s[:2]}\n{s[2:]}\n" for a, s in seqs.items()))
        (tmp_path / f"index.{gene}.json").write_text('{"blocks": [{"name": "5UTR", "type": "five_prime_UTR", "length": 2}, {"name": "exon1", "type": "exon", "length": 3}], "index": []}')
    (tmp_path / "index.other.KIR9.fa").write_text(">z\nA\n")
    (tmp_path / "index.other.KIR9.json").write_text('{"blocks": []}')
    sequences, blocks = alignments.read_msa_set(spark, f"{tmp_path}/index")
    assert {tuple(r) for r in sequences.collect()} == {("KIR2DL1", "KIR2DL1*001", "AC-GT"), ("KIR2DL1", "KIR2DL1*BACKBONE", "ACTGT"), ("KIR3DL3", "KIR3DL3*002", "GGG")}
    assert {tuple(r) for r in blocks.filter("gene = 'KIR2DL1'").collect()} == {("KIR2DL1", 0, "5UTR", "five_prime_UTR", 0, 2), ("KIR2DL1", 1, "exon1", "exon", 2, 5)}


def test_gene_annotation(spark, tmp_path):
    line = lambda c, src, kind, a, b, attr: f"{c}\t{src}\t{kind}\t{a}\t{b}\t.\t+\t.\t{attr}\n"
    (tmp_path / "x.gtf").write_text("#!v\n" + line("19", "r105", "gene", 11, 20, 'gene_id "1"; gene_name "KIR2DL1"') + line("19", "r109", "gene", 15, 30, 'gene_id "1"; gene_name "KIR2DL1"') * 2 + line("19", "r109", "exon", 15, 18, 'gene_name "KIR2DL1"') + line("19", "r109", "gene", 1, 2, 'gene_id "LILRA"') + line("19", "s", "gene", 5, 6, 'gene_id "KIR3DX1"'))
    got = {tuple(r) for r in alignments.read_gene_annotation(spark, str(tmp_path)).collect()}
    assert got == {("KIR2DL1", 109.0, "19", 14, 30, "+"), ("KIR3DX1", 0.0, "19", 4, 6, "+")}


def test_copies_of_any_method(spark, tmp_path):
    (tmp_path / "truth.tsv").write_text("id\thaplos\talleles\tname\n00\ta\tG*1_G*2_H*1\tn\n")
    assert {tuple(r) for r in results.read_copies_of(spark, f"{tmp_path}/truth.tsv", "answer").collect()} == {("00", "G", 2), ("00", "H", 1)}
    with pytest.raises(ValueError, match="haplotypes"):
        results.read_copies_of(spark, f"{tmp_path}/truth.tsv", "kpi")
    with pytest.raises(NotImplementedError):
        results.read_copies_of(spark, f"{tmp_path}/truth.tsv", "tarot")


def test_made_up_cohort(spark):
    """The same seed gives the same cohort whatever the layout; haplotypes and alleles are drawn about evenly."""
    samples = spark.range(600).select(F.format_string("%03d", "id").alias("sample"))
    haplotypes = spark.createDataFrame([(f"h{i}", g, n) for i in range(6) for g, n in (("K1", 1), ("K2", i % 3))], "hapID string, gene string, n int")
    names = spark.createDataFrame([(g, f"{g}*{i:03d}") for g in ("K1", "K2") for i in range(4)], "gene string, allele string")

    def cohort(seed, parts):
        chosen = synthesis.two_haplotypes(samples.repartition(parts), haplotypes, seed)
        named = synthesis.sample_alleles(synthesis.gene_copies(chosen, haplotypes), names, seed)
        return chosen.collect(), named.collect(), synthesis.answers(chosen, named).collect()

    first, again, other = cohort(7, 2), cohort(7, 5), cohort(8, 2)
    assert [sorted(map(str, x)) for x in first] == [sorted(map(str, x)) for x in again]
    assert sorted(map(str, first[0])) != sorted(map(str, other[0]))
    chosen, named, answer = first
    assert len(chosen) == 1200 and all(150 < sum(r["hapID"] == f"h{i}" for r in chosen) < 250 for i in range(6))
    count = {("K1", s): 2 for s in {r["sample"] for r in chosen}}
    for r in chosen:
        count["K2", r["sample"]] = count.get(("K2", r["sample"]), 0) + int(r["hapID"][1]) % 3
    for (g, s), n in count.items():
        own = sorted(r["name"] for r in named if r["sample"] == s and r["gene"] == g)
        assert len(own) == n == len(set(own)) and all(x.split("-")[0].startswith(g) for x in own)
    assert len(answer) == 600 and all(len(r["haplos"].split("_")) == 2 for r in answer)
    sequences = spark.createDataFrame([("a", "ACGT" * 20), ("b", "AAAA")], "allele string, seq string")
    positions = spark.createDataFrame([("a", i) for i in range(0, 80, 3)], "allele string, pos int")
    got = {r["allele"]: r for r in synthesis.with_new_singles(sequences, positions, 3, 5).collect()}
    assert got["b"]["seq"] == "AAAA" and got["b"]["changed"] == [] and len(got["a"]["changed"]) == 5
    for c in got["a"]["changed"]:
        assert c["pos"] % 3 == 0 and c["old"] == ("ACGT" * 20)[c["pos"]] != c["new"] == got["a"]["seq"][c["pos"]]


def test_new_variants_are_discovered(spark):
    """A base that an allele's own reads show and the catalogue lacks is found, and put into the sequence."""
    catalogue = engine.catalogue(spark)
    lines, n = [], 0
    for i in range(60):  # allele G*000 has hv0, hv3, hv6 and hv9; half of its reads show a new base at 5
        truth = {p: v for _, p, v, held, _ in engine.VARIANTS if 0 in held} | ({5: "C"} if i % 10 else {})
        for mate in (0, 1):
            seq = "".join(truth.get(p, "A") for p in range(20 * mate, 20 * mate + 20))
            md, run = "", 0
            for c in seq:
                md, run = (md, run + 1) if c == "A" else (f"{md}{run}A", 0)
            lines.append((n, "\t".join([f"q{i}", "99" if mate == 0 else "147", engine.GENE, str(20 * mate + 1), "60", "20M", "=", str(20 * (1 - mate) + 1), "40", seq, "I" * 20, "NH:i:1", f"NM:i:{sum(c != 'A' for c in seq)}", f"MD:Z:{md}{run}"])))
            n += 1
    records = alignments.sam_records(spark.createDataFrame(lines, "line bigint, value string"), "line").withColumn("sample", F.lit("s"))
    pairs = reads.read_pairs(records)
    mates = reads.decoded(reads.mates(pairs))
    variants = reads.with_ids(reads.long_variants(mates), catalogue)
    found = reads.evidence(mates, variants, catalogue)
    salted = reads.evidence(mates, variants, catalogue, broadcast_rows=0)
    assert sorted(map(str, found.collect())) == sorted(map(str, salted.collect()))
    called = spark.createDataFrame([("s", engine.GENE, "G*000"), ("s", engine.GENE, "G*001")], "sample string, gene string, allele string")
    backbone = spark.createDataFrame([(engine.GENE, "A" * 40)], "gene string, seq string")
    whole = "".join({p: v for _, p, v, held, _ in engine.VARIANTS if 0 in held}.get(p, "A") for p in range(40))
    sequences = spark.createDataFrame([("G*000", whole)], "allele string, seq string")
    candidates, new = novel.discovered(mates, found, variants, catalogue, called, backbone, sequences)
    got = candidates.collect()
    assert [(r["allele"], r["kind"], r["pos"], r["alt"], r["alt_depth"], r["applies"]) for r in got] == [("G*000", "novel", 5, "C", 54, True)]
    assert [tuple(r)[2:] for r in new.collect()] == [("G*000-5C", whole[:5] + "C" + whole[6:])]


def test_blocks_are_aligned_by_themselves(spark):
    rows = [("G", "G*1", "ACTACCACCACC" + "ACCATATATACC"), ("G", "G*2", "ACTACCACCACC" + "ACCATATATACC"), ("G", "G*3", "ACTTCC---ACC" + "ACCATAT--ACC")]
    msa = spark.createDataFrame(rows, "gene string, allele string, seq string")
    blocks = spark.createDataFrame([("G", 0, 0, 12), ("G", 1, 12, 24)], "gene string, idx int, start int, end int")
    got = {r["allele"]: r["seq"] for r in alignment.left_align_blocks(msa, blocks).collect()}
    assert got["G*3"] == "ACT---TCCACC" + "ACC--ATATACC" and got["G*1"] == rows[0][2]
    assert set(got) == {"G*1", "G*2", "G*3", "G*BACKBONE"}
    kept = alignment.without_alleles(msa, spark.createDataFrame([("G", "G*3")], "gene string, allele string"))
    assert kept.count() == 2


def test_regions_of_a_cohort(spark):
    rows = [("g", p) for p in range(0, 3000, 10) for _ in range(4)] + [("h", p) for p in range(0, 300, 10)]
    df = spark.createDataFrame(rows, "ref string, pos int")
    for legacy in (False, True):
        got = series.cohort_regions(df, 5, legacy=legacy).collect()
        assert [(r["ref"], r["first"], r["last"]) for r in got] == [("g", 0, 2990)]


def test_quantiles_of_groups_over_many_ranges(spark):
    """Against numpy, for doubles with ties, negative and single values, null groups and values."""
    import numpy as np

    rng = random.Random(5)
    values = {"a": [rng.gauss(0, 9) for _ in range(999)], "b": [1.5], "c": [rng.choice([0.5, 2.5, 7.0]) for _ in range(500)], None: [3.0, 1.0], "d": []}
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r["g"]: r for r in series.quantiles(df, ["g"], "v", {"p10": 0.1, "p50": 0.5, "p75": 0.75, "top": 1.0}, most=0).collect()}
        assert set(got) == {"a", "b", "c", None}
        for g in got:
            assert np.allclose([got[g][x] for x in ("p10", "p50", "p75", "top")], np.quantile(values[g], [0.1, 0.5, 0.75, 1.0]))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    whole = {r["g"]: r for r in series.depth_statistics(df, ["g"], "v").collect()}
    assert whole["d"]["n"] == 0 and whole["d"]["median"] is None and whole["b"]["p75"] == 1.5 and None not in whole


def test_prefixes_and_missing_columns(spark):
    names = spark.createDataFrame([("abc",), ("ab",), ("x",), (None,), ("abc",)], "name string")
    prefixes = spark.createDataFrame([("", 0, "all"), ("ab", 1, "first"), ("ab", 2, "second"), ("abc", 1, "long"), (None, 9, "none")], "p string, o int, id string")
    got = sorted(((r["name"], r["id"]) for r in shapes.joined_by_prefix(names, "name", prefixes, "p", "id", "o").collect()), key=str)
    assert got == sorted([("abc", "second"), ("abc", "second"), ("ab", "second"), ("x", "all"), (None, None)], key=str)
    assert shapes.reindexed(names, ["name", "other"]).filter("other = 'NA'").count() == 5


def paired_lines(sample, truths):
    """(sample, line, value): a pair of alignment lines for each truth, a dict of places and bases on a backbone of A."""
    lines = []
    for i, truth in enumerate(truths):
        for mate in (0, 1):
            seq = "".join(truth.get(p, "A") for p in range(20 * mate, 20 * mate + 20))
            md, run = "", 0
            for c in seq:
                md, run = (md, run + 1) if c == "A" else (f"{md}{run}A", 0)
            fields = [f"q{i}", "99" if mate == 0 else "147", engine.GENE, str(20 * mate + 1), "60", "20M", "=", str(20 * (1 - mate) + 1), "40", seq, "I" * 20, "NH:i:1", f"NM:i:{sum(c != 'A' for c in seq)}", f"MD:Z:{md}{run}"]
            lines.append((sample, 2 * i + mate, "\t".join(fields)))
    return lines


def test_new_variants_of_samples_stay_apart(spark):
    """Sample a shows new bases at 5 and, once, at 9; sample b at 9 only: numbers within a sample would mix them up."""
    catalogue = engine.catalogue(spark)
    own = {p: v for _, p, v, held, _ in engine.VARIANTS if 0 in held}
    a = [own | {5: "C"}] * 5 + [own | {9: "C"}] + [own] * 2
    b = [own | {9: "C"}] * 7
    lines = paired_lines("a", a) + paired_lines("b", b)
    records = alignments.sam_records(spark.createDataFrame(lines, "sample string, line bigint, value string"), "sample", "line")
    mates = reads.decoded(reads.mates(reads.read_pairs(records)))
    variants = reads.with_ids(reads.long_variants(mates), catalogue)
    found = reads.evidence(mates, variants, catalogue)
    called = spark.createDataFrame([(s, engine.GENE, x) for s in "ab" for x in ("G*000", "G*001")], "sample string, gene string, allele string")
    backbone = spark.createDataFrame([(engine.GENE, "A" * 40)], "gene string, seq string")
    sequences = spark.createDataFrame([("G*000", "A" * 40)], "allele string, seq string")
    candidates, new = novel.discovered(mates, found, variants, catalogue, called, backbone, sequences)
    assert sorted((r["sample"], r["pos"], r["novel"], r["alt_depth"]) for r in candidates.collect()) == [("a", 5, 5, 5), ("b", 9, 7, 7)]
    assert sorted((r["sample"], r["name"]) for r in new.collect()) == [("a", "G*000-5C"), ("b", "G*000-9C")]


def test_registry_is_merged_by_content(spark):
    catalogue = engine.catalogue(spark)

    def of(sample, truths):
        records = alignments.sam_records(spark.createDataFrame(paired_lines(sample, truths), "sample string, line bigint, value string"), "sample", "line")
        return reads.with_ids(reads.long_variants(reads.decoded(reads.mates(reads.read_pairs(records)))), catalogue)

    first = novel.registry(of("a", [{5: "C"}] * 3 + [{9: "C"}]))
    both = novel.registry(of("b", [{9: "C"}] * 2), first)
    again = novel.registry(of("b", [{9: "C"}] * 2), both)  # a run that is repeated
    want = {("a", 5): 3, ("a", 9): 1, ("b", 9): 2}
    for table in (both, again):
        assert {(r["sample"], r["pos"]): r["n"] for r in table.collect()} == want
    assert {(r["pos"], r["samples"], r["n"], r["most"]) for r in novel.cohort_variants(again).collect()} == {(5, 1, 3, 3), (9, 2, 3, 2)}
