import pytest
from pyspark.sql import functions as F

from locuspark.sources import alignments, results, sinks


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return f"file://{path}"


def test_index(spark, tmp_path):
    snp = alignments.read_variants(spark, put(tmp_path, "i.snp", "hv0\tsingle\tb\t5\tT\nhv1\tdeletion\tb\t12\t3\nhv2\tinsertion\tb\t15\tGG\n"))
    link = alignments.read_links(spark, put(tmp_path, "i.link", "hv0\ta1 a2\nhv1\ta3\n"))
    exons = alignments.read_exons(spark, put(tmp_path, "i.locus", "b\tb\t0\t20\t20\t1-10 14-16\t+\n"))
    assert sorted((r["start"], r["end"]) for r in exons.collect()) == [(0, 10), (13, 16)]
    got = {r["id"]: r for r in alignments.catalogue(snp, link, exons, spark.createDataFrame([("hv0", 0.05)], "id string, freq double")).collect()}
    assert got["hv0"]["allele"] == ["a1", "a2"] and got["hv0"]["in_exon"] and got["hv0"]["ignore"]
    assert got["hv1"]["del_len"] == 3 and got["hv1"]["in_exon"] and not got["hv1"]["ignore"] and got["hv2"]["allele"] == []
    sinks.write_index(alignments.catalogue(snp, link, exons, spark.createDataFrame([("hv0", 0.05)], "id string, freq double")), f"file://{tmp_path}/out")
    assert alignments.read_variants(spark, f"file://{tmp_path}/out.index.snp").count() == 2


def test_sequences(spark, tmp_path):
    assert {r["id"]: r["seq"] for r in alignments.read_fasta(spark, put(tmp_path, "x.fa", ">a one\nAC\nGT\n>b\nTT\n")).collect()} == {"a": "ACGT", "b": "TT"}
    assert sorted(r["id"] for r in alignments.read_fastq_ids(spark, put(tmp_path, "x.fq", "@r1 x\nA\n+\n@\n@r2\nC\n+\nI\n")).collect()) == ["r1", "r2"]
    depth = alignments.read_depth(spark, put(tmp_path, "d.tsv", "A\t1\t10\nA\t2\t20\n"))
    assert depth.agg(F.sum("depth")).first()[0] == 30
    pile = alignments.read_pileup(spark, put(tmp_path, "p.tsv", "b\t1\tN\t3\t^]G^]G^KA\tIII\nb\t2\tN\t0\t*\t*\n"))
    from locuspark.operators.reads import pileup_ratios

    row = pileup_ratios(pile).first()
    assert row["pos"] == 0 and abs(row["ratios"]["G"] - 2 / 3) < 1e-9 and row["depth"] == 3


def test_manifest(spark, tmp_path):
    rows = results.read_manifest(spark, put(tmp_path, "c.csv", "name,r1,r2,cnfile\n00,a,b,\n01,c,d,x.tsv\n")).collect()
    assert [(r["name"], r["cnfile"]) for r in rows] == [("00", None), ("01", "x.tsv")]
    assert results.read_manifest(spark, put(tmp_path, "c2.csv", "name,r1,r2\n00,a,b\n")).first()["cnfile"] is None
    with pytest.raises(ValueError):
        results.read_manifest(spark, put(tmp_path, "c3.csv", "name,r1,r2\n00,a,\n"))


def test_tables(spark, tmp_path):
    assert results.read_copy_numbers(spark, put(tmp_path, "cn.tsv", "gene\tcn\tdepth\nA\t2\t1.5\n")).first()["cn"] == 2
    assert results.read_copy_matrix(spark, put(tmp_path, "m.tsv", "gene\t00\t01\nA\t2\t1\n")).count() == 2
    calls = results.read_calls(spark, put(tmp_path, "a.tsv", "name\talleles\nx.00.y\tB*1_A*2\n")).collect()
    assert [(r["sample"], r["allele"]) for r in calls] == [("00", "A*2"), ("00", "B*1")]
    haplo = results.read_haplotypes(spark, put(tmp_path, "h.csv", "﻿hapID,G1,G2\nh1,1,0\n")).collect()
    assert {(r["hapID"], r["gene"], r["n"]) for r in haplo} == {("h1", "G1", 1), ("h1", "G2", 0)}
    assert results.read_thresholds(spark, put(tmp_path, "t.csv", "gene,0-1,1-2\nA,0.5,NA\n")).count() == 1
    sections = results.read_sections(spark, put(tmp_path, "s.txt", "Sample: 00\nx\ny\nSample: 01\nz\n")).collect()
    assert [(r["sample"], r["line"]) for r in sections] == [("00", "x"), ("00", "y"), ("01", "z")]
    wide = results.read_wide_truth(spark, put(tmp_path, "w.csv", "ID,G\n00,`001;002\n")).collect()
    assert [r["allele"] for r in wide] == ["001", "002"]


def test_other_tools(spark, tmp_path):
    t1k = results.read_t1k(spark, put(tmp_path, "t1k.tsv", "G\t2\tG*1,G*2\t10\t60\tG*3\t5\t5\nH\t1\tH*1\t3\t20\t.\t0\t-1\n")).collect()
    assert [(r["gene"], r["allele"]) for r in t1k] == [("G", "G*1"), ("H", "H*1")]
    ping = results.read_ping(spark, put(tmp_path, "ping.csv", "name,G\n00,G*001+G*002_x G*003+G*004\n01,G*null\n")).collect()
    assert [(r["sample"], r["allele"]) for r in ping] == [("00", "G*001"), ("00", "G*002.x")]
    haps = put(tmp_path, "haps.tsv", "nomenclature\tG1\tG2\nh1\t1\t2\nh2\t0\t1\n")
    kpi = results.read_kpi(spark, put(tmp_path, "kpi.tsv", "id\thaplotypes\n00\th1+h2|h2+h2\n01\th2+h2\n"), haps).collect()
    assert {(r["sample"], r["gene"], r["cn"]) for r in kpi} == {("00", "G1", 1), ("00", "G2", 3), ("01", "G1", 0), ("01", "G2", 1)}
    sakaue = results.read_sakaue(spark, put(tmp_path, "sk.tsv", "id\tgene\talleles\ttype\n00\tG\tG*1-G*2/G*3-or-G*4/G*5\tknown\n")).collect()
    assert [r["ambiguous"] for r in sakaue] == [["G*1", "G*2"], ["G*3"]]


def test_vcf(spark, tmp_path):
    text = "##x\n#CHROM\tPOS\nc\t1\t.\tA\tT\t.\t.\tEND=10;IDP=20\tGT:DP\t0/1/1:3\nc\t11\t.\tA\tT\t.\t.\tEND=15;IDP=40\tGT:DP\t./1:3\n"
    vcf = alignments.read_vcf(spark, put(tmp_path, "v.vcf", text))
    assert [r["d"] for r in vcf.orderBy("pos").select(alignments.dosage(F.col("gt")).alias("d")).collect()] == [2, None]
    assert abs(alignments.info_coverage(vcf, ["chrom"]).first()["depth"] - (20 * 10 + 40 * 5) / 15) < 1e-9


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("00", ["a", "b"])], "name string, alleles array<string>")
    sinks.write_table(df, f"file://{tmp_path}/t")
    assert spark.read.option("header", True).option("sep", "\t").csv(f"file://{tmp_path}/t").first()["alleles"] == "a_b"
    cn = spark.createDataFrame([("00", "A", 2), ("01", "A", 1), ("00", "B", 3)], "name string, gene string, cn int")
    assert {r["gene"]: (r["00"], r["01"]) for r in sinks.copy_matrix(cn, ["00", "01"]).collect()} == {"A": (2, 1), "B": (3, 0)}
    rec = spark.createDataFrame([("r", 16, "AAC", "ABC")], "qname string, flag int, seq string, qual string")
    sinks.write_fastq(rec, f"file://{tmp_path}/f")
    assert [r["value"] for r in spark.read.text(f"file://{tmp_path}/f").collect()] == ["@r", "GTT", "+", "CBA"]


def test_copies_of_many_samples(spark, tmp_path):
    rows = [(f"s{i}", g, i % 3 + 1) for i in range(7) for g in ("A", "B") if (i, g) != (3, "B")] + [("s\t8", "A", 2), ("s0", "A", 4)]
    cn = spark.createDataFrame(rows, "name string, gene string, cn int")
    sinks.write_copy_matrix(cn, f"file://{tmp_path}/m", block=3)
    heads = [len(f.read_text().splitlines()[0].split("\t")) for f in tmp_path.glob("m/*/*.txt")]
    assert len(heads) == 3 and max(heads) <= 5
    got = {(r["sample"], r["gene"]): r["cn"] for r in results.read_copies_of(spark, f"file://{tmp_path}/m", "cn").collect()}
    means = {(s, g): [c for t, h, c in rows if (t, h) == (s, g)] for s in {r[0] for r in rows} for g in "AB"}
    assert got == {k: sum(v) // len(v) if v else 0 for k, v in means.items()}


def test_saved_reads_in_lines(spark, tmp_path):
    reads = spark.createDataFrame([(s, f"l{i}", 1, ["hv1"]) for s in ("00", "01") for i in range(50)], "sample string, l_sam string, multiple int, lpv array<string>")
    known = spark.createDataFrame([("00", 3, "hv1", ["a"]), ("01", 4, "hv2", [])], "sample string, pos int, id string, allele array<string>")
    sinks.write_reads_and_variants(reads, known, f"file://{tmp_path}/saved", keys=["sample"])
    texts = [f.read_text() for f in tmp_path.glob("saved/*/*.json")]
    assert sum(t.count("\n") for t in texts) == 102  # no line holds more than one read or variant
    found, variants = alignments.read_reads_and_variants(spark, f"file://{tmp_path}/saved", lines=True)
    assert sorted((r["sample"], r["l_sam"], r["lpv"][0]) for r in found.collect()) == sorted((s, f"l{i}", "hv1") for s in ("00", "01") for i in range(50))
    assert sorted((r["sample"], r["id"], r["allele"]) for r in variants.collect()) == [("00", "hv1", ["a"]), ("01", "hv2", [])]
