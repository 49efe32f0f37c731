"""Binary alignments: rows as in text, splits with and without an index, regions that read few blocks."""

import random

import pytest

from locuspark.sources import alignments, bam

CONTIGS = [("chr1", 5_000_000), ("chr2", 3_000_000), ("HLA*01:02", 10_000)]


def lines(n=6000, seed=2):
    rng, out = random.Random(seed), []
    for i in range(n):
        contig, size = rng.choice(CONTIGS[:2] if i % 50 else CONTIGS)
        flag, pos = rng.choice([99, 147, 65, 1123, 83]), rng.randint(1, size - 400)
        length = rng.choice([0, 1, 7, 50, 151])
        cigar = rng.choice([f"{length}M", f"{length}M3D2N", f"2H{length}="]) if length else "*"
        tags = ["NH:i:2", "MD:Z:50", f"NM:i:{i % 9}", "XA:A:x", "XF:f:0.5", "XB:B:c,1,-2", "XS:B:f,0.5,2", "Zs:Z:0|S|hv1", "XH:H:1AE3", "XI:i:3000000000"][: rng.randint(0, 10)]
        seq = "".join(rng.choice("ACGTN") for _ in range(length)) or "*"
        qual = "*" if not length or rng.random() < 0.2 else "".join(chr(rng.randint(33, 73)) for _ in range(length))
        out.append("\t".join([f"q{i:05d}", str(flag), contig, str(pos), "60", cigar, rng.choice(["=", "*", "chr2"]), str(rng.randint(0, 1000)), "-5", seq, qual, *tags]))
    out += ["\t".join([f"u{i}", "4", "*", "0", "0", "*", "*", "0", "0", "ACGT", "IIII"]) for i in range(200)]
    # A record longer than a block.
    out.append("\t".join(["long", "0", "chr1", "1000000", "60", "200000M", "*", "0", "0", "ACGT" * 50_000, "I" * 200_000, "NM:i:0"]))
    return out


@pytest.fixture(scope="module")
def text():
    return lines()


@pytest.fixture(scope="module")
def folder(spark, text, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bam") / "reads")
    bam.write_bam(spark.createDataFrame([(x,) for x in text], "sam string"), path, CONTIGS, shards=3)
    return path


def names(df):
    return sorted(r["qname"] for r in df.select("qname").collect())


def test_rows_are_those_of_text(spark, text, folder):
    columns = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", "nh", "nm", "md", "zs", "sam"]
    same = lambda r: tuple(("=" if c == "rnext" and r["rnext"] == r["rname"] else r[c]) if c != "sam" else None for c in columns)
    want = alignments.sam_records(spark.createDataFrame([(x,) for x in text], "value string"))
    got = bam.read_bam(spark, folder)
    assert sorted(map(same, got.select(columns).collect())) == sorted(map(same, want.select(columns).collect()))
    for r in got.filter("flag <> 4").select("sam").limit(500).collect():
        assert r["sam"] in set(text) or r["sam"].split("\t")[6] == "="


def test_lines_rise_with_position(spark, folder):
    for rows in spark.createDataFrame([], "x int").collect(), bam.read_bam(spark, folder).filter("pos > 0").select("file", "line", "rname", "pos").collect():
        order = {n: i for i, (n, _) in enumerate(CONTIGS)}
        for file in {r["file"] for r in rows}:
            own = sorted((r["line"], order.get(r["rname"], 99), r["pos"]) for r in rows if r["file"] == file)
            assert [x[1:] for x in own] == sorted(x[1:] for x in own) and len({x[0] for x in own}) == len(own)


@pytest.mark.parametrize("split", [1, 3000, 50_000, 1 << 30])
def test_splits_lose_nothing(spark, text, folder, tmp_path, split):
    """With the index, and without it, where record starts are looked for."""
    import glob
    import shutil

    want = sorted(x.split("\t")[0] for x in text)
    reader = bam.BamReader({"path": folder, "split": str(max(split, 3000))})
    got = sorted(n for p in reader.partitions() for b in reader.read(p) for n in b["qname"].to_pylist())
    assert got == want
    if split > 1:
        for f in glob.glob(f"{folder}/*.bam"):
            shutil.copy(f, tmp_path)
        bare = bam.BamReader({"path": str(tmp_path), "split": str(split)})
        assert sorted(n for p in bare.partitions() for b in bare.read(p) for n in b["qname"].to_pylist()) == want
        assert names(bam.read_bam(spark, str(tmp_path), split=split)) == want


def overlapping(text, regions):
    import re

    out = []
    for x in text:
        f = x.split("\t")
        span = sum(int(n) for n, c in re.findall(r"(\d+)([MIDNSHP=X])", f[5]) if c in "MDN=X") or 1
        if any(f[2] == c and int(f[3]) - 1 < (b if b >= 0 else 1 << 40) and int(f[3]) - 1 + span > a for c, a, b in bam.parse_regions(regions)):
            out.append(x)
    return out


REGIONS = ["chr1:1,000,000-1,100,000", "chr1:1-400 chr2:2000000-2000001", "chr1:1100000-1150000 chr1:1120000-1200000", "chr2:2900000", "chrX:1-5"]


def test_texts_of_regions():
    assert bam.parse_regions("chr1 chr2:5 chr3:1,000-2,000") == [("chr1", 0, -1), ("chr2", 4, -1), ("chr3", 999, 2000)]


@pytest.mark.parametrize("regions", REGIONS)
def test_regions(spark, text, folder, regions):
    want = sorted(x.split("\t")[0] for x in overlapping(text, regions))
    assert names(bam.read_bam(spark, folder, regions=regions)) == want
    kept = sorted(x.split("\t")[0] for x in overlapping(text, regions) if not int(x.split("\t")[1]) & 1024)
    assert names(bam.read_bam_regions(spark, folder, regions)) == kept
    near = set(overlapping(text, f"{regions} chr2:1-100000"))
    loose = sorted(x.split("\t")[0] for x in text if not int(x.split("\t")[1]) & 1024 and (x in near or not int(x.split("\t")[1]) & 2))
    assert names(bam.read_bam_regions(spark, folder, regions, decoys="chr2:1-100000", loose=True)) == loose


def test_regions_read_few_blocks(folder):
    def blocks(**options):
        reader, total = bam.BamReader({"path": folder, **options}), 0
        for p in reader.partitions():
            list(reader.read(p))
            total += reader.blocks_read if p.file else 0
        return total

    whole = blocks()
    assert blocks(regions="chr2:1500000-1510000") < whole / 3
    assert blocks(regions="chr1:4000000-4010000") < whole / 3


def test_filters_choose_regions(spark, text, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = bam.read_bam(spark, folder).filter("rname = 'chr2' and pos >= 1500000 and pos < 1600000")
        want = sorted(x.split("\t")[0] for x in text if x.split("\t")[2] == "chr2" and 1_500_000 <= int(x.split("\t")[3]) < 1_600_000)
        assert names(df) == want
        reader = bam.PushingBamReader({"path": folder})
        list(reader.pushFilters([bam.EqualTo(("rname",), "chr2"), bam.GreaterThanOrEqual(("pos",), 1_500_000), bam.LessThan(("pos",), 1_600_000)]))
        assert reader.regions == [("chr2", 1_499_999, 1_600_000)]
        assert names(bam.read_bam(spark, folder).filter("rname in ('chr2', '*') and pos < 5")) == sorted(x.split("\t")[0] for x in text if x.split("\t")[2] == "*")
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_flags(spark, text, folder):
    want = sorted(x.split("\t")[0] for x in text if int(x.split("\t")[1]) & 2 and not int(x.split("\t")[1]) & 1024)
    assert names(bam.read_bam(spark, folder, required=2, excluded=1024)) == want


def test_empty_folder_of_reads(spark, tmp_path):
    path = str(tmp_path / "none")
    bam.write_bam(spark.createDataFrame([], "sam string"), path, CONTIGS)
    import os

    os.makedirs(path, exist_ok=True)
    assert bam.read_bam(spark, path).count() == 0


def test_keys_have_folders(spark, text, tmp_path):
    rows = spark.createDataFrame([(f"s {i % 3}", x) for i, x in enumerate(text[:300])], "sample string, sam string")
    bam.write_bam(rows, str(tmp_path), CONTIGS, shards=2, keys=["sample"])
    got = bam.read_bam(spark, str(tmp_path)).selectExpr("regexp_extract(file, 'sample=([^/]*)', 1) as sample", "qname").collect()
    assert sorted(map(tuple, got)) == sorted((f"s%20{i % 3}", x.split("\t")[0]) for i, x in enumerate(text[:300]))


def test_reads_behind_the_length_that_a_header_tells(spark, tmp_path):
    rows = ["\t".join([f"q{i}", "99", "chr1", str(i * 50_000 + 1), "60", "10M", "=", "1", "0", "*", "*"]) for i in range(1000)]
    bam.write_bam(spark.createDataFrame([(x,) for x in rows], "sam string"), str(tmp_path), [("chr1", 10_000_000)], shards=2)
    assert len(names(bam.read_bam_regions(spark, str(tmp_path), "chr1"))) == 1000
    assert names(bam.read_bam_regions(spark, str(tmp_path), "chr1:40,000,001-40,100,000")) == ["q800", "q801"]
    assert names(bam.read_bam_regions(spark, str(tmp_path), "chr1:1-10", decoys="chr1:40,000,001", loose=True)) == sorted(["q0", *(f"q{i}" for i in range(800, 1000))])
    with pytest.raises(ValueError, match="BAI index holds"):
        bam.as_record("\t".join(["far", "99", "chr1", str(bam.INDEXED), "60", "10M", "=", "1", "0", "*", "*"]), {"chr1": 0})
