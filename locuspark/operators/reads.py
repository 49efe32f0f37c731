"""From alignment records to the variants that each read supports or contradicts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from locuspark.functions.decoding import TYPE_RANK, decode, pileup_bases
from locuspark.functions.scalars import PROPER, has_flag
from locuspark.operators.sets import pair_records
from locuspark.storage import written

MAX_EDITS = 4
MIN_PILEUP, SURE_SHARE, RARE_SHARE = 20, 0.8, 0.2
#: Positions of a bin in the join of reads with the catalogue; reads are short, so they touch one or two.
BIN = 256
#: Catalogue rows that are broadcast, and ways that a larger catalogue's bins are dealt.
BROADCAST_CATALOGUE, SALTS = 200_000, 32
#: Decoded mates that a task remembers.
ALIKE = 10_000

PIECES = "piece array<struct<typ:string,pos:int,length:int,val:string>>, clipped boolean"


def kept_records(records: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """Properly paired records with few edits; no NM tag, no record."""
    return records.filter(has_flag(F.col("flag"), PROPER) & (F.col("nm") <= max_edits))


def unique_records(records: DataFrame) -> DataFrame:
    return records.filter("nh = 1")


def read_pairs(records: DataFrame, *, sample: str = "sample", max_edits: int = MAX_EDITS) -> DataFrame:
    """pair_id and both mates of pairs whose mates both pass: left is the later record, right the earlier."""
    # Written, since records are matched with themselves and their columns are costly expressions of one text line.
    rows = written(kept_records(records.filter("rnext = '='"), max_edits), "records")
    pairs = pair_records(rows, [sample, "qname", "rname"], "line", "pos", "pnext", "flag")
    name = F.xxhash64(sample, "qname", "rname", "left.line", "right.line")
    return pairs.withColumn("pair_id", name)


def mates(pairs: DataFrame, *, sample: str = "sample") -> DataFrame:
    """One row for each mate: sample, pair_id, mate (0 left, 1 right) and its record."""
    both = F.array(F.struct(F.lit(0).alias("mate"), F.col("left").alias("r")), F.struct(F.lit(1).alias("mate"), F.col("right").alias("r")))
    return pairs.select(F.col(sample).alias("sample"), "pair_id", F.explode(both).alias("m")).select("sample", "pair_id", "m.mate", F.col("m.r.rname").alias("ref"), F.col("m.r.pos").alias("pos"), F.col("m.r.cigar").alias("cigar"), F.col("m.r.seq").alias("seq"), F.col("m.r.md").alias("md"), F.col("m.r.nh").alias("nh"))


def decoded(rows: DataFrame) -> DataFrame:
    """mates() with the pieces of each alignment; clipped mates have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode_once = lru_cache(ALIKE)(decode)  # mates that are alike at a place
        for batch in batches:
            ends, clipped, held = [0], [], []
            for pos, cigar, seq, md in zip(*(batch[c].to_pylist() for c in ("pos", "cigar", "seq", "md")), strict=True):
                found, head, tail = decode_once(pos, cigar, seq, md)
                clipped.append(bool(head or tail))
                if not (head or tail):
                    held += found
                ends.append(len(held))
            fields = [pa.array([getattr(p, n) for p in held], t) for n, t in (("typ", pa.string()), ("pos", pa.int32()), ("length", pa.int32()), ("val", pa.string()))]
            pieces = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, names=["typ", "pos", "length", "val"]))
            keep = [n for n in batch.schema.names if n not in ("cigar", "seq", "md")]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in keep), pieces, pa.array(clipped)], names=[*keep, "piece", "clipped"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name not in ("cigar", "seq", "md"))
    return rows.mapInArrow(run, f"{kept}, {PIECES}")


def pileup_ratios(pileup: DataFrame, *keys: str) -> DataFrame:
    """keys, ref, pos, ratios and depth from pileup columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [pileup_bases(t or "") for t in batch["bases"].to_pylist()]
            kept = [n for n in batch.schema.names if n != "bases"]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in kept), pa.array(split, pa.list_(pa.string()))], names=[*kept, "base"])

    rows = pileup.select(*keys, "ref", "pos", "bases")
    bases = rows.mapInArrow(run, StructType([*(f for f in rows.schema.fields if f.name != "bases"), StructField("base", ArrayType(StringType()))]))
    from locuspark.operators.series import base_ratios

    return base_ratios(bases.withColumn("base", F.explode("base")), [*keys, "ref", "pos"])


def corrected_base(base, ratios, depth):
    """A single's base after a look at the pileup: kept, replaced by a sure one, or N."""
    best = F.array_max(F.transform(F.map_entries(ratios), lambda e: F.struct(e["value"].alias("share"), e["key"].alias("base"))))
    own = F.coalesce(F.try_element_at(ratios, base), F.lit(0.0))
    return F.when(depth.isNull() | (depth < MIN_PILEUP) | (own > RARE_SHARE), base).when(best["share"] >= SURE_SHARE, best["base"]).otherwise(F.lit("N"))


def long_variants(reads: DataFrame, ratios: DataFrame | None = None) -> DataFrame:
    """sample, pair_id, mate, ref, typ, pos, length, val of what differs from the reference, singles corrected by pileup."""
    rows = reads.select("sample", "pair_id", "mate", "ref", F.explode("piece").alias("p")).select("sample", "pair_id", "mate", "ref", "p.typ", "p.pos", "p.length", "p.val").filter("typ <> 'match'")
    if ratios is None:
        return rows
    joined = rows.join(ratios, ["sample", "ref", "pos"] if "sample" in ratios.columns else ["ref", "pos"], "left")
    single = F.col("typ") == "single"
    return joined.withColumn("val", F.when(single, corrected_base(F.col("val"), F.col("ratios"), F.col("depth"))).otherwise(F.col("val"))).drop("ratios", "depth")


def with_ids(variants: DataFrame, catalogue: DataFrame) -> DataFrame:
    """variants with the catalogue's ids; what it doesn't have is named by its content, alike in all samples and runs."""
    value = lambda: F.when(F.col("typ") == "deletion", F.col("del_len").cast("string")).otherwise(F.col("val"))
    known = catalogue.select("ref", "pos", "typ", value().alias("val"), F.col("id").alias("_id"))
    joined = variants.join(known, ["ref", "pos", "typ", "val"], "left")
    fresh = F.when(F.col("val") != "N", F.concat_ws(":", F.lit("nv"), "ref", "pos", "typ", "val"))
    return joined.withColumn("variant_id", F.coalesce("_id", fresh)).withColumn("novel", F.col("_id").isNull()).drop("_id")


def evidence(reads: DataFrame, variants: DataFrame, catalogue: DataFrame, *, broadcast_rows: int = BROADCAST_CATALOGUE) -> DataFrame:
    """sample, pair_id, mate, ref, sign, variant_id: what each mate supports (true) and contradicts (false).

    Contradicted are the catalogue's variants inside the mate's span that it doesn't show: at the span's first
    position insertions aren't counted, at the position behind its end insertions and singles but T are; deletions
    that reach within ten bases of the end aren't.  A corrected N says nothing on its position's singles.  A mate with a
    new insertion or deletion gives nothing at all.
    """
    bad = variants.filter("novel and typ in ('insertion', 'deletion')").select("sample", "pair_id", "mate").distinct()
    key = ["sample", "pair_id", "mate"]
    ok = reads.join(bad, key, "left_anti").filter("size(piece) > 0")
    spans = ok.select(*key, "ref", F.col("piece")[0]["pos"].alias("left"), F.element_at("piece", -1).alias("_e")).withColumn("right", F.col("_e.pos") + F.col("_e.length")).drop("_e")
    shown = variants.join(bad, key, "left_anti")
    positive = shown.filter("val <> 'N' or typ <> 'single'").select(*key, "ref", F.lit(True).alias("sign"), "variant_id")
    binned = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("left") / BIN), F.floor(F.col("right") / BIN))))
    known = catalogue.select("ref", F.col("pos").alias("v_pos"), "typ", "val", "del_len", F.col("id").alias("variant_id"), F.floor(F.col("pos") / BIN).alias("_bin"))
    inside = ((F.col("v_pos") > F.col("left")) & (F.col("v_pos") < F.col("right"))) | ((F.col("v_pos") == F.col("left")) & (F.col("typ") != "insertion")) | ((F.col("v_pos") == F.col("right")) & (F.col("left") < F.col("right")) & ((F.col("typ") == "insertion") | ((F.col("typ") == "single") & (F.col("val") < "T"))))
    open_end = (F.col("typ") == "deletion") & (F.col("v_pos") + F.col("del_len") + 10 >= F.col("right"))
    # All samples have the same few bins, so the catalogue is broadcast after a count, and beyond the bound dealt by salt.
    if known.count() <= broadcast_rows:
        met = binned.join(F.broadcast(known), ["ref", "_bin"])
    else:
        salted = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = binned.withColumn("_salt", F.pmod(F.xxhash64("sample", "pair_id"), F.lit(SALTS)).cast("int")).join(salted, ["ref", "_bin", "_salt"]).drop("_salt")
    near = met.filter(inside & ~F.coalesce(open_end, F.lit(False)))
    near = near.join(positive.select(*key, "variant_id"), [*key, "variant_id"], "left_anti")
    unsure = shown.filter("val = 'N' and typ = 'single'").select(*key, F.col("pos").alias("v_pos"), "typ")
    negative = near.join(unsure, [*key, "v_pos", "typ"], "left_anti").select(*key, "ref", F.lit(False).alias("sign"), "variant_id")
    return positive.unionByName(negative)


def as_pairs(found: DataFrame, pairs: DataFrame, *, sample: str = "sample") -> DataFrame:
    """The wide form: lpv, lnv, rpv, rnv for each pair, empty where there is nothing."""
    side = lambda mate, sign: F.array_sort(F.collect_list(F.when((F.col("mate") == mate) & (F.col("sign") == F.lit(sign)), F.col("variant_id"))))
    wide = found.groupBy("sample", "pair_id").agg(side(0, True).alias("lpv"), side(0, False).alias("lnv"), side(1, True).alias("rpv"), side(1, False).alias("rnv"))
    base = pairs.select(F.col(sample).alias("sample"), "pair_id", F.col("rname").alias("backbone"), F.greatest("left.nh", "right.nh").alias("multiple"), F.col("left.sam").alias("l_sam"), F.col("right.sam").alias("r_sam"))
    empty = F.array().cast("array<string>")
    return base.join(wide, ["sample", "pair_id"], "left").select("sample", "pair_id", "l_sam", "r_sam", "multiple", "backbone", *(F.coalesce(c, empty).alias(c) for c in ("lpv", "lnv", "rpv", "rnv")))


def decode_reads(records: DataFrame, catalogue: DataFrame, ratios: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(reads in wide form, evidence in long form) of a sample's records.

    Pairs, decoded mates and variants are each used several times, so they are written once.
    """
    pairs = written(read_pairs(records), "pairs")
    reads = written(decoded(mates(pairs)), "mates")
    variants = written(with_ids(long_variants(reads, ratios), catalogue), "read-variants")
    found = written(evidence(reads, variants, catalogue), "evidence")
    return as_pairs(found, pairs), found


def novel_variants(variants: DataFrame) -> DataFrame:
    """Catalogue rows of the new variants, without alleles."""
    return variants.filter("novel").select("sample", "ref", "pos", "typ", "val", F.col("variant_id").alias("id"), F.array().cast("array<string>").alias("allele")).distinct()


def type_rank(typ: str) -> int:
    return TYPE_RANK[typ]
