"""Calls against truth: matching at several resolutions, copy-number differences, mapping precision."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuspark.functions.alleles import allele_field, digits, gene_name, is_fusion, merged_gene, without_exon_suffix
from locuspark.functions.scalars import f1, has_flag, ratio
from locuspark.operators.sets import dealt

TIERS = (7, 5, 3)


def exploded(calls: DataFrame, sample: str, alleles: str) -> DataFrame:
    """sample, allele from sorted _-joined names."""
    return calls.select(F.col(sample).alias("sample"), F.explode(F.split(alleles, "_")).alias("allele")).filter("allele <> ''")


def tier_match(truth: DataFrame, called: DataFrame, keys: tuple[str, ...] = ("sample",), *, field=allele_field, gene=gene_name) -> DataFrame:
    """keys, gene, match, truth, called: pairs matched at 7, 5 and 3 digits, then by gene; the rest FN or FP.

    At each tier equal names pair up in order, so a multiset match: both sides are numbered within (keys, gene, field)
    among what earlier tiers left, and numbers up to the smaller side's count are pairs.  All tiers are windows within
    (keys, gene), so the names are shuffled once.  keys may be none, one or several columns.
    """
    base, a = [*keys, "gene"], F.col("allele")
    side = lambda df, name, which: df.select(*keys, name.alias("allele"), F.lit(which).alias("_side")).withColumn("gene", gene(a))
    rows = side(truth, a, 0).union(side(called, without_exon_suffix(a), 1)).withColumns({f"_f{t}": field(a, t) for t in TIERS} | {"_f0": F.lit("")})
    rows = dealt(rows, base).withColumn("_tier", F.lit(None).cast("int")).withColumn("_n", F.lit(None).cast("int"))
    left = lambda which: F.sum(F.when(F.col("_tier").isNull() & (F.col("_side") == which), 1).otherwise(0))
    for tier in (*TIERS, 0):
        within = W.partitionBy(*base, f"_f{tier}")
        running = within.orderBy("_side", "allele").rowsBetween(W.unboundedPreceding, W.currentRow)
        number = F.when(F.col("_side") == 0, left(0).over(running)).otherwise(left(1).over(running))
        rows = rows.withColumn("_m", number).withColumn("_least", F.least(left(0).over(within), left(1).over(within)))
        hit = F.col("_tier").isNull() & (F.col("_m") <= F.col("_least"))
        rows = rows.withColumn("_n", F.when(hit, F.col("_m").cast("int")).otherwise(F.col("_n"))).withColumn("_tier", F.when(hit, F.lit(tier)).otherwise(F.col("_tier")))
    names = F.create_map(*[x for t in (*TIERS, 0) for x in (F.lit(t), F.lit(f"MATCH{t}" if t else "GENE"))])
    of = F.coalesce(*(F.when(F.col("_tier") == t, F.col(f"_f{t}")) for t in (*TIERS, 0)))
    only = lambda which: F.max(F.when(F.col("_side") == which, a))
    pairs = rows.filter("_tier is not null").groupBy(*base, "_tier", of.alias("_f"), "_n").agg(only(0).alias("truth"), only(1).alias("called"))
    pairs = pairs.select(*base, names[F.col("_tier")].alias("match"), "truth", "called")
    rest = rows.filter("_tier is null").select(*base, F.when(F.col("_side") == 0, "FN").otherwise("FP").alias("match"), F.when(F.col("_side") == 0, a).alias("truth"), F.when(F.col("_side") == 1, a).alias("called"))
    return pairs.union(rest)


def match_summary(matches: DataFrame, keys: tuple[str, ...] = ("sample",)) -> DataFrame:
    """Counts by match; samples with nothing but FN are failed and counted apart."""
    by = matches.groupBy(*keys).agg(F.bool_and(F.col("match") == "FN").alias("failed"), *(F.count_if(F.col("match") == m).alias(m) for m in ("MATCH7", "MATCH5", "MATCH3", "GENE", "FN", "FP")))
    ok = lambda m: F.sum(F.when(~F.col("failed"), F.col(m)).otherwise(0)).alias(m)
    return by.agg(*(ok(m) for m in ("MATCH7", "MATCH5", "MATCH3", "GENE", "FN", "FP")), F.count_if("failed").alias("fail_sample"), F.sum(F.when(F.col("failed"), F.col("FN")).otherwise(0)).alias("fail_allele"))


def resolution_accuracy(matches: DataFrame, *, by: str = "method") -> DataFrame:
    """by, gene (null: all), total, and share of truth right at 7, 5, 3 digits and at gene level."""
    truth = F.col("truth").isNotNull()
    right = {7: ["MATCH7"], 5: ["MATCH7", "MATCH5"], 3: ["MATCH7", "MATCH5", "MATCH3"], 0: ["MATCH7", "MATCH5", "MATCH3", "GENE"]}
    out = matches.rollup(by, "gene").agg(F.count_if(truth).alias("total"), F.count_if(F.col("match") == "FP").alias("fp"), *(F.count_if(F.col("match").isin(*m)).alias(f"right{r}") for r, m in right.items()))
    return out.filter(F.col(by).isNotNull()).select(by, "gene", "total", "fp", *(ratio(F.col(f"right{r}"), F.col("total")).alias(f"accuracy{r}") for r in right), (F.col("total") - F.col("right0")).alias("fn"))


def greedy_match(truth: DataFrame, called: DataFrame, n: int, *, sample: str = "sample") -> DataFrame:
    """sample, gene, truth, called, match at n digits: truths in order take the first fitting call, in four passes.

    Passes: both have n digits, and these agree; only the call has, and begins with the truth's; only the truth has; neither
    has, and both are the same.  Names are in order of digits and then of themselves.

    A name comes right before those that begin with it.  So, in a pass with short names, all of a length are served before
    longer ones that begin with them, others don't compete with them, and each takes the first that are left: the same as
    pairing equal prefixes in order, length by length.  Both such passes share a window, since no name is in both.
    """
    keys, a, d, which = ["sample", "gene"], F.col("allele"), F.col("_digits"), F.col("_side")
    field = digits(allele_field(a, 7)).alias("_digits")
    side = lambda df, i: df.select(F.col(sample).alias("sample"), gene_name(a).alias("gene"), "allele", field, F.lit(i).alias("_side"))
    rows = side(truth, 0).union(side(called, 1))
    long, size = F.length(d) >= n, F.length(d)
    short = sorted(rows.select(a).distinct().select(field).agg(F.collect_set(F.when(size < n, size))).first()[0])
    steps = [F.when(long, F.concat(F.lit("n "), F.substring(d, 1, n)))]
    steps += [F.when(long | (size == k), F.concat(F.when(long, 1 - which).otherwise(which), F.lit(f" {k} "), F.substring(d, 1, k))) for k in short if k]
    steps += [F.when(~long, F.concat(F.lit("same "), d))] if short else []
    rows = dealt(rows, keys).withColumn("_pair", F.lit(None).cast("string")).withColumn("_n", F.lit(None).cast("int"))
    count = lambda i: F.count_if(which == i).over(W.partitionBy(*keys, "_k"))
    for step in steps:
        rows = rows.withColumn("_k", F.when(F.col("_pair").isNull() & F.col("sample").isNotNull() & F.col("gene").isNotNull(), step))
        rows = rows.withColumn("_m", F.row_number().over(W.partitionBy(*keys, "_k", "_side").orderBy("_digits", "allele"))).withColumn("_least", F.least(count(0), count(1)))
        hit = F.col("_k").isNotNull() & (F.col("_m") <= F.col("_least"))
        rows = rows.withColumn("_pair", F.when(hit, F.col("_k")).otherwise(F.col("_pair"))).withColumn("_n", F.when(hit, F.col("_m")).otherwise(F.col("_n")))
    pair = F.col("_pair")
    only = lambda i: F.max(F.when(which == i, a))
    out = rows.withColumn("_alone", F.when(pair.isNull(), F.monotonically_increasing_id())).groupBy(*keys, "_pair", "_n", "_alone").agg(only(0).alias("truth"), only(1).alias("called"), F.min("_side").alias("_side"))
    return out.select(*keys, "truth", "called", F.when(pair.isNotNull(), "TP").when(which == 0, "FN").otherwise("FP").alias("match"))


def precision_recall(matches: DataFrame, by: list[str]) -> DataFrame:
    """by, tp, fp, fn, precision, recall, f1 from summed counts; a fusion in the truth counts as not found."""
    good = (F.col("match") == "TP") & ~F.coalesce(is_fusion(F.col("truth")), F.lit(False))
    counts = matches.groupBy(*by).agg(F.count_if(good).alias("tp"), F.count_if(F.col("match") == "FP").alias("fp"), F.count_if(F.col("truth").isNotNull()).alias("n_truth"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("n_truth"))
    return counts.select(*by, "tp", "fp", (F.col("n_truth") - F.col("tp")).alias("fn"), p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def exclusions(truth: DataFrame, level: int, *, sample: str = "sample") -> DataFrame:
    """(sample, gene) to leave out: fusions and their partners; with 3 digits #, with 5 also + and =, with 7 also $."""
    marks = "".join(m for least, m in ((3, "#"), (5, "+="), (7, "$")) if level >= least)
    a = F.col("allele")
    gene = gene_name(a)
    fused = truth.filter(is_fusion(a)).select(sample, F.explode(F.array(gene, F.concat(F.regexp_extract(gene, "^([A-Z]*?)(?=[0-9])", 1), F.regexp_extract(a, r"e(\d[^*]*)\*", 1)))).alias("gene"))
    marked = truth.filter(a.rlike(f"[{marks.replace('$', chr(92) + '$')}]")).select(sample, gene.alias("gene")) if marks else truth.limit(0).select(sample, gene.alias("gene"))
    return fused.union(marked).filter("gene <> ''").distinct()


def excluded(df: DataFrame, out: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(out, keys, "left_anti")


def copies_from_alleles(alleles: DataFrame, sample: str, allele: str) -> DataFrame:
    return alleles.groupBy(sample, gene_name(F.col(allele)).alias("gene")).agg(F.count("*").cast("int").alias("cn"))


def merged_copies(cn: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """cn with genes renamed to a merged name where other, for the same keys, uses only that; then summed."""
    used = other.select(*by, F.col("gene").alias("_m")).distinct()
    joined = cn.withColumn("_m", merged_gene(F.col("gene"))).join(used.withColumn("_u", F.lit(True)), [*by, "_m"], "left")
    return joined.withColumn("gene", F.when(F.col("_u"), F.col("_m")).otherwise(F.col("gene"))).groupBy(*by, "gene").agg(F.sum("cn").alias("cn"))


def compare_copies(truth: DataFrame, called: DataFrame, by: list[str]) -> DataFrame:
    """by, gene, truth, called, diff of full outer joined copies; rows that are zero on both sides go."""
    t, c = truth.select(*by, "gene", F.col("cn").alias("truth")), called.select(*by, "gene", F.col("cn").alias("called"))
    both = t.join(c, [*by, "gene"], "full_outer").na.fill(0, ["truth", "called"])
    return both.filter("truth <> 0 or called <> 0").withColumn("diff", F.col("called") - F.col("truth"))


def copies_accuracy(compared: DataFrame, method: str = "method", sample: str = "sample") -> DataFrame:
    """1 - sum |diff| / sum truth by (method, gene), (method, sample) and method; null where a level doesn't tell."""
    out = compared.groupingSets([[F.col(method), F.col("gene")], [F.col(method), F.col(sample)], [F.col(method)]], F.col(method), F.col("gene"), F.col(sample))
    return out.agg(F.sum("truth").alias("total"), F.sum(F.abs("diff")).alias("wrong")).withColumn("accuracy", 1 - F.try_divide("wrong", "total"))


def bad_copies(depths: DataFrame, base: Column, *, most: float = 0.25) -> DataFrame:
    """Genes whose depth is far from a whole number of copies."""
    return depths.withColumn("off", F.abs(F.col("depth") / base - F.col("cn"))).filter(F.col("off") > most)


def best_set(scored: DataFrame, by: list[str], rank: str = "rank") -> DataFrame:
    """The set with most points (7, 4, 3, 1 for a match at 7, 5, 3 digits, gene), first rank on ties, none without points."""
    points = F.when(F.col("match") == "MATCH7", 7).when(F.col("match") == "MATCH5", 4).when(F.col("match") == "MATCH3", 3).when(F.col("match") == "GENE", 1).otherwise(0)
    sums = scored.groupBy(*by, rank).agg(F.sum(points).alias("score"))
    return sums.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), rank))).filter("_r = 1 and score > 0").drop("_r")


def mapping_counts(records: DataFrame, truth_gene: Column, *, by: list[str]) -> DataFrame:
    """by, view, gene, right, total: records of proper pairs with a reference, in four views.

    all: every record; read: each read's records share one vote; unique: reads with exactly two records; primary: not secondary.
    """
    ok = records.filter(has_flag(F.col("flag"), 2) & (F.col("rname") != "*") & ~has_flag(F.col("flag"), 2048)).withColumn("gene", truth_gene)
    ok = ok.withColumn("_right", (gene_name(F.col("rname")) == F.col("gene")).cast("double")).withColumn("_k", F.count("*").over(W.partitionBy(*by, "qname")))
    vote = lambda name, weight, when: F.struct(F.when(when, name).alias("view"), weight.cast("double").alias("w"))
    views = F.array(vote("all", F.lit(1), F.lit(True)), vote("read", 1 / F.col("_k"), F.lit(True)), vote("unique", F.lit(1), F.col("_k") == 2), vote("primary", F.lit(1), ~has_flag(F.col("flag"), 256)))
    rows = ok.select(*by, "gene", "_right", F.inline(views)).filter("view is not null")
    return rows.groupBy(*by, "view", "gene").agg(F.sum(F.col("_right") * F.col("w")).alias("right"), F.sum("w").alias("total"))


def mapping_status(records: DataFrame, by: list[str]) -> DataFrame:
    """by: reads, proper pairs, missed and secondary by two-level counts."""
    reads = records.groupBy(*by, "qname").agg(F.bool_or(has_flag(F.col("flag"), 2)).alias("pair"), F.bool_or(has_flag(F.col("flag"), 256)).alias("secd"))
    return reads.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("pair").alias("pair"), F.count_if(~F.col("pair")).alias("miss"), F.count_if("secd").alias("secd"))


def from_to(records: DataFrame, source: str, target: str) -> DataFrame:
    """source, target, n, share of the target's records."""
    counts = records.groupBy(source, target).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(target)))


def base_differences(matches: DataFrame, sequences: DataFrame) -> DataFrame:
    """matches with both sequences' lengths and the bases that no alignment can match."""
    from locuspark.functions.decoding import local_matches

    @F.pandas_udf("bigint")
    def missing(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else max(len(x), len(y)) - local_matches(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")

    s = sequences.select("allele", "seq")
    t = matches.join(s.withColumnsRenamed({"allele": "truth", "seq": "truth_seq"}), "truth", "left").join(s.withColumnsRenamed({"allele": "called", "seq": "called_seq"}), "called", "left")
    return t.withColumn("base_diff", missing("truth_seq", "called_seq")).withColumn("truth_length", F.length("truth_seq")).withColumn("called_length", F.length("called_seq")).drop("truth_seq", "called_seq")


def suffixed_sequences(sequences: DataFrame) -> DataFrame:
    """sequences with aliases: every name also with e and N behind it where that isn't a name itself."""
    alias = sequences.select(F.explode(F.array(F.concat("allele", F.lit("e")), F.concat("allele", F.lit("N")))).alias("allele"), "seq")
    return sequences.select("allele", "seq").union(alias.join(sequences.select("allele"), "allele", "left_anti"))


def read_targets(records: DataFrame, by: list[str]) -> DataFrame:
    """by, qname, targets: flag and reference of each of a read's records, sorted."""
    return records.groupBy(*by, "qname").agg(F.array_sort(F.collect_list(F.struct("flag", "rname"))).alias("targets"))


def mapping_means(frames: DataFrame, by: list[str], values: tuple[str, ...] = ("precision", "recall")) -> DataFrame:
    """by, gene (null: all genes) and the values' means, with the false discovery rate of the mean precision."""
    out = frames.groupingSets([[*map(F.col, by), F.col("gene")], list(map(F.col, by))], *map(F.col, by), F.col("gene"))
    return out.agg(*(F.avg(v).alias(v) for v in values), F.grouping("gene").alias("all_genes")).withColumn("fdr", 1 - F.col("precision"))


def previous_positions(records: DataFrame, by: list[str]) -> DataFrame:
    """by, ref, pos, prev_ref, prev_pos of proper pairs whose names hold where both mates were mapped before.

    Names are id|ref|pos|ref|pos, the first mate's place first; pos is 0-based, prev_pos as the name has it, * if unmapped.
    """
    part = F.split("qname", r"\|")
    first = has_flag(F.col("flag"), 64)
    rows = records.filter(has_flag(F.col("flag"), 2))
    return rows.select(*by, F.col("rname").alias("ref"), (F.col("pos") - 1).alias("pos"), F.get(part, F.when(first, 1).otherwise(3)).alias("prev_ref"), F.get(part, F.when(first, 2).otherwise(4)).alias("prev_pos"))


def simulated_positions(records: DataFrame, by: list[str]) -> DataFrame:
    """As previous_positions, for reads named after the allele that they were made from: its gene, and no position."""
    rows = records.filter(has_flag(F.col("flag"), 2))
    return rows.select(*by, F.col("rname").alias("ref"), (F.col("pos") - 1).alias("pos"), F.split_part("qname", F.lit("*"), F.lit(1)).alias("prev_ref"), F.lit("0").alias("prev_pos"))


def previously_mapped(positions: DataFrame) -> DataFrame:
    """Rows that were mapped before, with prev_pos as a number."""
    return positions.filter("prev_pos <> '*'").withColumn("prev_pos", F.col("prev_pos").cast("int"))


def mapped_records(records: DataFrame) -> DataFrame:
    return records.filter(~has_flag(F.col("flag"), 4))


def reserved_pairs(records: DataFrame, kept: DataFrame, name: str = "qname") -> DataFrame:
    """All records of reads of which any record is kept."""
    return records.join(kept.select(name).distinct(), name, "left_semi")


def with_multiplicity(pairs: DataFrame, by: list[str], name: str = "qname") -> DataFrame:
    """pairs with multiple: how many of a read's pairs are left."""
    return pairs.withColumn("multiple", F.count("*").over(W.partitionBy(*by, name)).cast("int"))


def common_ids(df: DataFrame, method: str, wanted: list[str], sample: str) -> DataFrame:
    """df with the samples that every wanted method has."""
    has = df.filter(F.col(method).isin(*wanted)).groupBy(sample).agg(F.countDistinct(method).alias("_n")).filter(F.col("_n") == len(set(wanted)))
    return df.join(has.select(sample), sample, "left_semi")


def base_difference_statistics(matches: DataFrame, by: list[str], value: str = "base_diff") -> DataFrame:
    """by, n, total, mean, sd of the differences in bases; rows without one don't count."""
    return matches.groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def best_of_possible(possible: DataFrame, truth: DataFrame) -> DataFrame:
    """sample, gene, rank, score: of each gene's possible sets the one that fits the truth best.

    possible: sample, gene, rank, alleles (array); truth: sample, allele.
    """
    called = possible.select("sample", "gene", F.col("rank").alias("set"), F.explode("alleles").alias("allele"))
    sets = possible.select("sample", gene_name(F.col("gene")).alias("gene"), F.col("rank").alias("set")).distinct()
    wanted = truth.select("sample", "allele", gene_name(F.col("allele")).alias("gene")).join(sets, ["sample", "gene"]).select("sample", "set", "allele")
    matched = tier_match(wanted, called.select("sample", "set", "allele"), ("sample", "set"))
    return best_set(matched.withColumnRenamed("set", "rank"), ["sample", "gene"])
