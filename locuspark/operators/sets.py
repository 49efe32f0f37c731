"""Relational operators of typing and evaluation that any table can use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a part where several windows hold their task's rows at once.
PART_ROWS = 100_000


def dealt(df: DataFrame, by: list[str], *, rows: int = PART_ROWS) -> DataFrame:
    """df by the hash of by, in parts of about so many rows.

    Parts are counted and stated, since parts that are merged by their compressed size grow with the table.
    """
    return df.repartition(df.count() // rows + 1, *by)


def range_join(points: DataFrame, spans: DataFrame, keys: list[str], pos: str, first: str, last: str, *, width: int = 256, how: str = "inner") -> DataFrame:
    """Points joined to the half-open spans [first, last) they lie in, by position bins.

    Spans are repeated for each bin that they touch and points have one bin, so bins make an equi-join without
    doubles; how is inner, left_semi or left_anti, of points.  Bins split what a key alone would gather in one task.
    """
    binned = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(first) / width), F.floor((F.col(last) - 1) / width)))).filter(F.col(last) > F.col(first))
    if how != "inner":
        binned = binned.select(*keys, "_bin", F.col(first).alias("_first"), F.col(last).alias("_last"))
    else:
        binned = binned.withColumnsRenamed({first: "_first", last: "_last"})
    p, s = points.withColumn("_bin", F.floor(F.col(pos) / width)).alias("p"), binned.alias("s")
    on = reduce(lambda a, b: a & b, [F.col(f"p.{k}") == F.col(f"s.{k}") for k in [*keys, "_bin"]]) & (F.col(f"p.{pos}") >= F.col("s._first")) & (F.col(f"p.{pos}") < F.col("s._last"))
    out = p.join(s, on, how)
    if how != "inner":
        return out.drop("_bin")
    return out.select(*(F.col(f"p.{c}") for c in points.columns), *(F.col(f"s.{c}") for c in binned.columns if c not in [*keys, "_bin", *points.columns])).withColumnsRenamed({"_first": first, "_last": last})


def group_sets(df: DataFrame, by: str, item: str, joined: str = "_") -> DataFrame:
    """by, items: distinct sorted items."""
    return df.groupBy(by).agg(F.array_sort(F.collect_set(item)).alias("items"))


def identical_sets(df: DataFrame, member: str, item: str, everyone: DataFrame | None = None) -> DataFrame:
    """items, members, n: members with the same set of items, sorted; everyone adds members without any item."""
    sets = group_sets(df, member, item)
    if everyone is not None:
        sets = everyone.select(member).distinct().join(sets, member, "left").withColumn("items", F.coalesce("items", F.array().cast(df.schema[item].dataType.simpleString().join(["array<", ">"]))))
    return sets.groupBy("items").agg(F.array_sort(F.collect_list(member)).alias("members"), F.count("*").alias("n"))


def sign_support(df: DataFrame, by: list[str], positive: Column, *, least: int = 3, share: float = 0.2) -> DataFrame:
    """by, n_pos, n_neg, keep_pos, keep_neg: a sign stays if all support is enough and its own share is."""
    counts = df.groupBy(*by).agg(F.count_if(positive).alias("n_pos"), F.count_if(~positive).alias("n_neg"))
    total = F.col("n_pos") + F.col("n_neg")
    keep = lambda n: (total >= least) & (F.col(n) / total >= share) & (F.col(n) > 0)
    return counts.withColumn("keep_pos", keep("n_pos")).withColumn("keep_neg", keep("n_neg"))


def modes(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, n: the most frequent values, all that tie."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    return counts.withColumn("_r", F.rank().over(W.partitionBy(*by).orderBy(F.desc("n")))).filter("_r = 1").drop("_r")


def tie_fraction(df: DataFrame, by: list[str], member: str, value: str, *, largest: bool = True) -> DataFrame:
    """member, credit: each group's one credit is split among the members with its best value."""
    w = W.partitionBy(*by)
    best = (F.max if largest else F.min)(value).over(w)
    held = df.withColumn("_b", best).filter(F.col(value) == F.col("_b"))
    return held.withColumn("_q", F.lit(1.0) / F.count("*").over(w)).groupBy(member).agg(F.sum("_q").alias("credit"))


def relational_division(facts: DataFrame, group: str, item: str, wanted: DataFrame, unwanted: DataFrame | None = None) -> DataFrame:
    """Groups that have every wanted item and none of the unwanted; none at all if nothing is wanted."""
    n = wanted.select(item).distinct().agg(F.count("*").alias("_n"))
    have = facts.join(wanted.select(item).distinct(), item, "left_semi").groupBy(group).agg(F.countDistinct(item).alias("_k"))
    out = have.crossJoin(F.broadcast(n)).filter("_k = _n").select(group)  # one row
    if unwanted is not None:
        out = out.join(facts.join(unwanted.select(item).distinct(), item, "left_semi").select(group).distinct(), group, "left_anti")
    return out


def candidates_per_read(positive: DataFrame, negative: DataFrame, read: str, allele: str, variant: str) -> DataFrame:
    """read, allele: alleles with all of the read's positive variants and none of its negative ones.

    positive and negative have a row for each (read, variant, allele that carries it).
    """
    n = positive.groupBy(read).agg(F.countDistinct(variant).alias("_n"))
    have = positive.groupBy(read, allele).agg(F.countDistinct(variant).alias("_k"))
    return have.join(n, read).filter("_k = _n").select(read, allele).join(negative.select(read, allele).distinct(), [read, allele], "left_anti")


def combinations_with_replacement(df: DataFrame, by: list[str], item: str, k: int) -> DataFrame:
    """by, items: multisets of k items of a group; meant for the few items of a group, as its result is as large as it sounds."""
    ranked = df.select(*by, item).distinct().withColumn("_i", F.row_number().over(W.partitionBy(*by).orderBy(item)))
    out = ranked.select(*by, F.array(item).alias("items"), "_i")
    for _ in range(k - 1):
        right = ranked.select(*[F.col(b).alias(f"_{b}") for b in by], F.col(item).alias("_item"), F.col("_i").alias("_j"))
        on = reduce(lambda a, b: a & b, [F.col(b) == F.col(f"_{b}") for b in by], F.col("_i") <= F.col("_j"))
        out = out.join(right, on).select(*by, F.array_append("items", F.col("_item")).alias("items"), F.col("_j").alias("_i"))
    return out.drop("_i")


def pivoted(df: DataFrame, by: str, column: str, values: list, value: str) -> DataFrame:
    """Wide form: means, 0 where there is none, cut to whole numbers."""
    wide = df.groupBy(by).pivot(column, values).agg(F.avg(value))
    return wide.select(by, *(F.coalesce(F.col(f"`{v}`"), F.lit(0.0)).cast("int").alias(str(v)) for v in values))


def first_by_key(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter("_r = 1").drop("_r")


def top(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """Adds rank and keeps the first n rows of each group."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n)


def nearest_with_ties(df: DataFrame, by: list[str], distance: str) -> DataFrame:
    return df.withColumn("_r", F.rank().over(W.partitionBy(*by).orderBy(distance))).filter("_r = 1").drop("_r")


def novel_ids(df: DataFrame, known: DataFrame, key: list[str], id_column: str = "id") -> DataFrame:
    """df with the catalogue's id, or 'nv' and a number for keys that it doesn't have.

    Numbers follow the sorted order of the distinct new keys: a prefix sum over hashed ranges, not one task of all rows.
    """
    joined = df.join(known.select(*key, F.col(id_column).alias("_known")), key, "left")
    fresh = joined.filter(F.col("_known").isNull()).select(*key).distinct()
    numbered = numbered_rows(fresh, key, "_n").select(*key, F.concat(F.lit("nv"), F.col("_n")).alias("_novel"))
    return joined.join(numbered, key, "left").withColumn(id_column, F.coalesce("_known", "_novel")).drop("_known", "_novel")


def numbered_rows(df: DataFrame, order: list[str], name: str, *, parts: int | None = None) -> DataFrame:
    """Adds 0-based numbers in sorted order: rows are ranged into parts, numbered there, and the parts' counts summed.

    There are as many parts as the session has shuffle partitions, which is what grows with the tables.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id())
    from locuspark.storage import written

    ranged = written(ranged, "numbered")
    base = ranged.groupBy("_p").agg(F.count("*").alias("_c")).withColumn("_b", F.coalesce(F.sum("_c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    local = ranged.withColumn("_l", F.row_number().over(W.partitionBy("_p").orderBy(*order)) - 1)
    return local.join(F.broadcast(base.select("_p", "_b")), "_p").withColumn(name, F.col("_b") + F.col("_l")).drop("_p", "_b", "_l", "_c")  # parts rows


def pair_records(df: DataFrame, key: list[str], line: str, pos: str, mate_pos: str, flag: str) -> DataFrame:
    """Mates: the earlier record's pos is the later one's mate_pos, flags agree in bit 256 and together have 192.

    Each record is used once at most; (left = later, right = earlier) as structs of all columns.
    """
    rows = df.withColumn("_s", F.col(flag).bitwiseAND(F.lit(256)))
    at, parts = [*key, "_s", "_at"], df.count() // PART_ROWS + 1
    late = rows.select(*key, "_s", F.col(mate_pos).alias("_at"), F.struct(*df.columns).alias("left")).repartition(parts, *at)
    early = rows.select(*key, "_s", F.col(pos).alias("_at"), F.struct(*df.columns).alias("right")).repartition(parts, *at)
    both = late.join(early, at).filter((F.col(f"right.{line}") < F.col(f"left.{line}")) & (F.col(f"left.{flag}").bitwiseOR(F.col(f"right.{flag}")).bitwiseAND(F.lit(192)) == 192))
    # A later record overwrites an earlier one under its key, so the nearest earlier line is the one found.
    # A record's candidates all have its place, so they lie where the join put them and aren't shuffled again.
    both = both.withColumn("_r", F.row_number().over(W.partitionBy(*at, f"left.{line}").orderBy(F.desc(f"right.{line}")))).filter("_r = 1")
    both = both.withColumn("_r", F.row_number().over(W.partitionBy(*at, f"right.{line}").orderBy(f"left.{line}"))).filter("_r = 1")
    return both.select(*key, "left", "right")


def support_edges(df: DataFrame, by: list[str], order: str, node: str) -> DataFrame:
    """src, dst, weight: how often two nodes follow each other."""
    nxt = F.lead(node).over(W.partitionBy(*by).orderBy(order))
    return df.select(F.col(node).alias("src"), nxt.alias("dst")).filter("dst is not null").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def column_frequencies(df: DataFrame, by: list[str], seq: Column) -> DataFrame:
    """by, pos, base, n, freq: characters in each column of aligned sequences."""
    chars = df.select(*by, F.posexplode(F.split(seq, "")).alias("pos", "base"))
    counts = chars.groupBy(*by, "pos", "base").agg(F.count("*").alias("n"))
    return counts.withColumn("freq", F.col("n") / F.sum("n").over(W.partitionBy(*by, "pos")))


def consensus(df: DataFrame, by: list[str], seq: Column, *, ignore: str = "") -> DataFrame:
    """by, consensus: the most frequent character of each column, the smallest on a tie."""
    counts = column_frequencies(df, by, seq)
    counts = counts.filter(~F.col("base").isin(*ignore)) if ignore else counts
    best = first_by_key(counts, [*by, "pos"], [F.desc("n"), F.asc("base")])
    rows = best.groupBy(*by) if by else best.groupBy()
    return rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "").alias("consensus"))
