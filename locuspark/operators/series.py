"""Operators over positions: depth statistics, dense spines, islands, intervals, minima, moving averages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from locuspark.operators.sets import dealt
from locuspark.storage import written


def group_depth(depths: DataFrame, by: list[str], value: str, mode: str = "p75") -> DataFrame:
    """by, depth: p75 with linear interpolation, median or mean.  Null keys are left out."""
    known = {"p75": 0.75, "median": 0.5, "mean": None}
    if mode not in known:
        raise NotImplementedError(f"no depth mode {mode}")
    rows = depths.dropna(subset=by)
    return rows.groupBy(*by).agg(F.avg(value).alias("depth")) if mode == "mean" else quantiles(rows, by, value, {"depth": known[mode]})


def depth_statistics(depths: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, mean, sd (ddof 1), p25, median, p75."""
    rows = depths.dropna(subset=by)
    plain = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    found = quantiles(rows, by, value, {"p25": 0.25, "median": 0.5, "p75": 0.75}).select(*(F.col(b).alias(f"_{b}") for b in by), "p25", "median", "p75")
    on = reduce(lambda x, y: x & y, (F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by))
    return plain.join(found, on, "left").drop(*(f"_{b}" for b in by))


#: Distinct values of a group that one aggregation buffer takes.
BUFFER_VALUES = 1_000_000


def quantiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, float], *, most: int = BUFFER_VALUES) -> DataFrame:
    """by and a column for each wanted quantile, with linear interpolation; groups without a value are left out.

    The built-in aggregate holds a group's distinct values in one buffer.  Whole numbers, as depths are, have few, and so
    have tables of at most ``most`` rows.  Of other tables values are counted first, and only groups with more distinct
    ones go by ranges, where no task holds a group.  All ways are exact.
    """
    rows = df.filter(F.col(value).isNotNull())
    if isinstance(df.schema[value].dataType, IntegralType) or rows.count() <= most:
        return rows.groupBy(*by).agg(*(F.percentile(value, q).alias(n) for n, q in wanted.items()))
    counts = written(rows.groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c")), "quantiles")
    large = written(counts.groupBy(*by).agg(F.count("*").alias("_d")).filter(F.col("_d") > most).select(*(F.col(c).alias(f"_l{i}") for i, c in enumerate(by))), "quantiles")
    in_buffers = lambda part: part.groupBy(*by).agg(*(F.percentile("_v", q, F.col("_c")).alias(n) for n, q in wanted.items()))
    if large.isEmpty():
        return in_buffers(counts)
    on = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_l{i}")) for i, c in enumerate(by)), F.lit(True))
    return in_buffers(counts.join(large, on, "left_anti")).unionByName(_ranged_quantiles(counts.join(large, on, "left_semi"), by, wanted))


def _ranged_quantiles(counts: DataFrame, by: list[str], wanted: dict[str, float]) -> DataFrame:
    """From by, _v and _c: values are ranged by (group, value) over all tasks and numbered there; a quantile is two ranks' values."""
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written, since ranges are sampled: both uses below must see the same ones.
    ranged = written(counts.repartitionByRange(parts, *by, "_v").select("*", F.spark_partition_id().alias("_p")), "quantiles")
    part = ranged.groupBy(*by, "_p").agg(F.sum("_c").alias("_n"))  # a row for each group and range that it reaches
    w = W.partitionBy(*by).orderBy("_p")
    offsets = part.select(*by, "_p", F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy(*by)).alias("_total"))
    inside = ranged.withColumn("_upto", F.sum("_c").over(W.partitionBy(*by, "_p").orderBy("_v")))
    on = reduce(lambda x, y: x & y, (F.col(f"i.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*by, "_p"]))
    rows = inside.alias("i").join(offsets.alias("o"), on).select(*(F.col(f"i.{b}").alias(b) for b in by), "_v", "_total", (F.col("_before") + F.col("_upto")).alias("_rank"))
    at = lambda place: F.min(F.when(F.col("_rank") > place, F.col("_v")))
    places = {n: (F.col("_total") - 1) * q for n, q in wanted.items()}
    ends = [c for n, x in places.items() for c in (at(F.floor(x)).alias(f"_lo_{n}"), at(F.ceil(x)).alias(f"_hi_{n}"))]
    found = rows.groupBy(*by).agg(F.max("_total").alias("_total"), *ends)
    return found.select(*by, *((F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * (x - F.floor(x))).alias(n) for n, x in places.items()))


def weighted_mean(df: DataFrame, by: list[str], value: Column, weight: Column) -> DataFrame:
    return df.groupBy(*by).agg((F.sum(value * weight) / F.sum(weight)).alias("weighted_mean"))


def category_share(df: DataFrame, by: list[str], category: str) -> DataFrame:
    """by, category, n, share: counts within a group over the group's total."""
    counts = df.groupBy(*by, category).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*by)))


def base_ratios(bases: DataFrame, by: list[str], base: str = "base") -> DataFrame:
    """by, ratios (base -> share) and depth, from one row for each read base."""
    shares = category_share(bases.withColumn(base, F.upper(base)), by, base)
    return shares.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(base), F.col("share"))))).alias("ratios"), F.sum("n").alias("depth"))


def normalised_by_category(df: DataFrame, by: list[str], category: str, reference: str, value: str) -> DataFrame:
    """Adds ratio: value over the reference category's value in the same group."""
    w = W.partitionBy(*by)
    return df.withColumn("ratio", F.try_divide(F.col(value), F.max(F.when(F.col(category) == reference, F.col(value))).over(w)))


def dense(df: DataFrame, by: list[str], pos: str, value: str, spans: DataFrame) -> DataFrame:
    """Every position from spans' first to last, 0 where df has none.  spans: by, first, last."""
    spine = spans.select(*by, F.explode(F.sequence("first", "last")).alias(pos))
    return spine.join(df.select(*by, pos, value), [*by, pos], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def coverage(spans: DataFrame, by: list[str], first: str, last: str) -> DataFrame:
    """by, pos, depth: how many spans cover each position that any covers, by running sums of starts and ends."""
    marks = spans.select(*by, F.explode(F.array(F.struct(F.col(first).alias("pos"), F.lit(1).alias("d")), F.struct((F.col(last) + 1).alias("pos"), F.lit(-1).alias("d")))).alias("m"))
    steps = marks.groupBy(*by, F.col("m.pos").alias("at")).agg(F.sum("m.d").alias("d"))
    w = W.partitionBy(*by).orderBy("at")
    runs = steps.select(*by, "at", F.sum("d").over(w).alias("depth"), F.lead("at").over(w).alias("next")).filter("depth > 0")
    return runs.select(*by, F.explode(F.sequence("at", F.col("next") - 1)).alias("pos"), "depth")


def islands(df: DataFrame, by: list[str], order: str, max_gap: float, *, tie: list[str] | None = None) -> DataFrame:
    """Adds island: a new one starts where the gap to the row before is max_gap or more."""
    w = W.partitionBy(*by).orderBy(order, *(tie or []))
    opens = F.coalesce((F.col(order) - F.lag(order).over(w) >= max_gap).cast("int"), F.lit(1))
    return df.withColumn("_opens", opens).withColumn("island", F.sum("_opens").over(w)).drop("_opens")


def significant_regions(depths: DataFrame, by: list[str], pos: str, depth: str, *, min_depth: float = 20, min_length: int = 2000, max_gap: int = 500) -> DataFrame:
    """by, first, last, length, mean_depth of islands that are long and deep enough."""
    found = islands(depths, by, pos, max_gap).groupBy(*by, "island").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.sum(depth).alias("_sum"))
    found = found.withColumn("length", F.col("last") - F.col("first")).filter(F.col("length") >= min_length)
    return found.withColumn("mean_depth", F.col("_sum") / F.col("length")).filter(F.col("mean_depth") >= min_depth).drop("_sum", "island")


def legacy_islands(rows: DataFrame, by: list[str], pos: str, tie: str, max_gap: float) -> DataFrame:
    """rows of islands with island (from 1), by the older rule: the row that breaks an island off belongs to none.

    The row after a breaking one begins an island, whatever the gap.  So of rows one after the other that all lie beyond a
    gap, the first breaks off, the second begins, the third breaks off again, and any row within a gap lies in an island:
    a row's part follows from its number in such a run.  Rows are dealt by ranges; a range only hands on its last place,
    how many rows beyond gaps it ends with, and how many islands it begins, so a group of any size is split.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(parts, *by, pos, tie).select("*", F.spark_partition_id().alias("_p")), "islands")
    inside, before = W.partitionBy(*by, "_p").orderBy(pos, tie), W.partitionBy(*by).orderBy("_p")
    earlier = before.rowsBetween(W.unboundedPreceding, -1)
    ends = ranged.groupBy(*by, "_p").agg(F.max(pos).alias("_end")).select(*by, "_p", F.lag("_end").over(before).alias("_end"))
    on = lambda a, b: reduce(lambda x, y: x & y, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in [*by, "_p"]))
    met = lambda table, more: table.alias("a").join(more.alias("b"), on("a", "b")).select("a.*", *(f"b.{c}" for c in more.columns if c not in [*by, "_p"]))
    last = F.coalesce(F.lag(pos).over(inside), F.col("_end"))
    number = F.row_number().over(inside)
    marked = met(ranged, ends).withColumn("_first", last.isNull()).withColumn("_far", F.coalesce(F.col(pos) - last >= max_gap, F.lit(False))).withColumn("_n", number)
    # _run: a row's number in its run of rows beyond gaps, of those in the range; _whole: the run goes on before the range.
    inside = W.partitionBy(*by, "_p").orderBy("_n")  # rows that are alike keep their order
    near = F.max(F.when(~F.col("_far"), F.col("_n"))).over(inside)
    marked = written(marked.withColumn("_run", F.col("_n") - F.coalesce(near, F.lit(0))).withColumn("_whole", near.isNull()).drop("_end"), "islands")
    tails = marked.groupBy(*by, "_p").agg(F.max("_n").alias("_rows"), F.max_by("_run", "_n").alias("_run"), F.bool_and("_far").alias("_all"))
    upto = F.sum("_rows").over(before)
    tails = tails.withColumn("_base", F.when(~F.col("_all"), upto - F.col("_run"))).withColumn("_sum", upto)
    carried = F.coalesce(F.lag("_sum").over(before) - F.coalesce(F.last("_base", ignorenulls=True).over(earlier), F.lit(0)), F.lit(0))
    rows = met(marked, tails.select(*by, "_p", carried.alias("_carried")))
    rows = rows.withColumn("_run", F.col("_run") + F.when(F.col("_whole"), F.col("_carried")).otherwise(0))
    # A row is in an island where its number in the run is even; 0 is a row within a gap.
    previous = F.when(F.col("_far"), F.col("_run") - 1).otherwise(F.coalesce(F.lag("_run").over(inside), F.col("_carried")))
    rows = rows.withColumn("_opens", (F.col("_run") % 2 == 0) & (F.col("_first") | (previous % 2 == 1)))
    rows = written(rows.filter("_run % 2 = 0").withColumn("_k", F.sum(F.col("_opens").cast("int")).over(inside)), "islands")
    opened = rows.groupBy(*by, "_p").agg(F.max("_k").alias("_k")).select(*by, "_p", F.coalesce(F.sum("_k").over(earlier), F.lit(0)).alias("_offset"))
    return met(rows, opened).withColumn("island", F.col("_k") + F.col("_offset")).drop("_p", "_first", "_far", "_n", "_run", "_whole", "_carried", "_opens", "_k", "_offset")


def legacy_regions(depths: DataFrame, by: list[str], pos: str, depth: str, *, min_depth: float = 20, min_length: int = 2000, max_gap: int = 500) -> DataFrame:
    """As significant_regions, but the position that breaks an island belongs to none, as in the older tool."""
    found = legacy_islands(depths.select(*by, pos, depth), by, pos, depth, max_gap).groupBy(*by, "island").agg(F.min(pos).cast("bigint").alias("first"), F.max(pos).cast("bigint").alias("last"), F.sum(depth).cast("double").alias("_sum"))
    found = found.withColumn("length", F.col("last") - F.col("first")).filter((F.col("length") >= min_length) & (F.col("length") > 0))
    return found.withColumn("mean_depth", F.col("_sum") / F.col("length")).filter(F.col("mean_depth") >= min_depth).drop("_sum", "island")


def merged_intervals(df: DataFrame, by: list[str], start: str, end: str, *, flank: int = 0, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """by, start, end of intervals widened by flank, clamped, and joined where they touch or overlap."""
    a, b = F.col(start) - flank, F.col(end) + flank
    rows = df.select(*by, (F.greatest(a, low) if low is not None else a).alias("a"), (F.least(b, high) if high is not None else b).alias("b"))
    w = W.partitionBy(*by).orderBy("a", "b")
    opens = F.coalesce((F.col("a") > F.max("b").over(w.rowsBetween(W.unboundedPreceding, -1))).cast("int"), F.lit(1))
    rows = rows.withColumn("_o", opens).withColumn("_g", F.sum("_o").over(w))
    return rows.groupBy(*by, "_g").agg(F.min("a").alias("start"), F.max("b").alias("end")).drop("_g")


def cumulative_offsets(df: DataFrame, by: list[str], order: list[str], length: str) -> DataFrame:
    """Adds offset: the summed length of the rows before."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(length).over(w), F.lit(0)))


def local_minima(df: DataFrame, by: list[str], order: str, value: str, reach: int = 5) -> DataFrame:
    """Rows whose value is below that of every neighbour within reach on both sides; first and last never are."""
    w = W.partitionBy(*by).orderBy(order)
    v = F.col(value)
    before, after = F.min(value).over(w.rowsBetween(-reach, -1)), F.min(value).over(w.rowsBetween(1, reach))
    return df.withColumn("_ok", (v < before) & (v < after)).filter("_ok").drop("_ok")


def moving_average(df: DataFrame, by: list[str], order: str, value: str, reach: int, *, every: int = 1) -> DataFrame:
    """Adds smooth, the mean over reach rows on each side, and keeps every so manyth row from the first."""
    w = W.partitionBy(*by).orderBy(order)
    out = df.withColumn("smooth", F.avg(value).over(w.rowsBetween(-reach, reach)))
    return out if every == 1 else out.withColumn("_n", F.row_number().over(w)).filter((F.col("_n") - 1) % every == 0).drop("_n")


def step_thresholds(df: DataFrame, by: list[str], ratio: str, level: str) -> DataFrame:
    """by, level, threshold: with ratios and levels each sorted, the mean ratio where the level steps up; +0.5 past the last.

    A step over several levels gives the same threshold to each.
    """
    w = W.partitionBy(*by)
    a = df.select(*by, F.col(ratio).alias("r"), F.row_number().over(w.orderBy(ratio)).alias("n"))
    b = df.select(*by, F.col(level).alias("l"), F.row_number().over(w.orderBy(level)).alias("n"))
    rows = a.join(b, [*by, "n"])
    o = w.orderBy("n")
    rows = rows.withColumn("pr", F.lag("r").over(o)).withColumn("pl", F.lag("l").over(o)).withColumn("nl", F.lead("l").over(o))
    steps = rows.filter("l > pl").select(*by, F.explode(F.sequence(F.col("pl"), F.col("l") - 1)).alias("level"), ((F.col("r") + F.col("pr")) / 2).alias("threshold"))
    last = rows.filter("nl is null").select(*by, F.col("l").alias("level"), (F.col("r") + 0.5).alias("threshold"))
    return steps.union(last)


def runs(df: DataFrame, by: list[str], pos: str, same: list[str]) -> DataFrame:
    """by, same, first, length of runs of adjacent positions with equal values; a position that comes twice counts once."""
    w = W.partitionBy(*by, *same).orderBy(pos)
    return dealt(df.select(*by, *same, pos), [*by, *same]).distinct().withColumn("_g", F.col(pos) - F.row_number().over(w)).groupBy(*by, *same, "_g").agg(F.min(pos).alias("first"), F.count("*").alias("length")).drop("_g")


def carried_header(df: DataFrame, by: list[str], order: str, header: str) -> DataFrame:
    """header filled down from the last row that has one."""
    return df.withColumn(header, F.last(header, ignorenulls=True).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def region_summary(df: DataFrame, by: list[str], pos: str, depth: str) -> DataFrame:
    """by, first, last, mean_depth over the region's length."""
    return df.groupBy(*by).agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.try_divide(F.sum(depth), F.max(pos) - F.min(pos)).alias("mean_depth"))


def depth_curves(depths: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, median, mean, sd, p25, p75 of depths over samples at each position."""
    return depths.groupBy(*by).agg(F.median(value).alias("median"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.percentile(value, 0.25).alias("p25"), F.percentile(value, 0.75).alias("p75"))


def cohort_regions(positions: DataFrame, samples: int, *, per_sample: float = 2.0, read_length: int = 150, by: list[str] | None = None, pos: str = "pos", legacy: bool = False) -> DataFrame:
    """by, first, last, length, mean_depth of regions that enough of a cohort's reads map to.

    positions: by and pos of each read; how many begin at a place is its depth, and a region needs on the average what so
    many samples with per_sample reads over a read's length would bring.
    """
    by = by or ["ref"]
    counts = positions.groupBy(*by, pos).agg(F.count("*").cast("double").alias("depth"))
    regions = legacy_regions if legacy else significant_regions
    return regions(counts, by, pos, "depth", min_depth=samples * per_sample / read_length)
