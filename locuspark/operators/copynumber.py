"""Copy numbers from gene depths: mixture likelihood on a grid, kernel density minima, ratio bins."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuspark.functions.scalars import equal_width_bin, normal_pdf, right_closed_bin

CN_MAX = 6
BASE_DEV = 0.08
REFERENCE_GENE = "KIR3DL3*BACKBONE"


@dataclass(frozen=True)
class Lcnd:
    """Settings of the grid likelihood.  start_base 2: copy number 0 is a narrow peak at 0; 1: a wide one."""

    bins: int = 500
    start_base: int = 2
    base_dev: float = BASE_DEV
    lower: float = 0.0
    upper: float | None = None


def deviation(n: Column, dev: Column, start_base: int) -> Column:
    """Standard deviation of the depth at a copy number."""
    if start_base == 2:
        return dev * F.when(n < 2, 0.3 * (2 - n) + 1).otherwise(0.5 * (n - 2) + 1)
    return dev * F.when(n == 0, 1.5).otherwise(0.5 * (n - 1) + 1)


def fit(depths: DataFrame, by: list[str], depth: str = "depth", setting: Lcnd = Lcnd(), bounds: DataFrame | None = None) -> DataFrame:
    """by, x_max, base_dev, base, log_likelihood: the base depth of one copy with the highest likelihood.

    bounds (by, lower, upper) limits each group's base in place of the setting's limits.

    Only bins with depths in them count, so the work is depths x grid x copy numbers for each group of genes, all in
    one stage of joins with small generated grids.
    """
    n = setting.bins
    scale = depths.groupBy(*by).agg(F.greatest(F.max(depth) * 1.2, F.lit(1e-6)).alias("x_max")).withColumn("base_dev", F.col("x_max") * setting.base_dev)
    if bounds is not None:
        scale = scale.join(bounds, by) if by else scale.crossJoin(F.broadcast(bounds))  # one row
        low, upper = F.col("lower"), F.col("upper")
    else:
        low = F.lit(float(setting.lower))
        upper = F.lit(setting.upper).cast("double") if setting.upper is not None else F.col("x_max")
    scale = scale.select(*by, "x_max", "base_dev", low.alias("_low"), upper.alias("_high"))
    scaled = depths.join(scale, by) if by else depths.crossJoin(F.broadcast(scale))
    density = scaled.withColumn("_bin", equal_width_bin(F.col(depth), n, F.col("x_max"))).groupBy(*by, "x_max", "base_dev", "_low", "_high", "_bin").agg(F.count("*").alias("_w"))
    grid = density.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_g")).withColumn("base", F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_g") / (n - 1))
    x = F.col("x_max") * F.col("_bin") / (n - 1)
    peak = F.greatest(*(normal_pdf(x, F.col("base") * c, deviation(F.lit(float(c)), F.col("base_dev"), setting.start_base)) for c in range(CN_MAX + 1)))
    ll = grid.withColumn("_l", F.ln(peak * F.col("x_max") / n + 1e-9) * F.col("_w"))
    sums = ll.groupBy(*by, "x_max", "base_dev", "_g", "base").agg(F.sum("_l").alias("log_likelihood"))
    w = W.partitionBy(*by).orderBy(F.desc(F.round("log_likelihood", 9)), "_g")
    return sums.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_g")


def assign(depths: DataFrame, model: DataFrame, by: list[str], depth: str = "depth", setting: Lcnd = Lcnd()) -> DataFrame:
    """depths with cn: the copy number whose peak is highest at the depth's grid point."""
    joined = depths.join(model.select(*by, "x_max", "base_dev", "base"), by) if by else depths.crossJoin(F.broadcast(model.select("x_max", "base_dev", "base")))
    n = setting.bins
    i = F.least(F.floor(F.col(depth) / (F.col("x_max") / n)), F.lit(n - 1))
    x = F.col("x_max") * i / (n - 1)
    peaks = F.array(*(normal_pdf(x, F.col("base") * c, deviation(F.lit(float(c)), F.col("base_dev"), setting.start_base)) for c in range(CN_MAX + 1)))
    return joined.withColumn("_p", peaks).withColumn("cn", (F.array_position("_p", F.array_max("_p")) - 1).cast("int")).drop("_p", "x_max", "base_dev", "base")


#: Grid points where a diploid region bounds the base.
BOUNDED_BINS = 300


def diploid_setting(statistics: DataFrame, setting: Lcnd = Lcnd()) -> Lcnd:
    """The setting with the base bounded by a diploid region's mean and sd (one row), on a grid of BOUNDED_BINS."""
    row = statistics.select(F.col("mean").cast("double").alias("m"), F.col("sd").cast("double").alias("s")).first()
    return Lcnd(BOUNDED_BINS, setting.start_base, setting.base_dev, (row["m"] - row["s"]) / 2, (row["m"] + row["s"]) / 2)


def reference_gene_fit(depths: DataFrame, setting: Lcnd = Lcnd(), gene: str = REFERENCE_GENE, *, by: list[str] | None = None) -> DataFrame:
    """Copy numbers under the assumption that the reference gene has two copies: up to five refits, each nearer to half its depth.

    Each group (a sample, or with no keys the cohort) is fitted by itself: it is bounded by its own reference gene's mean
    depth, and only groups whose reference gene isn't at two copies yet are fitted again.  A group that stays off
    two, or has no reference gene, raises an error that names some of them.
    """
    from locuspark.storage import written

    by = by or []
    depths = written(depths, "gene-depths")
    of_gene = F.col("gene") == gene
    means = depths.groupBy(*by).agg(F.avg(F.when(of_gene, F.col("depth"))).alias("_mean"))
    if lacking := means.filter("_mean is null").limit(3).collect():
        raise KeyError(f"{gene} is missing: {lacking}" if by else gene)
    if depths.isEmpty():
        return assign(depths, fit(depths, by, "depth", setting), by, "depth", setting)
    means, left, share, bounds, bins, done = written(means, "reference-depths"), depths, 1.0, None, setting.bins, []
    while bins >= 2:
        now = Lcnd(bins, setting.start_base, setting.base_dev, setting.lower, setting.upper)
        out = written(assign(left, fit(left, by, "depth", now, bounds), by, "depth", now), "copy-numbers")
        off = written(out.groupBy(*by).agg(F.bool_or(of_gene & (F.col("cn") != 2)).alias("_off")).filter("_off").drop("_off"), "copy-numbers-off") if by else out.filter(of_gene & (F.col("cn") != 2))
        if off.isEmpty():
            return _union([*done, out])
        if share <= 0:
            break
        if by:
            done.append(out.join(off, by, "left_anti"))
            left = left.join(off, by, "left_semi")
            means = means.join(off, by, "left_semi")
        bounds = means.select(*by, (F.col("_mean") / 2 - 5 * share).alias("lower"), (F.col("_mean") / 2 + 5 * share).alias("upper"))
        bins = int(setting.bins * share)
        share = round(share - 0.2, 10)
    raise ValueError(f"{gene} can't be fitted to two copies: {off.limit(3).collect()}")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def over_largest(values: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """values with name: value over its group's largest, which is joined as one row where there are no keys."""
    top = values.groupBy(*by).agg(F.max(value).alias("_top"))
    joined = values.join(top, by) if by else values.crossJoin(F.broadcast(top))
    return joined.withColumn(name, F.col(value) / F.col("_top")).drop("_top")


def kde_grid(values: DataFrame, by: list[str], value: str = "depth", *, bandwidth: float = 0.05, points: int = 100, high: float = 1.1) -> DataFrame:
    """by, i, x, log_density: Gaussian kernel density of value over its largest, on an even grid."""
    scaled = over_largest(values, by, value, "_v")
    grid = scaled.select(*by, "_v", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).withColumn("x", F.lit(float(high)) * F.col("i") / (points - 1))
    return grid.groupBy(*by, "i", "x").agg(F.ln(F.avg(normal_pdf(F.col("x"), F.col("_v"), F.lit(bandwidth)))).alias("log_density"))


def kde_cut(values: DataFrame, by: list[str], value: str = "depth", **grid: float) -> DataFrame:
    """values with cn: how many of the density's minima lie below value over the largest."""
    from locuspark.operators.series import local_minima

    cuts = local_minima(kde_grid(values, by, value, **grid), by, "i", "log_density", 5).groupBy(*by).agg(F.collect_list("x").alias("_cuts"))
    out = over_largest(values, by, value, "_v")
    out = out.join(cuts, by, "left") if by else out.crossJoin(F.broadcast(cuts))
    return out.withColumn("cn", F.coalesce(F.size(F.filter("_cuts", lambda m: m < F.col("_v"))), F.lit(0))).drop("_v", "_cuts")


def ploidy_by_ratio(ratios: DataFrame, sample: str = "sample", gene: str = "gene", depth: str = "depth", *, reference: str = "KIR3DL3", bandwidth: float = 0.075) -> DataFrame:
    """Copy numbers from depth ratios to the reference gene, cut at each gene's density minima; the reference has two.

    Each gene's cohort is small (one value a sample) and is fitted by itself.
    """
    import pandas as pd

    w = W.partitionBy(sample)
    r = ratios.withColumn("_r", F.try_divide(F.col(depth), F.max(F.when(F.col(gene) == reference, F.col(depth))).over(w)))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf["_r"].to_numpy(dtype=float)
        ok = v[~np.isnan(v)]
        grid = np.linspace(ok.min() - 0.05, ok.max() + 0.05, 50) if len(ok) else np.zeros(1)
        d = np.exp(-0.5 * ((grid[:, None] - ok[None, :]) / bandwidth) ** 2).sum(axis=1) if len(ok) else np.zeros(1)
        minima = [grid[i] for i in range(1, len(grid) - 1) if d[i] < d[i - 1] and d[i] < d[i + 1]]
        edges = [0.0, *minima, 4.0]
        cn = [0 if math.isnan(x) else next((i for i in range(1, len(edges)) if edges[i - 1] < x <= edges[i]), 1) - 1 for x in v]
        return pdf.drop(columns="_r").assign(cn=[c + 0 for c in cn])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ratios.schema.fields)
    out = r.groupBy(gene).applyInPandas(cut, f"{kinds}, cn int")
    return out.withColumn("cn", F.when(F.col(gene) == reference, 2).otherwise(F.col("cn")))


def bins_by_threshold(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    return df.withColumn("cn", right_closed_bin(F.col(value), edges))
