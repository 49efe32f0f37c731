"""The older rule of islands against a fold over rows in order, for groups over many ranges."""

import random

import pytest

from locuspark.operators import series


def folded(rows, max_gap):
    """(first, last, sum) of islands: the row that breaks one off belongs to none, and the next one begins another."""
    out, at = [], None
    for p, d in sorted(rows):
        if at is None:
            at = [p, p, d]
        elif p - at[1] < max_gap:
            at = [at[0], p, at[2] + d]
        else:
            out.append(tuple(at))
            at = None
    return out + ([tuple(at)] if at else [])


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_islands_by_the_older_rule(spark, parts):
    rng = random.Random(9)
    groups = {}
    for g, n in (("a", 400), ("b", 30), (None, 50), ("one", 1)):
        p, rows = 0, []
        for _ in range(n):
            p += rng.choice([0, 1, 5, 9, 10, 11, 30])
            rows.append((p, rng.randint(1, 9)))
        groups[g] = rows
    groups["far"] = [(100 * i, 1) for i in range(61)]  # every row lies beyond a gap
    df = spark.createDataFrame([(g, *r) for g, rows in groups.items() for r in rows], "g string, pos int, depth int").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        found = series.legacy_islands(df, ["g"], "pos", "depth", 10).groupBy("g", "island").agg({"pos": "min", "depth": "sum", "*": "count"}).collect()
        regions = series.legacy_regions(df, ["g"], "pos", "depth", min_depth=0.3, min_length=8, max_gap=10).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for g, rows in groups.items():
        want = folded(rows, 10)
        assert [(r["min(pos)"], r["sum(depth)"]) for r in sorted((r for r in found if r["g"] == g), key=lambda r: r["island"])] == [(a, d) for a, _, d in want]
        long = [(a, b, b - a, d / (b - a)) for a, b, d in want if b - a >= 8 and d / (b - a) >= 0.3]
        assert sorted((r["first"], r["last"], r["length"], r["mean_depth"]) for r in regions if r["g"] == g) == sorted(long)


def test_no_rows(spark):
    assert series.legacy_regions(spark.createDataFrame([], "g string, pos int, depth int"), ["g"], "pos", "depth").count() == 0
