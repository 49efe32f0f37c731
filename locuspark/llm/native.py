"""Column helpers for operators that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: White space of words: space and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"
#: Values of a block of prefix(), and code points of a chunk of cutter().
BLOCK, CHUNK = 64, 1000
#: Keys whose prefix sums are one window of before().
GROUP = 8192


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: the optimiser can't move it into a lambda that runs for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def indexes(n: Column) -> Column:
    """0 .. n-1; nothing where n is 0."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def prefix(values: Column, zero: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """What combine makes of all values before each: over whole blocks first, so that long arrays don't cost the square."""
    fold = lambda v: F.aggregate(v, zero, combine)

    def over(v: Column) -> Column:
        blocks = F.transform(indexes(F.ceil(F.size(v) / BLOCK)), lambda b: fold(F.slice(v, b * BLOCK + 1, BLOCK)))
        before = lambda s: F.transform(s, lambda _, b: fold(F.slice(s, 1, b)))
        return let(let(blocks, before), lambda base: F.transform(v, lambda _, i: combine(F.get(base, (i / BLOCK).cast("int")), fold(F.slice(v, (i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)))))

    return let(values, over)


def prefix_sums(values: Column) -> Column:
    """The sum of all values before each."""
    return prefix(values, F.lit(0).cast("bigint"), lambda a, b: a + b)


def cutter(text: Column, use: Callable[[Callable[[Column, Column], Column]], Column]) -> Column:
    """use(cut), where cut(a, b) is text[a:b] in code points: from chunks, so that many cuts don't each walk the text."""

    def with_chunks(chunks: Column) -> Column:
        def cut(a: Column, b: Column) -> Column:
            first, last = (a / CHUNK).cast("int"), (b / CHUNK).cast("int")
            part = lambda i, start, n: F.coalesce(F.substring(F.get(chunks, i), start.cast("int"), n.cast("int")), F.lit(""))
            far = F.concat(part(first, a % CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, first + 2, last - first - 1), ""), part(last, F.lit(1), b % CHUNK))
            return F.when(first == last, part(first, a % CHUNK + 1, b - a)).otherwise(far)

        return use(cut)

    return let(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0)), with_chunks)


def before(table: DataFrame, key: str, amount: str, name: str) -> DataFrame:
    """key and name: the sum of amount over all smaller keys, whole numbers from 0 on, each in one row.

    In two levels, so that one task has the sums of GROUP keys each, not the keys.
    """
    group = F.floor(F.col(key) / GROUP).alias("_group")
    rows = table.select(F.col(key), F.col(amount).alias("_amount"), group)
    preceding = lambda w: F.coalesce(F.sum("_amount").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = rows.groupBy("_group").agg(F.sum("_amount").alias("_amount")).select("_group", preceding(W.orderBy("_group")).alias("_base"))
    inside = rows.select(key, "_group", preceding(W.partitionBy("_group").orderBy(key)).alias("_local"))
    return inside.join(groups, "_group").select(key, (F.col("_base") + F.col("_local")).cast("bigint").alias(name))


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], copies: str, by: str, *, most: int) -> DataFrame:
    """rows joined to table on keys; a key with more than ``most`` rows is dealt over several tasks.

    table has a row for each key, with the number of rows that have it in ``copies`` (dropped); by is a stored column of
    rows that tells them apart.  Hot keys are at most one for every ``most`` rows, which is what bounds their broadcast.
    """
    ways = F.ceil(F.col(copies) / most).cast("int")
    hot = table.filter(F.col(copies) > most).select(*(F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)), ways.alias("_ways"))
    if hot.isEmpty():
        return rows.join(table.drop(copies), keys)
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_h{i}")) for i, k in enumerate(keys)))
    salted = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("_ways")), F.lit(0)).cast("int")).drop("_ways", *(f"_h{i}" for i in range(len(keys))))
    spread = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(ways, F.lit(1)) - 1))).drop(copies)
    return salted.join(spread, [*keys, "_salt"]).drop("_salt")


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found>> of leftmost non-overlapping matches, in code points, end exclusive.

    What lies between matches and the matches themselves give the places.  The pattern must not look around it.
    """

    def placed(found: Column, gaps: Column) -> Column:
        lengths = F.transform(found, lambda m, i: (F.length(F.get(gaps, i)) + F.length(m)).cast("bigint"))
        return let(prefix_sums(lengths), lambda base: F.transform(found, lambda m, i: let(F.get(base, i) + F.length(F.get(gaps, i)), lambda s: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("found")))))

    whole = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: let(F.split(text, pattern, -1), lambda gaps: placed(found, gaps)))
    return F.when(text.rlike(pattern), whole).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,found:string>>"))


def words(text: Column) -> Column:
    """Runs of characters other than SPACES."""
    return let(F.btrim(text, F.lit(SPACES)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+", -1)))
