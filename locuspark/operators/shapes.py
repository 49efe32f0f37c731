"""Reshaping of tables and joins by position or prefix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def melted(df: DataFrame, ids: list[str], values: list[str], name: str, value: str, *, keep_null: bool = True) -> DataFrame:
    """ids, name, value: a row for each of the columns; nulls stay unless keep_null is off."""
    out = df.unpivot(ids, values, name, value)
    return out if keep_null else out.filter(F.col(value).isNotNull())


def grouped_lists(df: DataFrame, by: list[str], value: str, name: str = "values") -> DataFrame:
    """by, name: all values of a group, sorted, repeats included."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias(name))


def lists_by_column(df: DataFrame, by: list[str], column: str, values: list[str], value: str) -> DataFrame:
    """by and a column for each of the values, with the sorted list of what falls there; empty where nothing does."""
    wide = df.groupBy(*by).pivot(column, values).agg(F.array_sort(F.collect_list(value)))
    empty = F.array().cast(f"array<{df.schema[value].dataType.simpleString()}>")
    return wide.select(*by, *(F.coalesce(F.col(f"`{v}`"), empty).alias(v) for v in values))


def transposed(df: DataFrame, row: str, columns: list[str], rows: list[str], name: str) -> DataFrame:
    """name and a column for each of rows: what stood in a row and column now stands in that column and row."""
    wide = df.unpivot([row], columns, name, "_v").groupBy(name).pivot(row, rows).agg(F.first("_v", ignorenulls=True))
    return wide.select(name, *(F.col(f"`{r}`").alias(r) for r in rows))


def stacked(df: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """ids, name, value of what isn't null, as from a table whose columns are an inner level of its index."""
    return melted(df, ids, columns, name, value, keep_null=False)


def reindexed(df: DataFrame, columns: list[str], missing: str = "NA") -> DataFrame:
    """The given columns as text, in their order; what a row or the table lacks is missing."""
    return df.select(*(F.coalesce(F.col(f"`{c}`").cast("string") if c in df.columns else F.lit(None).cast("string"), F.lit(missing)).alias(c) for c in columns))


def sorted_by(df: DataFrame, *order: Column) -> DataFrame:
    """Rows in a total order over all partitions; names of mates that are equal lie side by side."""
    return df.orderBy(*order)


def joined_names(df: DataFrame, by: list[str], name: str, *, separator: str = "_", as_name: str = "names") -> DataFrame:
    """by, n, as_name: a group's distinct names, sorted and joined, and its rows."""
    found = df.groupBy(*by).agg(F.array_sort(F.collect_set(name)).alias("_names"), F.count("*").alias("n"))
    return found.select(*by, F.array_join("_names", separator).alias(as_name), "n")


def outer_counts(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Both sides by key, 0 where a side lacks one; keys that are 0 throughout go."""
    both = a.join(b, keys, "full_outer").na.fill(0, values)
    return both.filter(reduce(lambda x, y: x | y, (F.col(v) != 0 for v in values)))


def with_model(raw: DataFrame, model: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """raw with the model's columns by key; rows that the model lacks keep nulls."""
    return raw.join(model.select(*keys, *columns).dropDuplicates(keys), keys, "left")


def joined_in_order(a: DataFrame, b: DataFrame, by: list[str], a_order: list[str], b_order: list[str]) -> DataFrame:
    """The n-th row of a group on one side with the n-th on the other, in each side's order; what has no partner goes."""
    number = lambda df, order: df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return number(a, a_order).join(number(b, b_order), [*by, "_n"]).drop("_n")


def joined_by_prefix(df: DataFrame, name: str, prefixes: DataFrame, prefix: str, value: str, order: str) -> DataFrame:
    """df with the value of the last prefix, in order, that its name begins with; null where none does.

    Names meet prefixes by their own beginnings, of those lengths that prefixes have, so no pair is tried in vain.  An
    empty prefix fits every name.
    """
    found = prefixes.filter(F.col(prefix).isNotNull()).select(F.col(prefix).alias("_p"), F.struct(F.col(order).alias("o"), F.col(value).alias("v")).alias("_s")).groupBy("_p").agg(F.max("_s").alias("_s"))
    lengths = found.agg(F.array_sort(F.collect_set(F.length("_p"))).alias("_lengths"))  # one row
    names = df.select(name).distinct().crossJoin(F.broadcast(lengths))
    starts = names.select(name, F.explode(F.transform(F.filter("_lengths", lambda n: n <= F.length(name)), lambda n: F.substring(F.col(name), F.lit(1), n))).alias("_p"))
    best = starts.join(found, "_p").groupBy(name).agg(F.max("_s").alias("_s")).select(F.col(name).alias("_name"), F.col("_s.v").alias(value))
    return df.join(best, F.col(name) == F.col("_name"), "left").drop("_name")


def set_operations(a: DataFrame, b: DataFrame) -> dict[str, DataFrame]:
    """Distinct rows of only a, of both, and of either."""
    return {"except": a.subtract(b), "intersect": a.intersect(b), "union": a.union(b).distinct()}


def nested_mean(df: DataFrame, by: list[str], text: str, path: str, kind: str) -> DataFrame:
    """by, n, mean of a number in JSON text; rows without it count in n only."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.get_json_object(text, path).cast(kind)).alias("mean"))


def word_counts(df: DataFrame, by: list[str], text: str, separators: str) -> DataFrame:
    """by, word, n of a text's pieces between separators, empty ones left out."""
    words = F.filter(F.split(text, separators), lambda x: x != "")
    return df.select(*by, F.explode(words).alias("word")).groupBy(*by, "word").agg(F.count("*").alias("n"))
