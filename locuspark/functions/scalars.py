"""Scalar expressions that Spark has no single function for."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits of an alignment's flag.
PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, FIRST, SECOND, SECONDARY, DUPLICATE, SUPPLEMENTARY = 2, 4, 8, 16, 64, 128, 256, 1024, 2048


def has_flag(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(F.lit(bits)) != 0


def normal_pdf(x: Column, mean: Column, sd: Column) -> Column:
    z = (x - mean) / sd
    return F.exp(-0.5 * z * z) / (sd * math.sqrt(2 * math.pi))


def half_even(x: Column) -> Column:
    return F.bround(x, 0)


def right_closed_bin(x: Column, edges: list[float]) -> Column:
    """1, 2, ... for (e0, e1], (e1, e2], ...; 0 outside and for null."""
    out = F.lit(0)
    for i in range(len(edges) - 1, 0, -1):
        out = F.when((x > edges[i - 1]) & (x <= edges[i]), i).otherwise(out)
    return F.when(x.isNull() | F.isnan(x), 0).otherwise(out)


def equal_width_bin(x: Column, bins: int, high: Column) -> Column:
    """0-based bin of [0, high] in so many bins; the right edge belongs to the last; null outside."""
    i = F.floor(x * bins / high).cast("int")
    return F.when((x >= 0) & (x <= high), F.least(i, F.lit(bins - 1)))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def substituted(seq: Column, pos: Column, base: Column) -> Column:
    """seq with the base at a 0-based position replaced."""
    return F.overlay(seq, base, pos + 1, F.lit(1))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0 or null."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def common_name(a: Column, b: Column) -> Column:
    """The parts between dots that two names begin with alike."""
    x, y = F.split(a, r"\."), F.split(b, r"\.")
    same = F.transform(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: F.coalesce(p["x"] == p["y"], F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.array_join(F.slice(x, F.lit(1), F.when(first == 0, F.size(x)).otherwise(first - 1).cast("int")), ".")


def escaped_name(name: Column) -> Column:
    """A path as one word: slashes and dots become underscores."""
    return F.translate(name, "/.", "__")


def in_folder(path: Column, folder: Column) -> Column:
    """The file of a path in another folder."""
    return F.concat_ws("/", F.rtrim(folder, F.lit("/")), F.element_at(F.split(path, "/"), -1))


def id_from_pattern(name: Column, pattern: str) -> Column:
    """What stands for {} in a pattern of a file's name; null where the name doesn't fit."""
    import re

    parts = [re.escape(p) for p in pattern.split("{}")]
    found = F.regexp_extract(name, "^" + "(.*)".join(parts[:2]) + "".join(f"(?:.*){p}" for p in parts[2:]) + "$", 1)
    return F.when(name.rlike("^" + "(.*)".join(parts) + "$"), found)
