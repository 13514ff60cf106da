"""Strings: natural order, key paths, pose rows and key-value records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def natural_key(s: Column) -> Column:
    """A sort key: lower-cased pieces in turn with digit runs, which compare as whole numbers of up to 20 digits."""
    low = F.lower(s)
    words = F.split(low, "[0-9]+")
    digits = F.transform(F.regexp_extract_all(low, F.lit("([0-9]+)"), F.lit(1)), lambda d: F.lpad(F.regexp_replace(d, "^0+(?=.)", ""), 20, "0"))
    return F.flatten(F.zip_with(words, F.concat(digits, F.array(F.lit(""))), lambda t, d: F.array(t, d)))


def floats(s: Column) -> Column:
    """The whitespace-separated numbers of a line; null where one isn't a number."""
    return F.transform(F.filter(F.split(s, "\\s+"), lambda x: x != ""), lambda x: x.try_cast("double"))


def pose_line(row: Column) -> Column:
    """Twelve numbers joined by spaces."""
    return F.array_join(F.transform(row, lambda x: x.cast("string")), " ")


def key_values(s: Column) -> Column:
    """name = value; records of a text as a map of strings; brackets stay in the values; the last of equal names counts."""
    pairs = F.transform(F.regexp_extract_all(s, F.lit(r"(?m)^\s*(\w+\s*=\s*(?:\[[^\]]*\]|[^;\n]*))"), F.lit(1)), lambda p: F.split(p, "\\s*=\\s*", 2))
    last = F.aggregate(pairs, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p[0]), F.create_map(p[0], F.trim(p[1]))))
    return last


def bracket_numbers(s: Column) -> Column:
    return F.transform(F.regexp_extract_all(s, F.lit(r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"), F.lit(1)), lambda x: x.try_cast("double"))


def human_time(seconds: Column) -> Column:
    """Minutes above a minute, seconds otherwise, with two decimals."""
    return F.when(seconds > 60, F.format_string("%4.2f min", seconds / 60)).otherwise(F.format_string("%4.2f s", seconds))


def title(s: Column) -> Column:
    return F.initcap(F.replace(s, F.lit("_"), F.lit(" ")))
