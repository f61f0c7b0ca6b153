"""Dates, arrays and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.text import col


def iso_utc(ts: Column | str) -> Column:
    """ISO-8601 with milliseconds, for sessions whose time zone is UTC."""
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'")


def parsed_time(text: Column | str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """The time, or null where the text has another form."""
    return F.try_to_timestamp(col(text), F.lit(pattern))


def pieces(items: Column | str, size: int) -> Column:
    """An array cut in arrays of at most size."""
    if size <= 0:
        raise ValueError("size must be positive")
    n = F.size(col(items))
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(n / size), F.lit(1)).cast("int") - 1)
    return F.when(n > 0, F.transform(starts, lambda i: F.slice(col(items), i * size + 1, F.lit(size)))).otherwise(F.array())


def squares(items: Column | str) -> Column:
    return F.transform(col(items), lambda x: x * x)


def evens(items: Column | str) -> Column:
    return F.filter(col(items), lambda x: x % 2 == 0)


def total(items: Column | str) -> Column:
    return F.aggregate(col(items), F.lit(0).cast("long"), lambda a, x: a + x)


def ordered_distinct(items: Column | str) -> Column:
    """Without repeats, first seen first."""
    return F.array_distinct(col(items))


def zipped(keys: Column, values: Column) -> Column:
    return F.map_from_arrays(keys, values)


def best_key(scores: Column) -> Column:
    """The key of a map's greatest value; the least such key."""
    entries = F.transform(F.map_entries(scores), lambda e: F.struct(-e["value"], e["key"].alias("key")))
    return F.array_min(entries)["key"]


def stringified(metadata: Column) -> Column:
    """A map with keys and values as strings."""
    return F.transform_values(metadata, lambda _, v: v.cast("string"))


def is_superset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(b, a)) == 0


def body_mass_index(kilograms: Column, metres: Column) -> Column:
    return F.round(F.try_divide(kilograms, metres * metres), 2)


def fibonacci(n: int) -> Column:
    """The first n numbers, as an array."""
    pair = F.aggregate(F.sequence(F.lit(1), F.lit(max(n, 1))), F.array(F.lit(0).cast("long"), F.lit(1).cast("long")), lambda a, _: F.concat(a, F.array(F.element_at(a, -1) + F.element_at(a, -2))))
    return F.slice(pair, 1, n)
