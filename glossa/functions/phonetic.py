"""Phonetic coordinates, roles, deltas and factorial-base digits as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from glossa.functions.dims import UNKNOWN, coordinates

_HOLE = "\u0001"
NOT_KNOWN = "[^" + "".join("\\" + x if not x.isalnum() else x for x in coordinates()) + "]"


def _translated(c: Column, at: int, base: int) -> Column:
    """Each character as chr(base + class) or chr(base + place)."""
    table = coordinates()
    known = "".join(table)
    c = F.regexp_replace(F.lower(c), NOT_KNOWN, _HOLE)
    return F.translate(c, known + _HOLE, "".join(chr(base + v[at]) for v in table.values()) + chr(base + UNKNOWN[at]))


def class_string(c: Column) -> Column:
    """Classes 0-6 of the characters as a string of digits."""
    return _translated(c, 0, 48)


def place_string(c: Column) -> Column:
    """Places of the characters, each as the character 48 further on."""
    return _translated(c, 1, 48)


def characters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def decoded(classes: Column, places: Column) -> Column:
    """The characters of a class_string and its place_string; ? for coordinates that have none."""
    table = F.create_map(*[F.lit(x) for c, (k, p) in coordinates().items() for x in (chr(48 + k) + chr(48 + p), c)])
    pairs = F.arrays_zip(characters(classes).alias("k"), characters(places).alias("p"))
    return F.array_join(F.transform(pairs, lambda x: F.coalesce(F.try_element_at(table, F.concat(x["k"], x["p"])), F.lit("?"))), "")


def role(i: Column, n: Column) -> Column:
    """0 first, 1 inside, 2 last, 3 the only one; i from 0. Lengths under 1 give null."""
    return F.when(n < 1, F.lit(None).cast("int")).when(n == 1, 3).when(i <= 0, 0).when(i >= n - 1, 2).otherwise(1)


def triples(c: Column) -> Column:
    """array<struct<cls, pos, role>> of a string, roles by its length."""
    classes, places = characters(class_string(c)), characters(place_string(c))
    n = F.size(classes)
    return F.transform(F.arrays_zip(classes.alias("k"), places.alias("p")), lambda x, i: F.struct(x["k"].cast("int").alias("cls"), (F.ascii(x["p"]) - 48).alias("pos"), role(i, n).alias("role")))


def deltas(a: Column) -> Column:
    """First value as it is, then differences; of an array of numbers."""
    return F.zip_with(a, F.slice(F.concat(F.array(F.lit(0)), a), F.lit(1), F.size(a)), lambda x, y: x - y)


def running_sums(a: Column) -> Column:
    """The inverse of deltas, in Arrow batches: a fold as an expression would copy the array at each step."""

    @F.pandas_udf("array<int>")
    def sums(v: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else np.cumsum(np.asarray(x, np.int64)) for x in v], dtype="object")

    return sums(a)


def factoradic(v: Column) -> Column:
    """Factorial-base digits, most significant first; 0 is [0], a negative has -1 in front."""
    n = F.abs(v).cast("long")
    size = sum(((n >= f).cast("int") for f in _factorials()), F.lit(1))
    digits = F.transform(F.sequence(size, F.lit(1), F.lit(-1)), lambda j: (F.call_function("div", n, F.factorial((j - 1).cast("int"))) % j).cast("int"))
    whole = F.when(n == 0, F.array(F.lit(0))).otherwise(digits)
    return F.when(v < 0, F.concat(F.array(F.lit(-1)), whole)).otherwise(whole)


def _factorials() -> list[int]:
    out, f = [], 1
    for i in range(1, 21):
        out.append(f)
        f *= i + 1
    return out


def from_factoradic(d: Column) -> Column:
    """The inverse of factoradic; null for no digits."""
    sign = F.when(F.element_at(d, 1) == -1, -1).otherwise(1)
    rest = F.when(F.element_at(d, 1) == -1, F.slice(d, F.lit(2), F.size(d) - 1)).otherwise(d)
    total = F.aggregate(F.transform(rest, lambda x, i: x * F.factorial(F.size(rest) - 1 - i)), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(F.size(d) > 0, sign * total)
