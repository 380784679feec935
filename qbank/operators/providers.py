"""Readings of the same rows by several named providers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A provider turns an input column into a reading: built-in functions or a pandas UDF.
Provider = Callable[[Column], Column]


def requested(names: str | None, providers: dict[str, Provider]) -> list[str]:
    """The providers named in a list with commas; none or ``all`` means every one, an unknown one is an error."""
    wanted = [x.strip().lower() for x in (names or "").split(",") if x.strip()]
    if wanted in ([], ["all"]):
        return list(providers)
    if unknown := [x for x in wanted if x not in providers]:
        raise ValueError(f"unknown providers: {', '.join(unknown)}")
    return wanted


def readings(df: DataFrame, column: str, providers: dict[str, Provider], names: str | None = None) -> DataFrame:
    """``df`` once for each requested provider, with ``provider`` and ``reading``; a map over the rows, without a shuffle."""
    each = [df.withColumns({"provider": F.lit(x), "reading": providers[x](F.col(column))}) for x in requested(names, providers)]
    return reduce(DataFrame.unionByName, each)
