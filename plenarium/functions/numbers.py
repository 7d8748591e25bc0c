"""Number rules."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def round2(x: Column) -> Column:
    """Two decimal places of the double itself; ``round(x, 2)`` would round its decimal text."""
    return F.round(x * 100) / 100


def number_of(text: Column) -> Column:
    """Blank as 0, what isn't a number as NaN."""
    return F.when(F.trim(text) == "", 0.0).otherwise(F.coalesce(F.trim(text).try_cast("double"), F.lit(float("nan"))))


def count_of(text: Column) -> Column:
    """A count as long; missing, blank and unreadable as 0."""
    value = number_of(F.coalesce(text, F.lit("")))
    return F.when(F.isnan(value), 0).otherwise(value).cast("long")


def to_fixed(places: int):
    """Decimal text of the exact binary value, ties away from zero; a UDF, as Spark's decimals start from the shortest text."""

    @F.pandas_udf("string")
    def fixed(values: pd.Series) -> pd.Series:
        step = Decimal(1).scaleb(-places)
        return values.map(lambda v: None if pd.isna(v) else str(Decimal(v).quantize(step, ROUND_HALF_UP)))

    return fixed


def locale_int(x: Column) -> Column:
    return F.format_number(x, 0)


def shown_float(x: Column) -> Column:
    """Shortest text of a double, whole ones without a decimal point."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def signed(x: Column) -> Column:
    return F.when(x > 0, F.concat(F.lit("+"), shown_float(x))).otherwise(shown_float(x))


def share(part: Column, whole: Column) -> Column:
    """Per cent, 0 of nothing."""
    return part / F.greatest(whole, F.lit(1)) * 100
