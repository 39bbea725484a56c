"""Exact arithmetic: averages, shares and ratios over decimals, so results do not depend on summation order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = "decimal(18,2)"


def exact_ratio(
    numerator: Column, denominator: Column, scale: int, numerator_scale: int = 0, whole_digits: int = 19
) -> Column:
    """``numerator / denominator`` rounded half up; NULL where the denominator is zero.

    Both are cast so that the decimal quotient keeps ``38 - whole_digits`` fractional digits before the one visible rounding;
    ``whole_digits`` are those of the numerator.
    """
    top = numerator.cast(f"decimal({whole_digits + numerator_scale},{numerator_scale})")
    return F.round(F.try_divide(top, denominator.cast("decimal(19,0)")), scale)


def money_average(total: Column, count: Column) -> Column:
    """Average of a money column from its sum and count, with six fractional digits."""
    return exact_ratio(total, count, 6, numerator_scale=2)


def percentage(part: Column, whole: Column) -> Column:
    """Share in per cent with two fractional digits, for whole-number operands."""
    return exact_ratio(part * 100, whole, 2)


def count_average(column: Column) -> Column:
    """Average of a whole-number column with four fractional digits."""
    return F.avg(column.cast("decimal(19,0)"))


PRICE = "decimal(18,4)"


def price_units(amount: Column) -> Column:
    """A price, which counts with four decimals, as a whole number of ten-thousandths."""
    return (amount.cast(PRICE) * 10_000).cast("bigint")


def sum_of_units(units: Column) -> Column:
    """Exact sum of whole numbers of ten-thousandths, as a decimal.

    The high and low 20 bits are summed apart as longs: as exact as a decimal sum and without its cost per row, and no
    overflow below 2**43 rows.
    """
    high = F.sum(F.shiftright(units, 20)).cast("decimal(38,0)")
    low = F.sum(units.bitwiseAND((1 << 20) - 1))
    return ((high * (1 << 20) + low) * F.lit("0.0001").cast("decimal(4,4)")).cast("decimal(38,4)")


def decimals_as_double(df: DataFrame) -> DataFrame:
    """Decimal columns as doubles, the form reports carry; sums stay exact up to here."""
    return df.select(
        *[
            F.col(f"`{field.name}`").cast("double").alias(field.name)
            if isinstance(field.dataType, T.DecimalType)
            else F.col(f"`{field.name}`")
            for field in df.schema.fields
        ]
    )
