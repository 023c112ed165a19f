"""Exact rounding on integers, so every engine agrees on ties."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def div_round(num: Column, den: Column) -> Column:
    """Nearest integer to num/den for num >= 0, den > 0; ties go to the even one."""
    num, den = num.cast("bigint"), den.cast("bigint")
    safe = F.when(den > 0, den)  # ANSI mode: no division by zero
    quotient = F.floor((num - num % safe) / safe).cast("bigint")
    twice = (num % safe) * 2
    up = (twice > safe) | ((twice == safe) & (quotient % 2 == 1))
    return quotient + up.cast("bigint")


def tenths(ms: Column) -> Column:
    """Milliseconds to tenths of a second."""
    return div_round(ms, F.lit(100))


def centis(ms: Column) -> Column:
    """Milliseconds rounded to hundredths of a second, still in milliseconds."""
    return div_round(ms, F.lit(10)) * 10
