"""Columns over base strings.

A cell is named by base-4 digits, newest base first (A 0, T 1, C 2, G 3), so the
first d digits name the cell of a grid of side 2^d that holds it.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

MANTISSA_BITS = 53


def clean(seq: Column) -> Column:
    """Upper-cased, with everything but A, C, G, T left out; null is empty."""
    return F.coalesce(F.regexp_replace(F.upper(seq), "[^ACGT]", ""), F.lit(""))


def padding(k: int) -> str:
    """Stands for the centre point before the first base."""
    return "A" * (k - 2) + "G" if k > 1 else ""


def carry_pattern(k: int) -> str:
    """Only a run this long can round a float64 walk over a cell's border."""
    run = MANTISSA_BITS - k
    return f"[CG]{{{run},}}|[GT]{{{run},}}"


def digits(bases: Column) -> Column:
    return F.translate(F.reverse(bases), "ATCG", "0123")


def row_major(z: Column, k: int) -> Column:
    """Index of a cell in the flattened grid: the x bits, then the y bits."""
    bits = lambda to: F.conv(F.translate(z, "0123", to), 2, 10).cast("long")
    return bits("0011") * (2**k) + bits("0101")


def z_order(z: Column) -> Column:
    return F.when(F.length(z) == 0, F.lit(0)).otherwise(F.conv(z, 4, 10).cast("long")).cast("long")


def chi_square_tail(x: float) -> float:
    """Upper tail of the chi-square distribution with three degrees of freedom."""
    return math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2)


@F.pandas_udf(DoubleType())
def chi_square_p(statistic: pd.Series) -> pd.Series:
    """The tail as a column, to be shown; splits compare the statistic with a literal instead."""
    return statistic.map(chi_square_tail, na_action="ignore")


def critical_value(p: float) -> float:
    """The statistic above which the tail is below p: a literal of the plan."""
    if p <= 0:
        return math.inf
    if p > 1:
        return -1.0
    if p == 1:
        return 0.0
    low, high = 0.0, 1.0
    while chi_square_tail(high) > p:
        high *= 2
    while low < (middle := (low + high) / 2) < high:
        low, high = (middle, high) if chi_square_tail(middle) > p else (low, middle)
    return high


def require_power_of_two(grid_size: int, depth: int) -> None:
    if grid_size < 1 or grid_size & (grid_size - 1):
        raise ValueError(f"grid_size must be a power of two, not {grid_size}")
    if grid_size < 2**depth:
        raise ValueError(f"grid_size {grid_size} is below 2^{depth}")
