"""Exact end point of the walk: its P bits per axis are the last P bases, padded by the centre point."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions.bases import clean

PRECISION_BITS = 512
LEVELS = (64, 128, 256, 512, 1024)


def point_bits(bases: Column, precision: int = PRECISION_BITS) -> tuple[Column, Column]:
    last = F.reverse(F.substring(F.concat(F.lit("A" * precision + "G"), bases), -precision, precision))
    return F.translate(last, "ATCG", "0011"), F.translate(last, "ATCG", "0101")


def final_point(seqs: DataFrame, precision: int = PRECISION_BITS, *, id_col: str = "doc_id", seq_col: str = "text") -> DataFrame:
    """(id, precision_bits, x_bits, y_bits, iterations) of each sequence; one without bases is at the centre."""
    rows = seqs.select(F.col(id_col).alias("id"), clean(F.col(seq_col)).alias("b"))
    x, y = point_bits(F.col("b"), precision)
    return rows.select("id", F.lit(precision).alias("precision_bits"), x.alias("x_bits"), y.alias("y_bits"), F.length("b").cast("long").alias("iterations"))


def point_stats(points: DataFrame) -> DataFrame:
    """Bits in use.  What is called remaining is the run of A that the sequence ends with, at most the precision."""
    used = lambda c: F.length(F.ltrim(c, F.lit("0"))).cast("int")
    remaining = F.col("precision_bits") - F.greatest("x_used_bits", "y_used_bits")
    rows = points.select("id", "iterations", "precision_bits", used(F.col("x_bits")).alias("x_used_bits"), used(F.col("y_bits")).alias("y_used_bits"))
    return rows.withColumn("precision_remaining", remaining).withColumn("can_handle_more", F.lit(True))


def precision_levels(seqs: DataFrame, *, id_col: str = "doc_id", seq_col: str = "text") -> DataFrame:
    """The bits left at each level, from one cleaned pass; OK where more than ten are."""
    tail = F.length(F.regexp_extract("b", "A*$", 0))
    rows = seqs.select(F.col(id_col).alias("id"), clean(F.col(seq_col)).alias("b"))
    # without another base the centre's own digit is the last one that is not A
    rows = rows.select("id", F.when(F.col("b") == "", 0).otherwise(tail).alias("tail"), F.explode(F.array(*map(F.lit, LEVELS))).alias("precision_bits"))
    left = F.least("tail", "precision_bits").cast("int")
    return rows.select("id", "precision_bits", left.alias("precision_remaining"), F.when(left > 10, "OK").otherwise("LOW").alias("status"))


@F.pandas_udf(DoubleType())
def bits_to_float(bits: pd.Series) -> pd.Series:
    """The correctly rounded value of a string of binary places; it may round to 1."""
    return bits.map(lambda b: int(b, 2) / (1 << len(b)) if b else 0.0)


@F.pandas_udf(StructType([StructField("numerator", StringType()), StructField("denominator", StringType())]))
def bits_to_fraction(bits: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"numerator": bits.map(lambda b: str(int(b, 2))), "denominator": bits.map(lambda b: str(1 << len(b)))})


def float_to_bits(precision: int = PRECISION_BITS):
    """A function from a number in [0, 1) to its binary places; a precision of 1024 or more overflows."""
    scale = float(2**precision) if precision < 1024 else None

    @F.pandas_udf(StringType())
    def convert(values: pd.Series) -> pd.Series:
        if scale is None:
            raise OverflowError("precision must be below 1024")
        return values.map(lambda v: format(int(v * scale), f"0{precision}b"))

    return convert


def updated(bits: Column, vertex: Column) -> Column:
    """A coordinate's bits after one step toward a vertex coordinate, 0 or 1."""
    return F.concat(vertex.cast("int").cast("string"), F.substring(bits, F.lit(1), F.length(bits) - 1))


@F.pandas_udf(StringType())
def ten_decimals(values: pd.Series) -> pd.Series:
    """Ten decimals of the exact value, a tie to the even digit; Spark's own format rounds ties up."""
    return values.map("{:.10f}".format)


def shown(points: DataFrame) -> DataFrame:
    """The point as text with ten decimals; the format is a fixed value."""
    side = lambda c: ten_decimals(bits_to_float(c))
    return points.withColumn("point", F.format_string("CGRPointPrecise(x=%s, y=%s, bits=%d)", side("x_bits"), side("y_bits"), "precision_bits"))
