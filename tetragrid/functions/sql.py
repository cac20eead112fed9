"""The library's functions under names that SQL knows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.fcgr import cell_names, window_cells
from ..operators.point import bits_to_float, bits_to_fraction, float_to_bits
from .bases import chi_square_p

#: Bytes of UTF-8 that are no bases; those of other characters are all among them.
_NO_BASES = bytes(set(range(256)) - set(b"ACGT"))


class KmerWindows:
    """kmer_windows(seq, k): a row (z, cnt) for each cell of a sequence; none for a null or one without bases."""

    def eval(self, seq: str, k: int) -> Iterator[tuple[str, int]]:
        if seq is not None and k is not None and (bases := seq.upper().encode("utf-8", "surrogatepass").translate(None, _NO_BASES).decode()):
            cells, counts = window_cells(bases, k)
            yield from zip(cell_names(cells, k).to_pylist(), counts.tolist(), strict=True)


@F.pandas_udf(StringType())
def _from_float(values: pd.Series, precision: pd.Series) -> pd.Series:
    out = pd.Series([None] * len(values), dtype=object)
    for p in precision.dropna().unique():
        at = precision.eq(p) & values.notna()
        out[at] = float_to_bits(int(p)).func(values[at])
    return out


def register(spark: SparkSession) -> None:
    """kmer_windows as a table function; cgr_bits, cgr_to_float, cgr_to_fraction, cgr_from_float and chi_square_p as functions of this session.

    cgr_bits(seq, precision, axis) is plain SQL: the binary places of the end
    point's x or y.
    """
    spark.udtf.register("kmer_windows", F.udtf(KmerWindows, returnType="z string, cnt bigint"))
    for name, function in (("cgr_to_float", bits_to_float), ("cgr_to_fraction", bits_to_fraction), ("cgr_from_float", _from_float), ("chi_square_p", chi_square_p)):
        spark.udf.register(name, function)
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION cgr_bits(seq STRING, places INT, axis STRING) RETURNS STRING RETURN
        translate(reverse(right(repeat('A', places) || 'G' || coalesce(regexp_replace(upper(seq), '[^ACGT]', ''), ''), places)), 'ATCG', CASE axis WHEN 'x' THEN '0011' ELSE '0101' END)
    """)
