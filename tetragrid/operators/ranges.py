"""Ranges of sorted rows, by literals: what is computed twice from them agrees."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sampled rows for each range, about.
SAMPLE = 20


def ranged(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with _part: the place, in the order of keys, of the range of its keys; a null comes first, rows with equal keys share a range.

    The sample is taken by a threshold of a hash of the keys, so what a key
    weighs in it does not grow with its rows.  A row is compared with about as
    many borders as the root of their number, twice.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = F.expr(f"shiftrightunsigned(xxhash64({', '.join(f'`{k}`' for k in keys)}), 11)")
    count = rows.count()
    share = 1.0 if count <= SAMPLE * parts else SAMPLE * parts / count
    seen = rows.select(*keys).where(hashed < F.lit(math.ceil(share * (1 << 53)))).distinct().collect()
    seen = sorted(seen, key=lambda r: [(v is not None, v) if v is not None else (False,) for v in r])
    kinds = [rows.schema[k].dataType for k in keys]
    borders = list(dict.fromkeys(tuple(seen[i * len(seen) // parts]) for i in range(1, parts))) if seen else []
    if not borders:
        return rows.withColumn("_part", F.lit(0))
    key = lambda values: F.struct(*(v.cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(values, kinds, strict=True))))
    own = key([F.col(k) for k in keys])
    below = lambda some: F.size(F.filter(some, lambda b: b <= own))
    literals = lambda some: F.array(*(key(list(map(F.lit, b))) for b in some))
    width = math.isqrt(len(borders) - 1) + 1
    groups = [borders[i : i + width] for i in range(0, len(borders), width)]
    at = below(literals([g[0] for g in groups]))
    inside = below(F.element_at(F.array(*map(literals, groups)), F.greatest(at, F.lit(1))))
    return rows.withColumn("_part", F.when(at == 0, 0).otherwise((at - 1) * width + inside))
