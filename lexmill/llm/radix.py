"""Exact ranks by an integer key from hierarchical digit histograms, without a global sort.

Rows fall into cells: the leading digits of the key, taken so that a cell holds
about ROWS_EACH rows of evenly spread keys. A cell of more than LIMIT rows (one
hot key, all null keys, crowded ranges) is split further by the key's other bits,
then by a hash of the row's content, then of its number, so no cell grows with
the input. Counts of cells are summed up digit by digit; every window holds the
children of one prefix. A null key sorts first; equal keys are ordered by content
hash, then row number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a cell of evenly spread keys holds, and rows from which a cell is split.
ROWS_EACH, LIMIT = 256, 1024
#: Bits of a digit above the cells, and below.
HIGH, DEEP = 8, 12


def digits(shift: int, bits: int, step: int) -> list[tuple[int, int]]:
    """(shift, width) of the digits of bits shift..shift+bits-1, the highest first."""
    return [(s, min(step, shift + bits - s)) for s in range(shift, shift + bits, step)][::-1]


def cut(x: Column, at: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(x, at[0]).bitwiseAND(F.lit((1 << at[1]) - 1)).cast("int")


def celled(rows: DataFrame, key: str, content: str, number: str, group: list[str], least_bit: int = 28) -> tuple[DataFrame, list[str]]:
    """rows with the digit columns of their cell, and the names of these.

    `content` is a 64-bit hash of the row, `number` its own number (both without nulls);
    `group` are columns without nulls that are ranked apart. Rows of equal key are told
    apart by content's bits from least_bit on (0 where its order matters), then by number.
    rows are read a few times over, so they should come from a written table.
    """
    n, filled, lo, hi = rows.agg(F.count(F.lit(1)), F.count(key), F.min(key), F.max(key)).first()
    bits = ((lo ^ hi) & (1 << 64) - 1).bit_length() if filled else 0
    low = min(63, max(8, bits - int(math.log2(max(1, n // ROWS_EACH)))))
    k = F.coalesce(F.col(key), F.lit(0)).cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    found = [F.col(key).isNotNull().cast("int")] if filled < n else []
    found += [cut(k, at) for at in digits(low, max(1, bits - low), HIGH)]
    names = [f"_d{i}" for i in range(len(found))]
    rows = rows.withColumns(dict(zip(names, found, strict=True)))
    crowded = rows.groupBy(*group, *names).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LIMIT).select(*group, *names, F.lit(True).alias("_crowded"))
    if crowded.isEmpty():
        return rows, names
    deep = [cut(k, at) for at in digits(0, low, DEEP)] + [cut(F.col(content), at) for at in digits(least_bit, 64 - least_bit, DEEP)] + [cut(F.xxhash64(number), (0, DEEP))]
    more = [f"_d{len(names) + i}" for i in range(len(deep))]
    rows = rows.join(crowded, [*group, *names], "left")
    return rows.withColumns({m: F.when(F.col("_crowded"), x).otherwise(F.lit(0)) for m, x in zip(more, deep, strict=True)}).drop("_crowded"), names + more


def before(rows: DataFrame, group: list[str], names: list[str], weights: dict[str, Column]) -> DataFrame:
    """One row for each cell of rows, with the sum of each weight over the cells before it in its group."""
    level = rows.groupBy(*group, *names).agg(*[F.sum(x).alias(w) for w, x in weights.items()])
    levels = [level]
    for j in range(len(names) - 1, 0, -1):
        level = level.groupBy(*group, *names[:j]).agg(*[F.sum(w).alias(w) for w in weights])
        levels.insert(0, level)
    out = None
    for j, level in enumerate(levels):
        above = [*group, *names[:j]]
        prior = Window.partitionBy(*above).orderBy(names[j]).rowsBetween(Window.unboundedPreceding, -1)
        level = level.select(*above, names[j], *[F.coalesce(F.sum(w).over(prior), F.lit(0)).alias(w) for w in weights])
        if out is not None:
            level = level.join(out.withColumnsRenamed({w: f"_up_{w}" for w in weights}), above)
            level = level.select(*above, names[j], *[(F.col(w) + F.col(f"_up_{w}")).alias(w) for w in weights])
        out = level
    return out


def ranked(rows: DataFrame, key: str, content: str, number: str, group: list[str], least_bit: int = 28) -> DataFrame:
    """rows with `rank`, from 0 in each group, by key, then content, then number."""
    rows, names = celled(rows, key, content, number, group, least_bit)
    at = before(rows, group, names, {"_before": F.lit(1).cast("long")})
    order = (F.col(key).asc_nulls_first(), F.shiftrightunsigned(content, least_bit), F.xxhash64(number).bitwiseAND(F.lit((1 << DEEP) - 1)), content, number)
    inside = Window.partitionBy(*group, *names).orderBy(*order)
    # window and join share one shuffle by cell
    rows = rows.withColumn("_in", F.row_number().over(inside)).join(at, [*group, *names])
    return rows.withColumn("rank", F.col("_before") + F.col("_in") - 1).drop("_in", "_before", *names)
