"""Joining weighted keys of many rows to a table with one row per key, whatever the frequency of a key.

Keys whose share of all cells is large are sent to every task: a key is one of those *heads* if
``cells * size >= total / HEAD_BYTES``, summed over all keys.  The heads together then hold at most ``HEAD_BYTES`` bytes,
because the sum of ``cells * size`` over all keys is the total.  The other keys are rare by the same rule and are
joined by a shuffle in which no key is hot.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD_BYTES = 8 << 20
ROW_BYTES = 32  # of a head beside its key's own bytes


def sum_by_row(
    cells: DataFrame, table: DataFrame, key: str, df: str, size: Column, sums: Mapping[str, Column], row: str = "_row",
    head_bytes: int = HEAD_BYTES,
) -> DataFrame:
    """``row`` and the sums over its cells (rows of ``cells``: ``row``, ``key``, ...) of expressions over both tables.

    ``table`` has one row per key, with the number of cells in column ``df``; ``size`` is the key's bytes.  Both should
    be written tables: they are read twice.  Rows without cells do not come back.
    """
    bytes_of = F.col(df) * (size + ROW_BYTES)
    total = table.agg(F.coalesce(F.sum(bytes_of), F.lit(0))).first()[0]
    # Head: its cells alone are worth total / head_bytes for each of its own bytes, so all heads fit head_bytes.
    is_head = F.col(df) * F.lit(head_bytes) >= F.lit(total)
    heads = table.filter(is_head)
    known = F.broadcast(heads.select(key).withColumn("_head", F.lit(True)))
    partial = {name: F.sum(c).alias(name) for name, c in sums.items()}
    often = cells.join(F.broadcast(heads), key).groupBy(row).agg(*partial.values())
    rare = cells.join(known, key, "left_anti").join(table.filter(~is_head), key).groupBy(row).agg(*partial.values())
    return often.unionByName(rare).groupBy(row).agg(*[F.sum(name).alias(name) for name in sums])
