"""Sharding by a Feistel permutation of global row numbers, with cycle walking; DataFrame functions only.

Rows are numbered 0..N-1 in the order of (doc_id, checksum, size).  The permutation works on pairs (l, r) with
``l < a``, ``r < b`` and ``a * b`` just above N: rounds add a keyed function of one half to the other.  A number that
lands at N or above walks on until it is below N; fewer than ``sqrt(N)`` numbers have to.  The permuted number gives
the shard (remainder) and the slot (quotient), so both can be computed for any row number, and shard sizes differ by
one row at most.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.textnum import need_columns
from ledgerloom.operators.ordered import number_rows
from ledgerloom.storage import materialize

SHARDS = 16
ROUNDS = 6
PRIME = (1 << 31) - 1
SEED = "shards"


def round_keys(seed: str = SEED) -> list[tuple[int, int, int]]:
    """Multiplier, shift and second multiplier of every round, below PRIME."""
    out = []
    for i in range(ROUNDS):
        digest = hashlib.sha256(f"{seed}:{i}".encode()).digest()
        out.append(tuple(int.from_bytes(digest[k : k + 8], "big") % (PRIME - 1) + 1 for k in (0, 8, 16)))
    return out


def domain(n: int) -> tuple[int, int]:
    """Sides a, b of the smallest grid that holds ``n`` numbers with ``a = ceil(sqrt(n))``."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def permute(x: int, n: int, seed: str = SEED) -> int:
    """The permuted number of row number ``x`` among ``n``: shard and slot of any row without Spark."""
    a, b = domain(n)
    while True:
        left, right = divmod(x, b)
        for i, key in enumerate(round_keys(seed)):
            if i % 2:
                right = (right + _round(left, key)) % b
            else:
                left = (left + _round(right, key)) % a
        x = left * b + right
        if x < n:
            return x


def _round(v: int, key: tuple[int, int, int]) -> int:
    x = (v * key[0] + key[1]) % PRIME
    return (x * x + v) % PRIME * key[2] % PRIME


def _permuted(rows: DataFrame, column: str, n: int, seed: str) -> DataFrame:
    """``rows`` with ``column`` sent once through all rounds."""
    a, b = domain(n)
    rows = rows.withColumns({"_l": F.expr(f"{column} div {b}L"), "_r": F.col(column) % b})
    for i, key in enumerate(round_keys(seed)):
        to, by, size = ("_r", "_l", b) if i % 2 else ("_l", "_r", a)
        x = (F.col(by) * F.lit(key[0]) + F.lit(key[1])) % F.lit(PRIME)
        # A column of its own, so that the next step does not repeat it.
        rows = rows.withColumn("_x", x)
        rows = rows.withColumn(to, (F.col(to) + (F.col("_x") * F.col("_x") + F.col(by)) % F.lit(PRIME) * F.lit(key[2]) % F.lit(PRIME)) % F.lit(size))
    return rows.withColumn(column, F.col("_l") * F.lit(b) + F.col("_r")).drop("_l", "_r", "_x")


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law).

    ``law`` is ``rows``: shard sizes are at most one row apart, slots run from 0 without gaps.  Null text has size 1
    and the checksum of the empty text; rows without ``doc_id`` come first in the numbering; rows that repeat a
    ``doc_id`` are numbered by checksum and size (equal rows may take each other's places).  An empty table gives no
    rows.  Other columns are ignored.
    """
    need_columns(docs, "doc_id", "text")
    narrow = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        text_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32").asc(), F.col("size").asc()]
    numbered = number_rows(narrow, order, name="_n").withColumn("_n", F.col("_n") - 1)
    n = numbered.count()
    done = materialize(_permuted(numbered, "_n", max(n, 1), seed), "permuted")
    pending = done.filter(F.col("_n") >= n)
    result = done.filter(F.col("_n") < n)
    # Cycle walking: fewer than sqrt(n) rows to begin with, and a round sends most of them home.
    while not pending.isEmpty():
        walked = materialize(_permuted(pending, "_n", n, seed), "walked")
        result = result.unionByName(walked.filter(F.col("_n") < n))
        pending = walked.filter(F.col("_n") >= n)
    return result.select(
        "doc_id", "size", "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_n") % shards).cast("int").alias("shard"),
        F.expr(f"_n div {shards}L").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
