"""Alignment of two tokenizers' tokens over the same bytes, and corpus-wide counts of the id pairs that overlap.

Every text (with a blank before it) is encoded by a byte-level BPE (A) and by a SentencePiece model (B).  The ends of
the tokens are two ascending lists of byte offsets.  They are intersected by galloping: each end of the shorter list
starts in the longer one at its own rank, doubles its step until it is overtaken, and ends with a binary search
in between.  Common ends cut the tokens into groups; the difference between the ranks of a token's two ends is the range of
tokens it overlaps.  A document leaves its task as distinct id pairs with frequencies; the counts of pairs over the
corpus are joined back with hot pairs sent to every task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.bestfit import byte_bpe, encode_texts
from ledgerloom.llm.heads import sum_by_row
from ledgerloom.llm.pretokens import BLANK, encode_pieces, piece_model
from ledgerloom.llm.textnum import blocks, need_columns, ready_for_python
from ledgerloom.storage import materialize

BLOCK = 1 << 20  # bytes of text aligned at once
SHIFT = 1 << 15  # an id pair is a * SHIFT + b, below 2 ** 31

ALIGNED = (
    "struct<n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups:binary,"
    "pairs:array<struct<p:bigint,c:bigint>>>"
)


def gallop(short: np.ndarray, long: np.ndarray, guess: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For every value of ``short`` the first place in ``long[low:high]`` whose value is not smaller (``high`` if none).

    ``long`` ascends between ``low`` and ``high``; the search starts at ``guess``.
    """
    value = np.append(long, np.iinfo(np.int64).max)

    def smaller(at: np.ndarray, which: np.ndarray) -> np.ndarray:
        return value[at] < short[which]

    every = np.arange(len(short))
    guess = np.clip(guess, low, np.maximum(low, high - 1))
    up = (guess < high) & smaller(guess, every)
    # Everything before ``left`` is smaller; nothing at or after ``right`` is.
    left, right = np.where(up, guess + 1, low), np.where(up, high, guess)
    step, live = 1, np.flatnonzero(left < right)
    while len(live):
        forward = up[live]
        probe = np.where(forward, guess[live] + step, guess[live] - step)
        inside = (probe >= left[live]) & (probe < right[live])
        less = smaller(np.clip(probe, 0, len(long)), live)
        go_on = inside & (less == forward)
        left[live] = np.where(inside & less, probe + 1, left[live])
        right[live] = np.where(inside & ~less, probe, right[live])
        live = live[go_on & (left[live] < right[live])]
        step *= 2
    live = np.flatnonzero(left < right)
    while len(live):
        middle = (left[live] + right[live]) // 2
        less = smaller(middle, live)
        left[live] = np.where(less, middle + 1, left[live])
        right[live] = np.where(less, right[live], middle)
        live = live[left[live] < right[live]]
    return left


def _drive(ends: np.ndarray, starts: np.ndarray, others: np.ndarray, other_starts: np.ndarray, rows: np.ndarray):
    """The tokens of ``rows`` drive: their places, and for each the first and last other token it overlaps, and whether
    both end together."""
    count = np.diff(starts)[rows]
    base = np.cumsum(count) - count
    at = np.arange(count.sum()) + np.repeat(starts[:-1][rows] - base, count)
    low = np.repeat(other_starts[:-1][rows], count)
    high = np.repeat(other_starts[1:][rows], count)
    rank = at - np.repeat(starts[:-1][rows], count)
    last = gallop(ends[at], others, low + rank, low, high)
    common = others[np.minimum(last, len(others) - 1)] == ends[at]
    first = np.empty_like(last)
    if len(at):
        first[1:] = last[:-1] + common[:-1]
        first[base[count > 0]] = low[base[count > 0]]
    return at, first, last, common


def link_ranges(
    ends_a: np.ndarray, starts_a: np.ndarray, ends_b: np.ndarray, starts_b: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All overlapping (A token, B token) places, and the places where both end together, of texts one after the other.

    In each text the side with fewer tokens drives the search into the other one.
    """
    by_a = np.diff(starts_a) <= np.diff(starts_b)
    out, cuts = [], []
    for drives_a, rows in ((True, np.flatnonzero(by_a)), (False, np.flatnonzero(~by_a))):
        mine, other = ((ends_a, starts_a), (ends_b, starts_b))[:: 1 if drives_a else -1]
        at, first, last, common = _drive(*mine, *other, rows)
        size = last - first + 1
        here = np.repeat(at, size)
        there = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
        out.append((here, there) if drives_a else (there, here))
        cuts.append((at[common], last[common]) if drives_a else (last[common], at[common]))
    a, b = (np.concatenate([o[k] for o in out]) for k in (0, 1))
    cut_a, cut_b = (np.sort(np.concatenate([c[k] for c in cuts])) for k in (0, 1))
    return a, b, cut_a, cut_b


def _decimal(ids: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal text of all ids, each followed by its byte of ``after``, and where each begins (with the end)."""
    size = np.maximum(1, np.searchsorted(10 ** np.arange(10), ids, side="right"))
    ends = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.empty(ends[-1], np.uint8)
    out[ends[1:] - 1] = after
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[ends[1:][has] - 2 - k] = 48 + ids[has] // 10**k % 10
    return out, ends


def _group_texts(ids_a, ids_b, starts_a, starts_b, cut_a, cut_b) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of every text."""
    group_a = np.searchsorted(cut_a, np.arange(len(ids_a)))
    group_b = np.searchsorted(cut_b, np.arange(len(ids_b)))
    before_b = np.concatenate([[0], cut_b + 1])  # B tokens before a group
    upto_a = cut_a + 1  # A tokens up to a group's end
    ids = np.empty(len(ids_a) + len(ids_b), np.int64)
    after = np.full(len(ids), ord(","), np.uint8)
    at_a = np.arange(len(ids_a)) + before_b[group_a]
    at_b = np.arange(len(ids_b)) + upto_a[group_b]
    ids[at_a], ids[at_b] = ids_a, ids_b
    after[at_a[cut_a]], after[at_b[cut_b]] = ord("|"), ord(";")
    text, ends = _decimal(ids, after)
    bounds = ends[starts_a + starts_b]
    whole = text.tobytes()
    return [whole[i : max(i, j - 1)] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _aligned(texts: pa.Array, path_a: str | None, path_b: str | None) -> pa.Array:
    large = pa.large_string()
    n = len(texts)
    # B writes blanks as U+2581, so a text that holds one does not come back from its tokens.
    lossy = pc.or_(pc.equal(pc.binary_length(texts), 0), pc.match_substring(texts, BLANK))
    texts = pc.if_else(lossy, pa.scalar("", large), texts)
    lead = pc.if_else(lossy, pa.scalar("", large), pa.scalar(" ", large))
    ended, at = encode_texts(pc.binary_join_element_wise(lead, texts, pa.scalar("", large)), path_a)
    ids_a = np.delete(ended, at[1:] - 1).astype(np.int64)
    starts_a = at - np.arange(n + 1)
    ids_b, starts_b = encode_pieces(texts, path_b)
    ids_b = ids_b.astype(np.int64)
    ends_a = np.cumsum(byte_bpe(path_a)[1][ids_a])
    ends_b = np.cumsum(piece_model(path_b).size[ids_b])
    a, b, cut_a, cut_b = link_ranges(ends_a, starts_a, ends_b, starts_b)
    row = np.searchsorted(starts_a[1:], a, side="right")
    key, count = np.unique((row << 31) | (ids_a[a] * SHIFT + ids_b[b]), return_counts=True)
    cells = pa.StructArray.from_arrays([pa.array(key & ((1 << 31) - 1)), pa.array(count)], names=["p", "c"])
    groups = np.bincount(np.searchsorted(starts_a[1:], cut_a, side="right"), minlength=n)
    links = np.bincount(row, minlength=n)
    fields = [
        pa.array(np.diff(starts_a)), pa.array(np.diff(starts_b)), pa.array(groups.astype(np.int64)),
        pa.array(links.astype(np.int64)),
        pa.array(_group_texts(ids_a, ids_b, starts_a, starts_b, cut_a, cut_b), pa.binary()),
        pa.ListArray.from_arrays(pa.array(np.searchsorted(key >> 31, np.arange(n + 1)).astype(np.int32)), cells),
    ]
    return pa.StructArray.from_arrays(fields, names=["n_a", "n_b", "n_groups", "n_links", "groups", "pairs"])


def aligned_tokens(path_a: str | None = None, path_b: str | None = None, digest: bool = False):
    """Column function: token and group counts, the groups as text (or their SHA-256) and the id pairs of a text."""

    @F.arrow_udf(ALIGNED)
    def align(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = [_aligned(b, path_a, path_b) for b in blocks(batch, BLOCK)] or [
                _aligned(pa.array([], pa.large_string()), path_a, path_b)
            ]
            whole = pa.concat_arrays(out)
            if digest:
                hashed = [hashlib.sha256(g).hexdigest().encode() if g else b"" for g in whole.field("groups").to_pylist()]
                fields = [pa.array(hashed, pa.binary()) if f.name == "groups" else whole.field(f.name) for f in whole.type]
                whole = pa.StructArray.from_arrays(fields, names=[f.name for f in whole.type])
            yield whole

    return align


def align_tokens(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, digest: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and the groups.

    The groups are column ``groups_sha256`` (hexadecimal), or with ``digest=False`` their text in column ``groups``.  A null or
    empty text, and one whose tokens do not give back its bytes (it holds U+2581), has zeros and ''.  Rows that repeat
    a ``doc_id``, or have none, count one by one.  Other columns are ignored; an empty table gives no rows.
    """
    need_columns(docs, "doc_id", "text")
    ready_for_python(docs.sparkSession)
    measured = materialize(
        docs.select(
            F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("bigint").alias("doc_id"),
            aligned_tokens(path_a, path_b, digest)(F.col("text")).alias("_a"),
        ).select("_row", "doc_id", "_a.*"),
        "alignments",
    )
    cells = measured.select("_row", F.explode("pairs").alias("_p")).select("_row", "_p.p", "_p.c")
    counts = cells.groupBy("p").agg(F.sum("c").alias("_n"), F.count(F.lit(1)).alias("_rows"))
    counts = materialize(counts.withColumn("_b", F.col("p") % SHIFT), "pair-counts")
    # One row per id of B: no more than its vocabulary.
    most = counts.groupBy("_b").agg(F.max("_n").alias("_most"))
    rated = materialize(
        counts.join(F.broadcast(most), "_b").select("p", "_rows", "_n", (F.col("_n") == F.col("_most")).alias("_best")),
        "pair-ratings",
    )
    sums = sum_by_row(cells, rated, "p", "_rows", F.lit(8), {
        "n_best": F.when(F.col("_best"), F.col("c")).otherwise(F.lit(0)), "count_sum": F.col("c") * F.col("_n"),
    })
    zero = F.lit(0).cast("bigint")
    groups = F.col("groups").cast("string").alias("groups_sha256" if digest else "groups")
    return (
        measured.drop("pairs").join(sums, "_row", "left")
        .select(
            "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
            F.coalesce("count_sum", zero).alias("count_sum"), groups,
        )
    )
