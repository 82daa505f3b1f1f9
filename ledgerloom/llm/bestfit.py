"""Best-fit-decreasing packing of tokenized documents into sequences of fixed length.

Every document is tokenized once and cut into pieces.  Best fit decreasing looks at lengths alone, and lengths are at
most the capacity, so the packing is planned from the histogram of lengths (at most ``capacity`` numbers, whatever the
corpus): items of one length are placed a run of equal bins at a time, each time into the tightest open bin, which a
segment tree over the remaining capacities finds in logarithmic time.  The plan says which ranks among the items of a
length go to which bins; Spark ranks the items and looks their place up.  No group of documents meets in one task:
ranks are counted per (bucket of documents, length), buckets hold about ``BUCKET_PIECES`` pieces, and running
sums over the buckets do the rest.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator, Mapping
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerloom.llm.textnum import blocks, ready_for_python, need_columns, text_bytes
from ledgerloom.storage import materialize

CAPACITY = 2048
END_ID = 0
MARK, MARK_ID = "<|endoftext|>", 50256  # fixed values of the vocabulary
BUCKET_PIECES = 100_000
TOKENIZE_BYTES = 4 << 20

PIECES = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"

# The tokenizer always cuts between a character that is no space and a blank, so texts are cut at blanks and each
# distinct chunk is tokenized once.  Texts with other space around a blank, or with START, are tokenized whole.
START = "\x01"
_UNSAFE = r"[\t\n\v\f\r\x1c-\x1f\x{85}\p{Z}] |\x01"
CHUNKS = 200_000


@lru_cache(maxsize=2)
def byte_bpe(path: str | None):
    """The byte-level BPE of a rank file; its default is the 50k vocabulary of the public tokenizers."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), size


class _Chunks:
    """Token ids of chunks of text; those met first are remembered, up to ``CHUNKS`` of them."""

    def __init__(self, path: str | None):
        self.bpe, self.size = byte_bpe(path)
        self.index: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(1, np.int64)

    def encode(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each chunk where its ids begin and how many they are."""
        at = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, len(chunks))
        new = chunks[at < 0]
        ids, starts = self._tokenize(new)
        known = len(self.starts) - 1
        at[at < 0] = known + np.arange(len(new))
        all_ids = np.concatenate([self.ids, ids])
        all_starts = np.concatenate([self.starts, self.starts[-1] + starts[1:]])
        room = min(len(new), CHUNKS - known)
        if room > 0:
            self.index.update(zip(new[:room], range(known, known + room)))
            self.starts = all_starts[: known + room + 1]
            self.ids = all_ids[: self.starts[-1]]
        return all_ids, all_starts[at], np.diff(all_starts)[at]

    def _tokenize(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks one after the other, and where each chunk's begin (with the end).

        A chunk stands for itself after a blank, or without one where it starts with START.
        """
        data, ends = text_bytes(pa.array(chunks, pa.large_string()))
        length = np.diff(ends)
        last = data[np.maximum(ends[1:] - 1, 0)] if len(data) else np.zeros(len(chunks), np.uint8)
        # Written one after the other, chunks tokenize as they do alone if each begins with space and ends without.
        joined = (length > 0) & (last != 32) & (last != 10)
        joined &= data[np.minimum(ends[:-1], len(data) - 1)] != ord(START) if len(data) else False
        alone = [
            self.bpe.encode_ordinary(c[1:] if c.startswith(START) else " " + c) for c in chunks[~joined]
        ]
        text = "".join([" " + c for c in chunks[joined]])
        together = np.array(self.bpe.encode_ordinary(text), np.uint32)
        byte_ends = np.cumsum(length[joined] + 1)
        cut = np.searchsorted(np.cumsum(self.size[together]), byte_ends, side="left") + 1
        counts = np.empty(len(chunks), np.int64)
        counts[joined] = np.diff(cut, prepend=0)
        counts[~joined] = [len(a) for a in alone]
        ids = _merge(together, np.array([i for a in alone for i in a], np.uint32), counts, joined)
        return ids, np.concatenate([[0], np.cumsum(counts)])


@lru_cache(maxsize=2)
def _chunks(path: str | None) -> _Chunks:
    return _Chunks(path)


def _merge(first: np.ndarray, second: np.ndarray, counts: np.ndarray, is_first: np.ndarray) -> np.ndarray:
    """Two runs of ids, each in row order, merged: row ``i`` takes ``counts[i]`` ids of the run it belongs to."""
    out = np.empty(counts.sum(), np.uint32)
    mask = np.repeat(is_first, counts)
    out[mask] = first
    out[~mask] = second
    return out


def _encode_whole(text: str, path: str | None, marks: bool) -> list[int]:
    bpe = byte_bpe(path)[0]
    if not marks:
        return bpe.encode_ordinary(text)
    ids: list[int] = []
    for k, part in enumerate(text.split(MARK)):
        ids += ([MARK_ID] if k else []) + bpe.encode_ordinary(part)
    return ids


def encode_texts(texts: pa.Array, path: str | None = None, marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all (large-string, not null) texts, each followed by END_ID, and where each begins (with the end).

    With ``marks`` the vocabulary's special token, spelled out in a text, is that one token, as its tokenizer takes it when
    loaded; without, its letters are ordinary text.
    """
    large = pa.large_string()
    unsafe = pc.match_substring_regex(texts, _UNSAFE)
    safe = pc.invert(pc.or_(unsafe, pc.match_substring(texts, MARK)) if marks else unsafe)
    cut = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(START, large), texts.filter(safe), pa.scalar("", large)), " ")
    words = pc.list_value_length(cut).to_numpy()
    coded = cut.flatten().dictionary_encode()
    ids, begin, size = _chunks(path).encode(coded.dictionary.to_numpy(zero_copy_only=False))
    codes = coded.indices.to_numpy()
    begin, size = begin[codes], size[codes]
    ends = np.concatenate([[0], np.cumsum(size)])
    # One place more per text, for END_ID.
    inner = np.full(ends[-1] + len(words), END_ID, np.uint32)
    shift = np.repeat(np.repeat(np.arange(len(words)), words), size)
    step = np.arange(ends[-1])
    inner[step + shift] = ids[step + np.repeat(begin - ends[:-1], size)]
    is_safe = safe.to_numpy(zero_copy_only=False)
    whole = [_encode_whole(t, path, marks) + [END_ID] for t in texts.filter(pc.invert(safe)).to_pylist()]
    counts = np.empty(len(texts), np.int64)
    counts[is_safe] = np.diff(ends[np.concatenate([[0], np.cumsum(words)])]) + 1
    counts[~is_safe] = [len(w) for w in whole]
    out = _merge(inner, np.array([i for w in whole for i in w], np.uint32), counts, is_safe)
    return out, np.concatenate([[0], np.cumsum(counts)])


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: all of full length but the first, which may be shorter."""
    first = n % capacity or capacity
    return [(0, min(first, n)), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(path: str | None = None, capacity: int = CAPACITY):
    """Column function: the pieces of a text (null counts as empty) with the checksum of their ids."""

    @F.arrow_udf(PIECES)
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kinds = (("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()))
        for batch in batches:
            out = []
            for block in blocks(batch, TOKENIZE_BYTES):
                ids, starts = encode_texts(block, path, marks=True)
                rows, ends = [], [0]
                for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                    for k, (s, n) in enumerate(cuts(b - a, capacity)):
                        rows.append((k, s, n, zlib.crc32(ids[a + s : a + s + n].astype("<u4").tobytes())))
                    ends.append(len(rows))
                fields = [pa.array([r[j] for r in rows], kind) for j, (_, kind) in enumerate(kinds)]
                out.append(pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, names=[n for n, _ in kinds])
                ))
            yield pa.concat_arrays(out)

    return pieces


class _Tightest:
    """Segment tree over remaining capacities: how many runs of open bins have each."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, remaining: int, change: int) -> None:
        node = remaining + self.size
        while node:
            self.count[node] += change
            node >>= 1

    def at_least(self, need: int) -> int | None:
        """The smallest remaining capacity of an open bin that is at least ``need``."""
        node = need + self.size
        if self.count[node]:
            return need
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None


def best_fit_plan(histogram: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit decreasing of ``histogram[length]`` items of each length.

    Returns runs (length, first rank, first bin, items per bin, offset in the bin): items of that length, from that
    rank on up to the next run, fill consecutive bins.
    """
    tree = _Tightest(capacity)
    open_runs: dict[int, list[tuple[int, int]]] = {}
    runs: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def keep(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            open_runs.setdefault(remaining, []).append((first, n))
            tree.add(remaining, 1)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            remaining = tree.at_least(length)
            if remaining is None:
                remaining, first = capacity, bins
                n = -(-left // (capacity // length))
                bins += n
            else:
                first, n = open_runs[remaining].pop()
                tree.add(remaining, -1)
            # Once an item is in a bin, that bin is the tightest as long as it takes another of this length.
            each = remaining // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, first, each, capacity - remaining))
                keep(remaining - each * length, first, full)
                left, rank = left - full * each, rank + full * each
            rest = 0
            if full < n and left:
                runs.append((length, rank, first + full, left, capacity - remaining))
                keep(remaining - left * length, first + full, 1)
                left, rank, rest = 0, rank + left, 1
            keep(remaining, first + full + rest, n - full - rest)
    return runs


def _placed(runs: list[tuple[int, int, int, int, int]]):
    """Column function: sequence and offset of the item with this length and rank."""
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    edges = np.searchsorted(table[:, 0], np.arange(int(table[:, 0].max(initial=0)) + 2))

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        size, number = np.asarray(length), np.asarray(rank)
        at = np.empty(len(size), np.int64)
        for one in np.unique(size):
            here = size == one
            at[here] = edges[one] + np.searchsorted(table[edges[one] : edges[one + 1], 1], number[here], "right") - 1
        inside = number - table[at, 1]
        fields = [table[at, 2] + inside // table[at, 3], table[at, 4] + inside % table[at, 3] * size]
        return pa.StructArray.from_arrays([pa.array(f) for f in fields], names=["sequence_id", "offset"])

    return place


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and END_ID; null text counts as empty.  Only documents longer than ``capacity`` are
    cut.  Rows that repeat a ``doc_id`` (or have none) are packed as documents of their own.  Sequences have no gaps;
    equal rows may take each other's places.  An empty table gives no rows.  Other columns are ignored.
    """
    need_columns(docs, "doc_id", "text")
    spark = docs.sparkSession
    ready_for_python(spark)
    cut = token_pieces(path, capacity)(F.col("text"))
    pieces = materialize(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.explode(cut).alias("_p")).select("doc_id", "_p.*"),
        "pieces",
    )
    buckets = max(1, -(-pieces.count() // BUCKET_PIECES))
    spread = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = materialize(spread.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n")), "lengths")
    # At most ``capacity`` rows come to the driver.
    histogram = {r["length"]: r["_n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("_n")).collect()}
    place = _placed(best_fit_plan(histogram, capacity))
    before = W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = W.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = spread.join(offsets, ["length", "_bucket"]).withColumn("_rank", F.row_number().over(within) - 1 + F.col("_before"))
    return ranked.withColumn("_at", place(F.col("length"), F.col("_rank"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset"
    )
