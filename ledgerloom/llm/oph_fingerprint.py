"""Document fingerprints by one-permutation MinHash with optimal densification and packed low-order bits.

Every word shingle is hashed once; the hash names a bin and, within it, competes for the minimum.  An empty bin copies
from a bin that its own sequence of universal hashes reaches first (optimal densification), so two texts fill it from
the same bin whenever that bin holds the same minimum.  Of each bin ``BITS`` low-order bits are kept; two different
minima agree in them with probability ``2**-BITS``, which the likeness corrects for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.textnum import blocks, ready_for_python, mix, need_columns, row_starts, shingles, word_hashes

BINS = 256
BITS = 4
SHINGLE = 5
EMPTY = ""  # the fingerprint of a text without words

_U64 = np.uint64
_TOP = ~_U64(0)


def _filled(minima: np.ndarray) -> np.ndarray:
    """Fill every empty bin from the first non-empty one on the bin's own hash sequence."""
    rows, bins = np.nonzero(minima == _TOP)
    source = minima.copy()
    attempt = 0
    while len(rows):
        attempt += 1
        probe = (mix(bins.astype(_U64) * _U64(0x9E3779B97F4A7C15) + _U64(attempt)) % _U64(BINS)).astype(np.int64)
        found = source[rows, probe]
        hit = found != _TOP
        minima[rows[hit], bins[hit]] = found[hit]
        rows, bins = rows[~hit], bins[~hit]
    return minima


def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> list[str]:
    """Hexadecimal fingerprints of large-string texts without nulls."""
    n = len(texts)
    rows, hashes = shingles(*word_hashes(texts), n, shingle)
    minima = np.full((n, BINS), _TOP)
    np.minimum.at(minima.reshape(-1), rows * BINS + (hashes >> _U64(56)).astype(np.int64), hashes & _U64((1 << 56) - 1))
    some = np.diff(row_starts(rows, n)) > 0
    low = mix(_filled(minima[some])) & _U64((1 << BITS) - 1)
    packed = (low[:, 0::2] << _U64(4) | low[:, 1::2]).astype(np.uint8)
    out = [EMPTY] * n
    for i, row in zip(np.flatnonzero(some), packed):
        out[i] = row.tobytes().hex()
    return out


def likeness(a: str, b: str) -> float:
    """Similarity of two fingerprints, 0 to 1: share of equal bins, corrected for chance; 1 if both are empty."""
    if not a or not b:
        return float(a == b)
    x, y = (np.frombuffer(bytes.fromhex(t), np.uint8) for t in (a, b))
    apart = x ^ y
    same = (np.count_nonzero(apart >> 4 == 0) + np.count_nonzero(apart & 15 == 0)) / BINS
    chance = 2.0**-BITS
    return float(min(1.0, max(0.0, (same - chance) / (1 - chance))))


@F.arrow_udf(T.StringType())
def fingerprint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The fingerprint of each text; null counts as empty."""
    for batch in batches:
        yield pa.array([f for b in blocks(batch) for f in fingerprints(b)], pa.string())


def fingerprint_likeness(a: Column, b: Column) -> Column:
    """``likeness`` of two fingerprint columns as a Spark expression."""

    def nibbles(c: Column, i: Column) -> Column:
        return F.substring(c, i, F.lit(1))

    same = F.size(F.filter(F.sequence(F.lit(1), F.lit(BINS)), lambda i: nibbles(a, i) == nibbles(b, i)))
    chance = 2.0**-BITS
    raw = (same / F.lit(float(BINS)) - chance) / (1 - chance)
    return F.when((a == EMPTY) | (b == EMPTY), (a == b).cast("double")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def edited_text(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the start of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third] if third else text


EDITS = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
EDIT_CHARS = 1 << 20  # texts held at once, beside the last
STRETCH_BYTES = 64 << 20  # of text that one task should read


def _edits(pending: list[tuple], following: tuple[str, str] | None = None) -> pa.RecordBatch:
    """Result rows of consecutive rows (doc_id, text); the last one is followed by ``following``."""
    texts = [t for _, t in pending]
    marks = [f for b in blocks(pa.array(texts, pa.large_string())) for f in fingerprints(b)]
    after, after_marks = texts[1:], marks[1:]
    if following is not None:
        after, after_marks = [*after, following[0]], [*after_marks, following[1]]
    edited = [edited_text(t, n) for t, n in zip(texts, after)]
    edited_marks = [f for b in blocks(pa.array(edited, pa.large_string())) for f in fingerprints(b)]
    n = len(edited)
    columns = [
        pa.array([d for d, _ in pending[:n]], pa.int64()),
        pa.array([len(t) for t in texts[:n]], pa.int64()),
        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
        pa.array(marks[:n], pa.string()),
        pa.array(edited_marks, pa.string()),
        pa.array([likeness(a, b) for a, b in zip(marks, edited_marks)], pa.float64()),
        pa.array([likeness(a, b) for a, b in zip(marks, after_marks)], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in EDITS.split(", ")])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by stretch and place; the last row of a stretch is a copy of the next stretch's first."""
    pending: list[tuple] = []
    stretch, held = None, 0
    for batch in batches:
        parts, ids, texts = (batch.column(i).to_pylist() for i in range(3))
        copies = batch.column(3).to_pylist()
        for part, doc_id, text, copy in zip(parts, ids, texts, copies):
            if part != stretch:
                # The rows of a finished stretch all came out when its copy was seen.
                pending, held, stretch = [], 0, part
            if copy:
                if pending:
                    yield _edits(pending, (text, next(iter(fingerprints(pa.array([text], pa.large_string()))))))
                pending, held = [], 0
                continue
            pending.append((doc_id, text))
            held += len(text)
            if held > EDIT_CHARS and len(pending) > 1:
                yield _edits(pending)
                pending, held = pending[-1:], len(text)


def _stretches(docs: DataFrame) -> int:
    """Number of stretches: one for every STRETCH_BYTES of text, and enough to keep all cores busy."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(-(-size // STRETCH_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _stretch_bounds(docs: DataFrame, stretches: int) -> list[int]:
    """Upper ids of the stretches, from approximate quantiles of the ids alone, exact to a twentieth of a stretch."""
    shares = [i / stretches for i in range(1, stretches)]
    exactness = max(10_000, 20 * stretches)
    found = docs.filter("doc_id is not null").agg(F.percentile_approx("doc_id", shares, exactness)).first()[0] if shares else None
    return sorted(set(found or []))


def fingerprint_edits(docs: DataFrame, stretches: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The edited text has its last ``floor(n_chars / 3)`` code points replaced by the first as many (or all) of the next
    document by descending ``doc_id``; the last document is followed by the first.  Null text counts as empty.  Rows
    that repeat a ``doc_id`` follow each other by text; rows without ``doc_id`` come last (all rows of one id, or
    without one, are one task's work: ids are taken to be nearly unique).  One row per input row;
    an empty table gives no rows; a single row is its own next.  Other columns are ignored.

    The texts are shuffled once: rows go to stretches of ids, as many as the size of the texts asks for, and the first row of each stretch is sent to the stretch
    before it as well, so that every row meets its successor.  Only the stretches' first ids go through the driver.
    """
    need_columns(docs, "doc_id", "text")
    spark = docs.sparkSession
    ready_for_python(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = _stretch_bounds(rows, stretches or _stretches(rows))
    placed = rows.withColumn("_part", _stretch_of(bounds)(F.col("doc_id")))
    # The first row of each stretch in use: its largest id, then its smallest text.
    first_ids = sorted(
        ((r["_part"], r["_id"]) for r in placed.groupBy("_part").agg(F.max("doc_id").alias("_id")).collect()),
    )
    if not first_ids:
        return spark.createDataFrame([], EDITS)
    used = [p for p, _ in first_ids]
    before = {p: used[i - 1] for i, p in enumerate(used)}
    heads = F.broadcast(
        spark.createDataFrame([(p, i, before[p]) for p, i in first_ids], "_part int, _id bigint, _to int")
    )
    copies = (
        placed.join(heads, (placed["_part"] == heads["_part"]) & placed["doc_id"].eqNullSafe(heads["_id"]))
        .groupBy("_to").agg(F.min("text").alias("text"))
        .select(F.col("_to").alias("_part"), F.lit(None).cast("bigint").alias("doc_id"), "text", F.lit(True).alias("_copy"))
    )
    everything = placed.select("_part", "doc_id", "text", F.lit(False).alias("_copy")).unionByName(copies)
    # A stretch is a task of its own: there are at most len(bounds) + 2 of them, numbered from 0.
    ordered = everything.repartitionById(len(bounds) + 2, "_part").sortWithinPartitions(
        "_part", "_copy", F.col("doc_id").desc_nulls_last(), "text"
    )
    return ordered.mapInArrow(_walk, EDITS)


def _stretch_of(bounds: list[int]):
    """Column function: 0 holds the largest ids; rows without id come in the last stretch."""
    upper = np.array(bounds, np.int64)

    @F.arrow_udf("int")
    def part(ids: pa.Array) -> pa.Array:
        value = np.asarray(ids.fill_null(0))
        at = len(upper) - np.searchsorted(upper, value, side="left")
        return pa.array(np.where(np.asarray(ids.is_null()), len(upper) + 1, at).astype(np.int32))

    return part
