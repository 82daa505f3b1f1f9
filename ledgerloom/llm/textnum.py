"""Vectorised word and shingle hashing over Arrow text columns, for use inside Python tasks.

Words are runs of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return, with A-Z
lowered.  Everything works on the UTF-8 bytes of many rows at once; a block holds a bounded number of bytes, or one
single longer row.
"""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BLOCK_BYTES = 2 << 20
SHINGLE_WORDS = 5

_U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_POSITION = np.array([pow(0xD6E8FEB86659FD93, j + 1, 1 << 64) | 1 for j in range(64)], _U64)
_powers = np.array([1], _U64)
_SENT: set[str] = set()


def ready_for_python(spark: SparkSession, rows: int = 2000, size: str = "16m") -> None:
    """Send this package to the executors, once per application, and bound the session's Arrow batches.

    The bounds keep a batch of long texts from outgrowing an executor; lower ones that are set stay.
    """
    context = spark.sparkContext
    if context.applicationId not in _SENT:
        package = Path(__file__).parents[1]
        archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for module in sorted(package.rglob("*.py")):
                out.write(module, module.relative_to(package.parent))
        context.addPyFile(str(archive))
        _SENT.add(context.applicationId)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def need_columns(df: DataFrame, *names: str) -> None:
    """Fail early, with the name, when an input column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[pa.Array]:
    """The texts as large-string arrays of at most ``limit`` bytes, or one row; null becomes empty."""
    whole = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_string()).fill_null("")
    ends = _offsets(whole)
    first = 0
    while first < len(whole):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, side="right")) - 1)
        yield whole.slice(first, last - first)
        first = last


def _offsets(texts: pa.Array) -> np.ndarray:
    if len(texts) == 0:
        return np.zeros(1, np.int64)
    return np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a large-string array without nulls, and where each row starts (with the end)."""
    offsets = _offsets(texts)
    data = texts.buffers()[2]
    if data is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    h = (h ^ (h >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U64(27))) * _U64(0x94D049BB133111EB)
    return h ^ (h >> _U64(31))


def _power_table(n: int) -> np.ndarray:
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * _U64(pow(_BASE, len(_powers), 1 << 64))])
    return _powers


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of every word, in order."""
    data, ends = text_bytes(texts)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, _U64)
    is_word = ~_SPACE[data]
    before = np.empty_like(is_word)
    before[0] = False
    before[1:] = is_word[:-1]
    before[ends[:-1][ends[:-1] < len(data)]] = False
    first = is_word & ~before
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, _U64)
    place = np.arange(len(data))
    place -= np.maximum.accumulate(np.where(first, place, 0))
    place[~is_word] = 0
    values = (_LOWER[data].astype(_U64) + _U64(1)) * _power_table(int(place.max()) + 1)[place]
    values[~is_word] = 0
    rows = np.searchsorted(ends[1:], starts, side="right")
    return rows, mix(np.add.reduceat(values, starts))


def shingles(rows: np.ndarray, words: np.ndarray, n_rows: int, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every run of ``k`` words; a row with fewer words is one shingle of all of them."""
    count = np.bincount(rows, minlength=n_rows) if len(rows) else np.zeros(n_rows, np.int64)
    if not len(rows):
        return rows, words
    at = np.cumsum(count) - count
    padded = np.concatenate([words, np.zeros(k, _U64)])
    full = np.flatnonzero(np.arange(len(words)) + k <= (at + count)[rows])
    total = np.zeros(len(full), _U64)
    for j in range(k):
        total += padded[full + j] * _POSITION[j]
    short = np.flatnonzero((count > 0) & (count < k))
    rest = count[short].astype(_U64) * _U64(0xA24BAED4963EE407)
    for j in range(k - 1):
        rest += np.where(count[short] > j, padded[np.minimum(at[short] + j, len(words))], 0).astype(_U64) * _POSITION[j]
    all_rows = np.concatenate([rows[full], short])
    hashes = mix(np.concatenate([total, rest]))
    order = np.argsort(all_rows, kind="stable")
    return all_rows[order], hashes[order]


def row_starts(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Bounds of each row's entries in a list that is ordered by row."""
    return np.searchsorted(rows, np.arange(n_rows + 1))
