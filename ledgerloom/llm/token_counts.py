"""Token counts of a SentencePiece model without materialising ids.

Every document becomes the frequencies of its pre-tokens (stretches of text that the model encodes independently).
The pieces of each distinct pre-token are counted once, joined to the frequencies, and summed per document:

* Pre-tokens that are frequent in a sample of the texts (the heads, at most ``HEADS`` and ``HEAD_BYTES``) are counted first and
  sent to every task, which sums their part of a document at once.
* The frequencies of the others are shuffled by pre-token.  None of them is in a large share of the documents (it would
  be in the sample), so no task gets a hot key.  Equal pre-tokens lie side by side there and are counted once.

Which pre-tokens are heads decides where they are counted, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.pretokens import piece_model, pretokens
from ledgerloom.llm.textnum import blocks, need_columns, ready_for_python
from ledgerloom.storage import materialize

LIMIT = 4096
SAMPLE_TEXTS, HEADS, HEAD_BYTES = 4096, 100_000, 64
FREQUENCIES = "struct<known:bigint,rest:array<struct<t:string,c:bigint>>>"


def frequencies_of(heads: tuple[list[str], list[int]] = ([], []), path: str | None = None):
    """Column function: pieces of a text's (null counts as empty) head pre-tokens, and the frequencies of the others."""
    head_list = pa.array(heads[0], pa.large_string())
    head_size = np.array([*heads[1], 0], np.int64)

    @F.arrow_udf(FREQUENCIES)
    def frequencies(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [_frequencies(b, head_list, head_size, path) for b in blocks(batch)]
            yield pa.concat_arrays(parts or [_frequencies(pa.array([], pa.large_string()), head_list, head_size, path)])

    return frequencies


def _frequencies(texts: pa.Array, heads: pa.Array, head_size: np.ndarray, path: str | None) -> pa.Array:
    tokens, starts = pretokens(texts, piece_model(path), long=0)
    coded = tokens.dictionary_encode()
    rows = np.repeat(np.arange(len(texts)), np.diff(starts))
    codes = coded.indices.to_numpy()
    head = pc.index_in(coded.dictionary, value_set=heads).fill_null(-1).to_numpy()[codes]
    known = np.bincount(rows, head_size[head], len(texts)).astype(np.int64)
    n = max(1, len(coded.dictionary))
    key, count = np.unique((rows * n + codes)[head < 0], return_counts=True)
    found = coded.dictionary.take(pa.array(key % n)).cast(pa.string())
    cells = pa.StructArray.from_arrays([found, pa.array(count, pa.int64())], names=["t", "c"])
    ends = np.searchsorted(key // n, np.arange(len(texts) + 1)).astype(np.int32)
    rest = pa.ListArray.from_arrays(pa.array(ends), cells)
    return pa.StructArray.from_arrays([pa.array(known), rest], names=["known", "rest"])


def head_pretokens(docs: DataFrame, path: str | None = None) -> tuple[list[str], list[int]]:
    """Pre-tokens that several sampled texts share, and their pieces: at most HEADS, each of at most HEAD_BYTES bytes."""
    share = min(1.0, SAMPLE_TEXTS / max(1, docs.count()))
    sample = docs if share == 1.0 else docs.sample(share, seed=11)
    cells = sample.select(F.explode(frequencies_of(path=path)(F.col("text"))["rest"]["t"]).alias("t"))
    often = (
        cells.filter(F.octet_length("t") <= HEAD_BYTES).groupBy("t").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        .orderBy(F.desc("_n"), "t").limit(HEADS).collect()
    )
    names = [r["t"] for r in often]
    return names, [len(i) for i in piece_model(path).ids(names)] if names else []


def _counted(path: str | None):
    """Task function: (row, pre-token, frequency) in order of pre-token to (row, pieces), one row per row and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        last, pieces = None, 0
        for batch in batches:
            coded = pc.run_end_encode(batch.column("t"))
            names = coded.values.to_pylist()
            # The pre-token that ended the batch before is not counted again.
            fresh = names[1:] if names and names[0] == last else names
            sizes = [pieces] * (len(names) - len(fresh)) + [len(i) for i in (model.ids(fresh) if fresh else [])]
            if names:
                last, pieces = names[-1], sizes[-1]
            runs = np.diff(coded.run_ends.to_numpy(), prepend=0)
            total = np.repeat(np.array(sizes, np.int64), runs) * batch.column("c").to_numpy()
            rows, place = np.unique(batch.column("_row").to_numpy(), return_inverse=True)
            sums = np.bincount(place, total, len(rows)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"_row": rows, "n": sums})

    return run


def count_tokens(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    Null and empty texts have no bytes and no tokens.  Rows that repeat a ``doc_id``, or have none, are counted one by
    one.  Other columns are ignored; an empty table gives no rows.
    """
    need_columns(docs, "doc_id", "text")
    ready_for_python(docs.sparkSession)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    measured = materialize(
        docs.select(
            F.monotonically_increasing_id().alias("_row"),
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"),
            frequencies_of(head_pretokens(docs, path), path)(F.col("text")).alias("_f"),
        ).select("_row", "doc_id", "n_bytes", "_f.*"),
        "pretokens",
    )
    rest = measured.select("_row", F.explode("rest").alias("_c")).select("_row", "_c.t", "_c.c")
    counted = (
        rest.repartition(partitions, "t").sortWithinPartitions("t").mapInArrow(_counted(path), "_row bigint, n bigint")
        .groupBy("_row").agg(F.sum("n").alias("n"))
    )
    total = F.col("known") + F.coalesce("n", F.lit(0).cast("bigint"))
    return (
        measured.select("_row", "doc_id", "n_bytes", "known").join(counted, "_row", "left")
        .select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
    )
