"""MinHash near-duplicate groups, with candidates of the bands checked by odd sketches before full sets are compared.

Per text: K MinHash samples of its distinct word shingles; bands of ROWS samples give bucket keys; and the samples are
folded into a parity bitmap (odd sketch), whose XOR population count estimates the similarity of two texts closely
when it is high.  Two documents are linked when the full shingle sets have ``100 * intersection >= 75 * union``.

How links are found without emitting the pairs of a group:

1. Texts with the same shingle set are one class, represented by its smallest ``doc_id``.
2. In each bucket every class outside the bucket's largest group meets one member of that group, and keeps the partner
   whose sketch is most alike.  Full sets confirm; confirmed links join into groups.  This is done ROUNDS times.
3. In buckets that still hold several groups, the classes outside the largest group meet all classes of other groups
   there, each pair once.  Sketch, then full sets, confirm.  Nothing is capped: a group that is already joined costs
   nothing.

Sets of different size cannot be similar: before sketches are fetched, a pair's sizes must be within the similarity; in
step 3 classes also meet by size class, so that a bucket of texts of all lengths is not compared in full.

Recall: two sets of similarity 0.75 share no bucket with probability (1 - 0.75**4)**32 = 5e-6, less above.  The sketch
test leaves a margin of four standard errors (a link of exactly 0.75 passes with probability 0.99997, others more).  Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ledgerloom.llm.components import merge_components
from ledgerloom.llm.textnum import blocks, ready_for_python, mix, need_columns, row_starts, shingles, word_hashes
from ledgerloom.operators.ordered import number_rows
from ledgerloom.storage import materialize

BANDS, ROWS = 32, 4  # of the first BANDS * ROWS samples
K, BITS = 1024, 2048  # samples in an odd sketch, and its bits
ROUNDS = 2
SIMILARITY = 75  # hundredths
SHINGLE = 5

_U64 = np.uint64
_SEED = mix(np.arange(1, K + 1, dtype=_U64) * _U64(0x9E3779B97F4A7C15))
_MULTIPLIER = (mix(_SEED) >> _U64(32)).astype(np.uint32) | np.uint32(1)
_MASK = (_SEED >> _U64(32)).astype(np.uint32)

SIGNATURE = T.StructType([
    *[T.StructField(name, T.LongType()) for name in ("n", "a", "b")],
    *[T.StructField(name, T.ArrayType(T.LongType())) for name in ("bands", "sketch")],
])


def _distinct(rows: np.ndarray, hashes: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every row, sorted, and where each row starts."""
    at = row_starts(rows, n_rows)
    parts = [np.unique(hashes[at[i] : at[i + 1]]) for i in range(n_rows)]
    starts = np.zeros(n_rows + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=starts[1:])
    return np.concatenate(parts) if parts else hashes, starts


def _samples(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """K MinHash samples (32 bits) of each row that has shingles."""
    short = (sets >> _U64(32)).astype(np.uint32)
    out = np.empty((K, len(starts)), np.uint32)
    for k in range(K):
        out[k] = np.minimum.reduceat((short ^ _MASK[k]) * _MULTIPLIER[k], starts)
    return out


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _lists(values: np.ndarray, width: int, present: np.ndarray) -> pa.Array:
    ends = np.zeros(len(present) + 1, np.int32)
    np.cumsum(present * width, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), _signed(np.ascontiguousarray(values.reshape(-1))))


def _signatures(texts: pa.Array) -> pa.Array:
    n = len(texts)
    sets, starts = _distinct(*shingles(*word_hashes(texts), n, SHINGLE), n)
    size = np.diff(starts)
    present = size > 0
    identity = np.zeros((2, n), _U64)
    if present.any():
        at = starts[:-1][present]
        identity[0, present] = np.add.reduceat(mix(sets), at)
        identity[1, present] = np.add.reduceat(mix(sets ^ _U64(0x5851F42D4C957F2D)), at)
        sample = _samples(sets, at).astype(_U64)
        bands = np.zeros((present.sum(), BANDS), _U64)
        for b in range(BANDS):
            key = np.full(bands.shape[0], b + 1, _U64)
            for r in range(ROWS):
                key = mix(key + sample[b * ROWS + r])
            bands[:, b] = key
        toggled = (mix(sample + _SEED[:, None]) % _U64(BITS)).astype(np.int64) + np.arange(bands.shape[0]) * BITS
        parity = (np.bincount(toggled.reshape(-1), minlength=bands.shape[0] * BITS) & 1).astype(np.uint8)
        sketch = np.packbits(parity, bitorder="little").view(_U64).reshape(-1, BITS // 64)
    else:
        bands, sketch = np.zeros((0, BANDS), _U64), np.zeros((0, BITS // 64), _U64)
    return pa.StructArray.from_arrays(
        [
            pa.array(size), _signed(identity[0]), _signed(identity[1]),
            _lists(bands, BANDS, present), _lists(sketch, BITS // 64, present),
        ],
        names=["n", "a", "b", "bands", "sketch"],
    )


@F.arrow_udf(SIGNATURE)
def signature(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Set size, 128-bit set identity, band keys and odd sketch of each text."""
    for batch in batches:
        yield pa.concat_arrays([_signatures(b) for b in blocks(batch)])


@F.arrow_udf(T.ArrayType(T.LongType()))
def shingle_set(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The distinct shingle hashes of each text."""
    for batch in batches:
        out = []
        for block in blocks(batch):
            sets, starts = _distinct(*shingles(*word_hashes(block), len(block), SHINGLE), len(block))
            out.append(pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), _signed(sets)))
        yield pa.concat_arrays(out)


def estimate(a: Column, b: Column) -> Column:
    """Similarity estimated from the sketches; 0 where the bitmaps differ too much to tell."""
    apart = sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(BITS // 64)), F.lit(0))
    inside = F.lit(1.0) - apart * F.lit(2.0 / BITS)
    return F.when(inside <= 0, 0.0).otherwise(F.lit(1.0) + F.log(inside) * F.lit(BITS / (4.0 * K)))


def sketch_margin(similarity: float, errors: float = 4.0) -> float:
    """How far below ``similarity`` an estimate may fall: standard errors of the samples and of the bitmap."""
    samples = similarity * (1 - similarity) / K
    x = 4 * K * (1 - similarity) / BITS
    bitmap = (math.exp(x) - 1) * BITS / (4.0 * K) ** 2 * 2
    return errors * math.sqrt(samples + bitmap)


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""
    # The side that many pairs share (v, a bucket's smallest class) is joined first: that join may be skewed, and
    # adaptive execution splits it; u is spread evenly.
    one = sets.select(F.col("node").alias("v"), F.col("set").alias("_b"))
    two = sets.select(F.col("node").alias("u"), F.col("set").alias("_a"))
    both = F.size(F.array_intersect("_a", "_b"))
    joined = pairs.join(one, "v").join(two, "u").withColumn("_both", both)
    union = F.size("_a") + F.size("_b") - F.col("_both")
    return joined.filter(F.col("_both") * 100 >= union * similarity).select("u", "v").distinct()


def _size_fits(a: str, b: str, similarity: int) -> Column:
    """Sets of these sizes can reach the similarity: the smaller one holds that share of the larger."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * similarity


def _size_class(n: str, similarity: int) -> Column:
    """Sizes that fit each other lie in the same class or in neighbouring ones."""
    return F.floor(F.log(F.col(n)) / F.lit(math.log(100 / similarity)) + F.lit(1e-9)).cast("int")


def _main_groups(grouped: DataFrame, turn: int) -> DataFrame:
    """Per bucket (key) with several groups: its largest group and one member of it, another one each turn."""
    drawn = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n")
    by_group = grouped.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("_n"), F.min(drawn).alias("_head"))
    best = F.max(F.struct("_n", "comp", "_head"))
    return (
        by_group.groupBy("key").agg(best.alias("_m"), F.count(F.lit(1)).alias("_groups")).filter("_groups > 1")
        .select("key", F.col("_m.comp").alias("main"), F.col("_m._head.node").alias("head"), F.col("_m._head.n").alias("head_n"))
    )


def _likeliest(grouped: DataFrame, sketches: DataFrame, floor: float, turn: int, similarity: int) -> DataFrame:
    """For each class outside a bucket's largest group the likeliest of the members it meets: pairs (u, v)."""
    met = grouped.join(_main_groups(grouped, turn), "key").filter("comp <> main").filter(_size_fits("n", "head_n", similarity))
    pairs = met.select(F.col("node").alias("u"), F.col("head").alias("v")).distinct()
    rated = (
        pairs.join(sketches.select(F.col("node").alias("u"), F.col("sketch").alias("_a")), "u")
        .join(sketches.select(F.col("node").alias("v"), F.col("sketch").alias("_b")), "v")
        .select("u", "v", estimate(F.col("_a"), F.col("_b")).alias("_e")).filter(F.col("_e") >= floor)
    )
    return rated.groupBy("u").agg(F.max(F.struct("_e", "v")).alias("_best")).select("u", F.col("_best.v").alias("v"))


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): n_shingles, component_id, kept.

    A text without words (or null) has no shingles and is linked with nothing; a text of fewer than five words is one
    shingle.  Rows that repeat a ``doc_id`` are one document: it is linked if any of its texts is.  A row without
    ``doc_id`` takes no part: its component is null and it is kept.  Other columns are ignored.  An empty table gives
    no rows.
    """
    need_columns(docs, "doc_id", "text")
    ready_for_python(docs.sparkSession)
    signed = materialize(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), signature(F.col("text")).alias("s"))
        .select("doc_id", "s.*"),
        "signatures",
    )
    with_words = signed.filter("n > 0")
    # 1. Classes of equal sets; partial aggregation leaves one row per class and task before the shuffle.
    node = materialize(
        with_words.filter("doc_id is not null").groupBy("a", "b").agg(F.min("doc_id").alias("node")), "classes"
    )
    reps = materialize(
        with_words.join(node, (with_words.doc_id == node.node) & (with_words.a == node.a) & (with_words.b == node.b))
        .select("node", "n", "bands", "sketch").dropDuplicates(["node", "bands"]),
        "representatives",
    )
    keyed = reps.select("node", "n", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("_a"), F.max("node").alias("_b")).filter("_a < _b").select("key")
    met = materialize(keyed.join(shared, "key"), "met")
    sets = materialize(
        docs.select(F.col("doc_id").cast("bigint").alias("node"), "text")
        .join(met.select("node").distinct(), "node", "left_semi")
        .select("node", shingle_set(F.col("text")).alias("set")).filter(F.size("set") > 0),
        "sets",
    )
    floor = similarity / 100.0 - sketch_margin(similarity / 100.0)
    sketches = reps.select("node", "sketch")
    # 2. Rounds in which a class meets one member of each bucket's largest group and keeps the likeliest.
    grouped = met.withColumn("comp", F.col("node"))
    roots = node.select("node", F.col("node").alias("comp"))
    for turn in range(ROUNDS):
        roots = merge_components(roots, _confirmed(_likeliest(grouped, sketches, floor, turn, similarity), sets, similarity))
        grouped = met.join(roots, "node")
    # 3. Buckets that still hold several groups.
    open_ = materialize(
        grouped.join(_main_groups(grouped, ROUNDS), "key").select("key", "node", "comp", "main")
        .join(reps, "node").withColumn("_class", _size_class("n", similarity)).distinct(),
        "open",
    )
    near = F.explode(F.array(*[F.col("_class") + d for d in (-1, 0, 1)])).alias("_near")
    left = open_.filter("comp <> main").select(
        "key", F.col("node").alias("u"), F.col("comp").alias("_cu"), F.col("sketch").alias("_a"), F.col("bands").alias("_ba"),
        F.col("n").alias("_nu"), near,
    )
    right = open_.select(
        F.col("n").alias("_nv"), "_class",
        F.col("key").alias("_key"), F.col("node").alias("v"), F.col("comp").alias("_cv"), F.col("sketch").alias("_b"),
        F.col("bands").alias("_bb"), (F.col("comp") == F.col("main")).alias("_main"),
    )
    same = F.filter(F.zip_with("_ba", "_bb", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())
    across = left.join(
        right,
        (F.col("key") == F.col("_key")) & (F.col("_near") == F.col("_class")) & _size_fits("_nu", "_nv", similarity)
        & (F.col("_cu") != F.col("_cv")) & (F.col("_main") | (F.col("u") < F.col("v")))
        & (estimate(F.col("_a"), F.col("_b")) >= floor)
        & (F.get(same, F.lit(0)) == F.col("key")),  # a pair comes out of the first bucket it shares only
    ).select("u", "v").distinct()
    more = _confirmed(across, sets, similarity)
    # A doc_id with several texts ties their classes together.
    members = signed.filter("n > 0").join(node, ["a", "b"])
    repeated = members.filter("doc_id is not null").groupBy("doc_id").agg(
        F.min("node").alias("u"), F.max("node").alias("v")
    ).filter("u < v")
    ties = (
        members.join(repeated.select("doc_id", "u"), "doc_id").select("u", F.col("node").alias("v")).filter("u <> v")
    )
    groups = merge_components(roots, more.unionByName(ties))
    roots = node.join(groups, "node").select("a", "b", F.col("comp").alias("_root"))
    done = signed.select("doc_id", "n", F.when(F.col("n") > 0, F.col("a")).alias("a"), "b").join(
        roots, ["a", "b"], "left"
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_root", "doc_id"))
    return done.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _unused(columns: list[str], name: str) -> str:
    """``name``, or a longer form of it that no column has."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def _quoted(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def drop_near_duplicates(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest ``doc_id``; all columns stay as they are.

    Where a ``doc_id`` repeats with other texts, each text is a document of its own (the smallest of near copies under
    one id stays), but a null one beside a text is dropped.  Of rows that repeat id and text one stays, the same in every
    run unless all their columns print alike.  Rows without ``doc_id`` stay.  Empty tables stay empty.
    """
    need_columns(docs, "doc_id", "text")
    with_id = docs.filter("doc_id is not null")
    key = F.col("doc_id").cast("bigint")
    keep_id, keep_text, told_id, nth = (_unused(docs.columns, n) for n in ("_keep", "_text", "_told", "_nth"))
    slim = with_id.select(key.alias("_id"), "text")
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())
    several = slim.groupBy("_id").agg(F.min(text_hash).alias("_a"), F.max(text_hash).alias("_b")).filter("_a < _b")
    if several.isEmpty():
        decided = near_duplicates(slim.withColumnRenamed("_id", "doc_id"), similarity)
        keep = decided.filter("kept and doc_id is not null").select(F.col("doc_id").alias(keep_id)).distinct()
        left = with_id.join(keep, key == F.col(keep_id), "left_semi")
    else:
        numbered = materialize(
            number_rows(slim.distinct(), [F.col("_id").asc(), F.col("text").asc_nulls_last()], name="_n"), "numbered"
        )
        decided = near_duplicates(numbered.select(F.col("_n").alias("doc_id"), "text"), similarity)
        keep = numbered.join(decided.filter("kept").select(F.col("doc_id").alias("_n")), "_n", "left_semi")
        texts = keep.select(F.col("_id").alias(keep_id), F.col("text").alias(keep_text))
        told = slim.filter("text is not null").select(F.col("_id").alias(told_id)).distinct()
        left = with_id.join(texts, (key == F.col(keep_id)) & F.col("text").eqNullSafe(F.col(keep_text)), "left_semi")
        left = left.filter("text is not null").unionByName(
            left.filter("text is null").join(told, key == F.col(told_id), "left_anti")
        )
    # Spark keeps the first row of a window per task before the shuffle, so a row repeated very often is no hot key.
    printed = F.xxhash64(*[_quoted(c).cast("string") for c in docs.columns])
    first = F.row_number().over(W.partitionBy("doc_id", "text").orderBy(printed))
    one = left.select("*", first.alias(nth)).filter(F.col(nth) == 1).select(*map(_quoted, docs.columns))
    return one.unionByName(docs.filter("doc_id is null"))
