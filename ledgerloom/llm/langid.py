"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text is the average of the embeddings of its letter n-grams (2 to 4 UTF-8 bytes of lower-case words with their
bounds, hashed to ``BUCKETS`` rows).  Training sees a bounded sample: at most ``PER_LANGUAGE`` rows of each language,
the ones with the smallest hash of their id, whole and as one short stretch; the driver receives packed bucket counts,
not texts.  At prediction the embedding and the output layer are one table, so a text costs one look-up per n-gram.

A fifth of the sample, without copies of training texts, is kept out of training and cut into pieces of all lengths, from 8
characters on and inside words.  It sets the softmax temperature, against smoothed targets so that the loss has an
optimum also where every piece is told rightly, and the limit of rejection.  A softmax only compares the learned
languages, so rejection asks how likely the text's n-grams are in the language it was given: their mean
log-likelihood.  Its limit is taken per length class, from the low quantile of held-out pieces and a margin below it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ledgerloom.llm.textnum import blocks, ready_for_python, need_columns, text_bytes
from ledgerloom.storage import broadcast_if_small, materialize

BUCKETS = 1 << 14
WIDTH = 16
GRAMS = (2, 3, 4)
PER_LANGUAGE = 400
EPOCHS, RATE, BATCH = 8, 20.0, 32
SMOOTHING = 0.02  # of the calibration targets
SHORT_PIECES = 6  # cut from each held-out text
REJECT_SHARE, REJECT_MARGIN = 0.01, 4.0  # quantile of held-out pieces, and how much further below, in quantile-to-median distances
LENGTHS = (16, 48, 128, 512)  # numbers of n-grams that bound the length classes
UNKNOWN = "und"
SCORED_BYTES = 1 << 18  # of text scored at once; its n-grams take some 120 times as much memory

_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


def gram_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of large-string texts without nulls, grouped by text; and where each text begins."""
    large = pa.large_string()
    spaced = pc.binary_join_element_wise(pa.scalar("", large), pc.utf8_lower(texts), pa.scalar("", large), pa.scalar(" ", large))
    data, ends = text_bytes(spaced)
    letter = _LETTER[data]
    code = np.where(letter, data, 32).astype(np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(ends))
    rows, found = [], []
    value = code.copy()
    inside = np.ones(len(code), bool)  # the bytes after the first and before the last are letters
    for n in range(2, max(GRAMS) + 1):
        if len(code) < n:
            break
        if n > 2:
            inside = inside[: len(code) - n + 1] & letter[n - 2 : len(code) - 1]
        else:
            inside = inside[: len(code) - 1]
        value = value[: len(code) - n + 1] * np.uint32(0x01000193) + code[n - 1 :]
        first, last = slice(0, len(code) - n + 1), slice(n - 1, len(code))
        ok = inside & (letter[first] | letter[last]) & (row[first] == row[last])
        if n in GRAMS:
            h = value[ok] * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
            found.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(18)).astype(np.int64))
            rows.append(row[first][ok])
    rows = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    found = np.concatenate(found) if found else np.zeros(0, np.int64)
    order = np.argsort(rows, kind="stable")
    return found[order], np.searchsorted(rows[order], np.arange(len(texts) + 1))


@dataclass
class LanguageModel:
    """Score table (buckets by languages), bias and temperature; log-likelihoods of the buckets in each language, and the
    mean below which a text of each length class is rejected."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    likelihood: np.ndarray | None = None
    limits: np.ndarray | None = None

    def logits(self, buckets: np.ndarray, starts: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
        n = np.diff(starts)
        out = np.tile(self.bias, (len(n), 1))
        some = n > 0
        if some.any():
            weight = self.table[buckets] if counts is None else self.table[buckets] * counts[:, None]
            total = np.add.reduceat(weight, starts[:-1][some], axis=0)
            size = n[some] if counts is None else np.add.reduceat(counts, starts[:-1][some])
            out[some] += total / size[:, None]
        return out

    def fit_of(self, best: np.ndarray, buckets: np.ndarray, starts: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
        """Mean log-likelihood of each text's n-grams in its language; 0 without n-grams."""
        n = np.diff(starts)
        out, some = np.zeros(len(n)), n > 0
        if some.any():
            weight = np.ones(len(buckets)) if counts is None else counts
            each = self.likelihood[buckets, np.repeat(best, n)] * weight
            at = starts[:-1][some]
            out[some] = np.add.reduceat(each, at) / np.add.reduceat(weight, at)
        return out

    def judge(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its probability, and whether the text is rejected."""
        buckets, starts = gram_buckets(texts)
        p = _softmax(self.logits(buckets, starts) / self.temperature)
        best = p.argmax(1)
        if self.limits is None:
            return best, p.max(1), np.zeros(len(best), bool)
        fit = self.fit_of(best, buckets, starts)
        limit = self.limits[np.searchsorted(LENGTHS, np.diff(starts), side="right")]
        return best, p.max(1), (fit < limit) & (np.diff(starts) > 0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def learnable(doc_id: Column) -> Column:
    """Rows that may be learned from: crc32 of the id as text, mod 5, is not 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


_COUNTS = T.ArrayType(T.StructType([T.StructField("b", T.BinaryType()), T.StructField("c", T.BinaryType())]))


@F.arrow_udf(_COUNTS)
def _counted(texts: pa.Array, seeds: pa.Array, held: pa.Array) -> pa.Array:
    """Bucket counts of a text and of a short stretch of it, of a held-out text also of pieces of 8 characters and more;
    packed: buckets as 16-bit, counts as 32-bit numbers."""
    out = []
    for text, seed, is_held in zip(texts.to_pylist(), seeds.to_pylist(), held.to_pylist()):
        rng = np.random.default_rng(seed)
        sizes = [24 + seed % 137, *(rng.integers(8, 40 << 2 * (k % 3), SHORT_PIECES)[k] for k in range(SHORT_PIECES) if is_held)]
        pieces = [text]
        for size in sizes:
            at = int(rng.integers(0, max(1, len(text) - size)))
            pieces.append(text[at : at + size])
        both = []
        for piece in pieces:
            found, _ = gram_buckets(pa.array([piece], pa.large_string()))
            b, c = np.unique(found, return_counts=True)
            both.append({"b": b.astype("<u2").tobytes(), "c": c.astype("<f4").tobytes()})
        out.append(both)
    kind = pa.list_(pa.struct([("b", pa.binary()), ("c", pa.binary())]))
    return pa.array(out, kind)


def _train(items: list[tuple[np.ndarray, np.ndarray, int]], languages: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings times output weights (buckets by languages) and bias."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    out, bias = rng.normal(0, 0.1, (WIDTH, languages)), np.zeros(languages)
    steps, done = EPOCHS * -(-len(items) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(items))
        for at in range(0, len(order), BATCH):
            batch = [items[i] for i in order[at : at + BATCH]]
            b = np.concatenate([i[0] for i in batch]).astype(np.int64)
            w = np.concatenate([i[1] for i in batch])
            doc = np.repeat(np.arange(len(batch)), [len(i[0]) for i in batch])
            starts = np.searchsorted(doc, np.arange(len(batch)))
            mean = np.add.reduceat(embed[b] * w[:, None], starts, axis=0)
            p = _softmax(mean @ out + bias)
            p[np.arange(len(batch)), [i[2] for i in batch]] -= 1
            rate = RATE * (1 - done / steps) / len(batch)
            slope = p @ out.T
            out -= 0.1 * rate * mean.T @ p
            bias -= 0.01 * rate * p.sum(0)
            np.add.at(embed, b, -rate * w[:, None] * slope[doc])
            done += 1
    return embed @ out, bias


def fit_languages(docs: DataFrame) -> LanguageModel:
    """Learn from the text and non-null lang of the rows that may be learned from; texts without a letter are left out.

    Without any such row the model knows no language and every text is ``und``.
    """
    need_columns(docs, "doc_id", "text", "lang")
    ready_for_python(docs.sparkSession)
    usable = docs.filter("lang is not null and doc_id is not null and text is not null").filter(learnable(F.col("doc_id")))
    # Ids first: texts are read only for the chosen rows, at most PER_LANGUAGE of a language.
    chosen = F.broadcast(_first_of_each(usable.select("doc_id", "lang")).select(F.col("doc_id").alias("_id")).distinct())
    sample = usable.select("doc_id", "lang", "text").join(chosen, F.col("doc_id") == F.col("_id")).filter(F.col("text").rlike(r"\p{L}"))
    seed = F.xxhash64("doc_id", F.lit("stretch")).bitwiseAND(F.lit((1 << 40) - 1))
    held_out = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(5)) == 0
    got = sample.select("doc_id", "lang", held_out.alias("held"), F.xxhash64("text").alias("copy"), _counted("text", seed, held_out).alias("x")).collect()
    got.sort(key=lambda r: (r["held"], r["doc_id"], r["lang"], r["copy"]))
    languages = sorted({r["lang"] for r in got})
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0))
    place = {name: i for i, name in enumerate(languages)}
    train, held, seen = [], [], set()
    total = np.zeros((BUCKETS, len(languages)))
    for r in got:
        if r["held"] and r["copy"] in seen:
            continue
        seen.add(r["copy"])
        for k, piece in enumerate(r["x"]):
            b, c = np.frombuffer(piece["b"], "<u2"), np.frombuffer(piece["c"], "<f4")
            if len(b):
                if not r["held"] and k == 0:
                    total[b, place[r["lang"]]] += c
                (held if r["held"] else train).append((b, c, place[r["lang"]]))
    del got
    if len(languages) == 1 or not train:
        return LanguageModel(languages, np.zeros((BUCKETS, len(languages))), np.zeros(len(languages)))
    table, bias = _train([(b, c / c.sum(), y) for b, c, y in train], len(languages))
    model = LanguageModel(languages, table.astype(np.float32).astype(float), bias)
    model.likelihood = np.log((total + 0.5) / (total.sum(0) + 0.5 * BUCKETS)).astype(np.float32)
    if held:
        _calibrate(model, held)
    return model


def _first_of_each(ids: DataFrame) -> DataFrame:
    """The rows (doc_id, lang) with the PER_LANGUAGE smallest hashes of each language.

    A language's rows are first cut by a bound of the hash that leaves some four times as many as needed, so that the task
    that ranks them does not grow with the table; should a bound leave too few (ids that repeat), all rows are ranked.
    """
    count = materialize(ids.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")), "languages")
    place = F.xxhash64("doc_id").cast("double") / F.lit(2.0**64) + 0.5
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= PER_LANGUAGE)

    near = ids.join(broadcast_if_small(count), "lang").filter(place * F.col("_n") <= 4.0 * PER_LANGUAGE)
    first = materialize(ranked(near), "sampled-ids")
    found = first.groupBy("lang").agg(F.count(F.lit(1)).alias("_found"))
    short = count.join(found, "lang", "left").filter(F.coalesce("_found", F.lit(0)) < F.least("_n", F.lit(PER_LANGUAGE)))
    return first if short.isEmpty() else ranked(ids)


def _calibrate(model: LanguageModel, held: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    size = np.array([len(h[0]) for h in held])
    starts = np.concatenate([[0], np.cumsum(size)])
    buckets, counts = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]).astype(float)
    z = model.logits(buckets, starts, counts)
    truth = np.array([h[2] for h in held])
    target = np.full(z.shape, SMOOTHING / z.shape[1])
    target[np.arange(len(held)), truth] += 1 - SMOOTHING
    tried = np.geomspace(0.05, 20, 120)
    loss = [-(target * np.log(np.maximum(_softmax(z / t), 1e-12))).sum(1).mean() for t in tried]
    model.temperature = float(tried[int(np.argmin(loss))])
    best = z.argmax(1)
    fit = model.fit_of(best, buckets, starts, counts)
    kind = np.searchsorted(LENGTHS, np.add.reduceat(counts, starts[:-1]), side="right")
    limits = np.full(len(LENGTHS) + 1, -np.inf)
    for k in range(len(limits)):
        mine = fit[(kind == k) & (best == truth)]
        if len(mine) >= 2 / REJECT_SHARE:  # else the quantile cannot be told, and no text of that length is rejected
            low, middle = np.quantile(mine, [REJECT_SHARE, 0.5])
            limits[k] = low - REJECT_MARGIN * (middle - low)
    model.limits = limits


def language_of(model: LanguageModel):
    """Column function: (lang, score, known) of a text; ``und``, 0 and false where it is null or has no letter."""

    @F.arrow_udf("struct<lang:string,score:double,known:boolean>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            names, scores, known = [], [], []
            for block in blocks(batch, SCORED_BYTES):
                if model.languages:
                    best, p, rejected = model.judge(block)
                    letters = pc.match_substring_regex(block, r"\p{L}").to_numpy(zero_copy_only=False)
                    names += [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
                    scores += np.where(letters, p, 0.0).tolist()
                    known += (letters & ~rejected).tolist()
                else:
                    names += [UNKNOWN] * len(block)
                    scores += [0.0] * len(block)
                    known += [False] * len(block)
            fields = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(known, pa.bool_())]
            yield pa.StructArray.from_arrays(fields, names=["lang", "score", "known"])

    return predict


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; only the text is an input of the prediction.

    Null texts and texts without a letter are ``und`` with score 0; equal texts get equal results; a row without
    ``doc_id`` has held_out false.  Other columns are ignored.  An empty table gives no rows.
    """
    need_columns(docs, "doc_id", "text")
    told = docs.select("doc_id", language_of(model)(F.col("text")).alias("_l"))
    return told.select(
        "doc_id",
        F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out"),
        F.col("_l.lang").alias("lang_pred"),
        F.col("_l.score").alias("score"),
    )


def keep_known_languages(docs: DataFrame) -> DataFrame:
    """``docs`` without the texts that the model rejects: null, no letter, or n-grams too unlikely in the language told.

    All columns stay as they are.  Rows with equal texts share their fate, so repeated rows stay repeated.  Without any
    learnable row (an empty table, no ``lang``) every text is rejected.
    """
    model = fit_languages(docs)
    return docs.filter(language_of(model)(F.col("text"))["known"])
