"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned: terms are whole words and word beginnings whose document frequency is much higher in toxic
than in clean labelled texts; of those, a greedy cover keeps the few that explain the toxic texts, so that rare words
of repeated texts stay out.  Features are lexicon densities, closeness of lexicon words to second-person pronouns,
and rates of capitals, punctuation, symbols, digits and obfuscated words.  Lexicon features of a labelled row come
from a lexicon learned without its fold, trees are cross-fitted the same way, and the calibration sees only
out-of-fold scores.

The labelled sample is bounded: at most ``MAX_TOXIC`` and ``MAX_CLEAN`` rows with the smallest hash of their id, one
for each distinct text; weights restore the shares of the classes.  Everything else sees every text whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerloom.llm.boosting import Boosted, fit_boosted, fit_isotonic, sigmoid
from ledgerloom.llm.textnum import blocks, ready_for_python, need_columns, text_bytes
from ledgerloom.storage import materialize

MAX_TOXIC, MAX_CLEAN = 2000, 4000
THRESHOLD = 0.7
FOLDS = 3
LEAST_LOG_ODDS = 2.5
COVER = 4  # terms wanted for every toxic text of the sample
PREFIXES = (3, 4, 5, 6, 7)
WHOLE = " "  # ends a term that stands for a whole word

SECOND_PERSON = (
    "you", "your", "yours", "yourself", "u", "ur",
    "du", "dich", "dir", "dein", "deine", "ihr", "euch",
    "tu", "toi", "te", "ton", "ta", "tes", "vous", "votre", "vos",
    "tú", "ti", "tus", "usted", "ustedes", "vosotros",
)
_PERSON = re.compile(r"(?<![^\W\d_])(?:" + "|".join(SECOND_PERSON) + r")(?![^\W\d_])")
_MASKED = re.compile(r"[^\W\d_]+[0-9@$!*]+[^\W\d_]+")
_UNMASK = str.maketrans("013457@$!", "oieastasi")
NEAR = 60  # characters

# Byte classes: capitals, exclamation and question marks, other punctuation, symbols, digits, beyond ASCII.
_CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!", b"?", b".,;:'\"-()", b"#*$%&|<>@_=+~^", b"0123456789", bytes(range(128, 256)),
)
FEATURES = 5 + 2 + len(_CLASSES) + 4


class Lexicon:
    """Terms with weights, found in one pass over a text."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self._found = None

    def __getstate__(self):
        return self.weights

    def __setstate__(self, weights):
        self.__init__(weights)

    def hits(self, text: str) -> list[tuple[int, str, float]]:
        """(start, term, weight) of the heaviest term at each word that has one; ``text`` is lower case."""
        if not self.weights:
            return []
        if self._found is None:
            self._found = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                word = term.rstrip(WHOLE)
                held = self._found.get(word, ())
                self._found.add_word(word, (*held, (len(word), term, weight)))
            self._found.make_automaton()
        best: dict[int, tuple[str, float]] = {}
        for end, terms in self._found.iter(text):
            for size, term, weight in terms:
                start = end - size + 1
                if start and text[start - 1].isalpha():
                    continue
                if term.endswith(WHOLE) and end + 1 < len(text) and text[end + 1].isalpha():
                    continue
                if start not in best or weight > best[start][1]:
                    best[start] = (term, weight)
        return [(start, *found) for start, found in sorted(best.items())]


def _lexical(text: str, lexicon: Lexicon, words: int) -> list[float]:
    low = text.lower()
    found = lexicon.hits(low)
    masked = 0
    if _MASKED.search(low):
        for m in _MASKED.finditer(low):
            masked += 1
            found += [(m.start(), t, w) for _, t, w in lexicon.hits(m[0].translate(_UNMASK))]
    near = 0
    if found:
        persons = np.array([m.start() for m in _PERSON.finditer(low)])
        if len(persons):
            starts = np.array([s for s, _, _ in found])
            at = np.searchsorted(persons, starts)
            gap = np.minimum(
                np.abs(persons[np.minimum(at, len(persons) - 1)] - starts), np.abs(persons[np.maximum(at - 1, 0)] - starts)
            )
            near = int((gap <= NEAR).sum())
    per = 1000.0 / max(words, 1)
    weight = sum(w for _, _, w in found)
    top = max((w for _, _, w in found), default=0.0)
    return [
        math.log1p(len(found)), len(found) * per, float(len({t for _, t, _ in found})), top, weight * per,
        float(near), near * per, masked * per,
    ]


def features(texts: pa.Array, lexicons: list[Lexicon], which: np.ndarray) -> np.ndarray:
    """Feature rows of large-string texts without nulls; row ``i`` uses ``lexicons[which[i]]``."""
    n = len(texts)
    data, ends = text_bytes(texts)
    table = np.zeros(256, np.int64)
    for k, members in enumerate(_CLASSES):
        table[np.frombuffer(members, np.uint8)] = k + 1
    kind = table[data]
    size = np.diff(ends)
    sums = []
    for k in range(1, len(_CLASSES) + 1):
        upto = np.concatenate([[0], np.cumsum(kind == k)])
        sums.append(np.diff(upto[ends]))
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    gap = np.concatenate([[0], np.cumsum(space[data])])
    words = np.diff(gap[ends]) + 1
    shouted = np.zeros(len(data), bool)
    if len(data):
        shouted[1:] = (kind[1:] == 1) & (kind[:-1] == 1)
    loud = np.diff(np.concatenate([[0], np.cumsum(shouted)])[ends])
    lexical = np.array(
        [_lexical(t, lexicons[w], c) for t, w, c in zip(texts.to_pylist(), which, words.tolist())], float
    ).reshape(n, 8)
    share = np.maximum(size, 1)
    rates = [s / share for s in sums] + [loud / share, np.log1p(size), np.log1p(words)]
    return np.concatenate([lexical, np.stack(rates, 1)], 1)


@dataclass
class ToxicityModel:
    """Lexicon, trees and calibration; without labels of both classes, the share of toxic labels."""

    lexicon: Lexicon
    trees: Boosted | None
    knots: tuple[np.ndarray, np.ndarray]
    prior: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.prior)
        raw = sigmoid(self.trees.raw(features(texts, [self.lexicon], np.zeros(len(texts), np.int64))))
        # A thousandth of the uncalibrated score keeps the order inside flat stretches.
        return 0.999 * np.interp(raw, *self.knots) + 0.001 * raw


def learnable(doc_id: Column) -> Column:
    """Rows whose label may be learned from: crc32 of the id as text, mod 3, is not 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def _first_of_each(usable: DataFrame, counts: dict[int, int]) -> DataFrame:
    """The rows (doc_id, toxic) with the smallest hashes of each label, MAX_TOXIC and MAX_CLEAN of them.

    A bound of the hash first leaves some four times as many rows as are wanted, so that the tasks that rank them do not
    grow with the table; a bound that left too few would be raised.
    """
    limits = {1: MAX_TOXIC, 0: MAX_CLEAN}
    wanted = {label: min(n, limits[label]) for label, n in counts.items()}
    place = F.xxhash64("doc_id").cast("double") / F.lit(2.0**64) + 0.5
    order = W.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    limit = F.when(F.col("toxic") == 1, MAX_TOXIC).otherwise(MAX_CLEAN)
    share = 4.0
    while True:
        near = F.lit(False)
        for label, n in counts.items():
            near = near | ((F.col("toxic") == label) & (place * n <= share * limits[label]))
        ranked = usable.filter(near).withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= limit)
        first = materialize(ranked.select("doc_id", "toxic"), "toxicity-ids")
        found = {r["toxic"]: r["n"] for r in first.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        if found == wanted:
            return first
        share *= 4


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float, int]:
    """Bounded labelled texts (doc_id, text, toxic, fold, weight), the share of toxic labels and their number."""
    usable = labels.filter("toxic is not null and doc_id is not null").filter(learnable(F.col("doc_id")))
    usable = usable.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    # At most MAX_TOXIC + MAX_CLEAN ids: small enough to send to every task.
    chosen = _first_of_each(usable, counts).select(F.col("doc_id").alias("_id"), "toxic")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).drop("_id")
    one = W.partitionBy(F.xxhash64("text")).orderBy(F.col("toxic").desc(), "doc_id")
    rows = rows.withColumn("_copy", F.row_number().over(one)).filter("_copy = 1").drop("_copy")
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int"))
    total = sum(counts.values())
    return materialize(rows, "toxicity-sample"), counts.get(1, 0) / total if total else 0.0, total


def _terms(text: Column) -> Column:
    """Distinct whole words and word beginnings of a text."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1))

    def beginnings(n: int) -> Column:
        return F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.left(w, F.lit(n)))

    whole = F.transform(F.filter(words, lambda w: F.length(w) > 2), lambda w: F.concat(w, F.lit(WHOLE)))
    return F.array_distinct(reduce(lambda a, b: F.concat(a, b), [whole, *map(beginnings, PREFIXES)]))


def _log_odds(p, n, pos: int, neg: int) -> np.ndarray:
    p, n = np.asarray(p, float), np.asarray(n, float)
    return np.log((p + 0.5) / (pos + 1.0)) - np.log((n + 0.5) / (neg + 1.0))


def _cover(present: np.ndarray, terms: list[str], weight: np.ndarray, least: int) -> np.ndarray:
    """Greedy cover of the rows of ``present`` by terms, COVER times over, by gain times weight; ties go to the longer.

    Of a word and its beginnings one is taken: a chosen term rules out those that begin it or that it begins.
    """
    missing = np.full(len(present), COVER)
    free = weight >= LEAST_LOG_ODDS
    size = np.array([len(t) for t in terms])
    chosen = []
    while free.any():
        gain = np.where(free, present[missing > 0].sum(0), 0)
        best = int(np.lexsort((-np.arange(len(gain)), size, gain * weight))[-1])
        if gain[best] < least:
            break
        chosen.append(best)
        free &= np.array([not (t.startswith(terms[best]) or terms[best].startswith(t)) for t in terms])
        missing -= present[:, best]
    return np.array(chosen, np.int64)


def _lexicons(sample: DataFrame) -> list[Lexicon]:
    """Lexicons learned without fold 0, 1, ..., and from all folds."""
    size = {(r["fold"], r["toxic"]): r["n"] for r in sample.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos = np.array([size.get((f, 1), 0) for f in range(FOLDS)])
    neg = np.array([size.get((f, 0), 0) for f in range(FOLDS)])
    columns = [
        F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == t), 1).otherwise(0)).alias(f"{'np'[t]}{f}")
        for f in range(FOLDS) for t in (0, 1)
    ]
    counted = sample.select("fold", "toxic", F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(*columns)
    p = reduce(lambda a, b: a + b, [F.col(f"p{f}") for f in range(FOLDS)])
    n = reduce(lambda a, b: a + b, [F.col(f"n{f}") for f in range(FOLDS)])
    odds = F.log((p + 0.5) / (float(pos.sum()) + 1.0)) - F.log((n + 0.5) / (float(neg.sum()) + 1.0))
    # Half the limit of log-odds here: a lexicon without one fold may still want the term.
    # The rows of the sample are bounded, and so are the terms that three of its toxic texts hold.
    found = counted.filter((p >= 3) & (odds >= LEAST_LOG_ODDS / 2)).orderBy(p.desc(), "term").collect()
    terms = [r["term"] for r in found]
    if not terms:
        return [Lexicon({})] * (FOLDS + 1)
    in_p = np.array([[r[f"p{f}"] for f in range(FOLDS)] for r in found])
    in_n = np.array([[r[f"n{f}"] for f in range(FOLDS)] for r in found])
    wanted = F.split(F.lit("\n".join(terms)), "\n", -1)
    held = sample.filter("toxic = 1").select("fold", F.array_intersect(_terms(F.col("text")), wanted).alias("held")).collect()
    place = {t: i for i, t in enumerate(terms)}
    present = np.zeros((len(held), len(terms)), bool)
    for i, r in enumerate(held):
        present[i, [place[t] for t in r["held"]]] = True
    fold = np.array([r["fold"] for r in held])
    out = []
    for left_out in range(FOLDS + 1):
        use = np.arange(FOLDS) != left_out
        weight = _log_odds(in_p[:, use].sum(1), in_n[:, use].sum(1), pos[use].sum(), neg[use].sum())
        rows = present[fold != left_out]
        chosen = _cover(rows, terms, weight, max(2, len(rows) // 500))
        out.append(Lexicon({terms[i]: float(weight[i]) for i in chosen}))
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learn from ``labels`` (doc_id, toxic) of the rows that may be learned from, and the texts of ``docs``.

    Null labels and ids, and labels without a text row, are left out; a repeated label counts as toxic if any says so.
    """
    need_columns(docs, "doc_id", "text")
    need_columns(labels, "doc_id", "toxic")
    ready_for_python(docs.sparkSession)
    sample, share, total = _sample(docs, labels)
    kinds = {r["toxic"] for r in sample.select("toxic").distinct().collect()}
    if len(kinds) < 2:
        return ToxicityModel(Lexicon({}), None, (np.zeros(1), np.zeros(1)), share)
    lexicons = _lexicons(sample)

    @F.arrow_udf("array<double>")
    def feature_rows(text: pa.Array, fold: pa.Array) -> pa.Array:
        out, at = [], 0
        which = np.asarray(fold)
        for block in blocks(text):
            out += list(features(block, lexicons, which[at : at + len(block)]))
            at += len(block)
        return pa.array(out, pa.list_(pa.float64()))

    # A bounded number of rows of FEATURES numbers.
    rows = sample.select("doc_id", "toxic", "fold", feature_rows("text", "fold").alias("x")).orderBy("doc_id").collect()
    x = np.array([r["x"] for r in rows])
    y, fold = np.array([r["toxic"] for r in rows]), np.array([r["fold"] for r in rows])
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    out_of_fold = np.zeros(len(y))
    for f in range(FOLDS):
        rest = fold != f
        if rest.all() or not rest.any() or len(set(y[rest])) < 2:
            out_of_fold[~rest] = share
        else:
            out_of_fold[~rest] = sigmoid(fit_boosted(x[rest], y[rest], weight[rest]).raw(x[~rest]))
    return ToxicityModel(lexicons[-1], fit_boosted(x, y, weight), fit_isotonic(out_of_fold, y, weight), share)


def toxicity_score(model: ToxicityModel):
    """Column function: score of a text, 0 to 1; null counts as empty."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [model.scores(b) for b in blocks(batch)]
            yield pa.array(np.concatenate(found) if found else np.zeros(0))

    return score


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; only the text is an input of the score.

    Null and empty texts get the score of an empty text; equal texts get equal scores; rows without ``doc_id`` are
    scored too (held_out is then false).  Other columns are ignored.  An empty table gives no rows.
    """
    need_columns(docs, "doc_id", "text")
    scored = docs.select("doc_id", toxicity_score(model)(F.col("text")).alias("score"))
    return scored.select(
        "doc_id",
        F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the texts that score at least ``threshold``; the columns stay as they are."""
    model = fit_toxicity(docs, labels)
    return docs.filter(toxicity_score(model)(F.col("text")) < threshold)
