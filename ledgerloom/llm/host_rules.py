"""Quality rules with host verdicts; DataFrame functions only.

Base rules look at one text.  Host rules look at the shares of a host's texts that fail the base rules, have too many
symbols, too many repeated lines, or words of odd length: each share is shrunk towards the corpus by its own beta prior
fitted to the hosts' shares (method of moments), and a host with a shrunk share above its limit loses all its texts.
The limit is ``SPREADS`` standard deviations above the mean of the prior fitted to the other hosts with shares up to
``max_host_rate``, but never below ``MIN_HOST_LIMIT`` nor above ``max_host_rate``.  A host with few texts stays close to the prior, so it is not condemned
by one bad text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.textnum import need_columns
from ledgerloom.storage import broadcast_if_small, materialize

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.8
MIN_HOST_LIMIT = 0.6  # one failing text at the least prior weight stays below
SPREADS = 4.0
MAX_SYMBOL_PERCENT = 10  # of the words
MAX_DUP_LINE_PERCENT = 30
WORD_LENGTHS = (2, 12)  # mean letters a word
MOST_PRIOR_WEIGHT = 1000.0  # hosts that hardly differ would make the prior infinitely strong

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 3


def _repeated_words(windows: Column) -> Column:
    """Words in windows (hashes, by first word) that occur twice or more, each word once."""
    # Equal windows stand next to each other once sorted; their places then cover up to WINDOW new words each.
    places = F.sort_array(F.transform(
        F.filter(
            "_sorted",
            lambda x, i: (F.get("_sorted", i - 1)["h"] == x["h"]) | (F.get("_sorted", i + 1)["h"] == x["h"]),
        ),
        lambda x: x["p"],
    ))
    start = F.struct(F.lit(-WINDOW).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("n"))
    covered = F.aggregate(
        places, start,
        lambda s, p: F.struct(
            p.cast("bigint").alias("at"), (s["n"] + F.least(F.lit(WINDOW).cast("bigint"), p - s["at"])).alias("n")
        ),
    )["n"]
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("bigint")).otherwise(covered)


def base_measures(docs: DataFrame) -> DataFrame:
    """doc_id, source and the measures of every text; windows of words are compared by 64-bit hash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    rows = docs.select(
        "doc_id", "source",
        F.regexp_extract_all(text, F.lit(f"({WORD})"), 1).alias("_w"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        lines.alias("_lines"),
    )
    hashes = F.when(
        F.size("_w") >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), F.size("_w") - WINDOW),
            lambda i: F.xxhash64(*[F.get("_w", i + j) for j in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(
        "doc_id", "source", "n_symbols",
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        hashes.alias("_h"),
    )
    rows = rows.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_h")) < F.size("_h"),
            F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("p")))),
        ),
    )
    return rows.select(
        "doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines",
        _repeated_words(F.col("_h")).alias("n_repeat_words"),
    )


def host_failures() -> dict[str, Column]:
    """What is counted per host, over the measures of a text; only a text with words has symbols, lines and lengths."""
    n = F.col("n_words")
    return {
        "base": F.col("base_failed"),
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * n,
        "dup_lines": 100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"),
        "lengths": (F.col("word_chars") < WORD_LENGTHS[0] * n) | (F.col("word_chars") > WORD_LENGTHS[1] * n),
    }


def _prior(texts: Column, failures: Column, square: Column) -> tuple[Column, Column]:
    """Mean and weight of the beta prior of hosts with these sums; ``square`` sums texts * rate ** 2."""
    mean = failures / texts
    spread = square / texts - mean * mean
    weight = F.greatest(F.lit(1.0), F.least(F.lit(MOST_PRIOR_WEIGHT), mean * (1 - mean) / spread - 1))
    return mean, F.when(spread > 0, weight).otherwise(MOST_PRIOR_WEIGHT)


def host_rates(measured: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Per host (``source``): texts, failures and shrunk rate of the base rules, and whether any rate is above its limit."""
    rules = host_failures()
    hosts = measured.filter("source is not null").groupBy("source").agg(
        F.count(F.lit(1)).alias("texts"), *[F.sum(failed.cast("bigint")).alias(k) for k, failed in rules.items()]
    )

    def square(k: str) -> Column:
        rate = F.col(k) / F.col("texts")
        return F.col("texts") * rate * rate

    def usual(k: str) -> Column:
        return F.col(k) <= max_host_rate * F.col("texts")

    def own(k: str) -> dict[str, Column]:
        return {"texts": F.col("texts"), "failures": F.col(k), "square": square(k)}

    sums = [F.sum("texts").alias("texts")]
    for k in rules:
        sums += [F.sum(k).alias(k), F.sum(square(k)).alias(f"{k}_square")]
        sums += [F.coalesce(F.sum(F.when(usual(k), v)), F.lit(0)).alias(f"{k}_usual_{n}") for n, v in own(k).items()]
    total = hosts.agg(*sums).select(F.struct("*")).scalar()
    rated = hosts.withColumn("_all", total)
    above = F.lit(False)
    for k in rules:
        mean, weight = _prior(F.col("_all.texts"), F.col(f"_all.{k}"), F.col(f"_all.{k}_square"))
        rated = rated.withColumn(f"{k}_rate", (F.col(k) + mean * weight) / (F.col("texts") + weight))
        # A bad host would raise its own limit, and those above the upper one that of others.
        texts, failures, squares = (
            F.col(f"_all.{k}_usual_{n}") - F.when(usual(k), v).otherwise(F.lit(0)) for n, v in own(k).items()
        )
        others = F.when(texts > 0, texts)
        mean, weight = _prior(others, failures, squares)
        limit = F.greatest(F.lit(MIN_HOST_LIMIT), mean + SPREADS * F.sqrt(F.greatest(mean * (1 - mean), F.lit(0.0)) / (weight + 1)))
        limit = F.when(others.isNull(), max_host_rate).otherwise(F.least(F.lit(max_host_rate), limit))
        above = above | (F.col(f"{k}_rate") > limit)
    return rated.select(
        "source", "texts", F.col("base").alias("failures"), F.col("base_rate").alias("rate"), above.alias("condemned")
    )


def quality_rules(docs: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per row of ``docs``: doc_id, measures, base_failed, host_rate, kept.

    A null text has no words and fails.  A row without ``source`` has no host: its host_rate is null and its base
    rules alone decide.  Repeated rows count as often as they occur.  An empty table gives no rows.  Columns other
    than doc_id, text and source are ignored.
    """
    need_columns(docs, "doc_id", "text", "source")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    # The measures are the whole cost: written once, then read for the hosts and for the documents.
    measured = materialize(base_measures(docs).withColumn("base_failed", failed), "measures")
    verdicts = materialize(
        host_rates(measured, max_host_rate).select(
            F.col("source").alias("_host"), F.col("rate").alias("host_rate"), F.col("condemned").alias("_condemned")
        ), "hosts",
    )
    # Up to a counted bound the verdicts go to the documents; beyond it, adaptive execution splits a hot host.
    verdicts = broadcast_if_small(verdicts)
    joined = measured.join(verdicts, F.col("source") == F.col("_host"), "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate",
        (~F.col("base_failed") & ~F.coalesce("_condemned", F.lit(False))).alias("kept"),
    )
