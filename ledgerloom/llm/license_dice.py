"""License scan: Dice coefficient of word bigrams between text segments and licence templates; DataFrame functions only.

A segment is a line, or a paragraph (lines up to an empty one) of several lines.  Segments are normalised (lower case,
runs of anything but letters and digits are one blank).  A whole segment is compared to the templates whose bigram count
allows the wanted coefficient at all: ``2 * min / (a + b) >= t`` bounds the sizes to a factor of ``(2 - t) / t`` of each
other.  Inside a segment, every window of the template's length that begins with one of its bigrams is compared, cut off
after the last of them, so that a notice is found wherever it stands in a line or a paragraph.  Lines that hold a
notice of their own are left out of the windows of their paragraph.

The same bound says how many of a template's bigrams a match must share.  ``cover_words`` picks words that stand in so
many of them that a segment without any of these words cannot reach ``t``; such segments are left before their bigrams
are built.  No match is lost by it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.license_texts import BSD_2, PARAGRAPHS
from ledgerloom.llm.textnum import need_columns

THRESHOLD = 0.75

COMMON = frozenset(
    "a all an and any are as at be by can does each for from if in into is it may no not of on one or other out such than"
    " that the their there these they this those to under was we which who will with you your".split()
)

# Licence, kind of its terms, usual wordings of its notice.
NOTICES: tuple[tuple[str, str, str], ...] = (
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "permissive", "This project is licensed under the Apache License 2.0"),
    ("MIT", "permissive", "Released under the MIT License"),
    ("MIT", "permissive", "This project is licensed under the MIT License"),
    ("MIT", "permissive", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD-3-Clause", "permissive", "Released under the 3-Clause BSD License"),
    ("BSD-3-Clause", "permissive", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("BSD-3-Clause", "permissive", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "permissive", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "copyleft", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "copyleft", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-2.1", "copyleft", "This work is licensed under the GNU Lesser General Public License, version 2.1"),
    ("AGPL-3.0", "copyleft", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "copyleft", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "attribution", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "copyleft", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "copyleft", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "noncommercial", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "noncommercial", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-ND-4.0", "noderivatives", "Licensed under CC BY-ND 4.0"),
    ("CC0-1.0", "public domain", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("Unlicense", "public domain", "This is free and unencumbered software released into the public domain"),
)

# The first of equal coefficients wins, so that the one text that others hold parts of comes first.
TEMPLATES: tuple[tuple[str, str, str], ...] = (BSD_2, *NOTICES, *PARAGRAPHS)


def _words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a normalised template; a single word counts as itself."""
    words = _words(text)
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])] or words
    return sorted(set(pairs))


def normalised(segment: Column) -> Column:
    """Letters and digits of a segment in lower case, with one blank for all else."""
    return F.trim(F.regexp_replace(segment, r"[^\p{L}\p{N}]+", " "))


def _pairs(segment: Column) -> Column:
    """Word bigrams of a normalised segment in order; a single word counts as itself."""
    words = F.split(segment, " ")
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    # zip_with pads the shorter side with null; the padded pair is null.
    return F.when(F.size(words) == 1, words).otherwise(F.filter(pairs, lambda p: p.isNotNull()))


def _dice(pairs: Column, template: Column) -> Column:
    """Coefficient of distinct bigrams; ``pairs`` may repeat some."""
    shared = F.size(F.array_intersect(pairs, template["g"]))
    return F.lit(2.0) * shared / (F.size(F.array_distinct(pairs)) + F.size(template["g"]))


def _windows(pairs: Column, template: Column) -> Column:
    """Stretches of ``pairs`` of the template's length that begin and end with one of its bigrams and hold enough of them."""
    length, low = template["length"], template["low"]
    at = F.filter(F.transform(pairs, lambda p, i: F.when(F.array_contains(template["g"], p), i)), lambda i: i.isNotNull())
    # ``at`` is computed once: it is bound as the only element of an array.
    inside = F.flatten(F.transform(F.array(at), lambda at: F.transform(
        at, lambda i, k: F.filter(F.slice(at, k + 1, length), lambda j: j < i + length)
    )))
    enough = F.filter(inside, lambda w: F.size(w) >= low)
    return F.transform(enough, lambda w: F.slice(pairs, w[0] + 1, F.element_at(w, -1) - w[0] + 1))


def _size_bounds(n: int, t: float) -> tuple[int, int]:
    """Bigram counts with which ``n`` bigrams can still reach coefficient ``t``."""
    low = next(k for k in range(1, n + 1) if 2.0 * k / (n + k) >= t)
    high = n
    while 2.0 * n / (n + high + 1) >= t:
        high += 1
    return low, high


def cover_words(grams: Sequence[Sequence[str]], t: float) -> list[str]:
    """Words of which every segment holds one that reaches ``t`` with some template.

    A match shares ``low`` of a template's ``n`` bigrams or more, so ``n - low + 1`` of them cannot all be absent.  Words
    are chosen greedily until every template has so many bigrams with a chosen word; long words count for more, and words
    of every text only where no others are left.
    """
    left = [(set(g), len(g) - _size_bounds(len(g), t)[0] + 1) for g in grams]
    chosen: list[str] = []
    while any(need > 0 for _, need in left):
        gains: dict[str, int] = {}
        for open_, need in left:
            if need > 0:
                for word in {w for g in open_ for w in g.split()}:
                    gains[word] = gains.get(word, 0) + min(need, sum(word in g.split() for g in open_))
        word = max(gains, key=lambda w: (w not in COMMON, gains[w] * len(w) ** 2, w))
        chosen.append(word)
        for i, (open_, need) in enumerate(left):
            hit = {g for g in open_ if word in g.split()}
            left[i] = (open_ - hit, need - len(hit))
    return sorted(chosen)


def scan_licenses(
    docs: DataFrame, threshold: float = THRESHOLD, templates: Sequence[tuple[str, str, str]] = TEMPLATES
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_segments, n_matches, license, terms, dice, segment.

    ``n_segments`` counts segments with a letter or digit; ``n_matches`` those that reach the threshold with some
    template, whole or in a window.  The best match (highest coefficient, then earliest template, then earliest segment,
    counted from 0, lines before paragraphs) names the licence; the last four columns are null without a match.  Null
    and empty texts have no segments.  Repeated rows are scanned each; an empty table gives no rows; other columns are
    ignored.  A template of one word is compared to whole segments only.
    """
    need_columns(docs, "doc_id", "text")
    grams = [bigrams(t) for _, _, t in templates]
    bounds = [_size_bounds(len(g), threshold) for g in grams]
    least = min(b[0] for b in bounds)
    lone = any(len(_words(t)) == 1 for _, _, t in templates)
    known = F.array(*[
        F.struct(
            F.lit(i).alias("i"), F.lit(b[0]).alias("low"), F.lit(b[1]).alias("high"),
            F.lit(max(len(_words(t[2])) - 1, 1)).alias("length"), F.split(F.lit("\n".join(g)), "\n").alias("g"),
        )
        for i, (t, g, b) in enumerate(zip(templates, grams, bounds))
    ])
    cover = cover_words(grams, threshold)
    whole_words = F.array(*map(F.lit, cover))
    # A word that holds another one needs no search of its own.
    parts = [w for w in cover if not any(v != w and v in w for v in cover)]
    rows = docs.select("doc_id", F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("_t"))
    paragraphs = F.filter(F.split("_t", r"\n\s*\n", -1), lambda p: F.contains(F.trim(p), F.lit("\n")))

    def covered(c: Column) -> Column:
        return reduce(or_, [F.contains(c, F.lit(w)) for w in parts])

    def lettered(segments: Column) -> Column:
        return F.filter(segments, lambda s: s.rlike(r"[\p{L}\p{N}]"))

    def able(s: Column) -> Column:
        # A segment of w words has at most w - 1 bigrams, and repeated ones only make it fewer; one word stands for itself.
        n = F.size(F.split(s, " "))
        long_enough = (n > least) | (n == 1) if lone else n > least
        return long_enough & F.arrays_overlap(F.split(s, " "), whole_words)

    rows = rows.select(
        "doc_id", covered(F.col("_t")).alias("_hit"), lettered(F.split("_t", "\n", -1)).alias("_ls"), lettered(paragraphs).alias("_ps")
    )
    # Of most documents no segment has to be looked at.  The new names differ, as a lambda would read a column made beside it.
    count = F.size("_ls")

    def picked(segments: str, first: Column) -> Column:
        numbered = F.transform(segments, lambda s, i: F.struct((i + first).alias("i"), s.alias("raw")))
        return F.filter(numbered, lambda x: F.col("_hit") & covered(x["raw"]))

    rows = rows.select(
        "doc_id", (count + F.size("_ps")).cast("bigint").alias("n_segments"),
        picked("_ls", F.lit(0)).alias("_l"), picked("_ps", count).alias("_p"),
    )

    def best(i: Column, whole: Column, parts: Column) -> Column:
        """Highest coefficient of a segment, null if none is in reach; ``parts`` are the bigrams for windows."""
        distinct = F.array_distinct(whole)
        fitting = F.filter(known, lambda t: F.size(distinct).between(t["low"], t["high"]))
        scored = F.transform(fitting, lambda t: F.struct(
            _dice(distinct, t).alias("dice"), (-t["i"]).alias("template"), (-i).alias("segment")
        ))
        # No window shares more of a template's bigrams than the segment.
        held = F.filter(known, lambda t: F.size(F.array_intersect(parts, t["g"])) >= t["low"])
        inside = F.transform(held, lambda t: F.struct(
            F.array_max(F.transform(_windows(parts, t), lambda w: _dice(w, t))).alias("dice"),
            (-t["i"]).alias("template"), (-i).alias("segment"),
        ))
        return F.array_max(F.filter(F.concat(scored, inside), lambda m: m["dice"] >= threshold))

    def matches(segments: Column) -> Column:
        found = F.transform(segments, lambda x: F.struct(x["raw"].alias("raw"), best(x["i"], x["whole"], x["parts"]).alias("m")))
        return F.filter(found, lambda x: x["m"].isNotNull())

    lines = F.transform("_l", lambda x: F.struct(x["i"].alias("i"), x["raw"].alias("raw"), normalised(x["raw"]).alias("s")))
    rows = rows.withColumn("_l", F.filter(lines, lambda x: able(x["s"])))
    rows = rows.withColumn("_l", F.transform("_l", lambda x: F.struct(x["i"].alias("i"), x["raw"].alias("raw"), _pairs(x["s"]).alias("whole"))))
    rows = rows.withColumn("_l", matches(F.transform("_l", lambda x: x.withField("parts", x["whole"]))))

    own = F.transform("_l", lambda x: x["raw"])

    def without_own(raw: Column) -> Column:
        # What stands for a line that is left out has no letter, so that no bigram of a template goes across it.
        kept = F.transform(F.split(raw, "\n", -1), lambda s: F.when(F.array_contains(own, s), F.lit("|")).otherwise(normalised(s)))
        return F.array_join(F.filter(kept, lambda s: s != ""), " ")

    texts = F.transform("_p", lambda x: F.struct(
        x["i"].alias("i"), x["raw"].alias("raw"), normalised(x["raw"]).alias("s"), without_own(x["raw"]).alias("o")
    ))
    rows = rows.withColumn("_p", F.filter(texts, lambda x: able(x["s"])))
    rows = rows.withColumn("_p", F.transform("_p", lambda x: F.struct(
        x["i"].alias("i"), x["raw"].alias("raw"), _pairs(x["s"]).alias("whole"), _pairs(x["o"]).alias("parts")
    )))
    rows = rows.withColumn("_p", matches(F.col("_p")))
    rows = rows.select("doc_id", "n_segments", F.transform(F.concat("_l", "_p"), lambda x: x["m"]).alias("_m"))
    rows = rows.select("doc_id", "n_segments", F.size("_m").cast("bigint").alias("n_matches"), F.array_max("_m").alias("_best"))
    names, terms = (F.array(*[F.lit(t[k]) for t in templates]) for k in (0, 1))
    return rows.select(
        "doc_id", "n_segments", "n_matches",
        F.get(names, -F.col("_best.template")).alias("license"),
        F.get(terms, -F.col("_best.template")).alias("terms"),
        F.col("_best.dice").alias("dice"),
        (-F.col("_best.segment")).alias("segment"),
    )
