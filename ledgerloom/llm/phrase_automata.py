"""Collocations of two and three words, counted by weighted acyclic automata.

A count transducer reads the words of an n-gram and writes, on every arc, the count of the n-gram read so far: reading a
phrase gives the counts of all its beginnings.  States with the same arcs (labels, weights and targets) are one state.

1. A shard (a bounded stretch of a task's texts, one language) sorts its n-grams and builds their transducer, growing
   it block by block.  It is cut at bounds that all shards share (prefix ranges), so that equal n-grams meet.
2. Each range unites its shards' transducers and sums the weights; n-grams below the least count go.
3. Candidates ask for the counts of their parts.  Distinct parts are sent to their range and composed with its transducer.

Bounds are quantiles of a sample of n-grams.  They decide which task counts an n-gram, never the result.  A range may
begin inside the extensions of one word or word pair, so a hot prefix is many ranges.
"""

from __future__ import annotations

import struct
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerloom.llm.textnum import blocks, mix, need_columns, ready_for_python, text_bytes
from ledgerloom.storage import materialize

LEAST, TOP, SHARE, SCALE = 10, 2000, 50, 1_000_000
WORDS = 3
# A union works on some twenty arrays of its arcs, of which a task's stretch adds up to three a word: both bound its memory.
BLOCK = 2 << 20  # bytes of text counted at once
STRETCH = 250_000  # words counted at once
SHARD, SHARD_WORDS = 1_000_000, 500_000  # arcs, and distinct words, beyond which a shard is sent
RANGE_WORDS = 900_000  # distinct words beyond which a range is held in two parts
SAMPLE_TEXTS, SAMPLE_KEYS, LONGEST_KEY = 4096, 20_000, 200
RANK_PARTS = 64
UNDETERMINED = "und"

_BITS = 21
_LOW = (1 << _BITS) - 1
_U64 = np.uint64
_KIND = np.zeros(256, np.uint8)  # 1: between words, 2: between pieces
_KIND[[9, 32]] = 1
_KIND[[*b".,;:!?", *range(10, 14)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BINARY = pa.large_binary()


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of all (large-string, not null) texts, and for each the number of its text and of its piece."""
    data, ends = text_bytes(texts)
    kind = _KIND[data]
    is_word = kind == 0
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    at_row = ends[:-1][ends[:-1] < len(data)]
    begins[at_row] = is_word[at_row]
    starts = np.flatnonzero(begins)
    row = np.searchsorted(ends[1:], starts, side="right")
    # Counts within a block fit 32 bits; only those at the words are kept.
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts] + row if len(starts) else row
    inner = np.cumsum(is_word, dtype=np.int32)
    offsets = np.append(inner[starts] - 1, inner[-1] if len(inner) else 0).astype(np.int64)
    kept = np.ascontiguousarray(_LOWER[data[is_word]])
    words = pa.Array.from_buffers(_BINARY, len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    return words, row, piece


def _ranked(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words in byte order, and for each word its place there, from 1."""
    coded = words.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their summed counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def count_ngrams(words: pa.Array, piece: np.ndarray) -> Iterator["CountTransducer"]:
    """Transducers of the n-grams of a block of words; n-grams stay inside a piece.

    A block is counted in stretches of first words, which bounds the distinct words of a transducer.
    """
    for at in range(0, len(words), STRETCH):
        own = min(STRETCH, len(words) - at)
        symbols, ids = _ranked(words.slice(at, min(own + WORDS - 1, len(words) - at)))
        there = piece[at : at + len(ids)]
        place, key = np.arange(own), ids[:own] << 2 * _BITS
        found = [key]
        for n in range(1, WORDS):
            inside = place + n < len(ids)
            inside[inside] = there[place[inside] + n] == there[place[inside]]
            place, key = place[inside], key[inside]
            key = key | ids[place + n] << (WORDS - 1 - n) * _BITS
            found.append(key)
        keys, counts = np.unique(np.concatenate(found), return_counts=True)
        yield CountTransducer.build(symbols, keys, counts)


def _register(starts: np.ndarray, *arcs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States that stay (the first of each kind), and for every state the number of the one that stands for it.

    Kinds are found by hash and confirmed arc by arc.
    """
    size = np.diff(starts)
    owner = np.repeat(np.arange(len(size)), size)
    h = np.zeros(len(size), _U64)
    if len(owner):
        each = np.full(len(owner), 0x9E3779B97F4A7C15, _U64)
        for a in arcs:
            each = mix(each + a.astype(_U64))
        total = np.zeros(len(each) + 1, _U64)
        np.cumsum(each, out=total[1:])
        h = total[starts[1:]] - total[starts[:-1]]
    _, first, kind = np.unique(h, return_index=True, return_inverse=True)
    stand = first[kind]
    wrong = size[stand] != size
    same = ~wrong[owner]
    mine = np.flatnonzero(same)
    theirs = mine - starts[owner[mine]] + starts[stand[owner[mine]]]
    for a in arcs:
        wrong[owner[mine[a[mine] != a[theirs]]]] = True
    stand[wrong] = np.flatnonzero(wrong)
    own = stand == np.arange(len(stand))
    return np.flatnonzero(own), (np.cumsum(own) - 1)[stand]


def _before(marked: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many marks stand before each place, and all of them."""
    total = np.zeros(len(marked) + 1, np.int64)
    np.cumsum(marked, out=total[1:])
    return np.append(total[places], total[-1])


def _chosen(starts: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the arcs of the given states, one state after the other, and where each state's begin."""
    size = np.diff(starts)[states]
    begin = np.concatenate([[0], np.cumsum(size)])
    return np.arange(begin[-1]) + np.repeat(starts[states] - begin[:-1], size), begin


class CountTransducer:
    """Counts of n-grams of up to three words as an acyclic automaton; an arc of weight 0 only leads on.

    ``symbols`` are the words in byte order; labels count from 1.  ``one`` are the root's arcs (label, weight, target);
    ``two`` and ``three`` are the arcs of the states after one and two words, which begin at ``at_two`` and ``at_three``.
    """

    def __init__(self, symbols: pa.Array, one, at_two, two, at_three, three):
        self.symbols, self.one, self.at_two, self.two = symbols, one, at_two, two
        self.at_three, self.three = at_three, three

    @classmethod
    def build(cls, symbols: pa.Array, keys: np.ndarray, counts: np.ndarray) -> "CountTransducer":
        """From distinct n-grams in order (label, label, label, 0 for none, in one number) and their counts."""
        head, pair, last = keys >> 2 * _BITS, keys >> _BITS, keys & _LOW
        middle = pair & _LOW
        new_one = np.append(True, head[1:] != head[:-1]) if len(keys) else np.zeros(0, bool)
        is_two = middle > 0
        new_two = is_two & (np.append(True, pair[1:] != pair[:-1]) if len(keys) else new_one)
        is_three = last > 0
        first, second, third = np.flatnonzero(new_one), np.flatnonzero(new_two), np.flatnonzero(is_three)
        # States after two words: their arcs are the third words.
        at_three = _before(is_three, second)
        stay, to_three = _register(at_three, last[third], counts[third])
        arcs, at_three = _chosen(at_three, stay)
        three = (last[third][arcs], counts[third][arcs])
        # States after one word.
        weight = np.where(is_three[second], 0, counts[second])
        at_two = _before(new_two, first)
        stay, to_two = _register(at_two, middle[second], weight, to_three)
        arcs, at_two = _chosen(at_two, stay)
        two = (middle[second][arcs], weight[arcs], to_three[arcs])
        one = (head[first], np.where(is_two[first], 0, counts[first]), to_two)
        return cls(symbols, one, at_two, two, at_three, three)

    def ngrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys in order and counts: all paths whose last arc has a weight."""
        label, weight, target = self.one
        second, at = _chosen(self.at_two, target)
        key_two = np.repeat(label, np.diff(at)) << 2 * _BITS | self.two[0][second] << _BITS
        third, at = _chosen(self.at_three, self.two[2][second])
        key_three = np.repeat(key_two, np.diff(at)) | self.three[0][third]
        keys = np.concatenate([label << 2 * _BITS, key_two, key_three])
        counts = np.concatenate([weight, self.two[1][second], self.three[1][third]])
        keys, counts = keys[counts > 0], counts[counts > 0]
        order = np.argsort(keys, kind="stable")
        return keys[order], counts[order]

    @classmethod
    def union(cls, parts: Sequence["CountTransducer"]) -> "CountTransducer":
        """All n-grams of the parts, with summed counts."""
        if len(parts) == 1:
            return parts[0]
        symbols, ranks = _ranked(pa.concat_arrays([p.symbols for p in parts]))
        assert len(symbols) < _LOW, "the limits on distinct words of shards and ranges keep labels within their bits"
        keys, counts, at = [], [], 0
        for p in parts:
            label = np.concatenate([[0], ranks[at : at + len(p.symbols)]])
            k, c = p.ngrams()
            keys.append(label[k >> 2 * _BITS] << 2 * _BITS | label[k >> _BITS & _LOW] << _BITS | label[k & _LOW])
            counts.append(c)
            at += len(p.symbols)
        return cls.build(symbols, *_summed(np.concatenate(keys), np.concatenate(counts)))

    def _only(self, keys: np.ndarray, counts: np.ndarray) -> "CountTransducer":
        """A transducer of some of the n-grams, with the words they need."""
        used = np.zeros(len(self.symbols) + 1, bool)
        for shift in range(WORDS):
            used[keys >> shift * _BITS & _LOW] = True
        used[0] = False
        labels, new = np.flatnonzero(used), np.cumsum(used) * used
        keys = new[keys >> 2 * _BITS] << 2 * _BITS | new[keys >> _BITS & _LOW] << _BITS | new[keys & _LOW]
        return CountTransducer.build(self.symbols.take(pa.array(labels - 1)), keys, counts)

    def ranges(self, bounds: Sequence[tuple[bytes, ...]]) -> Iterator[tuple[int, "CountTransducer"]]:
        """The parts between the bounds (each the first n-gram of its range), without the empty ones."""
        keys, counts = self.ngrams()
        cuts = np.concatenate([[0], np.searchsorted(keys, [self._first(b) for b in bounds]), [len(keys)]]).astype(int)
        for number, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if a < b:
                yield number, self._only(keys[a:b], counts[a:b])

    def _first(self, words: tuple[bytes, ...]) -> int:
        """The smallest key that is not before this n-gram."""
        key = 0
        for n, word in enumerate(words):
            place = bisect_left(self.symbols, word, key=lambda s: s.as_py())
            shift = (WORDS - 1 - n) * _BITS
            key |= (place + 1) << shift
            if place == len(self.symbols) or self.symbols[place].as_py() != word:
                break
        return key

    def middle(self) -> tuple[bytes, ...]:
        """The n-gram in the middle of the order."""
        keys, _ = self.ngrams()
        key = int(keys[len(keys) // 2])
        labels = [key >> 2 * _BITS, key >> _BITS & _LOW, key & _LOW]
        return tuple(self.symbols[x - 1].as_py() for x in labels if x)

    def frequent(self, least: int) -> "CountTransducer":
        keys, counts = self.ngrams()
        return self._only(keys[counts >= least], counts[counts >= least])

    def phrases(self) -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
        """First, second and third words (null where there is none), numbers of words, and counts."""
        keys, counts = self.ngrams()
        labels = [keys >> 2 * _BITS, keys >> _BITS & _LOW, keys & _LOW]
        words = [self.symbols.take(pa.array(x - 1, mask=x == 0)) for x in labels]
        return words, 1 + (labels[1] > 0) + (labels[2] > 0), counts

    def compose(self, phrases: Sequence[str]) -> np.ndarray:
        """Weights that the transducer writes when it has read each phrase (words and single blanks); 0 if it cannot."""
        split = [p.encode().split(b" ") for p in phrases]
        label = np.zeros((len(split), WORDS), np.int64)
        flat = pa.array([w for s in split for w in s], _BINARY)
        place = pc.index_in(flat, value_set=self.symbols).fill_null(-1).to_numpy() + 1
        size = np.array([len(s) for s in split], np.int64)
        base = np.cumsum(size) - size
        for n in range(WORDS):
            has = size > n
            label[has, n] = place[base[has] + n]
        known = np.array([(label[i, : size[i]] > 0).all() for i in range(len(split))], bool)

        def step(labels, owners, at, wanted_owner, wanted):
            """The arc with that label of that state, -1 if none; arcs are in order of (state, label)."""
            if not len(labels):
                return np.full(len(wanted), -1)
            joined = owners << 32 | labels
            want = wanted_owner << 32 | wanted
            found = np.minimum(np.searchsorted(joined, want), len(joined) - 1)
            return np.where((joined[found] == want) & (wanted_owner >= 0), found, -1)

        out = np.zeros(len(split), np.int64)
        root = np.zeros(len(split), np.int64)
        arc = step(self.one[0], np.zeros(len(self.one[0]), np.int64), None, root, label[:, 0])
        levels = [(self.one, None), (self.two, self.at_two), (self.three, self.at_three)]
        for n, (arcs, at) in enumerate(levels):
            if n:
                before = levels[n - 1][0]
                state = np.where(arc >= 0, before[2][arc], -1) if len(before[0]) else np.full(len(split), -1)
                arc = step(arcs[0], np.repeat(np.arange(len(at) - 1), np.diff(at)), at, state, label[:, n])
            here = known & (size == n + 1) & (arc >= 0)
            out[here] = arcs[1][arc[here]]
        return out

    def __len__(self) -> int:
        return len(self.one[0]) + len(self.two[0]) + len(self.three[0])

    def to_bytes(self) -> bytes:
        text, ends = text_bytes(self.symbols)
        arrays = [np.diff(ends), *self.one, np.diff(self.at_two), *self.two, np.diff(self.at_three), *self.three]
        out = [struct.pack("<q", len(text)), text.tobytes()]
        for a in arrays:
            wide = 8 if a.max(initial=0) >> 32 else 4 if a.max(initial=0) >> 16 else 2
            out += [struct.pack("<qq", wide, len(a)), a.astype(f"<u{wide}").tobytes()]
        return pa.compress(b"".join(out), "zstd", asbytes=True).join([struct.pack("<q", sum(map(len, out))), b""])

    @classmethod
    def from_bytes(cls, blob: bytes) -> "CountTransducer":
        raw = pa.decompress(blob[8:], struct.unpack("<q", blob[:8])[0], "zstd", asbytes=True)
        n = struct.unpack_from("<q", raw)[0]
        text, at, arrays = raw[8 : 8 + n], 8 + n, []
        while at < len(raw):
            wide, count = struct.unpack_from("<qq", raw, at)
            arrays.append(np.frombuffer(raw, f"<u{wide}", count, at + 16).astype(np.int64))
            at += 16 + wide * count
        ends = [np.concatenate([[0], np.cumsum(arrays[k])]) for k in (0, 4, 8)]
        symbols = pa.Array.from_buffers(_BINARY, len(arrays[0]), [None, pa.py_buffer(ends[0]), pa.py_buffer(text)])
        return cls(symbols, tuple(arrays[1:4]), ends[1], tuple(arrays[5:8]), ends[2], tuple(arrays[9:11]))


class _Shard:
    """A transducer that grows by unions of parts, joined when the last one is no longer small beside the one before."""

    def __init__(self, *parts: CountTransducer):
        self.parts = list(parts)

    def add(self, part: CountTransducer) -> None:
        self.parts.append(part)
        while len(self.parts) > 1 and len(self.parts[-1]) * 2 > len(self.parts[-2]):
            self.parts[-2:] = [CountTransducer.union(self.parts[-2:])]

    def whole(self) -> CountTransducer:
        self.parts = [CountTransducer.union(self.parts)]
        return self.parts[0]

    def words(self) -> int:
        return sum(len(p.symbols) for p in self.parts)

    def __len__(self) -> int:
        return sum(map(len, self.parts))


class _Range:
    """The union of all shards' parts of one range; held in parts of at most RANGE_WORDS distinct words, cut at n-grams."""

    def __init__(self):
        self.bounds: list[tuple[bytes, ...]] = []
        self.shards = [_Shard()]

    def add(self, part: CountTransducer) -> None:
        pieces = part.ranges(self.bounds) if self.bounds else [(0, part)]
        for number, piece in list(pieces):
            self.shards[number].add(piece)
        for number in range(len(self.shards) - 1, -1, -1):
            self._halve(number)

    def _halve(self, number: int) -> None:
        shard = self.shards[number]
        if shard.words() <= RANGE_WORDS or len((whole := shard.whole()).symbols) <= RANGE_WORDS:
            return
        bound = whole.middle()
        self.bounds.insert(number, bound)
        self.shards[number : number + 1] = [_Shard(piece) for _, piece in whole.ranges([bound])]
        self._halve(number + 1)
        self._halve(number)

    def wholes(self) -> list[CountTransducer]:
        return [s.whole() for s in self.shards]


Bounds = dict[str, list[tuple[bytes, ...]]]


def _shards(bounds: Bounds):
    """Task function: texts with their languages to cut transducers (lang, part, blob)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, _Shard] = defaultdict(_Shard)

        def sent(lang: str) -> Iterator[pa.RecordBatch]:
            for part, piece in shards.pop(lang).whole().ranges(bounds.get(lang, [])):
                yield pa.RecordBatch.from_pydict(
                    {"lang": [lang], "part": pa.array([part], pa.int32()), "blob": [piece.to_bytes()]}
                )

        for batch in batches:
            langs, texts = batch.column("lang"), batch.column("text")
            for lang in pc.unique(langs).to_pylist():
                for block in blocks(texts.filter(pc.equal(langs, lang)), BLOCK):
                    words, _, piece = words_of(block)
                    for grown in count_ngrams(words, piece):
                        shards[lang].add(grown)
                        if len(shards[lang]) > SHARD or shards[lang].words() > SHARD_WORDS:
                            yield from sent(lang)
            while sum(map(len, shards.values())) > SHARD:
                yield from sent(max(shards, key=lambda one: len(shards[one])))
        for lang in list(shards):
            yield from sent(lang)

    return run


_MERGED = "lang string, part int, words int, phrase string, n bigint, blob binary"


def _merge(least: int):
    """Task function: cut transducers in order of (lang, part) to frequent n-grams, the transducer of those, and a row
    (words 0) with the sum of all single words' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, _Range()

        def done() -> Iterator[pa.RecordBatch]:
            for whole in held.wholes():
                yield from _rows(*key, whole, least)

        for batch in batches:
            for lang, part, blob in zip(*(batch.column(c).to_pylist() for c in ("lang", "part", "blob"))):
                if key is not None and key != (lang, part):
                    yield from done()
                    held = _Range()
                key = (lang, part)
                held.add(CountTransducer.from_bytes(blob))
        if key is not None:
            yield from done()

    return run


def _rows(lang: str, part: int, whole: CountTransducer, least: int) -> Iterator[pa.RecordBatch]:
    kept = whole.frequent(least)
    words, size, n = kept.phrases()
    joined = pc.binary_join_element_wise(*words, pa.scalar(b" ", _BINARY), null_handling="skip")
    yield pa.RecordBatch.from_pydict({
        "lang": [lang], "part": pa.array([part], pa.int32()), "words": pa.array([0], pa.int32()),
        "phrase": pa.array([None], pa.string()), "n": [int(whole.one[1].sum())], "blob": [kept.to_bytes()],
    })
    for at in range(0, len(n), 100_000):
        rows = len(n[at : at + 100_000])
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array([lang] * rows, pa.string()), "part": pa.array(np.full(rows, part, np.int32)),
            "words": pa.array(size[at : at + rows].astype(np.int32)),
            "phrase": joined.slice(at, rows).cast(pa.large_string()).cast(pa.string()),
            "n": pa.array(n[at : at + rows]), "blob": pa.nulls(rows, pa.binary()),
        })


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: in order of (lang, part), first a range's transducers, then the phrases asked of it: their counts."""
    transducers, key = [], None
    for batch in batches:
        langs, parts, blobs, phrases = (batch.column(c).to_pylist() for c in ("lang", "part", "blob", "phrase"))
        at = 0
        while at < len(langs):
            if blobs[at] is not None:
                if key != (langs[at], parts[at]):
                    transducers, key = [], (langs[at], parts[at])
                transducers.append(CountTransducer.from_bytes(blobs[at]))
                at += 1
                continue
            upto = at
            while upto < len(langs) and blobs[upto] is None and (langs[upto], parts[upto]) == key:
                upto += 1
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array(langs[at:upto], pa.string()), "phrase": pa.array(phrases[at:upto], pa.string()),
                "n": pa.array(sum(t.compose(phrases[at:upto]) for t in transducers)),
            })
            at = upto


def _range_of(bounds: Bounds):
    """Column function: the range that holds a phrase."""

    @F.arrow_udf("int")
    def find(langs: pa.Array, phrases: pa.Array) -> pa.Array:
        return pa.array([
            bisect_right(bounds.get(lang, []), tuple(p.encode().split(b" ")))
            for lang, p in zip(langs.to_pylist(), phrases.to_pylist())
        ], pa.int32())

    return find


def _sampled_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every fourth n-gram of the sampled texts."""
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        texts = batch.column("text")
        for i in range(len(langs)):
            for block in blocks(texts.slice(i, 1), BLOCK):
                words, _, piece = words_of(block)
                word = words.to_pylist()
                keys = [
                    b" ".join(word[j : j + n]).decode()
                    for j in range(0, len(word), 4) for n in range(1, WORDS + 1)
                    if j + n <= len(word) and piece[j + n - 1] == piece[j]
                ]
                yield pa.RecordBatch.from_pydict({"lang": pa.array([langs[i]] * len(keys), pa.string()), "phrase": pa.array(keys, pa.string())})


def prefix_bounds(texts: DataFrame, ranges: int) -> Bounds:
    """Bounds of about ``ranges`` ranges with equally many distinct n-grams of the sample, whole languages first.

    The sample holds some SAMPLE_TEXTS texts and at most SAMPLE_KEYS n-grams, of LONGEST_KEY characters or less.
    """
    share = min(1.0, SAMPLE_TEXTS / max(1, texts.count()))
    sample = texts if share == 1.0 else texts.sample(share, seed=5)
    keys = (
        sample.mapInArrow(_sampled_keys, "lang string, phrase string").filter(F.length("phrase") <= LONGEST_KEY).distinct()
        .orderBy(F.xxhash64("lang", "phrase"), "lang", "phrase").limit(SAMPLE_KEYS).collect()
    )
    by_lang: dict[str, list[tuple[bytes, ...]]] = defaultdict(list)
    for r in keys:
        by_lang[r["lang"]].append(tuple(r["phrase"].encode().split(b" ")))
    bounds = {}
    for lang, found in by_lang.items():
        found.sort()
        n = max(1, round(ranges * len(found) / len(keys)))
        bounds[lang] = sorted({found[len(found) * i // n] for i in range(1, n)})
    return bounds


def ngram_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, Bounds]:
    """Written table of n-grams with at least ``least`` occurrences per language, beside the ranges' transducers.

    Columns: lang, part, words (1 to 3), phrase, n; and one row per range with words 0, the transducer of those n-grams
    (blob), and in n the occurrences of all single words of the range, rare ones included.
    """
    need_columns(docs, "text", "lang")
    spark = docs.sparkSession
    ready_for_python(spark)
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UNDETERMINED)).alias("lang"), F.coalesce("text", F.lit("")).alias("text")
    )
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = prefix_bounds(texts, 2 * partitions)
    shards = texts.mapInArrow(_shards(bounds), "lang string, part int, blob binary")
    ordered = shards.repartition(partitions, "lang", "part").sortWithinPartitions("lang", "part")
    return materialize(ordered.mapInArrow(_merge(least), _MERGED), "ngrams"), bounds


def part_counts(ngrams: DataFrame, bounds: Bounds, parts: DataFrame) -> DataFrame:
    """(lang, phrase, n) of every distinct phrase of ``parts`` (lang, phrase), read by the transducer of its range."""
    partitions = int(ngrams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = parts.distinct().select("lang", _range_of(bounds)("lang", "phrase").alias("part"), "phrase", F.lit(None).cast("binary").alias("blob"))
    ranges = ngrams.filter("words = 0").select("lang", "part", F.lit(None).cast("string").alias("phrase"), "blob")
    met = (
        ranges.unionByName(asked).repartition(partitions, "lang", "part")
        .sortWithinPartitions("lang", "part", F.col("blob").isNull(), "phrase")
    )
    return met.mapInArrow(_compose, "lang string, phrase string, n bigint")


def mine_phrases(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """The best ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A null ``lang`` counts as ``und``; null and empty texts have no words, and a language without a candidate no row.
    A phrase of two words is left out when a candidate of three words holds it and has at least ``share`` hundredths of
    its occurrences.  Repeated rows count as often as they stand; other columns are ignored.
    """
    ngrams, bounds = ngram_counts(docs, least)
    candidates = ngrams.filter("words >= 2").select("lang", "words", "phrase", F.col("n").alias("a"))
    word = F.split("phrase", " ")

    def joined(start: int, length) -> Column:
        return F.array_join(F.slice(word, start, length), " ")

    cuts = [
        F.struct(F.lit(k).alias("k"), joined(1, k).alias("first"), joined(k + 1, F.col("words") - k).alias("rest"))
        for k in range(1, WORDS)
    ]
    cut = candidates.select("*", F.explode(F.filter(F.array(*cuts), lambda c: c["k"] < F.col("words"))).alias("_c"))
    cut = cut.select("lang", "words", "phrase", "a", "_c.*")
    asked = cut.select("lang", F.explode(F.array("first", "rest")).alias("phrase"))
    answers = materialize(part_counts(ngrams, bounds, asked), "part-counts")
    left = answers.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = answers.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    wide = "decimal(15,0)"
    score = F.expr(f"cast({SCALE} as decimal(7,0)) * cast(a as {wide}) * cast(a as {wide}) div (cast(l as {wide}) * cast(r as {wide}))")
    best = (
        cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
        .groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("_b"))
    )
    # Two-word phrases inside a three-word candidate.
    longer = candidates.filter("words = 3")
    inside = longer.select("lang", F.explode(F.array(joined(1, 2), joined(2, 2))).alias("phrase"), "a")
    most = inside.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    total = ngrams.filter("words = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language's best are found in RANK_PARTS parts first, so that its one task ranks at most RANK_PARTS * top rows.
    some = F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order))
    return (
        best.join(most, ["lang", "phrase"], "left")
        .filter(F.col("_longer").isNull() | (F.col("_longer") * 100 < F.col("a") * share))
        .select("lang", "phrase", "a", "_b.l", "_b.r", "_b.score")
        .withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
        .withColumn("_some", some).filter(F.col("_some") <= top)
        .withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
        .join(total, "lang")
        .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
