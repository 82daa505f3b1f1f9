"""Token counts, token alignment and phrase mining against the libraries and brute force."""

import bisect
import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import heads, phrase_automata, token_counts
from ledgerloom.llm.phrase_automata import CountTransducer, mine_phrases
from ledgerloom.llm.pretokens import encode_pieces, piece_model
from ledgerloom.llm.token_alignment import align_tokens, gallop
from ledgerloom.llm.token_counts import count_tokens

BITS = [
    "a", "b", "the", " ", " ", "  ", "\n", "\t", "é", "中", "国", "文", "😀", "<s>", "</s>", "<unk>", "ﬁ", "\x00", "0", "12", ".",
    ",", "-", "ing", "　", "и", "<|endoftext|>", "\x85", "\r", "'s",
]


def _texts(n, seed=1, marks=("▁",)):
    rng = random.Random(seed)
    made = ["".join(rng.choice(BITS + list(marks) * (i % 9 == 0)) for _ in range(rng.randint(0, 60))) for i in range(n)]
    return made + ["", " ", "   ", "plain words and again plain words", None, "中国" * 4000, "x" * 30_000, "ab cd " * 5000]


def _tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def _byte_of():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def test_pieces_of_pretokens_are_those_of_the_whole_text():
    texts = [t or "" for t in _texts(1500)]
    ids, at = encode_pieces(pa.array(texts, pa.large_string()))
    for i, want in enumerate(piece_model().sp.encode(texts)):
        assert ids[at[i] : at[i + 1]].tolist() == want


def test_token_counts_equal_the_library(docs, spark):
    texts = _texts(200)
    texts += [texts[3]] * 50
    want = [len(i) for i in piece_model().sp.encode([t or "" for t in texts])]
    got = {r["doc_id"]: r for r in count_tokens(docs(texts).repartition(5), limit=20).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert tuple(got[i]) == (i, len((t or "").encode()), want[i], want[i] > 20)


def test_token_counts_do_not_depend_on_the_heads(docs, monkeypatch):
    texts = _texts(120, seed=7) * 2
    want = [len(i) for i in piece_model().sp.encode([t or "" for t in texts])]
    for heads_kept in (0, 5, 1000):
        monkeypatch.setattr(token_counts, "HEADS", heads_kept)
        got = {r["doc_id"]: r["n_tokens"] for r in count_tokens(docs(texts).repartition(3)).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_sums_do_not_depend_on_the_heads(spark):
    rng = random.Random(3)
    cells = [(row, f"k{min(rng.randrange(50), rng.randrange(50))}", rng.randrange(5)) for row in range(40) for _ in range(30)]
    frame = spark.createDataFrame(cells, "_row int, k string, c int")
    rows = Counter(k for _, k, _ in cells)
    table = spark.createDataFrame([(k, n, int(k[1:]) * 7) for k, n in rows.items()], "k string, _rows int, v int")
    want = Counter()
    for row, k, c in cells:
        want[row] += c * int(k[1:]) * 7
    from pyspark.sql import functions as F

    for limit in (1, 300, 10**6):
        got = heads.sum_by_row(frame, table, "k", "_rows", F.lit(8), {"s": F.col("c") * F.col("v")}, head_bytes=limit)
        assert {r["_row"]: r["s"] for r in got.collect()} == {r: want[r] for r in range(40)}


def test_galloping_finds_what_binary_search_finds():
    rng = np.random.default_rng(4)
    for _ in range(200):
        long = np.sort(rng.choice(400, rng.integers(0, 60), replace=False))
        low = int(rng.integers(0, len(long) + 1))
        high = int(rng.integers(low, len(long) + 1))
        short = rng.integers(0, 400, 30)
        n = np.full(30, 1)
        found = gallop(short, long, rng.integers(0, len(long) + 1, 30), low * n, high * n)
        assert found.tolist() == [bisect.bisect_left(long.tolist(), int(v), low, high) for v in short]


def _aligned(text, tokenizer, byte_of):
    """Brute force: both token lists as byte ranges, every pair looked at."""
    sp, full = piece_model().sp, (" " + (text or "")).encode()
    coded = tokenizer.encode(" " + (text or ""), add_special_tokens=False)
    a, b = coded.ids, sp.encode(text or "")
    bytes_a = [bytes(byte_of[c] for c in t) for t in coded.tokens]
    bytes_b = [
        bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b
    ]
    if not text or b"".join(bytes_a) != full or b"".join(bytes_b) != full:
        return 0, 0, 0, [], ""
    ends_a, ends_b = (np.cumsum([len(x) for x in side]).tolist() for side in (bytes_a, bytes_b))
    starts_a, starts_b = [0, *ends_a], [0, *ends_b]
    links, j0 = [], 0
    for i in range(len(a)):
        while ends_b[j0] <= starts_a[i]:
            j0 += 1
        j = j0
        while j < len(b) and starts_b[j] < ends_a[i]:
            links.append((a[i], b[j]))
            j += 1
    groups, x, y = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        i, j = ends_a.index(end) + 1, ends_b.index(end) + 1
        groups.append(",".join(map(str, a[x:i])) + "|" + ",".join(map(str, b[y:j])))
        x, y = i, j
    return len(a), len(b), len(groups), links, ";".join(groups)


def test_alignment_equals_brute_force(docs):
    tokenizer, byte_of = _tokenizer(), _byte_of()
    texts = _texts(150, seed=2) + ["the same words here"] * 40
    want = [_aligned(t, tokenizer, byte_of) for t in texts]
    counts = Counter(link for w in want for link in w[3])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    got = {r["doc_id"]: r for r in align_tokens(docs(texts).repartition(4)).collect()}
    assert len(got) == len(texts)
    for i, (n_a, n_b, n_groups, links, groups) in enumerate(want):
        r = got[i]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == (n_a, n_b, n_groups, len(links))
        assert r["n_best"] == sum(counts[x] == most[x[1]] for x in links)
        assert r["count_sum"] == sum(counts[x] for x in links)
        assert r["groups_sha256"] == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
    shown = {r["doc_id"]: r["groups"] for r in align_tokens(docs(texts), digest=False).collect()}
    assert shown == {i: w[4] for i, w in enumerate(want)}


def _ngrams(texts):
    found = Counter()
    for text in texts:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^ \t]+", piece)
            found.update(tuple(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1))
    return found


def _mined(texts, least, top, share):
    f = _ngrams(texts)
    n = sum(c for w, c in f.items() if len(w) == 1)
    candidates = {w: a for w, a in f.items() if len(w) > 1 and a >= least}
    rows = []
    for w, a in candidates.items():
        if any(
            100 * b >= share * a for v, b in candidates.items()
            if len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))
        ):
            continue
        score, _, l, r = min((10**6 * a * a // (f[w[:k]] * f[w[k:]]), k, f[w[:k]], f[w[k:]]) for k in range(1, len(w)))
        rows.append((-score, -a, " ".join(w).encode(), l, r))
    rows.sort()
    return [(i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(rows[:top])]


def _prose(n, seed):
    rng = random.Random(seed)
    vocabulary = ["New", "york", "york's", "the", "THE", "of", "a", "é", "中", "x1", "\x01", "b\x85c"]
    marks = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "!"]
    return ["".join(rng.choice(vocabulary) + rng.choice(marks) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_small_shards_and_ranges_count_the_same(monkeypatch):
    """The task functions with limits that give many shards, stretches, and parts of ranges."""
    limits = (("BLOCK", 200), ("STRETCH", 17), ("SHARD", 30), ("SHARD_WORDS", 8), ("RANGE_WORDS", 5))
    for name, value in limits:
        monkeypatch.setattr(phrase_automata, name, value)
    texts = {"en": _prose(40, 1), "de": _prose(30, 2)}
    bounds = {"en": [(b"of", b"new"), (b"the",), (b"york", b"the", b"x")]}
    sent = []
    for task in range(3):
        rows = [(lang, t) for lang in texts for t in texts[lang][task::3]]
        batch = pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows], "text": [r[1] for r in rows]})
        for out in phrase_automata._shards(bounds)(iter([batch.slice(0, 5), batch.slice(5)])):
            sent += out.to_pylist()
    assert len(sent) > 30
    sent.sort(key=lambda r: (r["lang"], r["part"]))
    batches = [pa.RecordBatch.from_pylist(sent[i : i + 7]) for i in range(0, len(sent), 7)]
    merged = [r for out in phrase_automata._merge(3)(iter(batches)) for r in out.to_pylist()]
    ranges = [r for r in merged if r["words"] == 0]
    assert len(ranges) > len({(r["lang"], r["part"]) for r in ranges})
    for lang in texts:
        want = _ngrams(texts[lang])
        got = {tuple(r["phrase"].split(" ")): r["n"] for r in merged if r["lang"] == lang and r["words"]}
        assert got == {w: n for w, n in want.items() if n >= 3}
        assert sum(r["n"] for r in ranges if r["lang"] == lang) == sum(n for w, n in want.items() if len(w) == 1)
    asked = [r | {"blob": None} for r in merged if r["words"]]
    met = sorted([r | {"phrase": None} for r in ranges] + asked, key=lambda r: (r["lang"], r["part"], r["blob"] is None))
    columns = {"lang": pa.string(), "part": pa.int32(), "phrase": pa.string(), "blob": pa.binary()}
    batches = [pa.RecordBatch.from_pylist([{c: r[c] for c in columns} for r in met[i : i + 5]], pa.schema(columns)) for i in range(0, len(met), 5)]
    told = [r for out in phrase_automata._compose(iter(batches)) for r in out.to_pylist()]
    assert Counter((r["lang"], r["phrase"], r["n"]) for r in told) == Counter((r["lang"], r["phrase"], r["n"]) for r in asked)


def test_mined_phrases_equal_brute_force(spark):
    rows = [(i, t, lang, "s", None, None) for lang, seed in (("en", 1), (None, 2), ("de", 3)) for i, t in enumerate(_prose(60, seed))]
    rows += [(1, None, "en", None, None, None), (2, "", "fr", None, None, None), (3, "rare words", "it", None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, phrase string, part string, n string")
    got = mine_phrases(frame.repartition(3), least=5, top=40).collect()
    for lang, key in (("en", "en"), (None, "und"), ("de", "de")):
        want = _mined([t for _, t, one, *_ in rows if one == lang], 5, 40, 50)
        mine = sorted((r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got if r["lang"] == key)
        assert mine == want
    assert {r["lang"] for r in got} == {"en", "und", "de"}


def test_transducers_add_cut_and_read():
    def made(text):
        words, _, piece = phrase_automata.words_of(pa.array([text], pa.large_string()))
        parts = list(phrase_automata.count_ngrams(words, piece))
        return CountTransducer.union(parts) if parts else None

    def listed(t):
        words, _, n = t.phrases()
        rows = zip(*(w.to_pylist() for w in words))
        return Counter({tuple(x.decode() for x in r if x is not None): int(c) for r, c in zip(rows, n)})

    one, two = " ".join(_prose(20, 5)), " ".join(_prose(20, 6))
    both = CountTransducer.union([made(one), made(two)])
    want = _ngrams([one]) + _ngrams([two])
    assert listed(both) == want
    assert listed(CountTransducer.from_bytes(both.to_bytes())) == want
    assert both.compose([" ".join(w) for w in want]).tolist() == list(want.values())
    assert both.compose(["unknown", "the unknown", "the of unknown", "the of the of"]).tolist() == [0, 0, 0, 0]
    bounds = sorted([(b"the",), (b"of", b"the", b"m"), (b"zzz",), (b"the", b"of")])
    cut = dict(both.ranges(bounds))
    assert sum((listed(t) for t in cut.values()), Counter()) == want
    for number, t in cut.items():
        assert all(bisect.bisect_right(bounds, tuple(x.encode() for x in w)) == number for w in listed(t))
    # The third words after equal two-word states are held once.
    assert len(both.three[0]) < sum(len(w) == 3 for w in want)


def test_odd_tables(odd, none):
    counted = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in count_tokens(odd).collect())
    sp = piece_model().sp
    assert (1, 0, 0) in counted and (2, 0, 0) in counted and counted.count((4, 7, len(sp.encode("one two")))) == 2
    assert len(counted) == 8
    aligned = align_tokens(odd).collect()
    assert len(aligned) == 8
    assert [tuple(r)[1:] for r in aligned if r["doc_id"] in (1, 2)] == [(0, 0, 0, 0, 0, 0, "")] * 2
    assert len({tuple(r) for r in aligned if r["doc_id"] == 4}) == 1
    phrases = mine_phrases(odd).collect()
    assert {r["lang"] for r in phrases} == {"en"} and phrases[0]["a"] >= 10
    for operator in (count_tokens, align_tokens, mine_phrases):
        assert operator(none).collect() == []
        with pytest.raises(ValueError, match="missing columns"):
            operator(none.drop("text"))


def test_real_documents(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in frame.collect()}
    counted = {r["doc_id"]: r["n_tokens"] for r in count_tokens(frame).collect()}
    assert counted == {i: len(piece_model().sp.encode(t or "")) for i, t in texts.items()}
    tokenizer = _tokenizer()
    aligned = {r["doc_id"]: r for r in align_tokens(frame).collect()}
    for i, t in texts.items():
        if t and "▁" not in t:
            assert aligned[i]["n_a"] == len(tokenizer.encode(" " + t, add_special_tokens=False).ids)
            assert aligned[i]["n_b"] == counted[i]
            assert aligned[i]["n_links"] == aligned[i]["n_a"] + aligned[i]["n_b"] - aligned[i]["n_groups"]


def test_a_task_of_many_distinct_phrases_holds_little_memory():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40_000)]
    texts = [" ".join(rng.choices(words, k=4000)) for _ in range(500)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * len(texts), "text": texts})
    tracemalloc.start()
    sent = [piece for out in phrase_automata._shards({})(iter([batch])) for piece in out.column("blob").to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 << 20
    words_sent = [phrase_automata.CountTransducer.from_bytes(piece).one[1].sum() for piece in sent]
    assert sum(words_sent) <= 500 * 4000 and len(sent) > 1
