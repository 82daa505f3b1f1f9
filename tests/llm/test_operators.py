"""The training-data operators against brute force, round trips and odd tables."""

import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import bestfit, html_main, license_dice, license_texts, odd_sketch_dedup, oph_fingerprint, piece_sampling
from ledgerloom.llm.feistel_shards import permute, shard_rows
from ledgerloom.llm.host_rules import quality_rules
from ledgerloom.llm.langid import UNKNOWN, fit_languages, predict_languages
from ledgerloom.llm.toxicity import fit_toxicity, score_toxicity

FOLDER = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _shingles(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def _real(spark, table="documents"):
    return spark.read.parquet(f"{FOLDER}/{table}.parquet")


def _near_copies():
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(120)) for _ in range(40)]
    for base in texts[:10]:
        for edits in (0, 1, 2, 4, 8, 20):
            words = base.split()
            for _ in range(edits):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    return texts


def test_near_duplicates_equal_brute_force(docs):
    texts = _near_copies()
    sets = [_shingles(t) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    got = {r["doc_id"]: r for r in odd_sketch_dedup.near_duplicates(docs(texts)).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == root
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    kept = {r["doc_id"] for r in odd_sketch_dedup.drop_near_duplicates(docs(texts)).collect()}
    assert kept == {i for i in range(len(texts)) if root[i] == i}


def test_best_fit_plan_equals_item_by_item_best_fit():
    rng = random.Random(1)
    for _ in range(100):
        capacity = rng.choice((7, 20, 64))
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 150))]
        room = []
        for size in sorted(sizes, reverse=True):
            fit = min(((r, i) for i, r in enumerate(room) if r >= size), default=None)
            if fit is None:
                room.append(capacity - size)
            else:
                room[fit[1]] -= size
        runs = sorted(bestfit.best_fit_plan(Counter(sizes), capacity))
        held = defaultdict(list)
        for size, n in Counter(sizes).items():
            for rank in range(n):
                run = [r for r in runs if r[0] == size and r[1] <= rank][-1]
                held[run[2] + (rank - run[1]) // run[3]].append((run[4] + (rank - run[1]) % run[3] * size, size))
        left = []
        for items in held.values():
            at = 0
            for offset, size in sorted(items):
                assert offset == at
                at += size
            left.append(capacity - at)
        assert sorted(left) == sorted(room)


def _tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_chunked_tokens_equal_the_tokenizer(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(" \n\tabc'sé中😀\x1c\x85\x01.,!?09\r") for _ in range(rng.randint(0, 50))) for _ in range(800)]
    marked = ["".join(rng.choice(["<|endoftext|>", " ", "a b", "  ", "\n", "<|", "text|>", "\x85", "é"]) for _ in range(9)) for _ in range(800)]
    texts += [r["text"] for r in _real(spark).limit(40).collect()] + ["", " ", "<|endoftext|> a", *marked]
    ids, starts = bestfit.encode_texts(pa.array(texts, pa.large_string()), marks=True)
    plain, begin = bestfit.encode_texts(pa.array(texts, pa.large_string()))
    loaded, spelled = _tokenizer(), _tokenizer()
    spelled.encode_special_tokens = True
    for i, t in enumerate(texts):
        assert ids[starts[i] : starts[i + 1]].tolist() == loaded.encode(t, add_special_tokens=False).ids + [bestfit.END_ID]
        assert plain[begin[i] : begin[i + 1]].tolist() == spelled.encode(t, add_special_tokens=False).ids + [bestfit.END_ID]


def test_packing_covers_every_token(spark):
    texts = {r["doc_id"]: r["text"] for r in _real(spark).collect()}
    rows = bestfit.pack_documents(_real(spark)).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for items in sequences.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= bestfit.CAPACITY
    encoded = _tokenizer().encode_batch(list(texts.values()), add_special_tokens=False)
    for doc_id, e in zip(texts, encoded):
        ids, at = e.ids + [0], 0
        for k, r in enumerate(sorted(pieces[doc_id], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == bestfit.CAPACITY)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)


def test_sampled_pieces_are_lossless_reproducible_and_rightly_weighted():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdethe  \n▁é中😀ßs.") for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["", " "]
    keys = np.arange(len(texts))
    ids, at = piece_sampling.sample_texts(pa.array(texts, pa.large_string()), keys)
    assert [piece_sampling.decode_ids(ids[at[i] : at[i + 1]]) for i in keys] == texts
    again, _ = piece_sampling.sample_texts(pa.array(texts[::-1], pa.large_string()), keys[::-1].copy())
    assert Counter(again.tolist()) == Counter(ids.tolist())
    n = 20_000
    ids, at = piece_sampling.sample_texts(pa.array(["hello"] * n, pa.large_string()), np.arange(n))
    seen = Counter(tuple(ids[at[i] : at[i + 1]].tolist()) for i in range(n))
    pieces = piece_sampling.pieces_of(None, piece_sampling.ALPHA)
    weight = {pieces.bytes[i]: (i, w) for i, w in enumerate(pieces.weight) if np.isfinite(w)}

    def paths(rest):
        if not rest:
            yield (), 0.0
        for k in range(1, len(rest) + 1):
            if rest[:k] in weight:
                for tail, w in paths(rest[k:]):
                    yield (weight[rest[:k]][0], *tail), weight[rest[:k]][1] + w

    exact = {p: np.exp(w) for p, w in paths(b" hello")}
    total = sum(exact.values())
    for path in sorted(exact, key=exact.get)[-4:]:
        assert seen[path] / n == pytest.approx(exact[path] / total, abs=0.015)


def test_fingerprints_follow_the_edits_and_estimate_similarity(spark):
    rows = sorted(_real(spark).collect(), key=lambda r: -r["doc_id"])
    got = {r["doc_id"]: r for r in oph_fingerprint.fingerprint_edits(_real(spark), stretches=5).collect()}
    off = []
    for i, r in enumerate(rows):
        following = rows[(i + 1) % len(rows)]["text"]
        edited = oph_fingerprint.edited_text(r["text"], following)
        one = got[r["doc_id"]]
        assert one["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and one["n_chars"] == len(r["text"])
        a, b = _shingles(r["text"]), _shingles(edited)
        off.append(abs(one["near_edited"] - (len(a & b) / len(a | b) if a | b else 1.0)))
    assert np.mean(off) < 0.05
    by_text = defaultdict(set)
    for r in rows:
        by_text[r["text"]].add(got[r["doc_id"]]["fingerprint"])
    assert all(len(f) == 1 for f in by_text.values())


def test_main_text_of_marked_and_unmarked_pages():
    prose = "the cat was in the house and it was on the mat with all of them as it had been for all of the days " * 3
    page = (
        f"<body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div class='cookie-notice'>{prose}</div>"
        f"<div><h2>Title of it</h2><p>{prose}<p>Short &amp; sweet.<p>{prose}</div><div class=comments><p>{prose}</p></div>"
        f"<form><p>Log in</p></form><footer>&copy; x</footer></body>"
    )
    clean = " ".join(prose.split())
    assert html_main.main_text(page) == f"Title of it\n{clean}\nShort & sweet.\n{clean}"
    assert html_main.main_text("<article><p>a &lt;b&gt;\n c<script>x='<p>y'</script><p>d") == "a <b> c\nd"
    assert html_main.main_text("") == html_main.main_text("<<<>") == ""


def test_main_text_survives_names_that_only_mention_a_word():
    prose = "the cat was in the house and it was on the mat with all of them as it had been for all of the days " * 3
    clean = " ".join(prose.split())
    end = "<footer><p>&copy; x</p></footer>"
    for opening, closing in (
        ("<article class='post-12 post hentry category-news tag-politics'>", "</article>"),
        ("<div class='container no-sidebar'>", "</div>"), ("<div class='page has-sidebar'>", "</div>"),
        ("<div class='comments-open'>", "</div>"), ("<div class='has-header'>", "</div>"),
        ("<article class='promo'>", "</article>"), ("<main id='search'>", "</main>"),
        ("<div class='sidebar-left'><main>", "</main></div>"), ("<div class='widget-area'><article>", "</article></div>"),
        ("<div id='sidebar'>", "</div>"),  # holds most of the page's text
    ):
        page = f"<body>{opening}<p>{prose}</p><p>{prose}</p>{closing}{end}"
        assert html_main.main_text(page) == f"{clean}\n{clean}", opening
    for name in ("comments", "Cookie-Notice", "site_footer", "post-tags", "related-posts", "widget widget_text", "menu-item-3", "ad-300x250"):
        page = f"<body><div><p>{prose}</p><p>{prose}</p></div><div class='{name}'><p>{prose}</p></div>{end}"
        assert html_main.main_text(page) == f"{clean}\n{clean}", name
    # More comments than article: the mark and the name agree.
    long = f"<p>{prose}</p>" * 2
    page = f"<body><article>{long}</article><div id='comments'>{''.join(f'<article>{long}</article>' for _ in range(4))}</div>{end}"
    assert html_main.main_text(page) == f"{clean}\n{clean}"


def test_main_text_outside_of_marks_is_judged_by_its_text():
    prose = "the cat was in the house and it was on the mat with all of them as it had been for all of the days " * 3
    clean = " ".join(prose.split())
    cards = "".join(f"<article class='card'><h3><a href=x>Card {i}</a></h3><p>Some few words {i}.</p></article>" for i in range(4))
    body = f"<h1>Title</h1><p>{prose}</p><p>Short.</p><p>{prose}</p>"
    wanted = f"Title\n{clean}\nShort.\n{clean}"
    assert html_main.main_text(f"<nav>Menu</nav><div>{body}</div><div>{cards}</div><footer>x</footer>") == wanted
    assert html_main.main_text(f"<nav>Menu</nav><div>{cards}</div><div>{body}</div><footer>x</footer>") == wanted
    # One part of several is marked.
    page = f"<nav>Menu</nav><div>{body}</div><article><h2>Part two</h2><p>Few words.</p></article><div>{body}</div><footer>x</footer>"
    assert html_main.main_text(page) == f"{wanted}\nPart two\nFew words.\n{wanted}"
    # Marked parts without stop words, and nothing else on the page.
    assert html_main.main_text("<article><p>Xq zw.</p></article><nav>Menu</nav><article><p>Vb nm.</p></article>") == "Xq zw.\nVb nm."
    # An advert with more text than the whole article.
    assert html_main.main_text("<div class='ad'>It is the one and the other of all that was in it for them.</div><article>Xq.</article>") == "Xq."


def test_main_text_keeps_links_and_copyright_signs_of_the_text():
    prose = "the cat was in the house and it was on the mat with all of them as it had been for all of the days " * 3
    clean = " ".join(prose.split())
    link = "<a href=x>{}</a>".format
    page = (
        f"<nav>{link('Home')}</nav><article><h1>{link('The title')}</h1><p>{prose}</p><p>See {link('this other page')}</p><p>{prose}</p>"
        f"<div class='share'>{link('Share')}</div><ol><li>{link('A reference, of some length, to the first of all the other texts')} 1990</li>"
        f"<li>{link('Second')}</li></ol></article><footer>{link('Imprint')}</footer>"
    )
    references = "A reference, of some length, to the first of all the other texts 1990\nSecond"
    assert html_main.main_text(page) == f"The title\n{clean}\nSee this other page\n{clean}\n{references}"
    # Without marks.
    page = (
        f"<ul><li>{link('Home')}</li><li>{link('News')}</li></ul><h1>{link('The title')}</h1><p>{prose}</p><p>See {link('this')}</p>"
        f"<p>{prose} The \N{COPYRIGHT SIGN} sign was on it.</p><p>\N{COPYRIGHT SIGN} 2020 Foo</p>"
    )
    got = html_main.main_text(page)
    assert got == f"The title\n{clean}\nSee this\n{clean} The \N{COPYRIGHT SIGN} sign was on it."


def test_permutation_is_a_bijection_and_matches_spark(spark, docs):
    for n in (1, 2, 17, 100):
        assert sorted(permute(x, n) for x in range(n)) == list(range(n))
    rows = shard_rows(docs([f"t{i}" for i in range(100)])).collect()
    assert all((r["shard"], r["slot"]) == (permute(r["doc_id"], 100) % 16, permute(r["doc_id"], 100) // 16) for r in rows)


def test_languages_and_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{folder}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in table.select("doc_id", "lang").collect()}
    told = [r for r in predict_languages(table, fit_languages(table)).collect() if r["held_out"]]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in told]) > 0.97
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    scored = [r for r in score_toxicity(table, fit_toxicity(table, labels)).collect() if r["doc_id"] in toxic]
    clean = [r["predicted"] for r in scored if toxic[r["doc_id"]] == 0]
    assert np.mean(clean) < 0.01
    assert np.mean([r["score"] for r in scored if toxic[r["doc_id"]]]) > 5 * np.mean([r["score"] for r in scored if not toxic[r["doc_id"]]])


def test_license_wordings_are_found(docs):
    got = license_dice.scan_licenses(docs([
        "Some text.\nReleased under the MIT License.", "Licensed under CC BY-NC 4.0.\nmore", "no licence here at all", "",
    ])).orderBy("doc_id").collect()
    assert [r["license"] for r in got] == ["MIT", "CC-BY-NC-4.0", None, None]
    assert [r["segment"] for r in got] == [1, 0, None, None]


def test_license_notices_are_found_wherever_they_stand(docs):
    filler = " ".join(f"filler{i}" for i in range(300))
    notice = "Released under the MIT License"
    texts = [
        f"{notice}, see the file.", f"Copyright 2020 Foo Inc. {notice}.", f"Here is one more sentence of text. {notice}.",
        f"{filler} {notice} {filler}", f"{filler}\n{filler} released under\nthe MIT license {filler}",
        f"{filler}. Licensed under CC BY-NC 4.0. {filler}. Released under it.", f"{filler} released {filler} under the {filler} license",
        f"Some text\n{notice}.\nmore text", f"{filler} {notice}. {filler}\n{filler}",
    ]
    got = license_dice.scan_licenses(docs(texts)).orderBy("doc_id").collect()
    assert [r["license"] for r in got] == ["MIT"] * 5 + ["CC-BY-NC-4.0", None, "MIT", "MIT"]
    assert [r["n_matches"] for r in got] == [1, 1, 1, 1, 1, 1, 0, 1, 1]
    assert [r["segment"] for r in got] == [0, 0, 0, 0, 3, 0, None, 1, 0]
    assert all(r["dice"] == 1.0 for r in got if r["license"])


def test_full_license_texts_are_found_wrapped_and_on_one_line(docs):
    full = {}
    for name, _, paragraph in license_texts.PARAGRAPHS:
        full.setdefault(name, []).append(paragraph)
    full["MIT"].insert(0, "MIT License\n\nCopyright (c) 2020 Foo Inc.")
    bsd = ["Copyright (c) 2020, Foo Inc."] + [p for name, _, p in license_texts.PARAGRAPHS if name == "BSD-3-Clause"][1:5]
    full["BSD-2-Clause"] = [f"{bsd[0]}\n{bsd[1]}\n1. {bsd[2]}\n2. {bsd[3]}\n{bsd[4]}"]
    filler = " ".join(f"filler{i}" for i in range(200))
    names, texts = [], []
    for name, paragraphs in full.items():
        wrapped = "\n\n".join("\n".join(f" * {line}" for line in textwrap.wrap(p, 72)) for p in paragraphs)
        one = " ".join(" ".join(paragraphs).split())
        names += [name] * 3
        texts += [wrapped, one, f"{filler} {one} {filler}"]
    for name, _, p in license_texts.PARAGRAPHS:  # each alone, on one line
        texts.append(p)
    got = license_dice.scan_licenses(docs(texts)).orderBy("doc_id").collect()
    assert [r["license"] for r in got[: len(names)]] == names
    assert all(r["n_matches"] and r["dice"] == 1.0 for r in got)


def test_license_cover_words_lose_no_match():
    for threshold in (0.5, 0.75, 1.0):
        grams = [license_dice.bigrams(t) for _, _, t in license_dice.TEMPLATES]
        cover = set(license_dice.cover_words(grams, threshold))
        for g in grams:
            # The likeliest segment without a covering word holds all other bigrams of the template and nothing else.
            rest = [p for p in g if not cover & set(p.split())]
            assert 2 * len(rest) / (len(g) + len(rest)) < threshold


def test_near_filter_keeps_other_texts_of_a_repeated_id(spark):
    long = [" ".join(f"{w}{i}" for i in range(80)) for w in "abcd"]
    rows = [(1, long[0]), (1, long[1]), (1, None), (2, long[0] + " end"), (2, long[2]), (3, None), (4, long[3]), (4, long[3])]
    got = odd_sketch_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in got) == [(1, long[0]), (1, long[1]), (2, long[2]), (3, ""), (4, long[3])]


def test_hosts_are_judged_by_several_rules(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = []
    for h in range(8):
        rows += [(f"fine{h}", good + f" f{i}") for i in range(30)]
    rows += [("symbols", " ".join(f"word{i}$$$ word{i}%%%" for i in range(40)) + f" s{i}") for i in range(30)]
    rows += [("three quarters", "short" if i % 4 else good + f" q{i}") for i in range(200)]
    rows += [("lines", "\n".join([good, good, good]) + f"\nl{i}") for i in range(30)]
    rows += [("lengths", " ".join(f"w{'x' * 30}{j}" for j in range(60)) + f" {i}") for i in range(30)]
    rows += [("one text", " ".join(f"word{i}$$$" for i in range(60)))]
    table = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string")
    kept = {rows[r["doc_id"]][0] for r in quality_rules(table).collect() if r["kept"]}
    assert kept == {f"fine{h}" for h in range(8)} | {"one text"}


def test_a_bad_host_loses_its_good_texts(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "short", "bad") for i in range(400)] + [(400, good, "bad")] + [(500 + i, good + str(i), "fine") for i in range(400)]
    rows += [(1000, good + "x", None)]
    kept = {r["doc_id"] for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect() if r["kept"]}
    assert kept == {500 + i for i in range(400)} | {1000}


def _labels(spark):
    return spark.createDataFrame([(1, 1), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")


OPERATORS = {
    "shards": lambda spark, d: shard_rows(d),
    "quality": lambda spark, d: quality_rules(d),
    "licenses": lambda spark, d: license_dice.scan_licenses(d),
    "packing": lambda spark, d: bestfit.pack_documents(d),
    "pieces": lambda spark, d: piece_sampling.segmentation_digests(d),
    "fingerprints": lambda spark, d: oph_fingerprint.fingerprint_edits(d),
    "near": lambda spark, d: odd_sketch_dedup.near_duplicates(d),
    "near filter": lambda spark, d: odd_sketch_dedup.drop_near_duplicates(d),
    "languages": lambda spark, d: predict_languages(d, fit_languages(d)),
    "toxicity": lambda spark, d: score_toxicity(d, fit_toxicity(d, _labels(spark))),
    "pages": lambda spark, d: html_main.extract_pages(d.selectExpr("doc_id as page_id", "source as url", "text as html", "text", "lang")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_tables(spark, odd, none, name):
    rows = OPERATORS[name](spark, odd).collect()
    assert OPERATORS[name](spark, none).collect() == []
    if name == "packing":
        assert len([r for r in rows if r["piece"] == 0]) == 8
    elif name == "near filter":
        assert sorted(str(r["doc_id"]) for r in rows) == ["1", "2", "3", "4", "5", "None", "None"]
    else:
        assert len(rows) == 8
    if name == "languages":
        assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3)} == {UNKNOWN}
    if name == "pieces":
        assert all(r["lossless"] for r in rows)
