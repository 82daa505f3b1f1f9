"""Host rules against their SQL over planted hosts, license windows against brute force, samples and stretches."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import license_dice, oph_fingerprint, toxicity
from ledgerloom.llm.host_rules import quality_rules
from ledgerloom.llm.oracle import ORACLE


def _planted_hosts():
    rng = random.Random(11)

    def prose(n=60):
        return " ".join(f"word{rng.randrange(4000)}" for _ in range(n))

    rows = [(f"fine{h}", prose() if rng.random() > 0.02 * h else "short") for h in range(12) for _ in range(40)]
    rows += [("symbols", " ".join(f"w{rng.randrange(999)}$$$ x{j}%%%" for j in range(40))) for _ in range(30)]
    rows += [("three quarters", "short" if i % 4 else prose()) for i in range(200)]
    rows += [("lines", "\n".join([prose()] * 3)) for _ in range(30)]
    rows += [("mixed lines", "\n".join([prose(), "a b", "a b", "a b"]) if i % 2 else prose()) for i in range(60)]
    rows += [("lengths", " ".join(f"w{'x' * 30}{rng.randrange(999)}" for _ in range(60))) for _ in range(30)]
    rows += [("letters", " ".join(rng.choice("abcdefgh") for _ in range(80))) for _ in range(25)]
    rows += [("one text", prose().replace(" ", "$$$ ")), ("repeats", prose(10) * 9), (None, "short"), (None, prose())]
    rows += [("empty", None)] * 5 + [("empty", "")] * 5 + [("empty", prose())] * 2
    return [(i, t, s) for i, (s, t) in enumerate(rows)]


@pytest.mark.parametrize("hosts", ["all", "one", "two"])
def test_host_rules_equal_their_sql(spark, tmp_path, hosts):
    rows = _planted_hosts()
    if hosts != "all":
        names = {"one": ("three quarters",), "two": ("lengths", "fine3")}[hosts]
        rows = [r for r in rows if r[2] in names]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    table.write.parquet(str(tmp_path / "documents"))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
        found = db.execute(ORACLE["op7_quality_rules"])
        names = [c[0] for c in found.description]
        wanted = sorted(found.fetchall())
    got = sorted(tuple(r) for r in quality_rules(table).select(*names).collect())
    assert got == wanted
    if hosts == "all":
        kept = {rows[r[0]][2] for r in got if r[-1]}
        assert not kept & {"symbols", "lines", "lengths", "letters"} and {f"fine{h}" for h in range(12)} <= kept


def _plain_matches(text, templates, threshold):
    """Matches (dice, -template, -segment) of every segment, by loops."""
    def words(s):
        return re.sub(r"[^a-z0-9]+", " ", s).split()

    def pairs(w):
        return [f"{a} {b}" for a, b in zip(w, w[1:])] or w

    def dice(a, b):
        return 2.0 * len(set(a) & set(b)) / (len(set(a)) + len(set(b)))

    wanted = [(pairs(words(t.lower())), max(len(words(t.lower())) - 1, 1)) for _, _, t in templates]

    def best(i, whole, parts):
        out = []
        for k, (g, length) in enumerate(wanted):
            out.append((dice(whole, g), -k, -i))
            for start, first in enumerate(parts):
                window = parts[start : start + length]
                if first in g:
                    while window[-1] not in g:
                        window = window[:-1]
                    out.append((dice(window, g), -k, -i))
        return max((m for m in out if m[0] >= threshold), default=None)

    text = (text or "").lower()
    lines = [s for s in text.split("\n") if words(s)]
    paragraphs = [p for p in re.split(r"\n\s*\n", text) if "\n" in p.strip(" ") and words(p)]
    found, own = [], set()
    for i, line in enumerate(lines):
        m = best(i, pairs(words(line)), pairs(words(line)))
        if m:
            found.append(m)
            own.add(line)
    for i, p in enumerate(paragraphs, len(lines)):
        rest = " ".join("|" if line in own else " ".join(words(line)) for line in p.split("\n")).split()
        m = best(i, pairs(words(p)), pairs(rest)) if rest else best(i, pairs(words(p)), [])
        if m:
            found.append(m)
    return len(lines) + len(paragraphs), found


TEMPLATES = (
    ("A", "x", "free to use and share this work"), ("B", "x", "all rights kept by the maker of this work"), ("C", "y", "foobarium"),
    ("D", "y", "share alike"), ("E", "z", "use this work and share this work and use this work"),
)


@pytest.mark.parametrize("threshold", [0.6, 0.75, 1.0])
def test_license_windows_equal_brute_force(docs, threshold):
    rng = random.Random(5)
    pool = sorted({w for _, _, t in TEMPLATES for w in t.split()}) + ["other", "words", "here"]
    texts = ["foobarium", "Foobarium.\nfoobarium", "so foobarium", "share alike", "please share alike", None, "", "\n\n"]
    for _ in range(400):
        parts = []
        for _ in range(rng.randrange(1, 9)):
            if rng.random() < 0.5:
                words = rng.choice(TEMPLATES)[2].split()
                for _ in range(rng.randrange(3)):
                    words[rng.randrange(len(words))] = rng.choice(pool)
            else:
                words = rng.choices(pool, k=rng.randrange(1, 7))
            parts += [rng.choice([" ", ", ", " ", "\n"]).join(words), rng.choice([" ", "\n", "\n", "\n\n", ". "])]
        texts.append("".join(parts))
    got = license_dice.scan_licenses(docs(texts), threshold, TEMPLATES).orderBy("doc_id").collect()
    found = 0
    for r, text in zip(got, texts):
        n, matches = _plain_matches(text, TEMPLATES, threshold)
        best = max(matches, default=None)
        assert (r["n_segments"], r["n_matches"]) == (n, len(matches)), text
        assert (r["dice"], r["segment"]) == ((best[0], -best[2]) if best else (None, None)), text
        assert r["license"] == (TEMPLATES[-best[1]][0] if best else None), text
        found += bool(best)
    assert len(got) == len(texts) and found > 50


def test_the_sample_of_a_label_is_its_smallest_hashes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_TOXIC", 20)
    monkeypatch.setattr(toxicity, "MAX_CLEAN", 50)
    usable = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("toxic"))
    counts = {1: 300, 0: 2700}
    hashed = usable.withColumn("h", F.xxhash64("doc_id")).collect()
    wanted = set()
    for label, limit in ((1, 20), (0, 50)):
        wanted |= {r["doc_id"] for r in sorted((r for r in hashed if r["toxic"] == label), key=lambda r: r["h"])[:limit]}
    assert {r["doc_id"] for r in toxicity._first_of_each(usable, counts).collect()} == wanted
    few = usable.filter("doc_id < 40")
    assert toxicity._first_of_each(few, {1: 4, 0: 36}).count() == 40
    assert toxicity._first_of_each(usable.filter("false"), {}).count() == 0


def test_edits_do_not_depend_on_the_stretches(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(40)))) for i in range(200)]
    rows += [(7, "again"), (None, "no id"), (None, None), (300, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    whole = oph_fingerprint.fingerprint_edits(table, 1).collect()
    monkeypatch.setattr(oph_fingerprint, "STRETCH_BYTES", 500)
    assert oph_fingerprint._stretches(table) > 20
    cut = oph_fingerprint.fingerprint_edits(table)
    assert cut.rdd.getNumPartitions() > 20
    assert sorted(map(str, cut.collect())) == sorted(map(str, whole))
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    following = {r: n for r, n in zip(order, order[1:] + order[:1])}
    digests = sorted(hashlib.sha256(oph_fingerprint.edited_text(r[1] or "", following[r][1] or "").encode()).hexdigest() for r in rows)
    assert sorted(r["edited_sha256"] for r in whole) == digests
