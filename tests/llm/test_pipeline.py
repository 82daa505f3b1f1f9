"""The corpus pipeline, its filters over odd tables, and the calibration of language identification."""

import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import langid
from ledgerloom.llm.langid import fit_languages, gram_buckets, keep_known_languages, language_of
from ledgerloom.llm.odd_sketch_dedup import drop_near_duplicates
from ledgerloom.llm.toxicity import drop_toxic

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def _words(rng, n):
    return " ".join(f"w{rng.integers(5000)}" for _ in range(n))


def test_pipeline_keeps_clean_documents_and_packs_each_once(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ids = {r["doc_id"] for r in docs.collect()}
    kept = docs
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SMALL).cache()
        assert kept.columns == docs.columns
        left = {r["doc_id"] for r in kept.collect()}
        assert left <= {r["doc_id"] for r in before.collect()}
        sizes.append(len(left))
    assert sizes[0] >= 0.98 * len(ids)
    packed = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"] for r in packed} == left
    assert len({(r["doc_id"], r["piece"]) for r in packed}) == len(packed)
    room = {}
    for r in packed:
        room[r["sequence_id"]] = room.get(r["sequence_id"], 0) + r["length"]
    assert max(room.values()) <= 2048


def test_stages_of_an_empty_table_are_empty(spark, tmp_path):
    for table in ("documents", "labels"):
        spark.read.parquet(f"{SMALL}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def _odd_columns(spark, texts):
    """Columns whose names are used inside, need quotes, or whose types have no order."""
    rows = [(i % 1000, t, "en", "s", i, {"k": i}, (i, "x"), 1.5) for i, t in texts]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, _keep int, `a.b` map<string,int>, _row struct<a:int,b:string>, n double"
    )


def test_near_duplicate_filter_carries_any_columns(spark):
    rng = np.random.default_rng(1)
    base, other = _words(rng, 200), _words(rng, 200)
    near = base.replace(base.split()[100], "changed", 1)
    texts = [(1, base), (2, near), (3, other), (4, None), (5, ""), (6, "one two"), (7, "one two"), (8, other), (1, base)]
    got = drop_near_duplicates(_odd_columns(spark, texts))
    assert got.columns == ["doc_id", "text", "lang", "source", "_keep", "a.b", "_row", "n"]
    kept = {(r["doc_id"], r["text"]): r for r in got.collect()}
    assert set(kept) == {(1, base), (3, other), (4, None), (5, ""), (6, "one two")}
    assert kept[3, other]["a.b"] == {"k": 3} and kept[3, other]["_row"] == (3, "x")
    # One id with different texts: each is a document, a null one beside them goes.
    several = [(1, base), (1, other), (1, None), (1001, near), (2, None)]
    kept = {(r["doc_id"], r["text"]) for r in drop_near_duplicates(_odd_columns(spark, several)).collect()}
    assert kept == {(1, min(base, near)), (1, other), (2, None)}


def test_filters_over_odd_rows(spark, odd, none):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source")
    wide = docs.unionByName(odd.select("doc_id", "text", "lang", "source")).withColumn("known", F.lit(1)).withColumn("a.b", F.create_map(F.lit(1), F.lit(2)))
    kept = keep_known_languages(wide)
    assert kept.columns == wide.columns
    texts = [r["text"] for r in kept.collect()]
    assert None not in texts and "" not in texts and " \n\t " not in texts
    assert texts.count("one two") in (0, 2)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    clean = drop_toxic(wide, labels)
    assert clean.columns == wide.columns
    # Null and empty texts are not toxic; repeated rows share their fate.
    left = [r["text"] for r in clean.collect()]
    assert left.count(None) == 2 and left.count("") == 1 and left.count("one two") in (0, 2)
    assert drop_toxic(none, labels).collect() == []
    assert keep_known_languages(none).collect() == []
    assert drop_near_duplicates(none).collect() == []


@pytest.fixture(scope="module")
def middle(spark):
    return spark.read.parquet(f"{MIDDLE}/documents.parquet").cache()


def test_calibration_has_an_optimum_and_limits_that_act(middle):
    model = fit_languages(middle)
    assert 0.06 < model.temperature < 19
    assert np.isfinite(model.limits).sum() >= 3
    texts = pa.array(["xk zq vvv wrrrp", "", "123"] + [r["text"] for r in middle.limit(50).collect()], pa.large_string())
    # Brute force of averages, softmax and likelihoods.
    best, p, rejected = model.judge(texts)
    buckets, at = gram_buckets(texts)
    for i in range(len(texts)):
        mine = buckets[at[i] : at[i + 1]]
        z = model.bias + (sum(model.table[b] for b in mine) / len(mine) if len(mine) else 0)
        e = [math.exp(v / model.temperature) for v in z - z.max()]
        assert best[i] == int(np.argmax(z)) and abs(p[i] - max(e) / sum(e)) < 1e-9
        if len(mine):
            fit = sum(float(model.likelihood[b, best[i]]) for b in mine) / len(mine)
            limit = model.limits[sum(len(mine) >= n for n in langid.LENGTHS)]
            assert rejected[i] == (fit < limit) or abs(fit - limit) < 1e-4
        else:
            assert not rejected[i]


def test_scoring_memory_is_bounded_and_the_same_as_at_once(spark):
    """A batch of many texts is scored in small blocks: its n-grams must not fill an executor beside the JVM."""
    rng = np.random.default_rng(3)
    words = np.array(["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(5000)])
    texts = pa.array([" ".join(rng.choice(words, 700)) for _ in range(1000)] + [None, "", "12"])
    table, likelihood = rng.normal(0, 1, (langid.BUCKETS, 4)), rng.normal(-9, 1, (langid.BUCKETS, 4)).astype(np.float32)
    model = langid.LanguageModel(list("abcd"), table, np.zeros(4), 1.0, likelihood, np.full(5, -9.0))
    best, p, rejected = model.judge(texts.cast(pa.large_string()).fill_null(""))
    score = language_of(model).func
    tracemalloc.start()
    got = pa.concat_arrays(list(score(iter([texts]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert texts.nbytes > 2 << 20 and peak < 80 << 20
    assert got.field("lang").to_pylist()[:1000] == ["abcd"[b] for b in best[:1000]]
    assert got.field("lang").to_pylist()[1000:] == ["und"] * 3
    assert got.field("score").to_pylist()[:1000] == p[:1000].tolist()
    assert got.field("known").to_pylist() == [*(~rejected[:1000]).tolist(), False, False, False]


@pytest.mark.parametrize("left_out", ["de", "es"])
def test_texts_of_a_left_out_language_are_rejected(middle, left_out):
    model = fit_languages(middle.filter(F.col("lang") != left_out))
    told = middle.withColumn("known", language_of(model)(F.col("text"))["known"])
    share = {r["out"]: r["share"] for r in told.groupBy((F.col("lang") == left_out).alias("out")).agg(F.avg(F.col("known").cast("int")).alias("share")).collect()}
    assert share[True] <= 0.1 and share[False] >= 0.99
