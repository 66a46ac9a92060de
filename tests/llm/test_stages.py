"""Stages of the pipeline on odd rows, and what they may not lose."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from waymark.llm import near_duplicates as N
from waymark.llm import quality_rules as Q


def row(doc_id, text):
    return (doc_id, text, "en", "a", len(text), None, "x", 7, "e", "s")


SCHEMA = "doc_id long, text string"


def words(seed, n=80):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def test_texts_that_share_an_id_stay(spark):
    a, b, c = words(1), words(2), words(3)
    near = lambda t: " ".join(t.split()[:-1] + ["other"])
    rows = [(1, a), (2, near(a)), (2, c), (3, b), (3, b), (4, near(b)), (5, None), (5, c), (None, a), (None, a), (None, None), (6, a.upper())]
    got = Counter(tuple(r) for r in N.one_of_each(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect())
    assert got == Counter([(1, a), (2, near(a)), (2, c), (3, b), (5, None), (5, c), (None, a), (None, None)])


def test_the_same_row_stays_however_rows_are_dealt(spark):
    rows = [(i % 7, words(i % 7) + (" " * (i % 3)), f"source {i % 4}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = sorted(N.one_of_each(df.coalesce(1)).collect())
    assert len(first) == 7 and first == sorted(N.one_of_each(df.repartition(5)).collect())


def test_a_text_goes_only_where_a_linked_one_stays(spark, odd):
    hashes = lambda t: set(N.shingle_sets(*N.buffers_of(N.pa.array([t or ""])))[1].tolist())
    kept = [hashes(r["text"]) for r in N.one_of_each(odd).collect()]
    for r in odd.collect():
        s = hashes(r["text"])
        assert any(s == k or 100 * len(s & k) >= 75 * len(s | k) for k in kept)


def test_keep_good_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(14)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    out, rules = Q.quality_rules(odd, labels)
    kept = Q.keep_good(odd, labels)
    assert kept.columns == odd.columns
    verdicts = Counter((r["doc_id"], r["kept"]) for r in out.collect())
    got = Counter(r["doc_id"] for r in kept.collect())
    assert got == Counter({d: n for (d, k), n in verdicts.items() if k})
    assert set(map(str, kept.collect())) <= set(map(str, odd.collect()))


def test_the_filter_shuffles_no_text(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    plan = Q.keep_good(odd, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


@pytest.mark.parametrize("which", ["odd", "none", "copies"])
def test_every_stage_on_odd_rows(spark, odd, none, which, tmp_path):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(14)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = {"odd": odd, "none": none, "copies": spark.createDataFrame([row(i, words(99) if i % 2 else words(i)) for i in range(20)], odd.schema)}[which]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert docs.columns == before.columns and docs.schema.simpleString() == before.schema.simpleString()
        if name == "secret scans":
            assert docs.count() == before.count()
        if name == "mixing":
            assert {str(r) for r in docs.collect()} == {str(r) for r in before.collect()}
    if which == "none":
        assert docs.count() == 0
    if which == "copies":
        assert docs.select("doc_id").distinct().count() == 11
