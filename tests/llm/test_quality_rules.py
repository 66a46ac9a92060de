import re
from collections import Counter

import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymark.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + d for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for d in range(3)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def counts(df):
    return [tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in df.collect()]


def test_statistics_equal_plain_ones(spark, odd):
    texts = [r[0] for r in odd.select("text").collect()]
    texts += ["a b c a b c", "a a a a", "a b\na b\n\na b ", "a\x1cb c", "x y z x y z", "%|<> #\n#"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    assert counts(Q.statistics(df).orderBy("doc_id")) == [plain(t) for t in texts]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t%", max_size=40), min_size=1, max_size=30))
def test_statistics_of_any_text(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    assert counts(Q.statistics(df).orderBy("doc_id")) == [plain(t) for t in texts]


def test_verdicts_on_labelled_data(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out, rules = Q.quality_rules(docs, labels)
    assert out.count() == docs.count() and rules.rules
    m = out.join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    got = {(r["quality"], r["kept"]): r["count"] for r in m}
    assert got.get((1, False), 0) <= 0.02 * got[1, True]
    assert got.get((0, True), 0) <= 0.35 * sum(v for (q, _), v in got.items() if q == 0)
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == out.where("kept").count()
    assert pq.read_table(f"{sf}/documents.parquet").num_rows > kept.count()


def test_odd_rows_and_no_labels(spark, odd, none):
    labels = spark.createDataFrame([(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    out, rules = Q.quality_rules(odd, labels)
    assert not rules.rules and out.count() == odd.count()
    assert all(r["kept"] == (not r["base_failed"]) for r in out.collect())
    assert Q.quality_rules(none, labels)[0].count() == 0
    assert Q.keep_good(none, labels).columns == none.columns
    contradicting = spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, quality int")
    assert [tuple(r) for r in Q.labels_of(contradicting).collect()] == [(1, 1)]


def test_rules_are_an_ordered_expression(spark):
    rules = Q.DecisionList([[Q.Condition("a", True, 1.0)], [Q.Condition("a", False, 0.0), Q.Condition("b", True, 5.0)]])
    df = spark.createDataFrame([(2.0, 9.0), (0.0, 9.0), (0.0, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(rules.rule_number({"a": F.col("a"), "b": F.col("b")})).collect()] == [1, 2, 0]
    assert "else: keep" in str(rules)
