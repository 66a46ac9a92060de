import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymark.llm import quality_model as Q
from waymark.llm.near_duplicates import buffers_of

TEXTS = ["short text", "", "a", "ab", "abc", "spam " * 300, "Grüße aus 東京, 12 Häuser.", "x" * 5000, "one two three four. " * 40 + "end", "\n\n\n", "%%% ### $$$ 99"]


@pytest.fixture(scope="module")
def model():
    good = [" ".join(f"word{(i * 7 + k) % 97} of" for k in range(80)) for i in range(30)]
    bad = ["buy now $$$ " * (20 + i) for i in range(30)]
    return Q.train(good + bad, np.array([1.0] * 30 + [0.0] * 30))


def scores(model, texts):
    return model.scores(*buffers_of(pa.array(texts, pa.string()))).tolist()


def test_a_score_is_a_function_of_the_text(model):
    alone = [scores(model, [t])[0] for t in TEXTS]
    assert scores(model, TEXTS) == alone
    rng = np.random.default_rng(0)
    for _ in range(20):
        order = rng.permutation(len(TEXTS)).tolist() * 2
        assert scores(model, [TEXTS[i] for i in order]) == [alone[i] for i in order]


def test_scores_do_not_depend_on_partitions(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    results = []
    for rows in (docs.coalesce(1), docs.repartition(7), docs.orderBy(F.desc("doc_id")), docs.unionByName(docs).repartition(3)):
        results.append({(r["doc_id"], r["score"]) for r in Q.score(rows, model).collect()})
    assert results[0] == results[1] == results[2] == results[3] and len(results[0]) == docs.count()


def plain_score(model, text):
    """The score of one text, passage by passage."""
    raw, p = text.encode(), model.p
    strings = [raw[i : i + 5] for i in range(len(raw) - 4)]
    count = {}
    for s in strings:
        count[s] = count.get(s, 0) + 1
    hidden, energy = [], []
    for a in range(0, max(1, len(raw)), Q.PASSAGE):
        b = min(a + Q.PASSAGE, len(raw))
        width = max(1, b - a)
        x = [sum(float(kind[c]) for c in raw[a:b]) / width for kind in Q.CLASSES]
        here = strings[a:b]
        x.append(sum(count[s] > 1 for s in here) / max(1, len(here)))
        x += [math.log1p(len(raw)) / 10, math.log1p(b - a) / 10]
        total = np.zeros(Q.PROJECTED)
        for i in range(a, min(b, len(raw) - 2)):
            g = ((raw[i] * 0x01000193 & 0xFFFFFFFF) ^ raw[i + 1]) * 0x01000193 & 0xFFFFFFFF
            g = (g ^ raw[i + 2]) * 0x9E3779B1 & 0xFFFFFFFF
            total += Q.PROJECTION[g >> 20]
        x = (np.array([*x, *(total / width)], np.float32) - model.mean) / model.spread
        h = np.tanh(x @ p["A"] + p["a"])
        hidden.append(h)
        energy.append(np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"]))) @ p["w"])
    weight = np.exp(np.array(energy) - max(energy))
    z = (weight[:, None] * hidden).sum(axis=0) / weight.sum()
    return 1 / (1 + math.exp(-(z @ p["c"] + p["b"])))


def test_scores_equal_plain_ones(spark, model):
    texts = TEXTS + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(30).collect()]
    assert scores(model, texts) == pytest.approx([plain_score(model, t) for t in texts], abs=1e-5)
