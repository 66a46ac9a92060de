import random
import re
import string

import numpy as np
import pyarrow as pa
import pytest

from waymark.llm import near_duplicates as N
from waymark.llm.common import Tables

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def expected(rows):
    """Components by comparing all pairs of nodes; rows that share an id are one node."""
    sets = [shingles(t) for _, t in rows]
    part = list(range(len(rows)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            linked = a and b and (a == b or rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 75 * len(a | b))
            if linked or a and b and rows[i][0] is not None and rows[i][0] == rows[j][0]:
                part[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if root(k) == root(i) and rows[k][0] is not None]
        comp = d if not sets[i] else min(ids, default=None)
        out.append((d, len(sets[i]), comp, comp == d))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in N.near_duplicates(df).collect()), key=str)


def test_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(odd) == expected(rows)
    assert got(none) == []
    kept = N.one_of_each(odd)
    assert kept.columns == odd.columns
    assert kept.where("doc_id = 1").count() == 1 and kept.where("doc_id = 2").count() == 0


def test_families_over_block_size_equal_brute_force(spark, monkeypatch):
    """Groups of near copies larger than LONG and BLOCK, a passage that many share, and borderline pairs."""
    monkeypatch.setattr(N, "LONG", 6)
    monkeypatch.setattr(N, "BLOCK", 8)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, passage = [word() for _ in range(90)], [word() for _ in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    for i in range(60, 100):
        own = [word() for _ in range(rng.choice([8, 15, 30, 60]))]
        rows.append((i, " ".join(passage + own)))
    rows += [(100 + i, rows[i][1].upper()) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(df) == expected(rows)


def test_sample_equals_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(df) == expected([(r["doc_id"], r["text"]) for r in df.collect()])


def test_shingle_sets_are_exact():
    texts = ["", "a", "A b", "a b c d e", "a b c d e f", "é x b c d e", "  a  b c\td e\n f ", "a b c d e a b c d e a b c d e"]
    offsets, data = N.buffers_of(pa.array(texts))
    bounds, _ = N.shingle_sets(offsets, data)
    assert list(np.diff(bounds)) == [len(shingles(t)) for t in texts]
    one = N.shingle_sets(*N.buffers_of(pa.array(["A B c d E f"])))[1]
    two = N.shingle_sets(*N.buffers_of(pa.array(["x", "a b C D e F"])))[1][1:]
    assert list(one) == list(two)


def test_blockwise_comparison():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    i, j = N.similar(sets, list(range(12)), list(range(12, 30)))
    want = {(a, b) for a in range(12) for b in range(12, 30) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want
    assert N.forest(4, [(0, 1), (1, 2), (0, 2), (3, 3)]) == [(0, 1), (1, 2)]


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (9, 3), (5, 6)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)]])
def test_components(spark, edges):
    links = spark.createDataFrame(edges, "a long, b long")
    out = {r["rep"]: r["comp"] for r in N.components(links, Tables(spark, "test")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert out == label
