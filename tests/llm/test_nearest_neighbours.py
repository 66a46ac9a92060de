from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import nearest_neighbours as N
from waymark.llm.common import Tables


def found(df):
    out = defaultdict(list)
    for r in N.nearest(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("scale", [1e-200, 1e200, 5e-324, 1e-308, 1.7e308])
def test_tiny_and_huge_components(spark, scale):
    x = np.random.default_rng(3).integers(-9, 10, (60, 4)).astype(float)
    x[:, 0] += 20
    if scale == 1.7e308:
        x /= np.abs(x).max()
    usual, scaled = found(frame(spark, x)), found(frame(spark, x * scale))
    assert {q: [v for v, _ in r] for q, r in usual.items()} == {q: [v for v, _ in r] for q, r in scaled.items()}
    for q, r in usual.items():
        assert [s for _, s in r] == pytest.approx([s for _, s in scaled[q]], abs=1e-12 if scale != 1.7e308 else 1e-9)


def test_scaling_is_exact(spark):
    x = np.random.default_rng(4).normal(size=(50, 7)) * 10.0 ** np.random.default_rng(5).integers(-30, 30, (50, 1))
    for v, w in frame(spark, x).select("embedding", N.scaled(F.col("embedding"))).collect():
        ratio = np.array(w) / np.array(v)
        assert len(set(ratio)) == 1 and np.frexp(ratio[0])[0] == 0.5 and 0.4 < np.abs(w).max() <= 2


def test_a_narrow_beam_is_widened(spark, monkeypatch):
    """With lists and a beam too narrow for the data the search goes on until the probes are found."""
    x = np.random.default_rng(6).normal(size=(1500, 64))
    nodes = N.valid_vectors(frame(spark, x), "vec_id", "embedding").select("id", "v")
    tables = Tables(spark, "test")
    monkeypatch.setattr(N, "BEAM", 6)
    monkeypatch.setattr(N, "TARGET", 1.0)
    lists, codes = N.neighbour_graph(nodes, tables)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    rows = N.search(lists, codes, nodes.where("id % 25 = 0"), tables).collect()
    for r in rows:
        s = unit @ unit[r["id"]]
        s[r["id"]] = -2
        hits += len(set(np.argsort(-s)[:5].tolist()) & set(r["near"]))
    assert hits >= 0.99 * 5 * 60 and max(len(r["near"]) for r in rows) > 6


def test_hubs_are_dealt_out(spark, monkeypatch):
    """A vector that is in every list: the same result when its join is dealt out."""
    x = np.random.default_rng(7).normal(size=(400, 12))
    x[0] = 0.01
    x[1:] += 1
    usual = found(frame(spark, x))
    monkeypatch.setattr(N, "HUB", 40)
    assert found(frame(spark, x)) == usual
