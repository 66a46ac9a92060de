from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from waymark.llm import sharding as S
from waymark.llm.common import Tables

SCHEMA = "doc_id long, text string"


def placed(spark, rows, links, shards=8):
    df = spark.createDataFrame(rows, SCHEMA)
    out = S.shard(df, shards, spark.createDataFrame(links, "a long, b long")).select("doc_id", "shard", "slot").collect()
    where = {r["doc_id"]: r["shard"] for r in out}
    count = Counter(where.values())
    assert len(out) == len(rows) and max(count.values()) - min(count.get(s, 0) for s in range(shards)) <= 1
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return where


def cut(where, links):
    return sum(where[a] != where[b] for a, b in links if a in where and b in where)


CHAINS = [(10 * c + i, 10 * c + i + 1) for c in range(60) for i in range(9)]
STARS = [(12 * c, 12 * c + i) for c in range(50) for i in range(1, 12)]


@pytest.mark.parametrize("links, share", [(CHAINS, 0.45), (STARS, 0.25)])
def test_links_between_different_texts_are_cut_less_than_by_hash(spark, links, share):
    """By a hash seven of eight links are cut."""
    rows = [(i, f"text {i}") for i in range(1200)]
    where = placed(spark, rows, links)
    assert cut(where, links) <= share * len(links)


def test_links_and_copies_together(spark):
    rows = [(i, f"text {i // 3}") for i in range(900)]
    links = [(3 * k, 3 * k + 3) for k in range(0, 200, 2)]
    where = placed(spark, rows, links)
    assert cut(where, links) <= 0.5 * len(links)
    assert sum(len({where[3 * k + j] for j in range(3)}) > 1 for k in range(300)) <= 15


def test_links_that_count_for_nothing(spark):
    rows = [(i, f"text {i}") for i in range(64)] + [(None, "x"), (None, None), (3, "text 3")]
    links = [(1, 1), (1, 999), (None, 2), (5, None), (2, 7), (2, 7), (7, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert S.shard(df, 4, spark.createDataFrame(links, "a long, b long")).count() == len(rows)
    assert S.shard(df.limit(0), 4, spark.createDataFrame(links, "a long, b long")).count() == 0
    assert S.shard(df, 4, spark.createDataFrame([], "a long, b long")).count() == len(rows)


def test_rounds_lower_the_cut_and_keep_quotas(spark):
    tables = Tables(spark, "test")
    df = spark.createDataFrame([(i, f"text {i // 2 if i < 1600 else i}") for i in range(2400)], SCHEMA)
    base = tables.put(S.narrow(df))
    start = base.groupBy("g1", "g2", (F.col("cell") % 16).alias("k")).agg(F.count("*").alias("n"))
    units = tables.put(start.withColumn("shard", F.col("k")).withColumn("whole", F.lit(False)))
    links = tables.put(S.unit_links(units, base, 16, None))
    before = S.cut_edges(links, units)
    after = S.propagate(units, links, [150] * 16, tables)
    size = {r["shard"]: r["n"] for r in after.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    began = {r["shard"]: r["n"] for r in units.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    assert S.cut_edges(links, after) <= 0.15 * before and all(size[s] <= max(150, began[s]) for s in size)
    assert sum(size.values()) == 2400


def test_allowed_moves():
    assert S._allowed({(0, 1): 5, (1, 0): 3}, [0, 0]) == {(0, 1): 3, (1, 0): 3}
    assert S._allowed({(0, 1): 5, (2, 1): 5}, [0, 4, 0]) == {(0, 1): 2, (2, 1): 2}
