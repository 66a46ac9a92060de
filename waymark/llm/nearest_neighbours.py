"""Approximate nearest neighbours by cosine: a neighbour graph by NN-descent, and greedy search in it.

Graph. Every vector has a list of its K nearest so far. To begin with, vectors are dealt into blocks of about LEAF by the
signs of random projections, and the best of a block fill the lists. Then rounds of joins: every vector gathers its
neighbours and those it is a neighbour of (the K nearest of these), and proposes to each of them the others that are
nearer than the worst in its list; pairs that met before are left out. Lists take the best. Rounds end when few lists
change. Vectors travel as 8-bit codes of their direction.

Search. Edges are walked both ways: a node leads to those in its list and to the K nearest that list it. A query starts
from its own list if it is in the graph, else from the best of ENTRIES vectors. Each round joins the unexpanded of its
beam, the best found so far, with what they lead to and keeps the best; it ends when all of them are
expanded, which it always comes to: what falls out of a beam never returns. Then the beam's scores are computed in double
precision, on vectors scaled by a power of two so that no square overflows or vanishes (the scale cancels exactly).

Beam. How wide a beam must be depends on the data and grows slowly with their number. So recall is measured: the nearest
of PROBES of the queries are found among all vectors by brute force, in blocks, and while the search finds less than
TARGET of them the beam is doubled and the search goes on from where it was.

Equal vectors are one node, with its five smallest ids and the query's own at hand, so that copies, however many, are
neither compared nor lost: the K + 1 nearest ids of any query need no more of a node than that.

Bounds: the graph is N lists of K, and 2 K when walked both ways; what a vector gathers is 2 K at most, a block about LEAF; every row of the table is
indexed. A vector in very many lists (a hub) joins in HUB_PARTS parts. The graph holds approximate lists by nature; recall against brute force is measured in tests and README.

Cases: null ids, null, empty or zero vectors and those with null or non-finite components take no part, nor those of
another length than most (a cosine needs vectors of one length); repeated rows of an id count once; with fewer than six vectors all others are found; ties go
to the smaller id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tables, free_shuffles, let

NEIGHBOURS = 5
K = 32
LEAF = 192
TREES = 2
ROUNDS = 6
FEW = 0.02  # of all list entries changed: enough
PROPOSALS = 10
BEAM = 160
PROBES = 200
TARGET = 0.97
HUB = 2048  # lists that hold a vector, beyond which its join is dealt out
HUB_PARTS = 64
ENTRIES = 256
SEED = 23


# Nodes
def scaled(v: Column) -> Column:
    """v times the power of two that brings its largest component near 1: exact, in two factors as one may be out of range."""
    half = F.floor(-F.floor(F.log2(F.array_max(F.transform(v, F.abs)))) / 2)
    rest = -F.floor(F.log2(F.array_max(F.transform(v, F.abs)))) - half
    powers = F.array(F.pow(F.lit(2.0), half.cast("double")), F.pow(F.lit(2.0), rest.cast("double")))
    return let(powers, lambda p: F.transform(v, lambda x: x * p[0] * p[1]))


def valid_vectors(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, v (array of doubles, scaled), h1 and h2 (a 128-bit mark of the vector), one row an id."""
    v = F.col(vector_column).cast("array<double>")
    d = table.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = d.where(good & F.exists("v", lambda x: x != 0))
    common = d.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    d = d.where(F.size("v") == (common[0]["n"] if common else 0))
    return d.groupBy("id").agg(F.min("v").alias("v")).select("id", scaled(F.col("v")).alias("v"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(SEED), "v").alias("h2"))


def _code_batches(bits: int):
    def each(batches):
        planes = None
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            n = batch.num_rows
            x = flat.reshape(n, -1) if n else np.zeros((0, 1))
            largest = np.abs(x).max(axis=1, keepdims=True)
            x = x / largest  # so that squares neither overflow nor vanish
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            scale = np.abs(x).max(axis=1, keepdims=True) / 127
            code = np.rint(x / scale).astype(np.int8)
            if planes is None:
                planes = np.random.default_rng(SEED).normal(size=(TREES, max(1, bits), x.shape[1]))
            signs = np.einsum("nd,tbd->ntb", x, planes) > 0 if bits else np.zeros((n, TREES, 1), bool)
            cell = signs @ (1 << np.arange(signs.shape[2]))
            cells = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * TREES), pa.array(cell.astype(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(scale.ravel().astype(np.float32)), cells], names=["id", "code", "scale", "cells"])

    return each


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a binary column of one width as int8."""
    n = len(column)
    if n == 0:
        return np.zeros((0, 1), np.int8)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(column.buffers()[2], np.int8)[offsets[0] : offsets[-1]].reshape(n, -1)


def _lists(arrays: list[np.ndarray], counts: np.ndarray) -> list[pa.Array]:
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(a)) for a in arrays]


def _propose(batches):
    """Rows: one with `m`, a list of (id, code, scale, worst, fresh). Out: for each id of a group the best others, nearer than its worst."""
    for batch in batches:
        groups = batch.column(0)
        m = groups.flatten()
        ids, scale, worst, fresh = (m.field(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3, 4))
        code = _matrix(m.field(1)).astype(np.float32) * scale[:, None]
        bounds = groups.offsets.to_numpy() - (groups.offsets[0].as_py() if len(groups) else 0)
        owner, found, far, counts = [], [], [], []
        for g in range(len(groups)):
            a, b = bounds[g], bounds[g + 1]
            n = b - a
            if n < 2:
                continue
            d = (1 - code[a:b] @ code[a:b].T).astype(np.float32)
            d[~(fresh[a:b, None] | fresh[None, a:b])] = 4
            d[ids[a:b, None] == ids[None, a:b]] = 4
            d[d >= worst[a:b, None]] = 4
            k = min(int(batch.column(1)[g].as_py()), n)
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            dn = np.take_along_axis(d, near, axis=1)
            good = dn < 4
            c = good.sum(axis=1)
            some = c > 0
            owner.append(ids[a:b][some])
            counts.append(c[some])
            found.append(ids[a:b][near][good])
            far.append(dn[good])
        join = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        c = join(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(join(owner, np.int64)), *_lists([join(found, np.int64), join(far, np.float32)], c)], names=["id", "near", "far"])


def best_of(row: np.ndarray, ids: np.ndarray, far: np.ndarray, old: np.ndarray, n: int, k: int):
    """The k nearest distinct ids of each of n rows; of an id that comes twice the old entry. Gives the picked positions and counts."""
    by = np.lexsort((~old, ids, row))
    first = np.ones(len(by), bool)
    first[1:] = (row[by][1:] != row[by][:-1]) | (ids[by][1:] != ids[by][:-1])
    by = by[first]
    by = by[np.lexsort((ids[by], far[by], row[by]))]
    count = np.bincount(row[by], minlength=n)
    start = np.cumsum(count) - count
    by = by[np.arange(len(by)) - np.repeat(start, count) < k]
    return by, np.minimum(count, k)


def _nested(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of lists of (near, far): the row of each entry, ids, distances."""
    n = len(column)
    outer = column.offsets.to_numpy() - (column.offsets[0].as_py() if n else 0)
    s = column.flatten()
    near, far = s.field(0), s.field(1)
    inner = near.offsets.to_numpy()
    size = np.diff(inner)
    row = np.repeat(np.repeat(np.arange(n), np.diff(outer)), size)
    return row, near.flatten().to_numpy(zero_copy_only=False), far.flatten().to_numpy(zero_copy_only=False)


def _merge(batches):
    """Rows: id, near, far, proposals. Out: id, near, far, fresh."""
    for batch in batches:
        n = batch.num_rows
        old_row = np.repeat(np.arange(n), np.diff(batch.column(1).offsets.to_numpy()))
        old_id, old_far = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2))
        row, ids, far = _nested(batch.column(3))
        rows, all_ids, all_far = np.concatenate([old_row, row]), np.concatenate([old_id, ids]).astype(np.int64), np.concatenate([old_far, far]).astype(np.float32)
        old = np.arange(len(rows)) < len(old_row)
        pick, count = best_of(rows, all_ids, all_far, old, n, K)
        yield pa.RecordBatch.from_arrays([batch.column(0), *_lists([all_ids[pick], all_far[pick], ~old[pick]], count)], names=["id", "near", "far", "fresh"])


LISTS = "id long, near array<long>, far array<float>, fresh array<boolean>"
EMPTY = "array<struct<near:array<long>,far:array<float>>>"


def _take(lists: DataFrame, proposals: DataFrame) -> DataFrame:
    p = proposals.groupBy("id").agg(F.collect_list(F.struct("near", "far")).alias("p"))
    joined = lists.join(p, "id", "left").select("id", "near", "far", F.coalesce("p", F.array().cast(EMPTY)).alias("p"))
    return joined.mapInArrow(_merge, LISTS)


def _back(edges: DataFrame) -> DataFrame:
    """edges: id, to, far and more. Of the edges to a node the K nearest."""
    nearest = F.row_number().over(Window.partitionBy("to").orderBy("far", "id"))
    return edges.withColumn("r", nearest).where(F.col("r") <= K).drop("r")


def neighbour_graph(nodes: DataFrame, tables: Tables, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """nodes: id, v. Gives lists (id, near, far: the K nearest found, nearest first) and codes (id, code, scale)."""
    spark = nodes.sparkSession
    n = nodes.count()
    bits = max(0, round(math.log2(max(1, n / LEAF))))
    codes = tables.put(nodes.select("id", "v").mapInArrow(_code_batches(bits), "id long, code binary, scale float, cells array<long>"))
    # a cell of any size is cut into blocks by hash
    placed = codes.select("id", "code", "scale", F.posexplode("cells").alias("tree", "cell"))
    size = placed.groupBy("tree", "cell").agg(F.ceil(F.count("*") / LEAF).alias("parts"))
    member = F.struct("id", "code", "scale", F.lit(3.0).cast("float").alias("worst"), F.lit(True).alias("fresh"))
    part = F.pmod(F.xxhash64("id", "tree"), F.col("parts"))
    blocks = placed.join(size, ["tree", "cell"]).groupBy("tree", "cell", part.alias("part")).agg(F.collect_list(member).alias("m"))
    empty = codes.select("id", F.array().cast("array<long>").alias("near"), F.array().cast("array<float>").alias("far"))
    first = blocks.select("m", F.lit(K).alias("k")).mapInArrow(_propose, "id long, near array<long>, far array<float>")
    lists = tables.put(_take(empty, first))
    for _ in range(rounds):
        edges = lists.select("id", F.explode(F.arrays_zip("near", "far", "fresh")).alias("e")).select("id", F.col("e.near").alias("to"), F.col("e.far").alias("far"), F.col("e.fresh").alias("fresh"))
        back = _back(edges).select(F.col("to").alias("owner"), F.col("id").alias("member"), "fresh")
        met = edges.select(F.col("id").alias("owner"), F.col("to").alias("member"), "fresh").unionByName(back).groupBy("owner", "member").agg(F.max("fresh").alias("fresh"))
        worst = F.when(F.size("far") < K, F.lit(3.0)).otherwise(F.element_at("far", -1)).cast("float")
        known = lists.select("id", worst.alias("worst")).join(codes.select("id", "code", "scale"), "id")
        hubs = met.groupBy("member").agg(F.count("*").alias("n")).where(F.col("n") > HUB).select("member", F.lit(True).alias("hub"))
        dealt = met.join(hubs, "member", "left").withColumn("part", F.when(F.col("hub"), F.pmod(F.xxhash64("owner"), F.lit(HUB_PARTS))).otherwise(F.lit(0).cast("long")))
        parts = F.when(F.col("hub"), F.sequence(F.lit(0).cast("long"), F.lit(HUB_PARTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
        spread = known.join(hubs, known.id == hubs.member, "left").select("id", "code", "scale", "worst", F.explode(parts).alias("part"))
        carried = dealt.join(spread, (dealt.member == spread.id) & (dealt.part == spread.part)).select("owner", F.struct("id", "code", "scale", "worst", "fresh").alias("x"))
        groups = carried.groupBy("owner").agg(F.collect_list("x").alias("m")).where(F.exists("m", lambda x: x["fresh"]))
        proposals = groups.select("m", F.lit(PROPOSALS).alias("k")).mapInArrow(_propose, "id long, near array<long>, far array<float>")
        new = tables.put(_take(lists.select("id", "near", "far"), proposals))
        changed = new.agg(F.sum(F.size(F.filter("fresh", lambda x: x)))).head()[0] or 0
        tables.drop(lists)
        lists = new
        free_shuffles(spark)
        if changed <= FEW * n * K:
            break
    return lists, codes


# Search
def _expand(batches):
    """Rows: query, q (its code), qscale, ids, codes, scales of a node's list. Out: query, near, far."""
    for batch in batches:
        q = _matrix(batch.column(1)).astype(np.float32) * batch.column(2).to_numpy()[:, None]
        m = batch.column(3)
        size = np.diff(m.offsets.to_numpy())
        s = m.flatten()
        x = _matrix(s.field(1)).astype(np.float32)
        row = np.repeat(np.arange(batch.num_rows), size)
        far = 1 - np.einsum("nd,nd->n", x, q[row]) * s.field(2).to_numpy() if len(row) else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column(0), *_lists([s.field(0).to_numpy(), far.astype(np.float32)], size)], names=["id", "near", "far"])


def _enter(entries):
    """Rows: id, code, scale. Out: id, near, far: the entries by distance. entries: ENTRIES rows at most."""
    ids = np.array([r["id"] for r in entries], np.int64)
    code = np.array([np.frombuffer(r["code"], np.int8) * r["scale"] for r in entries], np.float32)

    def each(batches):
        for batch in batches:
            n = batch.num_rows if len(ids) else 0
            q = _matrix(batch.column(1)).astype(np.float32) * batch.column(2).to_numpy()[:, None]
            far = 1 - q @ code.T if n else np.zeros((0, len(ids)))
            by = np.argsort(far, axis=1, kind="stable")
            near = _lists([ids[by].ravel(), np.take_along_axis(far, by, axis=1).astype(np.float32).ravel()], np.full(batch.num_rows, len(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *near], names=["id", "near", "far"])

    return each


def _advance(width: int):
    """Rows: id, near, far, found. Out: the width best with flags; all that were there are done."""

    def each(batches):
        for batch in batches:
            n = batch.num_rows
            old_row = np.repeat(np.arange(n), np.diff(batch.column(1).offsets.to_numpy()))
            old_id, old_far = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2))
            row, ids, far = _nested(batch.column(3))
            own = batch.column(0).to_numpy()
            keep = ids != own[row] if len(row) else np.zeros(0, bool)
            rows = np.concatenate([old_row, row[keep]])
            all_ids, all_far = np.concatenate([old_id, ids[keep]]).astype(np.int64), np.concatenate([old_far, far[keep]]).astype(np.float32)
            old = np.arange(len(rows)) < len(old_row)
            pick, count = best_of(rows, all_ids, all_far, old, n, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), *_lists([all_ids[pick], all_far[pick], ~old[pick]], count)], names=["id", "near", "far", "fresh"])

    return each


def search(lists: DataFrame, codes: DataFrame, queries: DataFrame, tables: Tables) -> DataFrame:
    """queries: id, v. Per query: id, near, far, fresh; near are the best nodes found, BEAM or more, without the query's own."""
    spark = queries.sparkSession
    q = tables.put(queries.select("id", "v").mapInArrow(_code_batches(0), "id long, code binary, scale float, cells array<long>").drop("cells"))
    listed = lists.select("id", F.explode(F.arrays_zip("near", "far")).alias("e")).select("id", F.col("e.near").alias("to"), F.col("e.far").alias("far"))
    edge = listed.select("id", "to").unionByName(_back(listed).select(F.col("to").alias("id"), F.col("id").alias("to"))).distinct()
    coded = codes.select(F.col("id").alias("to"), "code", "scale")
    carried = edge.join(coded, "to").groupBy("id").agg(F.collect_list(F.struct("to", "code", "scale")).alias("m"))
    graph = tables.put(carried, codec="none")
    entries = codes.orderBy(F.xxhash64("id"), "id").limit(ENTRIES).select("id", "code", "scale").collect()
    begun = q.join(lists.select("id"), "id", "left_anti").mapInArrow(_enter(entries), "id long, near array<long>, far array<float>")
    start = q.join(lists, "id").select("id", "near", "far").unionByName(begun)
    beam = tables.put(start.withColumn("fresh", F.transform("near", lambda x: F.lit(True))))
    probes = q.orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(PROBES).select("id", "code", "scale").collect()
    truth = tables.put(_probe(codes, probes))
    width = BEAM
    while True:
        beam = _walk(beam, q, graph, width, tables)
        met = truth.join(beam.select("id", "near"), "id").agg(F.sum(F.size(F.array_intersect("best", "near"))), F.sum(F.size("best")), F.max(F.size("near"))).head()
        if not met[1] or met[0] >= TARGET * met[1] or met[2] < width:  # or all that can be reached is in the beams
            return beam
        width *= 2
        # those of the narrow beam are expanded anew, as what they led to and was too far then may be kept now
        beam = beam.withColumn("fresh", F.transform("near", lambda x: F.lit(True)))


def _walk(beam: DataFrame, q: DataFrame, graph: DataFrame, width: int, tables: Tables) -> DataFrame:
    """Expands until every member of every beam is expanded. Ends: a beam's worst entry only gets nearer."""
    while True:
        open_ = F.filter(F.arrays_zip("near", "fresh"), lambda x: x["fresh"])
        front = beam.select("id", F.explode(open_).alias("x")).select("id", F.col("x.near").alias("node"))
        if not front.limit(1).count():
            return beam
        ready = front.join(q, "id").join(graph.select(F.col("id").alias("node"), "m"), "node").select("id", "code", "scale", "m")
        found = ready.mapInArrow(_expand, "id long, near array<long>, far array<float>").groupBy("id").agg(F.collect_list(F.struct("near", "far")).alias("p"))
        state = beam.join(found, "id", "left").select("id", "near", "far", F.coalesce("p", F.array().cast(EMPTY)).alias("p"))
        new = tables.put(state.mapInArrow(_advance(width), LISTS))
        if hasattr(beam, "_table_path"):
            tables.drop(beam)
        beam = new
        free_shuffles(beam.sparkSession)


def _probe(codes: DataFrame, probes) -> DataFrame:
    """Per probe: id, best (its NEIGHBOURS nearest among all codes). Each batch of codes gives its best few, an aggregate the best of these."""
    ids = np.array([r["id"] for r in probes], np.int64)
    code = np.array([np.frombuffer(r["code"], np.int8) * r["scale"] for r in probes], np.float32)

    def each(batches):
        for batch in batches:
            if not len(ids) or not batch.num_rows:
                continue
            own = batch.column(0).to_numpy()
            far = 1 - code @ (_matrix(batch.column(1)).astype(np.float32) * batch.column(2).to_numpy()[:, None]).T
            far[ids[:, None] == own[None, :]] = 4
            k = min(NEIGHBOURS, far.shape[1])
            near = np.argpartition(far, k - 1, axis=1)[:, :k]
            d = np.take_along_axis(far, near, axis=1).ravel()
            good = d < 4
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)[good]), pa.array(d[good].astype(np.float32)), pa.array(own[near].ravel()[good])], names=["id", "far", "to"])

    each_best = codes.select("id", "code", "scale").mapInArrow(each, "id long, far float, to long")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("far", "to"))
    return each_best.withColumn("r", rank).where(F.col("r") <= NEIGHBOURS).groupBy("id").agg(F.collect_list("to").alias("best"))


def nearest(table: DataFrame, is_query, id_column: str = "vec_id", vector_column: str = "embedding", n: int = NEIGHBOURS) -> DataFrame:
    """Per query of the table (is_query: a condition on id): query_id, rank, vec_id, score; the n nearest rows but its own."""
    tables = Tables(table.sparkSession, "nearest-neighbours")
    rows = tables.put(valid_vectors(table, id_column, vector_column))
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))
    ranked = rows.select("id", "h1", "h2").withColumn("place", place)
    few = tables.put(ranked.where(F.col("place") <= n + 1).groupBy("h1", "h2").agg(F.min("id").alias("node"), F.collect_list("id").alias("ids")))
    nodes = tables.put(rows.join(few.select(F.col("node").alias("id")), "id", "left_semi").select("id", "v"))
    lists, codes = neighbour_graph(nodes, tables)
    asked = tables.put(rows.where(is_query).select("id", "h1", "h2").join(few.select("h1", "h2", "node"), ["h1", "h2"]).select("id", "node"))
    beam = search(lists, codes, nodes.join(asked.select(F.col("node").alias("id")), "id", "left_semi"), tables)
    met = beam.select(F.col("id").alias("node"), F.explode("near").alias("to")).unionByName(beam.select(F.col("id").alias("node"), F.col("id").alias("to")))
    left, right = nodes.select(F.col("id").alias("node"), F.col("v").alias("a")), nodes.select(F.col("id").alias("to"), F.col("v").alias("b"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    cosine = dot("a", "b") / (F.sqrt(dot("a", "a")) * F.sqrt(dot("b", "b")))
    scored = tables.put(met.join(left, "node").join(right, "to").select("node", "to", cosine.alias("score")))
    # n + 1 nodes hold the n nearest ids of every query of the node
    top = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "to"))
    best = scored.withColumn("r", top).where(F.col("r") <= n + 1).join(few.select(F.col("node").alias("to"), "ids"), "to").select("node", "score", F.explode("ids").alias("vec_id"))
    small = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "vec_id"))
    kept = best.withColumn("r", small).where(F.col("r") <= n + 1)
    each = asked.join(kept, "node").where("id != vec_id")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= n).select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)
