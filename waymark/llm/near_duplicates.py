"""Near duplicates by bottom-k sketches of one hash function.

Every text becomes a set of hashed 5-word shingles; its sketch is the K smallest. Equal sets form a class, and one
document stands for each class. The retained values of the representatives, those rare in the corpus first, make
inverted lists; documents that share a list are candidates. The union sketch of a pair estimates its similarity and
drops clear misses, and the full sets of the rest are compared exactly. Links are merged to components.

Which values are indexed: two sets of similarity 0.75 or more share at least SHARED of their K retained values but for
a chance below 1e-8 (a set of at most K/1.34 shingles is retained whole, and there the bound is certain). With the values in one global
order, two sketches that share c of k values meet among the first k - c + 1. With rare values first, passages that
many documents carry stay out of the lists.

Long lists: each list first links its members to one of them only, and what that merges needs no further comparison.
Of a list that still spans several components, short ones give the pairs across components. Long ones (over LONG
members) are cut into blocks of BLOCK documents; each pair of blocks that can hold a missing link is compared by a
task of its own, which returns a spanning forest. So no task sees an unbounded list, no plan emits all pairs of a
list, and no link between different sets is given up.

Cases: a null or empty text, or one of blanks, has an empty set and is linked with nothing; fewer words than five are
one shingle; equal sets share a component; repeated rows are repeated in the result; rows that share an id but not a
text are one node with the links of all its texts; rows without an id are linked by equal sets only, and have no
component id where no row of their set has an id; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .common import Tables, documents

WORDS = 5
NUMERATOR, DENOMINATOR = 75, 100
K = 64
SHARED = 26
LONG = 48
BLOCK = 256
BLOCK_SHINGLES = 300_000  # long texts make smaller blocks
#: Estimates from K values deviate by up to about 0.055; a pair is dropped only far below the threshold.
ESTIMATE = 0.45
CHUNK = 1 << 20


def _table(fold: bool) -> np.ndarray:
    """A 64-bit number for each byte; letters A-Z have that of a-z if fold."""
    out = np.random.default_rng(20240601).integers(1, 2**64, 256, dtype=np.uint64)
    if fold:
        out[65:91] = out[97:123]
    return out


TABLE = _table(True)
BLANKS = np.zeros(256, dtype=bool)
BLANKS[[32, *range(9, 14)]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1 modulo 2 ** 64; those for a usual chunk are kept."""
    held = _powers.get(int(base))
    if held is None or len(held) < n:
        held = np.full(max(n, 2 * CHUNK), base, dtype=np.uint64)
        held[:1] = 1
        held = np.multiply.accumulate(held)
        if len(held) <= 2 * CHUNK:
            _powers[int(base)] = held
    return held[:n]


def buffers_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def pieces(offsets: np.ndarray, most: int = CHUNK):
    """Row ranges of about `most` bytes, one row at least."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, end
        start = end


def shingle_sets(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts in one buffer: bounds (one more than texts) and the sorted distinct shingle hashes of each."""
    n, size = len(offsets) - 1, len(data)
    lengths = np.diff(offsets)
    text = np.repeat(np.arange(n), lengths)
    word = ~BLANKS[data]
    first = np.zeros(size + 1, dtype=bool)  # a text begins here
    first[offsets] = True
    begins = np.flatnonzero(word & (first[:size] | ~np.concatenate([[False], word[:-1]])[:size])) if size else np.zeros(0, np.int64)
    ends = np.flatnonzero(word & (first[1:] | ~np.concatenate([word[1:], [False]]))) + 1 if size else np.zeros(0, np.int64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(TABLE[data] * powers(BASE, size), dtype=np.uint64)])
    back = powers(INVERSE, size)
    h = mix((sums[ends] - sums[begins]) * back[begins] + (ends - begins).astype(np.uint64)) if len(begins) else np.zeros(0, np.uint64)
    owner = text[begins] if len(begins) else np.zeros(0, np.int64)
    count = np.bincount(owner, minlength=n)
    at = np.concatenate([[0], np.cumsum(count)])
    m = len(h)
    value = h[: max(0, m - WORDS + 1)].copy()
    for i in range(1, WORDS):
        value = mix(value * BASE + h[i : len(value) + i])
    sets = []
    for d in range(n):
        a, b = at[d], at[d + 1]
        if b - a >= WORDS:
            sets.append(np.unique(value[a : b - WORDS + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for i in range(a, b):
                whole = mix(whole * BASE + h[i : i + 1])
            sets.append(whole)
        else:
            sets.append(h[:0])
    return np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64), np.concatenate([*sets, h[:0]])


def _sketch_batches(batches):
    for batch in batches:
        offsets, data = buffers_of(batch.column(1))
        for a, b in pieces(offsets):
            with np.errstate(over="ignore"):
                bounds, values = shingle_sets(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
                size = np.diff(bounds)
                places = powers(BASE, int(size.max(initial=0)))
                marks = np.zeros((b - a, 2), np.int64)
                keep = np.minimum(size, K)
                for i in range(b - a):
                    s = values[bounds[i] : bounds[i + 1]]
                    marks[i] = np.array([(mix(s + BASE) * places[: len(s)]).sum(dtype=np.uint64), (mix(s ^ INVERSE) * places[: len(s)]).sum(dtype=np.uint64)], np.uint64).view(np.int64)
                at = np.concatenate([[0], np.cumsum(keep)])
                taken = np.repeat(bounds[:-1] - at[:-1], keep) + np.arange(at[-1])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    pa.array(size.astype(np.int64)),
                    pa.array(marks[:, 0]),
                    pa.array(marks[:, 1]),
                    pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values[taken].view(np.int64))),
                ],
                names=["doc_id", "n", "m1", "m2", "sketch"],
            )


def sketches(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n (set size), m1 and m2 (a 128-bit mark of the set), sketch (its K smallest values, in unsigned order)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_sketch_batches, "doc_id long, n long, m1 long, m2 long, sketch array<long>")


def prefix_length(n: Column) -> Column:
    """How many values to index. Below K * 0.75 both sketches of a linked pair are whole sets and share 0.75 of this one at least."""
    k = F.least(n, F.lit(K))
    whole = n - F.ceil(n * NUMERATOR / DENOMINATOR) + 1
    return F.when(n <= K * NUMERATOR // DENOMINATOR, whole).otherwise(k - SHARED + 1).cast("int")


def similar(sets: list[np.ndarray], left: range, right: range):
    """Index pairs (one of left, one of right) of similarity NUMERATOR / DENOMINATOR or more, compared in full."""
    index = sorted({*left, *right})
    joined = np.concatenate([sets[i] for i in index])
    values, where = np.unique(joined, return_inverse=True)
    owner = np.repeat(np.arange(len(index)), [len(sets[i]) for i in index])
    shared = np.bincount(where)[where] > 1  # the others meet nothing
    _, column = np.unique(where[shared], return_inverse=True)
    row = owner[shared]
    size = np.array([len(sets[i]) for i in index])
    place = {i: k for k, i in enumerate(index)}
    a, b = np.array([place[i] for i in left]), np.array([place[i] for i in right])
    total = np.zeros((len(a), len(b)), np.float32)
    width, wide = 4096, int(column.max(initial=-1)) + 1
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    for start in range(0, wide, width):
        x, y = np.searchsorted(column, [start, start + width])
        m = np.zeros((len(index), min(width, wide - start)), np.float32)
        m[row[x:y], column[x:y] - start] = 1
        total += m[a] @ m[b].T
    union = size[a][:, None] + size[b][None, :] - total
    i, j = np.nonzero((DENOMINATOR * total >= NUMERATOR * union) & (union > 0))
    return np.array(left)[i], np.array(right)[j]


def forest(n: int, pairs) -> list[tuple[int, int]]:
    """The pairs that join two parts not yet joined."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in pairs:
        x, y = root(int(a)), root(int(b))
        if x != y:
            parent[y] = x
            out.append((int(a), int(b)))
    return out


def _estimate(batches):
    """Keeps the pairs whose union sketch has a share of common values of ESTIMATE or more."""
    for batch in batches:
        sa, sb = batch.column(2), batch.column(3)
        keep = np.zeros(batch.num_rows, dtype=bool)
        oa, va = sa.offsets.to_numpy(), sa.values.to_numpy().view(np.uint64)
        ob, vb = sb.offsets.to_numpy(), sb.values.to_numpy().view(np.uint64)
        for i in range(batch.num_rows):
            x, y = va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]
            both = np.sort(np.concatenate([x, y]))
            twice = both[1:] == both[:-1]
            distinct = both[np.concatenate([[True], ~twice])]
            # the K smallest of the union; whole sets give the exact share
            last = distinct[min(K, len(distinct)) - 1]
            keep[i] = np.count_nonzero(twice & (both[1:] <= last)) >= ESTIMATE * min(K, len(distinct))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))


def _verify(batches):
    for batch in batches:
        x, y = buffers_of(batch.column(2)), buffers_of(batch.column(3))
        keep = np.zeros(batch.num_rows, dtype=bool)
        sizes = np.concatenate([[0], np.cumsum(np.diff(x[0]) + np.diff(y[0]))])
        for a, b in pieces(sizes):
            with np.errstate(over="ignore"):
                (bx, vx), (by, vy) = (shingle_sets(o[a : b + 1] - o[a], d[o[a] : o[b]]) for o, d in (x, y))
            for i in range(b - a):
                s, t = vx[bx[i] : bx[i + 1]], vy[by[i] : by[i + 1]]
                common = len(np.intersect1d(s, t, assume_unique=True))
                union = len(s) + len(t) - common
                keep[a + i] = union > 0 and DENOMINATOR * common >= NUMERATOR * union
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))


def _compare_blocks(table: pa.Table) -> pa.Table:
    """One pair of blocks (or a block with itself): a spanning forest of its links across components."""
    ids, comp, side = table.column("rep").to_pylist(), table.column("comp").to_pylist(), np.array(table.column("side").to_pylist())
    offsets, data = buffers_of(table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string()))
    sets = []
    with np.errstate(over="ignore"):
        for a, b in pieces(offsets):
            bounds, values = shingle_sets(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
            sets += [values[bounds[i] : bounds[i + 1]] for i in range(b - a)]
    left = [int(i) for i in np.flatnonzero(side == 0)]
    right = [int(i) for i in np.flatnonzero(side == 1)] or left
    i, j = similar(sets, left, right) if left else ([], [])
    found = forest(len(ids), ((x, y) for x, y in zip(i, j, strict=True) if comp[x] != comp[y]))
    return pa.table({"a": pa.array([ids[x] for x, _ in found], pa.int64()), "b": pa.array([ids[y] for _, y in found], pa.int64())})


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """rep, comp (the smallest id reachable) of every id in a link (a, b).

    Each round hangs every node below the smallest among its neighbours' parents and shortens the paths by a jump.
    Grouping by node is pre-aggregated, so a hub costs a row a task.
    """
    both = tables.put(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    label = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("rep"), F.least("u", "v").alias("comp"))
    while True:
        seen = both.join(label, both.v == label.rep).groupBy("u").agg(F.min("comp").alias("near"))
        better = label.join(seen, label.rep == seen.u).select("rep", "comp", F.least("comp", "near").alias("next"))
        # an old parent learns what its children have found
        told = better.groupBy("comp").agg(F.min("next").alias("told")).withColumnRenamed("comp", "parent")
        held = tables.put(better.join(told, better.rep == told.parent, "left").select("rep", F.col("comp").alias("old"), F.least("next", "told").alias("next")))
        jump = held.select(F.col("rep").alias("up"), F.col("next").alias("top"))
        new = tables.put(held.join(jump, held.next == jump.up).select("rep", F.col("top").alias("comp"), (F.col("top") != F.col("old")).alias("changed")))
        tables.drop(held)
        if not new.where("changed").limit(1).count():
            tables.drop(both)
            return new.select("rep", "comp")
        label = new.select("rep", "comp")


def near_duplicates(docs: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id, kept. base: the sketches of docs, or of some of them, if they are at hand."""
    tables = Tables(docs.sparkSession, "near-duplicates")
    base = tables.put(sketches(docs) if base is None else base)
    classes = base.where("n > 0 and doc_id is not null").groupBy("m1", "m2").agg(F.min_by(F.struct("doc_id", "n", "sketch"), "doc_id").alias("s"))
    rep = tables.put(classes.select(F.col("s.doc_id").alias("rep"), F.col("s.n").alias("n"), F.col("s.sketch").alias("sketch"), "m1", "m2"))

    posting = rep.select("rep", "m1", "n", F.explode("sketch").alias("value"))
    often = posting.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    by_rarity = F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "value")))
    ranked = posting.join(often, "value", "left").groupBy("rep", "m1").agg(F.max("n").alias("n"), by_rarity.alias("values"))
    entry = F.filter(F.slice("values", F.lit(1), prefix_length(F.col("n"))), lambda v: v["df"] > 1)
    lists = tables.put(ranked.select("rep", F.explode(entry).alias("v")).select("rep", F.col("v.value").alias("value")))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null and text is not null")

    def checked(pairs: DataFrame) -> DataFrame:
        s, t = rep.select(F.col("rep").alias("id"), "sketch"), texts
        side = lambda df, k: df.withColumnsRenamed({"id": k, df.columns[1]: f"{k}_"})
        both = pairs.join(side(s, "a"), "a").join(side(s, "b"), "b").select("a", "b", "a_", "b_")
        likely = tables.put(both.mapInArrow(_estimate, "a long, b long").distinct())
        return tables.put(likely.join(side(t, "a"), "a").join(side(t, "b"), "b").select("a", "b", "a_", "b_").mapInArrow(_verify, "a long, b long").distinct())

    head = lists.groupBy("value").agg(F.min("rep").alias("a"), F.count("*").alias("rows")).where("rows > 1")
    star = tables.put(lists.join(head, "value").where("rep != a").select("a", F.col("rep").alias("b")).distinct())
    links = checked(star)
    first = components(links, tables)

    placed = lists.join(first, "rep", "left").select("value", "rep", F.coalesce("comp", "rep").alias("comp"))
    spread = placed.groupBy("value").agg(F.count("*").alias("rows"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("rep").alias("head")).where("lo != hi")
    rest = tables.put(placed.join(spread.select("value", "rows", "head"), "value"))
    short = rest.where(F.col("rows") <= LONG).groupBy("value").agg(F.collect_list(F.struct("rep", "comp")).alias("m")).select(F.explode("m").alias("x"), "m")
    partners = F.filter("m", lambda y: (y["rep"] > F.col("x.rep")) & (y["comp"] != F.col("x.comp")))
    across = short.select(F.col("x.rep").alias("a"), F.explode(partners).alias("y")).select("a", F.col("y.rep").alias("b")).distinct()
    more = checked(across.join(star, ["a", "b"], "left_anti"))

    # Long lists go by their head: two documents that share a long list share its head.
    blocks = tables.put(blocks_of(rest.where(F.col("rows") > LONG).select("head", "rep", "comp").distinct().join(rep.groupBy("rep").agg(F.sum("n").alias("n")), "rep")))
    tables.drop(rest, star)
    spans = blocks.groupBy("head", "block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    x, y = spans.alias("x"), spans.alias("y")
    several = (F.col("x.lo") != F.col("x.hi")) | (F.col("y.lo") != F.col("y.hi")) | (F.col("x.lo") != F.col("y.lo"))
    pair = x.join(y, (F.col("x.head") == F.col("y.head")) & (F.col("x.block") <= F.col("y.block"))).where(several).select("x.head", F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    sides = pair.select("head", "i", "j", F.explode(F.when(F.col("i") == F.col("j"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
    member = sides.withColumn("block", F.when(F.col("side") == 0, F.col("i")).otherwise(F.col("j"))).join(blocks, ["head", "block"]).join(texts.withColumnRenamed("id", "rep"), "rep")
    dense = tables.put(member.select("head", "i", "j", "side", "rep", "comp", "text").groupBy("head", "i", "j").applyInArrow(_compare_blocks, "a long, b long"))

    label = components(links.unionByName(more).unionByName(dense), tables)
    named = rep.join(label, "rep", "left").select("m1", "m2", F.coalesce("comp", "rep").alias("class_id"))
    out = base.select("doc_id", "n", "m1", "m2").join(named, ["m1", "m2"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def blocks_of(family: DataFrame) -> DataFrame:
    """Adds `block`: about BLOCK documents and BLOCK_SHINGLES shingles each at most. A component that fills blocks has its
    own; the small ones are dealt together. family: head, rep, comp, n."""
    fill = F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)
    size = family.groupBy("head", "comp").agg(fill.alias("fill"))
    small = size.where(F.col("fill") < 1).groupBy("head").agg(F.sum("fill").alias("small"))
    sized = family.join(size.join(small, "head", "left"), ["head", "comp"])
    large = F.col("fill") >= 1
    parts = F.ceil(F.when(large, F.col("fill")).otherwise(F.col("small")))
    block = F.xxhash64(F.when(large, F.col("comp")).otherwise(F.lit(-1)), F.pmod(F.xxhash64("rep"), parts))
    return sized.select("head", "rep", "comp", block.alias("block"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The kept document of each group, with its columns.

    Of rows that repeat an id the one with the smallest hash stays. An id that stands for different sets names no one
    document: its rows stay, one of each text, as do rows without an id. So a text goes only where a linked one stays.
    """
    tables = Tables(docs.sparkSession, "one-of-each")
    base = tables.put(sketches(docs))
    differ = [F.min(c) != F.max(c) for c in ("n", "m1", "m2")]
    shared = tables.put(base.where("doc_id is not null").groupBy("doc_id").agg((differ[0] | differ[1] | differ[2]).alias("shared")).where("shared").select("doc_id"))
    some = bool(shared.head(1))
    out = near_duplicates(docs, base.join(shared, "doc_id", "left_anti") if some else base)
    kept = out.where("kept and doc_id is not null").select("doc_id").distinct()

    whole = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, MapType)])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text", F.col("text").isNull()).alias("t"), whole.alias("mark"))
    narrow = rows.select("doc_id", "t", "mark")
    first = F.min("mark").alias("mark")
    wanted = narrow.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(first)
    wanted = wanted.unionByName(narrow.where("doc_id is null").groupBy("doc_id", "t").agg(first).drop("t"))
    if some:
        wanted = wanted.unionByName(narrow.join(shared, "doc_id", "left_semi").groupBy("doc_id", "t").agg(first).drop("t"))
    wanted = tables.put(wanted).select(F.col("doc_id").alias("id"), F.col("mark").alias("m"))
    met = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("m")), "left_semi")
    return met.dropDuplicates(["doc_id", "mark"]).select("row.*")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
