"""Sharding by balanced label propagation, with built-in functions only.

Links. Documents of equal text are linked with each other, and a table of links between documents may come besides.
Documents of one text that start in one shard see the same neighbours and move together: they are a unit (group of equal
texts, shard it started in, rows), SHARDS of a group at most; a text that has given links and fits a shard is one unit.
The link table is between units: all units of a text
with each other (weighing as many as the neighbour has rows), and those of given links (weighing how many there are).

Rounds. Every unit starts in a shard by hash. A round joins the link table with the shards that the neighbours are in,
adds up the votes for each unit and shard, and lets units that would cut fewer links move to the shard with the most
votes, of those with room if there are such. Quotas hold: between two shards as many rows move one way as the other way,
and beyond that as many as there is room; the largest gains go first (prefix sums within pairs of shards, in two passes,
so no task gets all wishes). By turns half of the units may move, so that neighbours don't swap places. Rounds end when
hardly any move.

Then sizes are made equal (the law `rows`: counts at most one apart). Groups that fit a shard and are still split are
placed anew as a whole, the largest first, in the room that they and a share of the other groups give up; so at most one
group a border between shards stays split, where no shard has room for it. Documents without a link fill all shards up.
cut_edges() counts what a state cuts.

At the end each group's counts become ranges of ranks; a document's rank is its place within (group, cell), where a
cell is one of CELLS hash parts, so a group with a third of all rows is CELLS windows.

Cases: a null text has size 1 and no link but with rows of the same id and no text; an empty text has size 1 and is
linked with other empty ones; long texts are read as their hashes only; links of ids that no document has, or of a
document with itself, count for nothing; of equal votes the lower shard wins; repeated rows each have a slot; an empty
table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tables, documents

SHARDS = 16
CELLS = 1024
ROUNDS = 12
FEW = 0.005  # of all linked rows moved in two rounds: enough
PARTS = 1024
SWAPPED = 8
SEED = 5


def narrow(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, g1 and g2 (a 128-bit mark of the text), cell."""
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    own = F.struct(F.lit("none"), F.col("doc_id"))
    mark = lambda seed: F.when(F.col("text").isNull(), F.xxhash64(F.lit(seed), own)).otherwise(F.xxhash64(F.lit(seed), "text", F.length("text")))
    return d.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        mark(1).alias("g1"),
        mark(2).alias("g2"),
        F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(CELLS)).cast("int").alias("cell"),
    )


def ahead(rows: DataFrame, by: list[str], part: Column, order: list[Column], amount: str) -> DataFrame:
    """Adds `before`, the sum of amount ahead within `by`: by part, then by order. part has a bounded number of values (CELLS at most)."""
    keyed = rows.withColumn("__p", part)
    below = lambda keys, o: Window.partitionBy(*keys).orderBy(*o).rowsBetween(Window.unboundedPreceding, -1)
    totals = keyed.groupBy(*by, "__p").agg(F.sum(amount).alias("__t"))
    offsets = totals.select(*by, "__p", F.coalesce(F.sum("__t").over(below(by, ["__p"])), F.lit(0)).alias("__o"))
    inner = keyed.withColumn("__w", F.coalesce(F.sum(amount).over(below([*by, "__p"], order)), F.lit(0)))
    # the offsets are at most CELLS rows for each value of `by`, which is a shard or a constant
    return inner.join(F.broadcast(offsets), [*by, "__p"]).withColumn("before", F.col("__w") + F.col("__o")).drop("__p", "__w", "__o")


UNIT = ["g1", "g2", "k"]


def unit_links(units: DataFrame, base: DataFrame, shards: int, links: DataFrame | None) -> DataFrame:
    """The link table: g1, g2, k of a unit, to1, to2, tok of its neighbour, weight. links: a, b (ids of documents), or none."""
    there = units.select("g1", "g2", F.col("k").alias("tok"), F.col("n").alias("weight"))
    out = units.select(*UNIT).join(there, ["g1", "g2"]).where("k != tok").select(*UNIT, F.col("g1").alias("to1"), F.col("g2").alias("to2"), "tok", "weight")
    if links is None:
        return out
    pairs = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a != b")
    pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    k = F.when(F.col("whole"), F.lit(0)).otherwise(F.col("cell") % shards).alias("k")
    whole = units.where("whole").select("g1", "g2", "whole").distinct()
    of = base.join(whole, ["g1", "g2"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "g1", "g2", k).distinct()
    near = pairs.join(of.withColumnRenamed("doc_id", "a"), "a")
    far = of.select(F.col("doc_id").alias("b"), F.col("g1").alias("to1"), F.col("g2").alias("to2"), F.col("k").alias("tok"))
    given = near.join(far, "b").where("g1 != to1 or g2 != to2").groupBy(*UNIT, "to1", "to2", "tok").agg(F.count("*").alias("weight"))
    return out.unionByName(given)


def cut_edges(links: DataFrame, units: DataFrame) -> int:
    """The weight of links between different shards, each counted from both ends. units: g1, g2, k, shard."""
    there = units.select(F.col("g1").alias("to1"), F.col("g2").alias("to2"), F.col("k").alias("tok"), F.col("shard").alias("to"))
    both = links.join(units.select(*UNIT, "shard"), UNIT).join(there, ["to1", "to2", "tok"])
    return both.where(F.col("shard") != F.col("to")).agg(F.sum("weight")).head()[0] or 0


def _allowed(flow: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """Rows that may go from one shard to another: as many as come back, and a share of the room there."""
    out = {(s, t): min(n, flow.get((t, s), 0)) for (s, t), n in flow.items()}
    for t, free in enumerate(room):
        more = {s: flow[s, u] - out[s, u] for s, u in flow if u == t}
        for s, n in more.items():
            out[s, t] += min(n, free * n // max(1, sum(more.values())))
    return out


def propagate(units: DataFrame, links: DataFrame, quotas: list[int], tables: Tables, rounds: int = ROUNDS) -> DataFrame:
    """units: g1, g2, k, n, shard. The same after the rounds; no shard gets more rows than its quota but by its own start."""
    units = units.withColumn("moved", F.lit(0).cast("long"))
    before = 0  # rows moved in the round before; in two rounds every unit has its turn
    for r in range(rounds + 1):
        state = units.groupBy("shard").agg(F.sum("n").alias("n"), F.sum("moved").alias("moved")).collect()  # a row a shard
        used, moved = {x["shard"]: x["n"] for x in state}, sum(x["moved"] for x in state)
        if r == rounds or not used or r and r % 2 == 0 and before + moved <= FEW * sum(used.values()):
            break
        before = moved
        room = [max(0, q - used.get(s, 0)) for s, q in enumerate(quotas)]
        there = units.select(F.col("g1").alias("to1"), F.col("g2").alias("to2"), F.col("k").alias("tok"), F.col("shard").alias("to"))
        votes = links.join(there, ["to1", "to2", "tok"]).groupBy(*UNIT, "to").agg(F.sum("weight").alias("v"))
        free = F.element_at(F.lit(room).cast("array<bigint>"), F.col("to") + 1)
        turn = F.pmod(F.xxhash64(F.lit(r // 2), *UNIT), F.lit(2)) == r % 2
        best = F.max(F.when(F.col("to") != F.col("shard"), F.struct((free >= F.col("n")).alias("fits"), "v", (-F.col("to")).alias("to")))).alias("best")
        own = F.sum(F.when(F.col("to") == F.col("shard"), F.col("v")).otherwise(0)).alias("own")
        wish = votes.join(units.where(turn).drop("moved"), UNIT).groupBy(*UNIT, "shard", "n").agg(best, own).where(F.col("best.v") > F.col("own"))
        wish = tables.put(wish.select(*UNIT, "shard", "n", (-F.col("best.to")).alias("to"), (F.col("best.v") - F.col("own")).alias("gain")))
        flow = {(x["shard"], x["to"]): x["n"] for x in wish.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}  # a row a pair of shards
        most = _allowed(flow, room)
        bounds = [most.get((s, t), 0) for s in range(len(quotas)) for t in range(len(quotas))]
        bound = F.element_at(F.lit(bounds).cast("array<bigint>"), F.col("shard") * len(quotas) + F.col("to") + 1)
        # the largest gains first: 64 classes of them, each in 16 parts
        part = (63 - F.least(F.floor(F.log2(F.col("gain").cast("double")) * 2), F.lit(63))) * 16 + F.pmod(F.xxhash64(*UNIT), F.lit(16))
        going = ahead(wish, ["shard", "to"], part, UNIT, "n").where(F.col("before") + F.col("n") <= bound).select(*UNIT, "to")
        new = units.join(going, UNIT, "left").select(*UNIT, "n", F.coalesce("to", "shard").alias("shard"), F.when(F.col("to").isNotNull(), F.col("n")).otherwise(0).alias("moved"))
        new = tables.put(new)
        tables.drop(wish, *([units] if hasattr(units, "_table_path") else []))
        units = new
    return units.drop("moved")


def _less(room: list[int], rows: DataFrame) -> list[int]:
    """room of the shards without what rows (shard, n) take."""
    taken = {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [max(0, x - taken.get(s, 0)) for s, x in enumerate(room)]


def _laid(pool: DataFrame, room: list[int], part: Column) -> DataFrame:
    """Adds `share`: the shards and counts that a group gets when the pool in a row, by part, fills the room of the shards."""
    bounds = [0]
    for x in room:
        bounds.append(bounds[-1] + x)
    spans = F.array(*[F.struct(F.lit(s).cast("long").alias("shard"), F.lit(bounds[s]).cast("long").alias("lo"), F.lit(bounds[s + 1]).cast("long").alias("hi")) for s in range(len(room))])
    placed = ahead(pool.withColumn("all", F.lit(0)), ["all"], part, ["g1", "g2"], "n")
    share = F.transform(spans, lambda s: F.struct(s["shard"].alias("shard"), (F.least(s["hi"], F.col("before") + F.col("n")) - F.greatest(s["lo"], F.col("before"))).alias("n")))
    return placed.select("g1", "g2", "n", F.filter(share, lambda s: s["n"] > 0).alias("share"))


def shard(docs: DataFrame, shards: int = SHARDS, links: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard. links: a, b (ids of documents that belong together)."""
    tables = Tables(docs.sparkSession, "sharding")
    base = tables.put(narrow(docs))
    fine = tables.put(base.groupBy("g1", "g2", "cell").agg(F.count("*").alias("n")))
    total = fine.agg(F.sum("n")).head()[0] or 0
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    groups = fine.groupBy("g1", "g2").agg(F.sum("n").alias("rows"))
    groups = groups.withColumn("tied", F.lit(False))
    start = fine.groupBy("g1", "g2", (F.col("cell") % shards).alias("k")).agg(F.sum("n").alias("n"))
    if links is not None:
        ids = links.select(F.col("a").cast("long").alias("doc_id")).unionByName(links.select(F.col("b").cast("long").alias("doc_id"))).distinct()
        tied = base.withColumn("doc_id", F.col("doc_id").cast("long")).join(ids, "doc_id", "left_semi").select("g1", "g2", F.lit(True).alias("t")).distinct()
        groups = tables.put(groups.drop("tied").join(tied, ["g1", "g2"], "left").select("g1", "g2", "rows", F.coalesce("t", F.lit(False)).alias("tied")))
    whole = (F.col("tied") & (F.col("rows") <= max(1, *quotas))).alias("whole")
    units = start.join(groups.where("rows > 1 or tied").select("g1", "g2", whole), ["g1", "g2"])
    one = units.where("whole").groupBy("g1", "g2").agg(F.sum("n").alias("n")).select("g1", "g2", F.lit(0).alias("k"), "n", F.pmod(F.xxhash64("g1", "g2"), F.lit(shards)).cast("int").alias("shard"), F.lit(True).alias("whole"))
    units = tables.put(units.where("not whole").select("g1", "g2", "k", "n", F.col("k").alias("shard"), "whole").unionByName(one))
    table = tables.put(unit_links(units, base, shards, links))
    settled = propagate(units, table, quotas, tables).groupBy("g1", "g2", "shard").agg(F.sum("n").alias("n"))
    settled = tables.put(settled)
    # what a shard holds beyond its quota goes back to the pool, the smallest cells first
    over = ahead(settled, ["shard"], F.least(F.floor(F.log2(F.col("n").cast("double"))), F.lit(39)) * 4 + F.pmod(F.xxhash64("g1"), F.lit(4)), ["n", "g1", "g2"], "n")
    used = {r["shard"]: r["n"] for r in settled.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    excess = F.element_at(F.array(*[F.lit(max(0, used.get(s, 0) - q)).cast("long") for s, q in enumerate(quotas)]), F.col("shard") + 1)
    split = tables.put(over.withColumn("back", F.greatest(F.lit(0), F.least(F.col("n"), excess - F.col("before")))))
    # a group that fits a shard and lies in several places goes to the pool whole; so that there is room to swap, so does one of SWAPPED others
    each = Window.partitionBy("g1", "g2")
    places = F.sum((F.col("n") > F.col("back")).cast("int")).over(each) + F.when(F.sum("back").over(each) > 0, 1).otherwise(0)
    fits = split.join(groups, ["g1", "g2"]).withColumn("fits", F.col("rows") <= max(1, *quotas)).withColumn("loose", F.col("fits") & (places > 1))
    fits = tables.put(fits)
    swaps = F.col("fits") & ~F.col("tied") & (F.pmod(F.xxhash64("g1", "g2"), F.lit(SWAPPED)) == 0) if fits.where("loose").head(1) else F.lit(False)
    freed = fits.withColumn("back", F.when(F.col("loose") | swaps, F.col("n")).otherwise(F.col("back")))
    stay = tables.put(freed.select("g1", "g2", "shard", (F.col("n") - F.col("back")).alias("n")).where("n > 0"))
    pool = tables.put(freed.groupBy("g1", "g2").agg(F.sum("back").alias("n")).where("n > 0"))
    room = _less(quotas, stay)
    # linked rows of the pool, the largest groups first, fill what each shard lacks; a group on a border goes where it fits whole, if it does anywhere
    laid = tables.put(_laid(pool, room, (39 - F.least(F.floor(F.log2(F.col("n").cast("double"))), F.lit(39))) * 16 + F.pmod(F.xxhash64("g1"), F.lit(16))))
    whole = laid.where(F.size("share") == 1).select("g1", "g2", F.inline("share"))
    room, rest = _less(room, whole), []
    for r in sorted(laid.where(F.size("share") > 1).select("g1", "g2", "n").collect(), key=lambda r: (-r["n"], r["g1"], r["g2"])):  # one a border at most
        n = r["n"]
        while n:
            able = [s for s in range(shards) if room[s] >= n]
            to = min(able, key=lambda s: room[s]) if able else max(range(shards), key=lambda s: room[s])
            m = min(n, room[to])
            rest.append(F.struct(F.lit(r["g1"]).cast("long").alias("g1"), F.lit(r["g2"]).cast("long").alias("g2"), F.lit(to).cast("long").alias("shard"), F.lit(m).cast("long").alias("n")))
            room[to], n = room[to] - m, n - m
    filled = whole.unionByName(docs.sparkSession.range(1).select(F.inline(F.array(*rest)))) if rest else whole
    # then documents without a copy
    single = _laid(groups.where("rows = 1 and not tied").select("g1", "g2", F.col("rows").alias("n")), room, F.pmod(F.xxhash64("g1", "g2"), F.lit(CELLS)))
    filled = filled.unionByName(single.select("g1", "g2", F.inline("share")))
    final = tables.put(stay.unionByName(filled).groupBy("g1", "g2", "shard").agg(F.sum("n").alias("n")))

    # ranges of ranks: of a group's cells, and of its shards; SHARDS and CELLS rows a group at most
    run = Window.partitionBy("g1", "g2").orderBy("shard")
    ranges = final.withColumn("hi", F.sum("n").over(run)).groupBy("g1", "g2").agg(F.array_sort(F.collect_list(F.struct("hi", "shard"))).alias("ranges"))
    cells = fine.withColumn("lo", F.sum("n").over(Window.partitionBy("g1", "g2").orderBy("cell")) - F.col("n")).join(ranges, ["g1", "g2"]).drop("n")
    place = F.row_number().over(Window.partitionBy("g1", "g2", "cell").orderBy("doc_id")) - 1
    ranked = base.withColumn("place", place).join(cells, ["g1", "g2", "cell"])
    rank = F.col("lo") + F.col("place")
    home = F.element_at(F.filter("ranges", lambda r: r["hi"] > rank), 1)["shard"]
    out = tables.put(ranked.select("doc_id", "size", "text_crc32", home.cast("int").alias("shard"), "cell"))
    slots = ahead(out.withColumn("one", F.lit(1).cast("long")), ["shard"], F.col("cell"), ["doc_id", "text_crc32"], "one")
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("before").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))
