"""Mixing sources to target weights, with built-in functions only.

A source's weight is its token share to the power alpha, normalised. alpha is bisected, from 1 (as it is) down to 0
(all alike), until the entropy of the weights reaches a target, or until no source is repeated more often than a limit.
The budget of tokens is by default the least that takes every source once in full: then no document is dropped, the
source with the least weight for its size is taken once, and the others are repeated.

Realisation: every source's documents are dealt by hash into the same number of blocks, so many that a block of the
largest source has about BLOCK_TOKENS. In each epoch a source's blocks come in an order of their own. All epochs but
the last are taken whole; of the last, as many blocks in its order as come nearest to what the budget leaves. The
blocks' offsets are prefix sums in two passes, over ranges of the permuting hash, so that no task gets a whole source.

Shares stay in a table; each round of the bisection is one aggregate of it with one row of result.

Cases: a null or empty text has no tokens and is taken as its block is; a null source is a source; with no tokens at all
every document is taken once; repeated rows are taken each; an empty table gives an empty one; of other columns none is
read, and mixed() carries the row as one struct, so that none clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANK, Tables, documents

MAX_REPEATS = 2.0
BLOCK_TOKENS = 100_000
LEAST_BLOCKS = 64
BROADCAST_ROWS = 100_000  # of the block table, about 60 bytes each
SEED = 17
ROUNDS, POINTS = 10, 15  # each round halves the interval four times


def n_tokens(text: Column) -> Column:
    """Words of the text: runs of anything but blanks."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(BLANK.replace("[", "[^") + "+")).cast("long")


def exponent(sources: DataFrame, entropy: float | None, max_repeats: float | None) -> float:
    """The largest exponent up to 1 that meets the target: an entropy (share of the largest possible) or a repetition limit.

    Lower exponents level the weights: entropy rises and the repetition of small sources with it. So for an entropy the
    largest that reaches it is sought, for a limit the smallest that keeps it.
    """
    s = sources.where("tokens > 0")
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        points = [low + (high - low) * (i + 1) / (POINTS + 1) for i in range(POINTS)]
        log = F.ln(F.col("share"))
        if entropy is not None:
            # H = ln(sum p^a) - a * sum(p^a ln p) / sum(p^a)
            each = [x for i, a in enumerate(points) for x in (F.sum(F.exp(log * a)).alias(f"z{i}"), F.sum(F.exp(log * a) * log).alias(f"u{i}"))]
            row = s.agg(F.count("*").alias("n"), *each).selectExpr(*[f"ln(z{i}) - {a!r} * u{i} / z{i} >= {entropy!r} * ln(n) - 1e-12 AS ok{i}" for i, a in enumerate(points)]).head()
            good = [bool(row[f"ok{i}"]) for i in range(POINTS)]  # true up to some exponent
            k = sum(good)
            low, high = (points[k - 1] if k else low), (points[k] if k < POINTS else high)
        else:
            # taken once: the source with the largest share; repeats of the smallest are (largest / smallest) ^ (1 - a)
            row = s.agg((F.max(log) - F.min(log)).alias("ratio")).selectExpr(*[f"exp(ratio * (1 - {a!r})) <= {max_repeats!r} + 1e-12 AS ok{i}" for i, a in enumerate(points)]).head()
            good = [bool(row[f"ok{i}"]) for i in range(POINTS)]  # true from some exponent on
            k = POINTS - sum(good)
            low, high = (points[k - 1] if k else low), (points[k] if k < POINTS else high)
    return low if entropy is not None else high


def plan(docs: DataFrame, tables: Tables, entropy: float | None = None, max_repeats: float | None = MAX_REPEATS, budget: int | None = None) -> DataFrame:
    """Per source: source, tokens, share, weight, quota (tokens to take), repeats. docs: source, tokens."""
    totals = docs.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    totals = tables.put(totals)
    whole = totals.agg(F.sum("tokens")).head()[0] or 0
    sources = tables.put(totals.select("source", "tokens", (F.col("tokens") / F.lit(max(1, whole))).alias("share")))
    alpha = exponent(sources, entropy, max_repeats)
    mass = F.when(F.col("tokens") > 0, F.pow("share", F.lit(alpha))).otherwise(F.lit(0.0))
    row = sources.agg(F.sum(mass).alias("norm"), F.max(F.try_divide(F.col("tokens").cast("double"), mass)).alias("once")).head()
    norm, once = row["norm"] or 1.0, row["once"] or 0.0
    wanted = float(budget) if budget is not None else once * norm
    quota = F.round(mass / F.lit(norm) * F.lit(wanted)).cast("long")
    quota = quota if budget is not None else F.greatest(quota, F.col("tokens"))
    return sources.select(
        "source",
        "tokens",
        "share",
        (mass / F.lit(norm)).alias("weight"),
        quota.alias("quota"),
        F.when(F.col("tokens") > 0, quota / F.col("tokens")).otherwise(F.lit(1.0)).alias("repeats"),
    )


def block_of(doc_id: Column, blocks: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), doc_id.cast("string")), F.lit(blocks))


def block_plan(counted: DataFrame, sources: DataFrame, blocks: int, tables: Tables, seed: int = SEED) -> DataFrame:
    """Per source and block: source, block, taken (an array of epoch and start: the source's tokens taken before it)."""
    totals = counted.groupBy("source", block_of(F.col("doc_id"), blocks, seed).alias("block")).agg(F.sum("tokens").alias("t"))
    known = totals.alias("t").join(sources.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source"))).select("t.*", F.col("s.quota").alias("quota"), F.col("s.tokens").alias("whole"))
    full = F.when(F.col("whole") > 0, F.floor(F.col("quota") / F.col("whole"))).otherwise(F.lit(1)).cast("long")
    each = known.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), full)))
    # `part`: a range of the permuting hash, so that a window's share of a source doesn't grow with it
    order = F.pmod(F.xxhash64(F.lit(seed), "epoch", "block"), F.lit(1 << 40))
    placed = each.withColumn("order", order).withColumn("part", F.floor(F.col("order") * F.lit(max(1, blocks // 256)) / F.lit(1 << 40)))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(*by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("source", "epoch", "part").agg(F.sum("t").alias("t"))
    parts = parts.select("source", "epoch", "part", F.coalesce(F.sum("t").over(before("source", "epoch", ["part"])), F.lit(0)).alias("offset"))
    inner = placed.withColumn("w", F.coalesce(F.sum("t").over(before("source", "epoch", "part", ["order", "block"])), F.lit(0)))
    same = [F.col("a.source").eqNullSafe(F.col("b.source")), F.col("a.epoch") == F.col("b.epoch"), F.col("a.part") == F.col("b.part")]
    out = inner.alias("a").join(parts.alias("b"), same).select("a.source", "a.block", "a.epoch", "a.t", "a.quota", "a.whole", (F.col("a.epoch") * F.col("a.whole") + F.col("b.offset") + F.col("a.w")).alias("start"))
    # a block is taken if at least half of it is within the quota, and in the first epoch if it is empty
    kept = out.where((F.col("start") + F.col("t") / 2 <= F.col("quota")) & (F.col("t") > 0) | (F.col("t") == 0) & (F.col("epoch") == 0))
    return tables.put(kept.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("epoch", "start"))).alias("taken")))


def mixed(docs: DataFrame, seed: int = SEED, **targets) -> tuple[DataFrame, DataFrame]:
    """Every taken copy: row (the document's columns as a struct), epoch, block, start; and the table of sources."""
    tables = Tables(docs.sparkSession, "mixing")
    counted = tables.put(docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").cast("string").alias("source"), n_tokens(F.col("text")).alias("tokens")))
    sources = tables.put(plan(counted, tables, **targets))
    largest = sources.agg(F.max("tokens")).head()[0] or 0
    blocks = max(LEAST_BLOCKS, -(-largest // BLOCK_TOKENS))
    planned = block_plan(counted, sources, blocks, tables, seed)
    if planned.count() <= BROADCAST_ROWS:
        planned = F.broadcast(planned)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").cast("string").alias("source"), block_of(F.col("doc_id"), blocks, seed).alias("block"))
    met = row.alias("d").join(planned.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.block") == F.col("p.block")))
    return met.select("d.row", "d.block", F.inline("p.taken")), sources


def mix(docs: DataFrame, **targets) -> DataFrame:
    """The documents as mixed, with their columns: each as often as it is taken."""
    return mixed(docs, **targets)[0].select("row.*")


def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, sources = mixed(documents(spark, sf_dir).select("doc_id", "source", "text"))
    narrow = out.select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), "epoch", "block", "start")
    w = sources.select(F.col("source").alias("s"), "weight", "repeats")
    return narrow.join(w, F.col("source").eqNullSafe(F.col("s"))).drop("s")
