"""Quality rules: statistics of each text and a learned decision list, with built-in functions only.

The list is learned by sequential covering. A rule is a conjunction of thresholds on interpretable statistics. It is
grown on two thirds of the labelled rows by FOIL gain, pruned on the other third, and accepted if it is precise there;
the rows it covers are then set aside and the next rule is grown. Each growing step is one aggregate of the labelled
rows to a histogram per statistic (statistics x bins x 2 rows come to the driver, whatever the input). The result is an
ordered Spark conditional expression.

Cases: a null text counts as empty; empty texts have no words and fail the base rule; one long text is one row of
arrays, sorted in n log n; repeated rows each get the same verdict; without labels the list is empty and only the base
rule decides; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, BLANK_CHARS, Tables, documents, let, words_of

BINS = 32
MAX_RULES = 8
MAX_CONDITIONS = 4
MIN_SUPPORT = 5
MIN_PRECISION = 0.97

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text."""

    def covered(h: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: F.get(s, i - 1)["h"].eqNullSafe(x["h"]) | F.get(s, i + 1)["h"].eqNullSafe(x["h"]))
            starts = F.array_sort(F.transform(twice, lambda x: x["p"]))
            none = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("total"))
            step = lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(3), p - a["last"])).alias("total"))
            return F.aggregate(starts, none, step, lambda a: a["total"])

        by_hash = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(by_hash, of_sorted))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(windows, covered))


def text_statistics(text: Column) -> Column:
    """A struct of COUNTS of the whole text (null: empty)."""
    t = F.coalesce(text, F.lit(""))
    full = F.filter(F.split(t, "\n"), lambda line: F.btrim(line, F.lit(BLANK_CHARS)) != "")
    lines = let(full, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    words = let(words_of(t), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("rep")))
    return let(
        F.struct(words.alias("w"), lines.alias("l")),
        lambda s: F.struct(
            s["w"]["n"].cast("long").alias("n_words"),
            (F.length(t) - F.regexp_count(t, F.lit(BLANK))).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            s["l"]["dup"].cast("long").alias("n_dup_lines"),
            s["w"]["rep"].cast("long").alias("n_repeat_words"),
            s["l"]["n"].cast("long").alias("n_lines"),
            F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
            F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s]")).cast("long").alias("n_marks"),
        ),
    )


def base_failed(s) -> Column:
    """s: a struct of COUNTS, or anything that gives a column by name."""
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def features(s) -> dict[str, Column]:
    """What thresholds are set on: sizes and shares; 0 where a text has no words."""
    share = lambda a, b: F.when(s[b] > 0, s[a] / s[b]).otherwise(F.lit(0.0))
    return {
        "words": s["n_words"].cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "duplicate_line_share": share("n_dup_lines", "n_lines"),
        "repeated_word_share": share("n_repeat_words", "n_words"),
        "words_per_line": share("n_words", "n_lines"),
        "upper_share": share("n_upper", "word_chars"),
        "mark_share": share("n_marks", "word_chars"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, f: dict[str, Column]) -> Column:
        return f[self.feature] > self.threshold if self.above else f[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Ordered rules; the first that holds rejects, a text under none is kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def rule_number(self, f: dict[str, Column]) -> Column:
        """From 1, of the first rule that holds; 0 if none."""
        out = F.lit(0)
        for n, rule in reversed(list(enumerate(self.rules, 1))):
            holds = F.lit(True)
            for c in rule:
                holds = holds & c.column(f)
            out = F.when(holds, F.lit(n)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join(f"if {' and '.join(map(str, r))}: reject" for r in self.rules) + "\nelse: keep"


def labels_of(labels: DataFrame) -> DataFrame:
    """One label a document; of contradicting ones the higher, so that doubt keeps."""
    good = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    return good.groupBy("doc_id").agg(F.max("quality").alias("quality"))


def fit(stats: DataFrame, labels: DataFrame, tables: Tables) -> DecisionList:
    """stats: doc_id and COUNTS. Learns from every labelled row."""
    f = features({c: F.col(c) for c in COUNTS})
    joined = stats.select("doc_id", *[v.alias(k) for k, v in f.items()]).join(labels_of(labels), "doc_id")
    rows = tables.put(joined)
    at = [i / BINS for i in range(1, BINS)]
    cuts_row = rows.agg(*[F.percentile_approx(k, at, 10000).alias(k) for k in f]).head()
    cuts = {k: sorted(set(cuts_row[k] or [])) for k in f}
    names = [k for k in f if cuts[k]]
    if not names:
        tables.drop(rows)
        return DecisionList()
    bin_of = lambda k: F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts[k]]), lambda c: c < F.col(k)))
    binned = tables.put(rows.select((F.col("quality") == 0).alias("bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune"), *[bin_of(k).alias(k) for k in names]))
    as_bins = lambda rule: [F.col(c.feature) > cuts[c.feature].index(c.threshold) if c.above else F.col(c.feature) <= cuts[c.feature].index(c.threshold) for c in rule]

    def all_of(columns: list[Column]) -> Column:
        out = F.lit(True)
        for c in columns:
            out = out & c
        return out

    def grow(left: DataFrame) -> list[Condition]:
        rule: list[Condition] = []
        while len(rule) < MAX_CONDITIONS:
            here = left.where(all_of(as_bins(rule)))
            each = here.select("bad", F.posexplode(F.array(*[F.col(k) for k in names])).alias("f", "bin"))
            counts: dict[tuple[int, bool], list[int]] = {(i, b): [0] * (BINS + 1) for i in range(len(names)) for b in (True, False)}
            for r in each.groupBy("f", "bin", "bad").count().collect():
                counts[r["f"], r["bad"]][r["bin"]] += r["count"]
            p0, n0 = sum(counts[0, True]), sum(counts[0, False])
            if p0 < MIN_SUPPORT or n0 == 0:
                break
            best, gain = None, 1e-9
            for i, k in enumerate(names):
                p, n = 0, 0
                for j, cut in enumerate(cuts[k]):
                    p, n = p + counts[i, True][j], n + counts[i, False][j]
                    for above, a, b in ((False, p, n), (True, p0 - p, n0 - n)):
                        if a >= MIN_SUPPORT and (g := a * (math.log2(a / (a + b)) - math.log2(p0 / (p0 + n0)))) > gain:
                            best, gain = Condition(k, above, cut), g
            if best is None:
                break
            rule.append(best)
        return rule

    rules, left = [], binned
    while len(rules) < MAX_RULES:
        rule = grow(left.where(~F.col("prune")))
        if not rule:
            break
        holds = [all_of(as_bins(rule[: n + 1])) for n in range(len(rule))]
        count = left.where("prune").agg(*[F.count_if(h & (F.col("bad") if bad else ~F.col("bad"))).alias(f"{'p' if bad else 'n'}{i}") for i, h in enumerate(holds) for bad in (True, False)]).head()
        worth = [((count[f"p{i}"] - count[f"n{i}"]) / max(1, count[f"p{i}"] + count[f"n{i}"]), -i) for i in range(len(rule))]
        i = -max(worth)[1]
        p, n = count[f"p{i}"], count[f"n{i}"]
        if p == 0 or p < MIN_PRECISION * (p + n):
            break
        rules.append(rule[: i + 1])
        left = left.where(~all_of(as_bins(rules[-1])))
    tables.drop(rows, binned)
    return DecisionList(rules)


def statistics(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_statistics(F.col("text")).alias("s")).select("doc_id", "s.*")


def quality_rules(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DecisionList]:
    """Per document: doc_id, COUNTS, base_failed, rule (number of the rejecting one, 0 if none), kept; and the list."""
    tables = Tables(docs.sparkSession, "quality-rules")
    stats = tables.put(statistics(docs))
    rules = fit(stats, labels, tables)
    s = {c: F.col(c) for c in COUNTS}
    out = stats.withColumns({"base_failed": base_failed(s), "rule": rules.rule_number(features(s))})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)), rules


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their columns; learned from those of them that have labels.

    Statistics are computed once and written beside the row, so the filter reads rows where they lie and shuffles none.
    A null or empty text fails the base rule and goes; repeated rows stay or go together; labels that contradict each
    other count as the higher, so that doubt keeps.
    """
    tables = Tables(docs.sparkSession, "quality-rules")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    each = tables.put(docs.select(row, F.col("doc_id"), text_statistics(F.col("text")).alias("s")))
    rules = fit(each.select("doc_id", "s.*"), labels, tables)
    s = F.col("s")
    return each.where(~base_failed(s) & (rules.rule_number(features(s)) == 0)).select("row.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
