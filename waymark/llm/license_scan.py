"""License scans: phrases that stand consecutively, and an exact set-similarity join with notice templates.

A template is the set of words of a license notice; a text block is a run of consecutive words, a quarter (and 2) more of
them than the notice has. A block meets a template if it holds THRESHOLD of the template's words, so words scattered
over a longer stretch don't. Every block of every text is looked at.

The join finds them in two steps. Blocks lie in frames, so wide that every block is within one. A frame goes by a prefix
filter: template words are ordered by how many documents hold them, the rarest first, and a frame that holds `need` =
ceil(THRESHOLD * m) of a template's m words shares one of its first m - need + 1. The length filter asks that the frame
has `need` template words at all, the positional filter that as many can still follow in both orders. In the frames that
pass, the template's words are counted in full, and those with `need` are searched for the blocks that meet it: from each
place of a template word to the nearest place where `need` distinct ones have come. Of templates of which one has all
words of the other and more, the larger one counts where a block of it encloses the smaller one's.

One pass over the texts keeps the places of template words, everything else reads those. Templates are a parameter
(MOST_TEMPLATES at most, checked); they alone are broadcast. Keys are (row, frame), so no key is hot however common a
notice is.

Cases: a null or empty text has no words, no labels and null for the word places; long texts have as many frames as they
need; repeated rows are told apart by a row number and give repeated results; without templates only the base is found;
other columns are not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, documents, let

THRESHOLD = 0.9
MOST_TEMPLATES = 2000

# The phrases of the base and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Notices as license authors ask to word them, lower case, words only.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gnu-gpl-3", "licensed under the gnu general public license version 3"),
    ("gnu-gpl-2", "licensed under the gnu general public license version 2"),
    ("gnu-lgpl", "licensed under the gnu lesser general public license"),
    ("gnu-agpl", "licensed under the gnu affero general public license"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0"),
    ("creative-commons", "this work is licensed under a creative commons attribution international license"),
    ("cc0-1.0", "cc0 1 0 universal public domain dedication"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided"),
    ("mpl-2.0", "subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gnu-gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gnu-gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "no part of this publication may be reproduced distributed or transmitted in any form without prior written permission"),
)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]  # distinct, sorted
    need: int  # so many of them
    span: int  # within so many consecutive words


@dataclass(frozen=True)
class Templates:
    """What is looked for. of() takes pairs of label and notice."""

    each: tuple[Template, ...]
    within: tuple[tuple[int, int], ...] = field(default=())  # pairs, by place, of which the second has all words of the first and more

    @classmethod
    def of(cls, notices) -> "Templates":
        out = []
        for label, text in notices:
            words = [w for w in re.split(NOT_WORD, text.translate(LOWERED)) if w]
            if words:
                distinct = tuple(sorted(set(words)))
                out.append(Template(label, distinct, math.ceil(THRESHOLD * len(distinct)), math.ceil(1.25 * len(words)) + 2))
        if len(out) > MOST_TEMPLATES:
            raise ValueError(f"more than {MOST_TEMPLATES} templates")
        return cls(tuple(out), tuple((a, b) for a, x in enumerate(out) for b, y in enumerate(out) if set(x.words) < set(y.words)))

    @property
    def stride(self) -> int:
        """A frame begins every so many words and is twice as long, so a block of any template lies in one."""
        return max((t.span for t in self.each), default=1)

    @property
    def vocabulary(self) -> list[str]:
        return sorted({w for t in self.each for w in t.words} | {w for p, _ in PHRASES for w in p.split()})


NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWERED = str.maketrans(UPPER, LOWER)
DEFAULT = Templates.of(TEMPLATES)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case. lower() does the same for ASCII and is fast; only U+0130 and U+212A would become ASCII letters by it."""
    odd = F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130"))
    return F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def template_places(docs: DataFrame, vocabulary: list[str] = DEFAULT.vocabulary) -> DataFrame:
    """Per row: row, doc_id, n_words, hits (place and word of every word of the vocabulary)."""
    split = F.filter(F.split(lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit(""))), NOT_WORD), lambda w: w != "")

    def of_words(w: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(vocabulary))
        hits = F.transform(at, lambda i: F.struct(i.alias("p"), F.get(w, i).alias("w")))
        none = F.array().cast("array<struct<p:int,w:string>>")
        return F.struct(F.size(w).cast("long").alias("n_words"), F.when(F.size(w) == 0, none).otherwise(hits).alias("hits"))

    return docs.select("doc_id", let(split, of_words).alias("x")).select(F.monotonically_increasing_id().alias("row"), "doc_id", "x.*")


def phrase_places(hits: Column, phrase: str) -> Column:
    words = phrase.split()

    def here(x: Column, i: Column) -> Column:
        ok = x["w"] == words[0]
        for k, word in enumerate(words[1:], 1):
            next_ = F.get(hits, i + k)
            ok = ok & F.coalesce((next_["w"] == word) & (next_["p"] == x["p"] + k), F.lit(False))
        return ok

    return F.transform(F.filter(hits, here), lambda x: x["p"])


def blocks_met(hits: Column, need: Column, span: Column) -> Column:
    """The shortest blocks that hold `need` distinct template words, one from each place where there is one: from, to, n
    (distinct words in the longest block from there). hits: p, w of one template's words, in order of p, one frame's at most."""
    ahead = lambda x: F.filter(hits, lambda y: (y["p"] >= x["p"]) & (y["p"] < x["p"] + span))
    words = lambda a: F.array_distinct(F.transform(a, lambda y: y["w"]))
    # where a word comes first from x on; sorted, the `need`-th is where enough of them have come
    firsts = lambda a: F.filter(a, lambda y, i: ~F.exists(F.slice(a, F.lit(1), i), lambda z: z["w"] == y["w"]))
    end = lambda a: F.element_at(firsts(a), need.cast("int"))["p"]
    found = F.transform(hits, lambda x: let(ahead(x), lambda a: F.struct(x["p"].alias("from"), F.when(F.size(words(a)) >= need, end(a)).alias("to"), F.size(words(a)).alias("n"))))
    return F.filter(found, lambda b: b["to"].isNotNull())


def matches(places: DataFrame, tables: Tables, templates: Templates = DEFAULT) -> DataFrame:
    """Per row with a met template: row, label, score (share of the template's words in the block that has the most)."""
    spark = places.sparkSession
    stride = templates.stride
    words = places.select("row", F.explode(F.array_distinct(F.transform("hits", lambda x: x["w"]))).alias("w"))
    count = {r["w"]: r["n"] for r in words.groupBy("w").agg(F.count("*").alias("n")).collect()}  # as many rows as the vocabulary has words
    rank = {w: i for i, w in enumerate(sorted(templates.vocabulary, key=lambda w: (count.get(w, 0), w)))}
    members, prefix = [], []
    for t, template in enumerate(templates.each):
        ordered = sorted(rank[w] for w in template.words)
        members += [(t, r) for r in ordered]
        prefix += [(t, r, len(ordered), i + 1, template.need) for i, r in enumerate(ordered[: len(ordered) - template.need + 1])]
    member = spark.createDataFrame(members, "t int, rank int")
    index = spark.createDataFrame(prefix, "t int, rank int, m int, at int, need int")
    order = spark.createDataFrame(list(rank.items()), "w string, rank int")
    about = spark.createDataFrame([(t, x.label, len(x.words), x.need, x.span) for t, x in enumerate(templates.each)], "t int, label string, m int, need int, span int")
    pairs = spark.createDataFrame(list(templates.within), "t int, larger int")
    first = sorted({w for w, r in rank.items() if any(p[1] == r for p in prefix) and count.get(w)})
    some = places.where(F.exists("hits", lambda x: x["w"].isin(first)) if first else F.lit(False))
    hit = some.select("row", F.explode("hits").alias("x")).select("row", F.floor(F.col("x.p") / stride).alias("b"), F.col("x.p").alias("p"), F.col("x.w").alias("w"))
    each = hit.select("row", "p", "w", F.explode(F.array("b", F.col("b") - 1)).alias("frame")).join(F.broadcast(order), "w")
    # per frame the ranks it has, in order, with their places: as many as a frame has words at most
    frame = each.groupBy("row", "frame").agg(F.array_sort(F.collect_set("rank")).alias("ranks"), F.array_sort(F.collect_list(F.struct("p", F.col("rank").alias("w")))).alias("hits"))
    least = min((t.need for t in templates.each), default=1)
    frames = tables.put(frame.where(F.size("ranks") >= least))
    at = frames.select("row", "frame", F.size("ranks").alias("n_b"), F.posexplode("ranks").alias("at_b", "rank"))
    near = at.join(F.broadcast(index), "rank").where((F.col("n_b") >= F.col("need")) & (1 + F.least(F.col("m") - F.col("at"), F.col("n_b") - F.col("at_b") - 1) >= F.col("need")))
    candidates = near.select("row", "frame", "t").distinct()
    ranks = member.groupBy("t").agg(F.collect_list("rank").alias("own")).join(about, "t")
    full = candidates.join(F.broadcast(ranks), "t").join(frames, ["row", "frame"]).where(F.size(F.array_intersect("own", "ranks")) >= F.col("need"))
    own = F.filter("hits", lambda x: F.array_contains("own", x["w"]))
    met = full.select("row", "frame", "t", "label", "m", F.explode(let(own, lambda h: blocks_met(h, F.col("need"), F.col("span")))).alias("x")).select("row", "frame", "t", "label", "m", "x.*")
    met = tables.put(met)
    # a block counts for the larger template where one of its blocks in a frame encloses this one
    larger = met.select("row", "frame", F.col("t").alias("larger"), F.col("from").alias("lo"), F.col("to").alias("hi"))
    inner = met.join(F.broadcast(pairs), "t").join(larger, ["row", "frame", "larger"]).where((F.col("lo") <= F.col("from")) & (F.col("to") <= F.col("hi")))
    free = met.join(inner.select("row", "t", "from", "to").distinct(), ["row", "t", "from", "to"], "left_anti")
    return free.groupBy("row", "label").agg(F.max(F.col("n") / F.col("m")).alias("score"))


def license_scan(docs: DataFrame, notices=TEMPLATES) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score. notices: pairs of label and wording."""
    templates = Templates.of(notices)
    tables = Tables(docs.sparkSession, "license-scan")
    places = tables.put(template_places(docs, templates.vocabulary))
    found = matches(places, tables, templates).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("score").alias("met"))
    at = F.array(*[F.struct(phrase_places(F.col("hits"), p).alias("at"), F.lit(label).alias("label")) for p, label in PHRASES])
    base = places.select("row", "doc_id", "n_words", F.filter(at, lambda x: F.size(x["at"]) > 0).alias("base"))
    starts = F.flatten(F.transform("base", lambda x: x["at"]))
    out = base.withColumn("starts", starts).join(found, "row", "left")
    own = F.transform("base", lambda x: x["label"])
    text = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return out.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        text(own).alias("base_labels"),
        text(F.concat(own, F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("starts") > 0, F.lit(1.0)).otherwise(F.coalesce("met", F.lit(0.0))).alias("score"),
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))
