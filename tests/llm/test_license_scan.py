import re
from collections import defaultdict

import duckdb
import pytest

from waymark.llm import license_scan as L
from waymark.llm import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string"


def labels_of(text, templates=L.DEFAULT):
    """Every run of words of every text against every template."""
    w = WORD.findall((text or "").translate(L.LOWERED))
    out = {label for p, label in L.PHRASES if f" {p} " in f" {' '.join(w)} "}
    met = defaultdict(set)
    for k, t in enumerate(templates.each):
        if len(set(t.words) & set(w)) < t.need:
            continue
        for i in range(len(w)):
            if w[i] not in t.words:
                continue
            seen = set()
            for j in range(i, min(len(w), i + t.span)):
                seen |= {w[j]} & set(t.words)
                if len(seen) >= t.need:
                    met[k].add((i, j))
                    break
    for k, blocks in met.items():
        larger = [b for a, b in templates.within if a == k]
        if any(not any(x <= i and j <= y for b in larger for x, y in met.get(b, ())) for i, j in blocks):
            out.add(templates.each[k].label)
    return ",".join(sorted(out))


def got(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    rows = {r["doc_id"]: r for r in L.license_scan(df, **options).collect()}
    return [rows[i]["labels"] for i in range(len(texts))]


NOTICES = [t for _, t in L.TEMPLATES]
ODD = [
    "By the time the report was licensed it had gone under 4 reviews, cc the board and file 0 copies",
    "Licensed under CC BY 4.0. Some words between. The pictures are licensed under CC BY-NC 4.0.",
    "Licensed under CC BY-NC 4.0",
    "licensed under cc by 4 0 " * 60,
    "filler " * 70 + "Licensed under the Apache License, Version 2.0" + " filler" * 70,
    " ".join(NOTICES),
    " ".join(reversed(" ".join(NOTICES).split())),
    None,
    "",
]


def test_scattered_words_are_no_notice(spark):
    found = got(spark, ODD)
    assert found[0] == "" and found[1].split(",") == ["cc-by", "cc-by-4.0", "cc-by-nc-4.0"] and found[2].split(",") == ["cc-by", "cc-by-nc-4.0"]


def test_odd_texts_equal_brute_force(spark):
    assert got(spark, ODD) == [labels_of(t) for t in ODD]


@pytest.mark.parametrize("shift", [0, 7, 41, 60])
def test_a_notice_is_found_wherever_it_stands(spark, shift):
    texts = [f"{'pad ' * (shift + k)}{n.upper()}{' pad' * 90}" for k, n in enumerate(NOTICES)]
    found = got(spark, texts)
    assert found == [labels_of(t) for t in texts]
    assert all(label in f.split(",") for (label, _), f in zip(L.TEMPLATES, found, strict=True))


def test_templates_are_a_parameter(spark):
    notices = [("house", "For internal use by the members of the house only; do not copy!"), ("empty", "--")]
    texts = ["x for INTERNAL use by the members of this house only, do not copy", "internal house members copy", "licensed under the mit license"]
    assert got(spark, texts, notices=notices) == ["house", "", ""]
    assert got(spark, texts, notices=[]) == ["", "", ""]
    with pytest.raises(ValueError):
        L.Templates.of([("a", "b c")] * (L.MOST_TEMPLATES + 1))


def test_sql_on_odd_texts(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), SCHEMA)
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    found = con.execute(queries.ORACLES["op8_license_scan"])
    names = [c[0] for c in found.description]
    want = sorted(found.fetchall())
    assert sorted(tuple(r[n] for n in names) for r in L.license_scan(df).collect()) == want
