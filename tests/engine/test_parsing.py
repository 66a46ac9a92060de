import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymark.functions.synonyms import DEFAULT, Dictionary, expand_direction, expand_street, languages_of, parse_lines, read_entries, read_lines, street_prefixes
from waymark.operators.parsing import chome_spellings, parse, parse_column
from waymark.operators.predicates import address_filter, city_name

# cc, typed, street, number, unit, postcode
CASES = [
    ("US", "25 Broadway", "Broadway", "25", None, None),
    ("US", "1871 MENAHAN ST APT 2R NY 11385", "MENAHAN ST", "1871", "APT 2R", "11385"),
    ("US", "broadway", "broadway", None, None, None),
    ("US", "10001", None, None, None, "10001"),
    ("US", "12 Main St Springfield", "Main St", "12", None, None),
    ("NL", "Keizersgracht 185", "Keizersgracht", "185", None, None),
    ("NL", "Keizersgracht 185 1016AG", "Keizersgracht", "185", None, "1016AG"),
    ("NL", "Keizersgracht 185 hs", "Keizersgracht", "185", "hs", None),
    ("NL", "2e Nassaustraat", "2e Nassaustraat", None, None, None),
    ("DE", "Unter den Linden 5", "Unter den Linden", "5", None, None),
    ("DE", "Hauptstr 12-14", "Hauptstr", "12-14", None, None),
    ("DE", "10117", None, None, None, "10117"),
    ("FR", "12 Rue de Rivoli", "Rue de Rivoli", "12", None, None),
    ("FR", "Rue de l'Eglise 12", "Rue de l'Eglise", "12", None, None),
    ("FR", "1 Avenue des Champs-Élysées 75008", "Avenue des Champs-Élysées", "1", None, "75008"),
    ("FR", "rue de rivoli 1er arrondissement", "rue de rivoli", None, None, None),
    ("BR", "Rua Augusta 1234", "Rua Augusta", "1234", None, None),
    ("BR", "01305-000", None, None, None, "01305-000"),
    ("JP", "本郷 1-2-3", "本郷", "2", None, None),
    ("JP", "本郷 100", "本郷", "100", None, None),
    ("JP", "茨城県土浦市本郷1208", "本郷", "1208", None, None),
    ("JP", "本郷１２０８", "本郷", "1208", None, None),
    ("JP", "乙24", None, "24", None, None),
    ("JP", "並木1丁目 4233", "並木1丁目", "4233", None, None),
    ("JP", "100-0001", None, None, None, "100-0001"),
    ("AU", "45 George Street", "George Street", "45", None, None),
    ("AU", "3/45 George Street NSW", "George Street", "45", "3", None),
    ("AU", "2000", None, None, None, "2000"),
    ("CA", "123 King Street", "King Street", "123", None, None),
    ("CA", "clearview ave 195 ON K1Z6S1", "clearview ave", "195", None, "K1Z 6S1"),
    ("CA", "K1A 0A0", None, None, None, "K1A 0A0"),
    ("ES", "Calle Gran Via 12", "Calle Gran Via", "12", None, None),
    ("ES", "Calle Mayor 5 3o bajo", "Calle Mayor", "5", "3o bajo", None),
    ("IT", "Via del Corso 12", "Via del Corso", "12", None, None),
    ("SE", "Storgatan 5 111 22", "Storgatan", "5", None, "111 22"),
]


@pytest.mark.parametrize("case", CASES, ids=lambda c: f"{c[0]}-{c[1]}")
def test_parse(case):
    cc, typed, *want = case
    a = parse(typed, cc)
    assert [a.street or None, a.number, a.unit, a.postcode] == want
    assert a.tokens == typed.split() and a.raw == typed


@pytest.mark.parametrize("cc", "NZ MX CL CO UY SG HK TW GB IE".split())
def test_number_first(cc):
    a = parse("25 Main Street", cc)
    assert (a.number, a.street) == ("25", "Main Street") and parse("Main Street", cc).street == "Main Street"


@pytest.mark.parametrize("cc", "AT BE CH CZ DK FI NO PL PT SE HR RS SK SI EE LV LT LU IS".split())
def test_street_first(cc):
    a = parse("Main Street 25", cc)
    assert (a.number, a.street) == ("25", "Main Street")


@given(st.text(max_size=40), st.sampled_from("US CA AU BR DE ES FR IT JP NL GB AT".split()))
def test_parse_takes_anything(text, cc):
    assert parse(text, cc).tokens == text.split()


def test_parse_column(spark):
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CASES)] + [(99, "US", None)], "i int, cc string, t string").repartition(3)
    out = df.select("i", parse_column(F.col("t"), F.col("cc")).alias("a")).orderBy("i").collect()
    assert [[r.a.street or None, r.a.number, r.a.unit, r.a.postcode] for r in out[:-1]] == [list(c[2:]) for c in CASES]
    assert out[-1].a.tokens == []


def test_chome():
    assert set(chome_spellings("並木1")) == {"並木1", "並木一", "並木1丁目", "並木一丁目"}
    assert set(chome_spellings("並木一丁目")) == {"並木一丁目", "並木1丁目"}
    assert chome_spellings("並木") == ["並木"] and chome_spellings("並木21丁目") == ["並木21丁目"] and chome_spellings("x 99") == ["x 99"]


@pytest.mark.parametrize("cc, a, b", [("US", "avenue", "ave"), ("US", "boulevard", "blvd"), ("CA", "avenue", "ave"), ("DE", "strasse", "str"), ("FR", "boulevard", "bd"), ("ES", "avenida", "av"), ("IT", "viale", "vle"), ("NL", "straat", "str")])
def test_street_types_both_ways(cc, a, b):
    assert b in expand_street(cc, a) and a in expand_street(cc, b) and expand_street(cc, a.upper())[0] == a


def test_synonyms():
    assert "strasse" in expand_street("DE", "STRAẞE") and "st" in expand_street("US", "street") and "r" in expand_street("PT", "rua")
    assert expand_street("US", "a") == ["a"] and expand_street("US", " ") == [] and expand_street("US", "nosuchword") == ["nosuchword"]
    assert "n" in expand_direction("US", "north") and expand_direction("US", "n") == ["n"] and "ne" in expand_direction("US", "northeast")
    assert languages_of("CH") == ["de", "fr", "it"] and languages_of("ZZ") == ["en"]
    with pytest.raises(ValueError):
        languages_of("usa")
    assert street_prefixes("clearview avenue", None) == ["clearview avenue"]
    assert street_prefixes("Clearview Avenue", "US") == ["clearview avenue", "clearview ave", "clearview av"]
    assert street_prefixes("north main", "US") == ["north main", "n main"]
    assert all(x in DEFAULT.expand("street", "CA", "ave") for x in ("avenue", "av"))


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "street_types.txt").write_text("# types\nAllée|all | all\n\nstraße|str # the usual\nstraße|x\n")
    rows = {r["canonical"]: r["variants"] for r in read_lines(spark, str(tmp_path / "street_types.txt")).collect()}
    assert rows["allee"] == ["all"] and rows["strasse"] in (["str"], ["x"]) and len(rows) == 2
    assert parse_lines(["# c", "Allée|all|all", ""]) == [["allee", "all"]]
    (tmp_path / "street_types.json").write_text('{"_meta": {}, "entries": [{"canonical": "Allée", "variants": ["all", "allee"]}, {"canonical": "x", "variants": null}]}')
    rows = {r["canonical"]: r["variants"] for r in read_entries(spark, str(tmp_path / "street_types.json")).collect()}
    assert rows == {"allee": ["all"], "x": []}
    assert Dictionary.from_groups({"fr": [["Allée", "all"]]}).expand("street", "FR", "ALL") == ["all", "allee"]
    d = Dictionary.of({"en": "lane|ln"}, {}, {"en": "ln"})
    assert d.expand("street", "US", "lane") == ["lane", "ln"] and d.expand("street", "US", "ln") == ["ln"]


def test_filters(spark):
    rows = [
        (1, "12 CLEARVIEW AVE, OTTAWA, ON, K1Z6S1", "clearview ave", "12", "K1Z6S1"),
        (2, "12 CLEARVIEW AVENUE, OTTAWA", "clearview avenue", "12", None),
        (3, "並木一丁目 362-9", "並木一丁目", "362-9", None),
        (4, "7 O'Brien St, 00186", "o'brien st", "7", "00186"),
    ]
    df = spark.createDataFrame(rows, "id int, full_address string, street_lower string, number string, postcode string")
    ids = lambda text, cc: sorted(r["id"] for r in df.where(address_filter(parse(text, cc))).collect())
    assert ids("12 clearview avenue", "CA") == [1, 2] and ids("12 clearview ave K1Z 6S1", "CA") == [1]
    assert ids("並木1丁目 362", "JP") == [3] and ids("", "US") == [1, 2, 3, 4] and ids("O'Brien street 7", "AT") == []
    assert ids("7 o'brien", "US") == [4] and ids("00186", "IT") == [4] and ids("99999", "DE") == []
    cities = spark.createDataFrame([("Paris 8e Arrondissement",), ("Paris",), ("Lyon 1er Arrondissement",), ("Nice",)], "c string").coalesce(1)
    assert [r[0] for r in cities.select(city_name(F.col("c"))).collect()] == ["Paris", "Paris", "Lyon", "Nice"]
