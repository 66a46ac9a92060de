import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import geocode as G
from waymark.operators import search as S
from waymark.plans import catalogue, indexes
from waymark.sources.catalog import Catalog, add_step, bucket_groups, measure, objects_of, plan_text, rows_of, run_tagged, update_last_step
from waymark.sources.parquet_meta import column_metadata, file_metadata

SF = "/root/testdata/sf0.001"
STREET = "street_lower string, tiles array<string>, addr_count int, primary_city string, pos int"


@pytest.fixture(scope="module")
def addr(spark):
    return catalogue.addresses(spark, SF).cache()


@pytest.fixture(scope="module")
def streets(spark):
    rows = [("keizersgracht", ["t1"], 2453, "Amsterdam"), ("kerkstraat", ["t2"], 25054, "Utrecht"), ("kerkstraat zuid", ["t1"], 10, "Amsterdam"), ("nieuwe keizersgracht", ["t4"], 518, "Amsterdam"), ("hauptstraße", ["t5"], 287036, "Bonn"), ("hauptstr.", ["t5"], 6765, "Bonn")]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], STREET)


def names(df):
    return [r["street_lower"] for r in df.collect()]


@pytest.mark.parametrize("text, cc, mode", [("12 rue", "FR", "street"), ("7 rue tourneux", "FR", "ready"), ("104", "US", "postcode"), ("keizersgracht 1", "NL", "ready"), ("keizers", "NL", "street"), ("1016", "NL", "postcode"), ("", "NL", "ready"), ("本郷 1", "JP", "ready"), ("10117", "DE", "postcode"), ("5", "GB", "postcode"), ("K1A 0A0", "CA", "postcode")])
def test_classify(text, cc, mode):
    assert S.classify(text, cc).mode == mode


def test_prefix_suggestions(streets):
    assert names(S.suggest_streets(streets, "KE")) == ["kerkstraat", "keizersgracht", "kerkstraat zuid"]
    assert names(S.suggest_streets(streets, "ke", ["t1"])) == ["keizersgracht", "kerkstraat zuid", "kerkstraat"]
    assert names(S.narrow_street(streets, "kerkstraat", "NL", exact=True)) == ["kerkstraat"]
    assert names(S.narrow_street(streets, "ke", "NL", exact=False)) == ["kerkstraat"]


def test_normalised_search(streets):
    assert names(S.search_streets(streets, "hauptstrasse", "DE")) == ["hauptstraße", "hauptstr."] or names(S.search_streets(streets, "hauptstrasse", "DE"))[0] == "hauptstraße"
    assert names(S.search_streets(streets, "gracht")) == ["keizersgracht", "nieuwe keizersgracht"]
    assert names(S.search_streets(streets, "kerkstraat")) [0] == "kerkstraat"
    assert names(S.search_streets(streets, "nothing")) == []


def test_city_and_postcode_search(spark):
    cities = spark.createDataFrame([("Amsterdam", "NH", 500000, 0), ("Amstelveen", "NH", 50000, 1), ("Rotterdam", "ZH", 400000, 2), ("New Amsterdam", "XX", 1000, 3), ("Amsterdam", "YY", 5, 4)], "city string, region string, addr_count int, pos int")
    got = [r["city"] for r in S.search_cities(cities, "amster").collect()]
    assert got[:2] == ["Amsterdam", "Amsterdam"] and "New Amsterdam" in got and "Rotterdam" not in got
    codes = spark.createDataFrame([("1016AG", ["a"], 14, 0), ("1016AH", ["a"], 31, 1), ("2722AJ", ["b"], 30, 2)], "postcode string, tiles array<string>, addr_count int, pos int")
    assert [r["postcode"] for r in S.search_postcodes(codes, "1016").collect()] == ["1016AH", "1016AG"]
    assert [r["postcode"] for r in S.suggest_postcodes(codes, "1016a").collect()] == ["1016AH", "1016AG"]
    assert [r["postcode"] for r in S.narrow_postcode(codes, "2722 aj").collect()] == ["2722AJ"]


def test_rank_suggestions(spark):
    rows = [("via cave", ["t9"], "Napoli", 0), ("via cave di peperino", ["t1"], "Marino", 1), ("via cavento", ["t1"], "Roma", 2)]
    df = spark.createDataFrame(rows, "label string, tiles array<string>, primary_city string, pos int")
    order = lambda city, tiles: [r["label"] for r in S.rank_suggestions(df, "via cave", city, tiles).collect()]
    assert order("Roma", ["t1"]) == ["via cave di peperino", "via cavento", "via cave"]
    assert order(None, ["t1"])[0] == "via cave"
    assert S.rank_by_similarity(["abcd", "abxx"], "abxx", str) == ["abxx", "abcd"]


def test_resolve_tiles():
    s = {"type": "street", "label": "x", "tiles": ["a", "b"]}
    assert S.resolve_tiles(s, {"city": "C"}, {"b"})[0] == ["b"] and S.resolve_tiles(s, {"city": "C"}, {"z"})[0] == ["a", "b"]
    assert S.resolve_tiles(None, {"city": "C"}, {"z"}) == (["z"], "city C") and S.resolve_tiles(None, None, None) == ([], "none")
    assert G.narrow_tiles(["a", "b", "c"], ["c"], only_city=False) == ["c", "a", "b"] and G.narrow_tiles(["a", "c"], ["c"], only_city=True) == ["c"]


class Fixed:
    def __init__(self):
        self.calls = []

    def postcodes(self, cc, query, tiles):
        self.calls.append("p")
        return [{"type": "postcode", "label": "1016AG", "tiles": ["a"], "addr_count": 3, "primary_city": None}]

    def streets(self, cc, query, tiles):
        self.calls.append("s")
        return [{"type": "street", "label": "keizersgracht", "tiles": ["a", "b"], "addr_count": 9, "primary_city": "Amsterdam"}]

    def addresses(self, cc, street, number, tiles):
        self.calls.append(tuple(tiles))
        return []


def test_suggest_and_cache():
    now = [0.0]
    cache, look = S.SearchCache(2, 10, lambda: now[0]), Fixed()
    _, rows = S.suggest("keizers", "NL", None, None, look, cache)
    assert [r["label"] for r in rows] == ["keizersgracht"]
    S.suggest("KEIZERS", "NL", None, None, look, cache)
    assert look.calls == ["s"]
    _, rows = S.suggest("keizersgracht 185", "NL", "Amsterdam", {"b"}, look, cache)
    assert rows[0]["label"] == "keizersgracht 185" and rows[0]["type"] == "address" and look.calls[-1] == ("b",)
    assert S.suggest("k", "NL", None, None, look, cache)[1] == []
    now[0] = 11
    S.suggest("keizers", "NL", None, None, look, cache)
    assert look.calls.count("s") == 3
    for k in "abc":
        cache.set(k, k)
    assert cache.get("a") is None and cache.get(" C ") == "c"
    cache.clear()
    assert cache.get("c") is None


def test_numbers(spark, addr):
    df = spark.createDataFrame([(["12-9", "120-9", "1-2", "12-1", "7"],)], "numbers array<string>")
    assert df.select(S.number_matches(F.col("numbers"), F.lit("12"), japanese=True)).head()[0] == ["12", "120"]
    assert df.select(S.number_matches(F.col("numbers"), F.lit("12"))).head()[0] == ["12-9", "120-9", "12-1"]


def test_boxes_and_grid(spark):
    box = geo.radius_box(52.3, 4.9, 250)
    assert box.max_lat - box.min_lat < 0.006 and box.min_lon < 4.9 < box.max_lon
    assert [geo.grid_steps(r) for r in (250, 5000, 5001, 10000, 10001)] == [0, 0, 1, 1, 2]
    h = spark.createDataFrame([(int("85196b17fffffff", 16),)], "c long")
    assert h.select(geo.hex_name(geo.hex_parent(F.col("c"), 4)), geo.hex_resolution(F.col("c"))).head()[:] == ("84196b1ffffffff", 5)
    assert spark.range(1).select(geo.hex_number(F.lit("84196b1ffffffff"))).head()[0] == int("84196b1ffffffff", 16)
    with pytest.raises(ValueError):
        geo.DegreeGrid().ring(F.lit(1), 11)
    d = spark.range(1).select(geo.haversine(F.lit(0.0), F.lit(1.0), 0.0, 0.0)).head()[0]
    assert d == pytest.approx(111194.9, abs=0.1)
    assert '"Polygon"' in geo.box_polygon(box)


def test_reverse(addr):
    a = addr.orderBy("address_id").head()
    got = G.reverse(addr, a.lat, a.lon, 50_000, 3).collect()
    assert got[0].distance_m == pytest.approx(0, abs=1e-6) and [r.distance_m for r in got] == sorted(r.distance_m for r in got)
    assert all(r.distance_m <= 10 for r in G.reverse(addr, a.lat, a.lon, 50_000, 3, max_m=10).collect())
    for bad in ({"limit": 0}, {"max_m": 0}, {"max_m": -1}):
        with pytest.raises(ValueError):
            G.reverse(addr, 0, 0, **bad)
    with pytest.raises(ValueError):
        G.reverse(addr, float("nan"), 0)
    plan = G.reverse(addr, a.lat, a.lon)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert G.point_groups(G.reverse(addr, a.lat, a.lon, 50_000, 10)).count() >= 1
    cities = indexes.merged_cities(indexes.city_index(addr))
    assert G.place_of(G.reverse(addr, a.lat, a.lon), cities).head()["country"] == a.country


def test_batch_plans_are_hashed(spark, addr):
    q = spark.createDataFrame([(1, "US", "12 small ring")], "query_id long, country string, text string")
    plan = G.geocode_batch(addr, q)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    p = spark.createDataFrame([(1, 0.0, 0.0)], "point_id long, lat double, lon double")
    plan = G.reverse_batch(addr, p)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


SCHEMA = "address_id int, country string, full_address string, street string, street_lower string, number string, unit string, city string, region string, postcode string, lat double, lon double, cell long, street_norm string"
STREETS = {
    "US": ["main st", "main street", "blue ave", "n lake road", "north lake road", "o'neil ct"],
    "CA": ["rue bay", "bay street", "bay st"],
    "DE": ["hauptstraße", "hauptstr", "grüne allee", "50% weg"],
    "FR": ["rue de rivoli", "bd voltaire", "boulevard voltaire"],
    "IT": ["via roma", "viale roma", "v.le roma"],
    "JP": ["並木1", "並木一丁目", "並木二丁目", "本郷", "本郷二丁目"],
    "NL": ["keizersgracht", "2e nassaustraat"],
    "ES": ["calle mayor", "avda mayor", "avenida mayor"],
    "CH": ["bahnhofstrasse", "rue du lac", "via lugano"],
}
TYPED = {
    "US": ["12 Main Street", "5 Blue Avenue", "12 North Lake Road", "12 main", "Main St", "12", "99501", "7 main st 99501", "12 m_in", "", "NY"],
    "CA": ["5 Bay Street", "Bay St K1A 0A0", "K1A 0B1", "5 rue bay K1A0A0"],
    "DE": ["Hauptstraße 12", "hauptstr 5", "Grune Allee", "12 99501", "5% weg 5", "50% weg"],
    "FR": ["5 Boulevard Voltaire", "7 bd voltaire 99501", "rue"],
    "IT": ["Via Roma 12", "Via Roma 12 00184", "viale roma", "00184"],
    "JP": ["並木1 24", "本郷二丁目24", "並木一 8", "本郷", "24", "乙24", "丁 3"],
    "NL": ["Keizersgracht 5", "2e Nassaustraat", "5"],
    "ES": ["Avenida Mayor 7", "calle mayor 12"],
    "CH": ["Rue du Lac 5", "bahnhofstr 7", "Via Lugano 12"],
}


@pytest.fixture(scope="module")
def places(spark):
    from waymark.functions.text import normalize_py

    rows = []
    for cc in catalogue_countries():
        for s in STREETS.get(cc, ["main street", "main st", "high road"]):
            for k, n in enumerate(["5", "7", "12", "24", "24-8", "8-3", "乙24-1"]):
                code = None if cc in ("IT", "JP") else ("K1A0A0" if cc == "CA" else "99501") if k % 2 else "K1A 0B1" if cc == "CA" else "12345"
                rows.append((len(rows), cc, f"{s} {n}", s.upper(), s, n, None, "c", "r", code, 1.0, 1.0, 1, normalize_py(s)))
    return spark.createDataFrame(rows, SCHEMA).cache()


def catalogue_countries():
    return sorted("US CA AU NZ GB IE NL DE FR IT ES BR JP AT BE CH DK NO PL PT SE SG MX CL FI".split())


@pytest.mark.parametrize("normalized", [False, True])
def test_batch_equals_single_queries_in_every_country(spark, places, normalized):
    texts = [(cc, t) for cc in catalogue_countries() for t in TYPED.get(cc, ["Main Street 5", "5 Main Street", "main", "12", "High Rd 7"])]
    q = spark.createDataFrame([(i, cc, t) for i, (cc, t) in enumerate(texts)], "query_id int, country string, text string")
    got = {}
    for r in G.geocode_batch(places, q, limit=1000, normalized=normalized).collect():
        got.setdefault(r.query_id, []).append(r.full_address)
    found = 0
    for i, (cc, t) in enumerate(texts):
        c = G.conditions(G.parse(t, cc), normalized=normalized)
        if not (c.prefixes or c.numbers or c.postcode):
            assert i not in got
            continue
        want = sorted(r.full_address for r in G.geocode(places, t, cc, limit=1000, normalized=normalized).collect())
        assert sorted(got.get(i, [])) == want, (cc, t)
        found += bool(want)
    assert found > 60


def test_batch_ranks_and_limits(spark, places):
    q = spark.createDataFrame([(1, "US", "main"), (2, "JP", "24"), (3, "DE", "12345"), (4, None, "x"), (5, "US", None)], "query_id int, country string, text string")
    rows = G.geocode_batch(places, q, limit=2).collect()
    assert sorted((r.query_id, r["rank"]) for r in rows) == [(k, n) for k in (1, 2) for n in (1, 2)] + [(3, 1), (3, 2)]
    stored = {r.address_id: r for r in places.collect()}
    best = sorted((len(r.street_lower), r.address_id) for r in stored.values() if r.country == "US" and r.street_lower.startswith("main"))[:2]
    assert [r.address_id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == 1] == [a for _, a in best]
    index = places.select("country", "street_lower", "street_norm").distinct()
    assert sorted(map(tuple, G.geocode_batch(places, q, 2, index).select("query_id", "rank", "address_id").collect())) == sorted((r.query_id, r["rank"], r.address_id) for r in rows)


def test_many_spellings_in_a_dictionary(spark):
    """As large as the dictionaries of a whole language collection: 27 languages of 400 groups."""
    from waymark.functions.synonyms import Dictionary, expand_tokens

    groups = {f"l{k}": [[f"type{k}x{i}", f"t{k}x{i}", f"ty{k}x{i}"] for i in range(400)] for k in range(25)} | {"en": [[f"type{i}", f"t{i}"] for i in range(400)], "fr": [[f"type{i}", f"tp{i}"] for i in range(400)]}
    d = Dictionary.from_groups(groups, {"en": [["north", "n"]]}, {"fr": ["t7"]})
    tokens = [("US", "type5"), ("CA", "type5"), ("CA", "t7"), ("US", "t7"), ("FR", "tp399"), ("ZZ", "type5"), ("US", "none")]
    out = {(r.country, r.token): r.variants for r in expand_tokens(spark.createDataFrame(tokens, "country string, token string"), d).collect()}
    assert out == {(cc, t): d.expand("street", cc, t) for cc, t in tokens}
    addr = spark.createDataFrame([(1, "US", "a", "A", "main t5", "9", None, "c", "r", None, 1.0, 1.0, 1, "main t5")], SCHEMA)
    q = spark.createDataFrame([(1, "US", "9 Main Type5")], "query_id int, country string, text string")
    assert G.geocode_batch(addr, q, dictionary=d).count() == 1 and G.geocode_batch(addr, q).count() == 0


@pytest.mark.parametrize("radius, scale", [(800, 0.01), (20_000, 0.3), (5000, 0.1)])
def test_reverse_batch_equals_brute_force(spark, radius, scale):
    rng = random.Random(radius)
    spot = lambda i: (i, f"a{i}", "XX", "c", rng.choice([0.0, 47.0, -63.0, 71.5]) + rng.uniform(-scale, scale), rng.choice([0.0, 8.0, -70.0]) + rng.uniform(-scale, scale))
    stored = [spot(i) for i in range(600)]
    asked = [(i, r[4] + 0.0001, r[5]) for i, r in enumerate(stored[:40])]
    a = spark.createDataFrame(stored, "address_id long, full_address string, country string, city string, lat double, lon double")
    got = {}
    for r in G.reverse_batch(a, spark.createDataFrame(asked, "point_id long, lat double, lon double"), radius, 5).collect():
        got.setdefault(r.point_id, []).append((r["rank"], r.address_id))

    def metres(p, q):
        h = math.sin(math.radians(q[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(q[0])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
        return 2 * geo.EARTH_M * math.asin(math.sqrt(h))

    for i, lat, lon in asked:
        near = sorted((m, s[0]) for s in stored if (m := metres((lat, lon), s[4:])) <= radius)[:5]
        assert [x for _, x in sorted(got[i])] == [x for _, x in near]


def test_buckets(spark):
    df = spark.createDataFrame([(i, "US", "t1" if i < 90 else "t2", "?") for i in range(100)], "address_id long, country string, tile string, bucket string")
    got = indexes.with_buckets(df, 40)
    assert {r.bucket for r in got.where("tile = 't1'").collect()} == {"01", "02", "03"} and {r.bucket for r in got.where("tile = 't2'").collect()} == {"_"}
    assert got.columns == df.columns and got.count() == 100


def test_limits_and_tiles(addr):
    with pytest.raises(ValueError):
        G.forward(addr, F.lit(True), 0)
    with pytest.raises(ValueError):
        G.in_tiles(addr, "US", [])
    with pytest.raises(ValueError):
        G.in_tiles(addr, "usa")
    assert G.geocode(addr, "red", "US").columns == list(G.FIELDS)


def test_catalog(spark, addr, tmp_path):
    root = str(tmp_path / "index")
    indexes.write_indexes(addr, root, "2026-03-18.0")
    indexes.write_indexes(addr.where("country = 'US'"), root, "2026-04-15.0")
    (tmp_path / "index" / "release=bad").mkdir()
    c = Catalog(spark, root)
    assert c.releases() == ["2026-04-15.0", "2026-03-18.0"] and c.release == "2026-04-15.0"
    told, seen = [], []
    c.on_release(told.append)
    c.use_release("2026-03-18.0")
    assert told == ["2026-03-18.0"] and c.addresses().count() == addr.count()
    n = c.prefetch("FR", seen.append)
    assert n["cities"] == seen[0] > 0 and n["streets"] > 0 and c.is_cached("FR") and set(c.prefetch("FR").values()) == {0}
    assert c.country_table("cities", "FR").where("city like '%Arrondissement%'").count() == 0
    tile = c.table("tile_index").where("country = 'US'").head()
    assert c.tile("US", tile.tile, tile.bucket).count() == tile.address_count and c.is_tile_cached("US", tile.tile, tile.bucket)
    c.tile_budget = 1
    c.tile("FR", "t1x1")
    assert not c.is_tile_cached("US", tile.tile, tile.bucket)
    plan = G.in_tiles(c.addresses(), "US", [tile.tile])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(country" in plan
    assert c.tile_buckets("US", [tile.tile]).head()["tile"] == tile.tile
    assert set(c.globals()) == {"tile_index", "region_index", "manifest"} and spark.table("manifest").count() == 25
    assert c.fresh("manifest").count() == 25
    import shutil

    shutil.rmtree(f"{root}/release=2026-03-18.0/postcode_index")
    assert c.table("postcode_index").count() == 0 and "postcode" in c.table("postcode_index").columns
    files = file_metadata(spark, c.path("number_index")).collect()
    assert sum(f["num_rows"] for f in files) == c.table("number_index").count() and all(f["file_size"] > 0 for f in files)
    columns = {r["name"]: r for r in column_metadata(spark, c.path("number_index")).collect()}
    assert columns["street_lower"]["compression"] and columns["street_lower"]["bytes_per_value"] > 0
    tries = []

    def unsteady(df):
        tries.append(df)
        if len(tries) == 1:
            raise PySparkException("lost")
        return df.count()

    assert c.retry("manifest", unsteady) == 25 and len(tries) == 2
    c.flush()
    with pytest.raises(ValueError):
        Catalog(spark, str(tmp_path / "nothing"))


def test_small_helpers(spark):
    df = spark.createDataFrame([("US", "t1", "02", 5), ("US", "t1", "01", 6), ("US", "t2", "_", 50)], "country string, tile string, bucket string, address_count int")
    assert [(r.tile, r.buckets) for r in bucket_groups(df, ["t1", "t2"]).collect()] == [("t2", ["_"]), ("t1", ["01", "02"])]
    assert rows_of(df.limit(1))[0] == df.columns and objects_of(df)[0]["country"] == "US" and "LocalTableScan" in plan_text(df) or plan_text(df)
    m = measure(lambda: df.where("address_count > 5"), 1)
    assert m["rows"] == 2 and m["cold_s"] > 0 and "address_count" in m["plan"]
    assert run_tagged(spark, "t", lambda: df.count()) == 3
    assert update_last_step(add_step(add_step([], "a"), "b"), "c", "ok") == [("a", None), ("c", "ok")]


def test_stream(spark, tmp_path, addr):
    from waymark.streaming import geocoded_stream, latest_queries

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "US", "12 small ring ave"), (2, "DE", "nirgends 5")], "query_id long, country string, text string").write.json(src)
    stream = spark.readStream.schema("query_id long, country string, text string").json(src)
    q = geocoded_stream(stream, indexes.street_index(addr)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
    q.awaitTermination()
    rows = {r["query_id"]: r for r in spark.read.parquet(out).collect()}
    assert rows[1]["number"] == "12" and rows[1]["street"] == "small ring ave" and rows[2]["street"] == "nirgends"
    ev = spark.createDataFrame([("s", "2024-01-01 00:00:00", "a"), ("s", "2024-01-01 00:00:00.5", "ab"), ("s", "2024-01-01 00:01:00", "x")], "session string, at string, text string").withColumn("at", F.col("at").cast("timestamp"))
    assert sorted(r["text"] for r in latest_queries(ev, "session", "at", "text").collect()) == ["ab", "x"]


def test_batch_query_types_every_address(spark):
    sf = "/root/testdata/sf0.001"
    addr = catalogue.addresses(spark, sf)
    got = {r["query_id"] for r in catalogue.QUERIES["geocode_batch"](spark, sf).collect()}
    stored = addr.select("address_id", "country", "number").collect()
    first = {r["number"].split("-")[0] for r in stored if r["country"] == "JP"}
    # in Japan Latin letters are no street, and of dashed digits the second is the number
    assert got == {r["address_id"] for r in stored if r["country"] != "JP" or r["number"].split("-")[1] in first}


def test_batches_answer_long_texts(spark):
    from waymark.operators import geocode as G
    from waymark.operators import search as S

    long = "blossoming " * 10
    names = [long + "lily", long + "wolf"]
    streets = spark.createDataFrame([("US", n, ["t"], 1, "c") for n in names], "country string, street_lower string, tiles array<string>, addr_count int, primary_city string")
    asked = spark.createDataFrame([(1, "US", long + "w"), (2, "US", long), (3, "US", long + "x")], "query_id int, country string, query string")
    got = sorted((r["query_id"], r["street_lower"]) for r in S.suggest_streets_batch(streets, asked).collect())
    assert got == [(1, names[1]), (2, names[0]), (2, names[1])]
    schema = "address_id int, country string, full_address string, street string, street_lower string, number string, unit string, city string, region string, postcode string, lat double, lon double, cell long"
    stored = spark.createDataFrame([(i, "US", n, n.upper(), n, "7", None, "c", "r", None, 1.0, 1.0, 1) for i, n in enumerate(names)], schema)
    typed = spark.createDataFrame([(1, "US", f"7 {names[1]}")], "query_id int, country string, text string")
    assert [(r["query_id"], r["address_id"]) for r in G.geocode_batch(stored, typed).collect()] == [(1, 1)]
