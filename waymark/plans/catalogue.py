"""Queries over the driver's tables, each with the SQL that gives the same rows.

`addr` derives an address table from orders, one row an order: 25 countries, some without postcodes, tiles of one degree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, text
from ..functions.synonyms import DEFAULT, LANGUAGES, expand_street, expand_tokens, street_prefixes
from ..operators import geocode as G
from ..operators import search as S
from ..operators.parsing import US_SUFFIXES, parse, parse_column
from ..operators.predicates import address_filter, city_name, street_filter
from ..sources.catalog import Catalog
from . import indexes, stats

ADDR = """
WITH b AS (
  SELECT o.o_orderkey AS k, o.o_custkey AS ck, c.c_mktsegment AS seg, n.n_nationkey AS nk, r.r_name AS region,
         substr('USCAAUNZGBIENLDEFRITESBRJPATBECHDKNOPLPTSESGMXCLFI', n.n_nationkey * 2 + 1, 2) AS country,
         concat(p.p_name, CASE o.o_orderkey % 6 WHEN 0 THEN ' ave' WHEN 1 THEN ' avenue' WHEN 2 THEN ' st'
                          WHEN 3 THEN ' street' WHEN 4 THEN ' rd' ELSE ' road' END) AS street_lower,
         CAST(n.n_nationkey * 4 - 50 AS DOUBLE) + CAST((o.o_orderkey * 7919) % 3000 AS DOUBLE) / 1000 AS lat,
         CAST(n.n_nationkey * 10 - 120 AS DOUBLE) + CAST((o.o_orderkey * 104729) % 3000 AS DOUBLE) / 1000 AS lon
  FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey
  JOIN {nation} n ON n.n_nationkey = c.c_nationkey JOIN {region} r ON r.r_regionkey = n.n_regionkey
  JOIN {part} p ON p.p_partkey = o.o_custkey % 200),
d AS (
  SELECT *, upper(street_lower) AS street,
         concat(CAST(1 + (k * 7) % 300 AS STRING), CASE WHEN country = 'JP' THEN concat('-', CAST(1 + k % 19 AS STRING)) ELSE '' END) AS number,
         CASE WHEN k % 29 = 0 THEN CAST(k % 50 AS STRING) END AS unit,
         CASE WHEN country = 'FR' AND ck % 2 = 0 THEN concat('Paris ', CAST(ck % 20 + 1 AS STRING), 'e Arrondissement')
              ELSE concat(seg, ' ', CAST(ck % 8 AS STRING)) END AS city,
         CASE WHEN country IN ('JP','IT','NZ','CL') THEN NULL ELSE lpad(CAST((ck * 37) % 100000 AS STRING), 5, '0') END AS postcode,
         concat('t', CAST(CAST(floor(lat) AS INT) + 90 AS STRING), 'x', CAST(CAST(floor(lon) AS INT) + 180 AS STRING)) AS tile,
         CAST(floor((lat + 90) * 10) AS BIGINT) * 10000 + CAST(floor((lon + 180) * 10) AS BIGINT) AS cell,
         CASE WHEN nk < 3 THEN CASE k % 2 WHEN 0 THEN '01' ELSE '02' END ELSE '_' END AS bucket
  FROM b)
SELECT k AS address_id, concat_ws(', ', concat_ws(' ', number, street), city, region, postcode) AS full_address,
       street, street_lower, number, unit, city, region, postcode, country, lat, lon, tile, cell, bucket FROM d
"""
TABLES = ("orders", "customer", "nation", "region", "part")
ADDR_SQL = "addr AS (" + ADDR.format(**{t: t for t in TABLES}) + ")"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ADDR, **{t: table(spark, sf_dir, t) for t in TABLES})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of addr, the session and the data folder. sql may read addr."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(addresses(spark, sf_dir), spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {ADDR_SQL} {sql}" if not sql.lstrip().startswith(",") else f"WITH {ADDR_SQL}{sql}"
        return f

    return add


P1 = "full_address, street, number, unit, city, region, postcode, lat, lon, cell"

# Forward geocoding
@query(f"SELECT {P1} FROM addr WHERE country = 'US' AND street_lower LIKE 'red%' AND number LIKE '1%'")
def fwd_prefix_number(addr, spark, sf_dir):
    where = text.like_prefix(F.col("street_lower"), "red") & text.like_prefix(F.col("number"), "1")
    return G.in_tiles(addr, "US").where(where).select(*G.FIELDS)


def _or(street: str, cc: str) -> str:
    return "(" + " OR ".join(f"street_lower LIKE '{p}%'" for p in street_prefixes(street, cc)) + ")"


@query(f"SELECT address_id, country, street_lower FROM addr WHERE country = 'CA' AND {_or('blue bolt avenue', 'CA')} ")
def fwd_or_variants(addr, spark, sf_dir):
    return addr.where((F.col("country") == "CA") & street_filter("blue bolt avenue", "CA")).select("address_id", "country", "street_lower")


@query("SELECT address_id, postcode FROM addr WHERE lower(postcode) = '00370'")
def fwd_postcode_exact(addr, spark, sf_dir):
    return addr.where(address_filter(parse("00370", "DE"))).select("address_id", "postcode")


@query("SELECT address_id, full_address FROM addr WHERE full_address ILIKE '%furniture%' AND full_address ILIKE '%ave%' AND full_address ILIKE '%america%'")
def fwd_token_ilike(addr, spark, sf_dir):
    from ..operators.predicates import token_filter

    return addr.where(token_filter(["furniture", "Ave", "america", "x"], 2)).select("address_id", "full_address")


@query("SELECT address_id, number, split_part(number, '-', 1) AS banchi FROM addr WHERE country = 'JP' AND split_part(number, '-', 1) IN ('24', '8')")
def jp_split_part(addr, spark, sf_dir):
    bare = F.split_part("number", F.lit("-"), F.lit(1))
    return addr.where((F.col("country") == "JP") & bare.isin("24", "8")).select("address_id", "number", bare.alias("banchi"))


def _found(name: str, typed: str, cc: str, where: str):
    def f(addr, spark, sf_dir):
        return G.geocode(addr, typed, cc).select("full_address", "number", "lat", "lon")

    f.__name__ = name
    query(f"SELECT full_address, number, lat, lon FROM addr WHERE country = '{cc}' AND {where} LIMIT 100")(f)


_found("fwd_parsed_filter", "Red Ring Avenue 260", "DE", "street_lower LIKE 'red ring avenue%' AND number = '260'")
_found("fwd_synonyms", "256 Blue Anvil Street", "US", "(street_lower LIKE 'blue anvil street%' OR street_lower LIKE 'blue anvil st%') AND number = '256'")
_found("fwd_italian", "Red Gear St 255 00184", "IT", "street_lower LIKE 'red gear st%' AND number = '255'")
_found("fwd_japanese", "本郷 24", "JP", "street_lower LIKE '本郷%' AND split_part(number, '-', 1) = '24'")
_found("fwd_japanese_number", "24", "JP", "split_part(number, '-', 1) = '24'")


@query("SELECT DISTINCT number, street, city, postcode FROM addr WHERE street_lower = (SELECT min(street_lower) FROM addr) AND number LIKE '1%' ORDER BY number, city, postcode LIMIT 15")
def house_numbers(addr, spark, sf_dir):
    first = addr.agg(F.min("street_lower")).head()[0]
    return S.house_numbers(addr, first, "1")


# Indexes
STREETS = "SELECT country, street_lower, list_sort(list_distinct(flatten(list(t)))) AS tiles, CAST(sum(n) AS INT) AS addr_count, arg_min(city, (-n, city)) AS primary_city FROM (SELECT country, street_lower, city, count(*) AS n, list(DISTINCT tile) AS t FROM addr GROUP BY ALL) GROUP BY country, street_lower"


@query(f"SELECT country, street_lower, array_to_string(tiles, ',') AS tiles, addr_count, primary_city, street_lower AS street_norm FROM ({STREETS})")
def build_street_index(addr, spark, sf_dir):
    return indexes.street_index(addr).select("country", "street_lower", F.array_join("tiles", ",").alias("tiles"), "addr_count", "primary_city", "street_norm")


@query("SELECT country, postcode, array_to_string(list_sort(list(DISTINCT tile)), ',') AS tiles, CAST(count(*) AS INT) AS addr_count FROM addr WHERE postcode IS NOT NULL AND postcode != '' GROUP BY country, postcode")
def build_postcode_index(addr, spark, sf_dir):
    return indexes.postcode_index(addr).select("country", "postcode", F.array_join("tiles", ",").alias("tiles"), "addr_count")


@query("SELECT country, street_lower, array_to_string(list_sort(list(DISTINCT number)), ',') AS numbers FROM addr GROUP BY country, street_lower")
def build_number_index(addr, spark, sf_dir):
    return indexes.number_index(addr).withColumn("numbers", F.array_join("numbers", ","))


@query("SELECT country, count(*) AS address_count, CAST(count(DISTINCT tile) AS INT) AS tile_count, CAST(count(DISTINCT (tile, bucket)) AS INT) AS bucket_count, min(lon) AS bbox_min_lon, max(lon) AS bbox_max_lon, min(lat) AS bbox_min_lat, max(lat) AS bbox_max_lat, '2026-03-18.0' AS release_tag FROM addr GROUP BY country")
def build_manifest(addr, spark, sf_dir):
    return indexes.manifest(addr, "2026-03-18.0")


TILES = "SELECT country, tile, bucket, CAST(count(*) AS INT) AS address_count, min(cell) AS cell_min, max(cell) AS cell_max, CAST(count(DISTINCT city) AS INT) AS unique_cities, CAST(count(DISTINCT postcode) AS INT) AS unique_postcodes, min(region) AS primary_region FROM addr GROUP BY country, tile, bucket"


@query(TILES)
def build_tile_index(addr, spark, sf_dir):
    return indexes.tile_index(addr)


@query("SELECT country, region, array_to_string(list_sort(list(DISTINCT tile)), ',') AS tiles, CAST(count(*) AS INT) AS addr_count FROM addr GROUP BY country, region")
def build_region_index(addr, spark, sf_dir):
    return indexes.region_index(addr).select("country", "region", F.array_join("tiles", ",").alias("tiles"), "addr_count")


MERGED = "CASE WHEN city LIKE 'Paris % Arrondissement' THEN 'Paris' WHEN city LIKE 'Lyon % Arrondissement' THEN 'Lyon' WHEN city LIKE 'Marseille % Arrondissement' THEN 'Marseille' ELSE city END"


@query(f"SELECT country, {MERGED} AS city, region, array_to_string(list_sort(list(DISTINCT tile)), ',') AS tiles, CAST(count(*) AS INT) AS addr_count FROM addr GROUP BY country, {MERGED}, region")
def city_merge(addr, spark, sf_dir):
    return indexes.merged_cities(indexes.city_index(addr)).select("country", "city", "region", F.array_join("tiles", ",").alias("tiles"), "addr_count")


@query(f"SELECT {MERGED} AS city, array_to_string(list_sort(list(DISTINCT tile)), ',') AS tiles, CAST(count(*) AS INT) AS addr_count FROM addr WHERE country = 'FR' AND lower({MERGED}) = 'paris' GROUP BY 1")
def city_lookup(addr, spark, sf_dir):
    cities = indexes.merged_cities(indexes.city_index(G.in_tiles(addr, "FR")))
    wanted = F.lower(city_name(F.lit("Paris 8e Arrondissement")))
    return cities.where(F.lower("city") == wanted).orderBy(F.desc("addr_count")).limit(1).select("city", F.array_join("tiles", ",").alias("tiles"), "addr_count")


@query(f", t AS ({TILES}) SELECT country, tile, array_to_string(list(bucket ORDER BY bucket), ',') AS buckets, sum(address_count) AS total_addresses FROM t WHERE tile IN ('t40x60', 't41x61', 't44x70', 't48x80') GROUP BY country, tile")
def tile_bucket_groups(addr, spark, sf_dir):
    from ..sources.catalog import bucket_groups

    return bucket_groups(indexes.tile_index(addr), ["t40x60", "t41x61", "t44x70", "t48x80"]).withColumn("buckets", F.array_join("buckets", ","))


# Suggestions
@query(f", s AS ({STREETS}) SELECT street_lower, addr_count, primary_city FROM s WHERE country = 'US' AND street_lower LIKE 'red%' ORDER BY list_has_any(tiles, ['t40x60', 't41x61']) DESC, addr_count DESC, street_lower LIMIT 15")
def suggest_street_boost(addr, spark, sf_dir):
    streets = indexes.street_index(G.in_tiles(addr, "US"))
    return S.suggest_streets(streets, "Red", ["t40x60", "t41x61"]).select("street_lower", "addr_count", "primary_city")


@query("SELECT postcode, CAST(count(*) AS INT) AS addr_count FROM addr WHERE country = 'DE' AND lower(postcode) LIKE '0%' GROUP BY postcode ORDER BY addr_count DESC, postcode LIMIT 15")
def suggest_postcode(addr, spark, sf_dir):
    return S.suggest_postcodes(indexes.postcode_index(G.in_tiles(addr, "DE")), "0").select("postcode", "addr_count")


@query(f", s AS ({STREETS}) SELECT street_lower, addr_count FROM s WHERE country = 'US' AND street_lower LIKE 'small r%' ORDER BY addr_count DESC, street_lower LIMIT 1")
def narrow_street_top1(addr, spark, sf_dir):
    return S.narrow_street(indexes.street_index(G.in_tiles(addr, "US")), "small r", "US", exact=False).select("street_lower", "addr_count")


BATCH = "SELECT CAST(r_regionkey AS BIGINT) AS query_id, CASE r_regionkey % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' ELSE 'FR' END AS country, CASE r_regionkey WHEN 0 THEN 'red' WHEN 1 THEN 'blue b' WHEN 2 THEN 'small' WHEN 3 THEN 'gree' ELSE 'larg' END AS query FROM region"


@query(f", s AS ({STREETS}), q AS ({BATCH}), r AS (SELECT q.query_id, row_number() OVER (PARTITION BY query_id ORDER BY addr_count DESC, street_lower) AS rank, street_lower, addr_count FROM q JOIN s ON s.country = q.country AND starts_with(s.street_lower, q.query)) SELECT query_id, CAST(rank AS INT) AS rank, street_lower, addr_count FROM r WHERE rank <= 5")
def suggest_streets_batch(addr, spark, sf_dir):
    key = F.col("r_regionkey")
    country = F.when(key % 3 == 0, "US").when(key % 3 == 1, "DE").otherwise("FR")
    queries = table(spark, sf_dir, "region").select(key.cast("long").alias("query_id"), country.alias("country"), F.element_at(F.array(*map(F.lit, ("red", "blue b", "small", "gree", "larg"))), key.cast("int") + 1).alias("query"))
    return S.suggest_streets_batch(indexes.street_index(addr), queries, 5).select("query_id", "rank", "street_lower", "addr_count")


# Statistics
@query(f", t AS ({TILES}) SELECT country, CAST(count(*) AS INT) AS tiles, CAST(sum(address_count) AS BIGINT) AS addresses, CAST(avg(address_count) AS INT) AS avg_addr, CAST(median(address_count) AS INT) AS median_addr, max(address_count) AS max_addr, min(address_count) AS min_addr, CAST(sum(unique_cities) AS BIGINT) AS total_cities, CAST(sum(unique_postcodes) AS BIGINT) AS total_postcodes, CAST(count(DISTINCT primary_region) FILTER (primary_region IS NOT NULL AND primary_region != '') AS INT) AS regions FROM t GROUP BY country")
def tile_stats(addr, spark, sf_dir):
    return stats.country_stats(indexes.tile_index(addr))


_CLASS = "CASE WHEN address_count > 1000000 THEN '>1M' WHEN address_count > 500000 THEN '500K-1M' WHEN address_count > 100000 THEN '100K-500K' WHEN address_count > 50000 THEN '50K-100K' WHEN address_count > 10000 THEN '10K-50K' WHEN address_count > 1000 THEN '1K-10K' ELSE '<1K' END"
_KEY = "CASE WHEN address_count > 1000000 THEN 1 WHEN address_count > 500000 THEN 2 WHEN address_count > 100000 THEN 3 WHEN address_count > 50000 THEN 4 WHEN address_count > 10000 THEN 5 WHEN address_count > 1000 THEN 6 ELSE 7 END"


@query(f", t AS ({TILES}) SELECT {_CLASS} AS label, {_KEY} AS sort_key, CAST(count(*) AS INT) AS tiles, CAST(sum(address_count) AS BIGINT) AS addresses FROM t GROUP BY ALL")
def tile_histogram(addr, spark, sf_dir):
    return stats.histogram(indexes.tile_index(addr))


@query(f", t AS ({TILES}) SELECT tile, CAST(sum(address_count) AS BIGINT) AS address_count, CAST(sum(unique_cities) AS BIGINT) AS unique_cities, CAST(sum(unique_postcodes) AS BIGINT) AS unique_postcodes, CAST(count(*) AS INT) AS buckets, arg_min(country, (bucket, country)) AS country, coalesce(arg_min(primary_region, (bucket, country)), '-') AS region FROM t GROUP BY tile")
def tile_rollup(addr, spark, sf_dir):
    return stats.tile_rollup(indexes.tile_index(addr))


def _top(column: str):
    def f(addr, spark, sf_dir):
        return stats.top_values(addr, column)

    f.__name__ = f"topn_{column.removesuffix('_lower')}"
    query(f"SELECT {column} AS value, count(*) AS n FROM addr WHERE {column} IS NOT NULL AND {column} != '' GROUP BY 1 ORDER BY n DESC, value LIMIT 15")(f)


for _c in ("street_lower", "city", "postcode"):
    _top(_c)


@query("SELECT CAST(sum(n) AS BIGINT) AS addresses, CAST(sum(t) AS BIGINT) AS tiles, max(n) AS max_addresses, arg_max(country, (n, country)) AS largest, count(*) AS countries FROM (SELECT country, count(*) AS n, count(DISTINCT tile) AS t FROM addr GROUP BY country)")
def global_totals(addr, spark, sf_dir):
    return stats.totals(indexes.manifest(addr, "2026-03-18.0"))


@query(f", t AS ({TILES}), s AS (SELECT country, sum(unique_postcodes) AS p, sum(unique_cities) AS c, count(DISTINCT primary_region) AS r FROM t GROUP BY country) SELECT country, p > 0 AS has_postcode, TRUE AS has_street, c > 0 AS has_city, CASE WHEN p > 0 AND c > 0 THEN 'Full' WHEN c > 0 THEN 'Street + City' ELSE 'Fallback' END AS readiness, r = 0 AS no_region FROM s")
def index_availability(addr, spark, sf_dir):
    out = stats.availability(stats.country_stats(indexes.tile_index(addr)), indexes.manifest(addr, "2026-03-18.0"))
    return out.select("country", "has_postcode", "has_street", "has_city", "readiness", "no_region")


@query("SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS addresses, CAST(count(*) FILTER (n > 1) AS BIGINT) AS duplicated, max(n) AS most FROM (SELECT full_address, count(*) AS n FROM addr GROUP BY full_address)")
def duplicate_profile(addr, spark, sf_dir):
    return stats.duplicate_profile(addr)


@query(f", t AS ({TILES}), s AS (SELECT country, sum(unique_postcodes) AS p, sum(unique_cities) AS c, count(DISTINCT primary_region) AS r FROM t GROUP BY country), b AS (SELECT country, max(lon) - min(lon) > 100 AS wide FROM addr GROUP BY country) SELECT count(*) FILTER (p > 0) AS has_postcode, count(*) AS has_street, count(*) FILTER (c > 0) AS has_city, count(*) FILTER (wide) AS oversized_box, count(*) FILTER (r = 0) AS no_region FROM s JOIN b USING (country)")
def availability_counts(addr, spark, sf_dir):
    return stats.counts_by_flag(stats.availability(stats.country_stats(indexes.tile_index(addr)), indexes.manifest(addr, "2026-03-18.0")))


@query("SELECT country, city, region, CAST(min(lon) * 1000000 AS INT) AS min_lon_e6, CAST(max(lat) * 1000000 AS INT) AS max_lat_e6, round(CAST(min(lon) * 1000000 AS INT) / 1000000.0 - 0.01, 6) AS min_lon_padded FROM addr GROUP BY country, city, region")
def city_boxes(addr, spark, sf_dir):
    box = F.round(geo.from_e6(F.col("bbox_min_lon_e6"), -0.01), 6).alias("min_lon_padded")
    return indexes.city_index(addr).select("country", "city", "region", F.col("bbox_min_lon_e6").alias("min_lon_e6"), F.col("bbox_max_lat_e6").alias("max_lat_e6"), box)


@query("SELECT street_lower, coalesce(array_to_string(list_sort(list(DISTINCT regexp_replace(number, '-[^-]*$', '')) FILTER (starts_with(number, '1'))), ','), '') AS found FROM addr WHERE country = 'JP' GROUP BY street_lower")
def number_prefix_matches(addr, spark, sf_dir):
    n = indexes.number_index(G.in_tiles(addr, "JP"))
    return n.select("street_lower", F.array_join(F.array_sort(S.number_matches(F.col("numbers"), F.lit("1"), japanese=True, limit=1000)), ",").alias("found"))


@query("SELECT 'street' AS type, street_lower AS label, CAST(count(*) AS INT) AS addr_count FROM addr WHERE country = 'NZ' GROUP BY street_lower UNION ALL SELECT 'postcode', postcode, CAST(count(*) AS INT) FROM addr WHERE country = 'DE' GROUP BY postcode")
def suggestion_union(addr, spark, sf_dir):
    streets = S.suggestion_rows(indexes.street_index(G.in_tiles(addr, "NZ")), "street")
    codes = S.suggestion_rows(indexes.postcode_index(G.in_tiles(addr, "DE")), "postcode")
    return streets.unionByName(codes).select("type", "label", "addr_count")


@query("SELECT street_lower, array_to_string(list_sort(list(DISTINCT number)), ',') AS numbers FROM addr WHERE country = 'US' AND street_lower = (SELECT min(street_lower) FROM addr WHERE country = 'US') GROUP BY street_lower")
def street_numbers(addr, spark, sf_dir):
    us = G.in_tiles(addr, "US")
    first = us.agg(F.min("street_lower")).head()[0]
    return S.street_numbers(indexes.number_index(us), first or "").select("street_lower", F.array_join("numbers", ",").alias("numbers"))


@query("SELECT address_id, CASE WHEN country IN ('US') THEN regexp_matches(postcode, '^[0-9]{5}(-[0-9]{4})?$') WHEN country IN ('DE','FR','ES','IT','MX','FI') THEN regexp_matches(postcode, '^[0-9]{5}$') WHEN country = 'SE' THEN regexp_matches(postcode, '^[0-9]{3} ?[0-9]{2}$') WHEN country = 'PL' THEN regexp_matches(postcode, '^[0-9]{2}-?[0-9]{3}$') WHEN country = 'NL' THEN regexp_matches(postcode, '^[0-9]{4}[a-zA-Z]{0,2}$') WHEN country = 'CA' THEN regexp_matches(postcode, '^[a-zA-Z][0-9][a-zA-Z] ?[0-9][a-zA-Z][0-9]$') WHEN country = 'BR' THEN regexp_matches(postcode, '^[0-9]{5}-?[0-9]{3}$') WHEN country = 'PT' THEN regexp_matches(postcode, '^[0-9]{4}(-[0-9]{3})?$') WHEN country = 'JP' THEN regexp_matches(postcode, '^[0-9]{3}-?[0-9]{4}$') WHEN country IN ('AT','BE','CH','DK','NO','AU') THEN regexp_matches(postcode, '^[0-9]{4}$') ELSE FALSE END AS whole FROM addr")
def whole_postcode(addr, spark, sf_dir):
    return addr.select("address_id", text.whole_postcode(F.col("postcode"), F.col("country")).alias("whole"))


# Reverse geocoding
HAVERSINE = "2 * 6371000 * asin(sqrt(power(sin(radians(lat - {lat}) / 2), 2) + cos(radians({lat})) * cos(radians(lat)) * power(sin(radians(lon - {lon}) / 2), 2)))"
_BOX = geo.radius_box(-20.5, -48.5, 20000)


@query(f"SELECT address_id, country, city, round({HAVERSINE.format(lat='-20.5', lon='-48.5')}, 3) AS distance_m FROM addr WHERE lat BETWEEN {_BOX.min_lat} AND {_BOX.max_lat} AND lon BETWEEN {_BOX.min_lon} AND {_BOX.max_lon} ORDER BY {HAVERSINE.format(lat='-20.5', lon='-48.5')}, address_id LIMIT 10")
def reverse_topk(addr, spark, sf_dir):
    return G.reverse(addr, -20.5, -48.5, 20000).select("address_id", "country", "city", F.round("distance_m", 3).alias("distance_m"))


POINTS = "SELECT CAST(n_nationkey AS BIGINT) AS point_id, n_nationkey * 4 - 48.5 AS lat, n_nationkey * 10 - 118.5 AS lon FROM nation"


def _points(spark, sf_dir):
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.cast("long").alias("point_id"), (k * 4 - 48.5).cast("double").alias("lat"), (k * 10 - 118.5).cast("double").alias("lon"))


@query(f""", p AS ({POINTS}), m AS (SELECT point_id, address_id, 2 * 6371000 * asin(sqrt(power(sin(radians(a.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(a.lat)) * power(sin(radians(a.lon - p.lon) / 2), 2))) AS d
  FROM p JOIN addr a ON a.lat BETWEEN p.lat - 0.3 AND p.lat + 0.3 AND a.lon BETWEEN p.lon - 1.5 AND p.lon + 1.5),
  r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, address_id) AS rank FROM m WHERE d <= 15000) SELECT point_id, CAST(rank AS INT) AS rank, address_id, round(d, 3) AS distance_m FROM r WHERE rank <= 3""")
def reverse_batch_topk(addr, spark, sf_dir):
    return G.reverse_batch(addr, _points(spark, sf_dir), 15000, 3).select("point_id", "rank", "address_id", F.round("distance_m", 3).alias("distance_m"))


_CELL = "(CAST(floor((lat + 90) * 10) AS BIGINT) + dy.v) * 10000 + CAST(floor((lon + 180) * 10) AS BIGINT) + dx.v"


@query(f", t AS ({TILES}), p AS ({POINTS}), o AS (SELECT unnest([-1, 0, 1]) AS v), c AS (SELECT point_id, {_CELL} AS cell FROM p, o dy, o dx), k AS (SELECT point_id, cell, concat('t', CAST(cell // 10000 // 10 AS STRING), 'x', CAST(cell % 10000 // 10 AS STRING)) AS tile FROM c) SELECT DISTINCT point_id, t.country, coalesce(primary_region, '') AS region, t.tile, bucket, address_count FROM k JOIN t ON t.tile = k.tile AND cell_min <= k.cell AND cell_max >= k.cell")
def tile_range_join(addr, spark, sf_dir):
    return G.tiles_at(indexes.tile_index(addr), _points(spark, sf_dir), 1)


@query("SELECT format('{:.6f},{:.6f}', lat, lon) AS point, count(*) AS n, min(address_id) AS first_id FROM addr WHERE country = 'GB' AND lat != 0 AND lon != 0 GROUP BY 1")
def point_groups(addr, spark, sf_dir):
    return G.point_groups(G.in_tiles(addr, "GB")).select("point", "n", F.element_at("members", 1)["address_id"].alias("first_id"))


@query("SELECT k AS h3, lower(to_hex((k & ~(15::BIGINT << 52)) | (4::BIGINT << 52) | ((1::BIGINT << 33) - 1))) AS parent4, CAST((k >> 52) & 15 AS INT) AS resolution FROM (SELECT 599405990164561919 + address_id * 34359738368 AS k FROM addr)")
def h3_parent_bits(addr, spark, sf_dir):
    k = (F.lit(599405990164561919) + F.col("address_id") * 34359738368).alias("h3")
    d = addr.select(k)
    return d.select("h3", geo.hex_name(geo.hex_parent(F.col("h3"), 4)).alias("parent4"), geo.hex_resolution(F.col("h3")).cast("int").alias("resolution"))


# Text functions
_BG = "CASE WHEN length({0}) < 2 THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, length({0})), lambda i: substr(upper({0}), i, 2))) END"
_NAMES = "n AS (SELECT DISTINCT street_lower AS s FROM addr)"


def _jac(x: str, y: str) -> str:
    a, b = _BG.format(x), _BG.format(y)
    return f"(CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END)"


@query(f", {_NAMES} SELECT s, round({_jac('s', chr(39) + 'blue avenue' + chr(39))}, 9) AS score FROM n")
def jaccard_bigrams(addr, spark, sf_dir):
    d = addr.select(F.col("street_lower").alias("s")).distinct()
    return d.select("s", F.round(text.jaccard(F.col("s"), F.lit("blue avenue")), 9).alias("score"))


@query(f""", {_NAMES} SELECT s, round(CASE WHEN s = 'blue b' THEN 100.0 WHEN contains(concat(' ', s, ' '), ' blue b ') THEN 80.0 WHEN starts_with(s, 'blue b') THEN 60 + 1 / length(s) WHEN contains(s, 'blue b') THEN 40.0 ELSE 30 * {_jac("s", "'blue b'")} END, 9) AS score FROM n""")
def suggestion_score(addr, spark, sf_dir):
    d = addr.select(F.col("street_lower").alias("s")).distinct()
    return d.select("s", F.round(text.suggestion_score(F.col("s"), F.lit("Blue B")), 9).alias("score"))


def _fold_sql(c: str) -> str:
    out = c
    for a, b in text.LIGATURES.items():
        out = f"replace({out}, '{a}', '{b}')"
    return f"lower(strip_accents({out}))"


@query(f"SELECT doc_id, md5({_fold_sql('text')}) AS folded FROM documents")
def normalize_text(addr, spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize(F.col("text"))).alias("folded"))


def _values(rows) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({q(lang)}, {q(form)}, {q(','.join(forms))})" for lang, form, forms in rows)


_DICT = [(lang, form, forms) for lang, kind, form, forms in DEFAULT.rows() if kind == "street"]
_LANGS = ", ".join(f"('{cc}', '{lang}', {k})" for cc, langs in LANGUAGES.items() for k, lang in enumerate(langs))
_VAGUE = ", ".join(f"('{lang}', '{t}')" for lang, tokens in DEFAULT.ambiguous.items() for t in sorted(tokens))


@query(f""", d(lang, form, variants) AS (VALUES {_values(_DICT)}), l(country, lang, place) AS (VALUES {_LANGS}), vague(lang, form) AS (VALUES {_VAGUE}),
  t AS (SELECT DISTINCT country, list_extract(string_split(street_lower, ' '), -1) AS tail FROM addr),
  k AS (SELECT t.country, tail, coalesce(l.lang, 'en') AS lang, coalesce(place, 0) AS place FROM t LEFT JOIN l USING (country)),
  v AS (SELECT k.country, tail, place, unnest(string_split(d.variants, ',')) AS v, generate_subscripts(string_split(d.variants, ','), 1) AS i FROM k JOIN d ON d.lang = k.lang AND d.form = tail
        WHERE NOT EXISTS (SELECT 1 FROM k b JOIN vague ON vague.lang = b.lang AND vague.form = b.tail WHERE b.country = k.country AND b.tail = k.tail)),
  o AS (SELECT country, tail, v, min(place * 1000 + i) AS o FROM v WHERE v != tail GROUP BY ALL),
  x AS (SELECT country, tail, string_agg(v, ',' ORDER BY o) AS more FROM o GROUP BY ALL)
  SELECT address_id, list_extract(string_split(street_lower, ' '), -1) AS tail, concat_ws(',', list_extract(string_split(street_lower, ' '), -1), more) AS variants
  FROM addr a LEFT JOIN x ON x.country = a.country AND x.tail = list_extract(string_split(street_lower, ' '), -1)""")
def expand_synonyms(addr, spark, sf_dir):
    t = addr.select("address_id", "country", F.element_at(F.split("street_lower", " "), -1).alias("token"))
    met = t.join(expand_tokens(t, DEFAULT), ["country", "token"])
    return met.select("address_id", F.col("token").alias("tail"), F.array_join("variants", ",").alias("variants"))


@query("SELECT address_id, country, CASE WHEN country IN ('US','CA','AU','NZ','BR','MX','CL','CO','UY','SG','HK','TW','GB','IE') THEN street_lower WHEN regexp_matches(number, '^[0-9]+[a-zA-Z]?$') THEN street_lower ELSE concat(street_lower, ' ', number) END AS q FROM addr")
def extract_street_query(addr, spark, sf_dir):
    first = F.col("country").isin(sorted(text.NUMBER_FIRST))
    typed = F.when(first, F.concat_ws(" ", "number", "street_lower")).otherwise(F.concat_ws(" ", "street_lower", "number"))
    return addr.select("address_id", "country", text.street_query(typed, F.col("country")).alias("q"))


@query("SELECT address_id, country, CASE WHEN country IN ('US','DE','FR','ES','IT','FI') THEN regexp_matches(left(postcode, 4), '^[0-9]{1,5}$') WHEN country = 'CA' THEN regexp_matches(left(postcode, 4), '^[a-zA-Z][0-9][a-zA-Z]?$') WHEN country = 'PL' THEN regexp_matches(left(postcode, 4), '^[0-9]{1,2}(-?[0-9]{0,3})?$') WHEN country = 'NL' THEN regexp_matches(left(postcode, 4), '^[0-9]{1,4}[a-zA-Z]{0,2}$') WHEN country = 'BR' THEN regexp_matches(left(postcode, 4), '^[0-9]{1,5}(-?[0-9]{0,3})?$') WHEN country = 'PT' THEN regexp_matches(left(postcode, 4), '^[0-9]{1,4}(-?[0-9]{0,3})?$') WHEN country = 'JP' THEN regexp_matches(left(postcode, 4), '^[0-9]{1,3}(-?[0-9]{0,4})?$') ELSE regexp_matches(left(postcode, 4), '^[0-9]{1,4}$') END AS partial FROM addr")
def partial_postcode(addr, spark, sf_dir):
    return addr.select("address_id", "country", text.partial_postcode(F.substring("postcode", 1, 4), F.col("country")).alias("partial"))


@query("SELECT address_id, number, CASE WHEN contains(number, '-') THEN regexp_replace(number, '-[^-]*$', '') ELSE number END AS bare, length(street_lower) AS specificity FROM addr WHERE country = 'JP'")
def jp_zone_and_specificity(addr, spark, sf_dir):
    d = addr.where("country = 'JP'")
    return d.select("address_id", "number", text.strip_zone(F.col("number")).alias("bare"), text.specificity(F.col("street_lower")).alias("specificity"))


@query(f", s AS ({STREETS}), c AS (SELECT list(DISTINCT tile) AS ct FROM addr WHERE city = 'BUILDING 1') SELECT country, street_lower, CAST(len(list_intersect(tiles, ct)) AS INT) AS inside, CAST(len(list_filter(tiles, lambda x: NOT list_contains(ct, x))) AS INT) AS outside FROM s, c")
def array_intersect_except(addr, spark, sf_dir):
    tiles = addr.where("city = 'BUILDING 1'").select("tile").distinct().withColumn("here", F.lit(1))
    streets = indexes.street_index(addr).select("country", "street_lower", F.explode_outer("tiles").alias("tile"))
    inside = F.count("here").cast("int")
    return streets.join(tiles, "tile", "left").groupBy("country", "street_lower").agg(inside.alias("inside"), (F.count("tile").cast("int") - inside).alias("outside"))


def _compact_sql(n: str) -> str:
    """One place; of exact halves (a quarter of the unit, the only ones that a double holds and that even rounding lowers) up."""
    units = ((10**9, "B"), (10**6, "M"), (10**3, "K"))
    cases = " ".join(f"WHEN {n} >= {u} AND {n} % {u} = {u // 4} THEN concat({n} // {u}, '.3{c}') WHEN {n} >= {u} THEN format('{{:.1f}}{c}', {n} / {float(u)})" for u, c in units)
    return f"CASE {cases} ELSE CAST({n} AS STRING) END"


@query(f"SELECT address_id, {_compact_sql('address_id')} AS compact, replace(replace(replace(replace(concat('<', street, '>&\"'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS html FROM addr")
def formatting(addr, spark, sf_dir):
    return addr.select("address_id", text.compact(F.col("address_id")).alias("compact"), text.html_escape(F.concat(F.lit("<"), "street", F.lit('>&"'))).alias("html"))


# Parsers, batches and search on normalised text
_TAILS = ("ave", "avenue", "st", "street", "rd", "road")
_SPELLINGS = ", ".join(f"('{cc}', '{t}', '{v}')" for cc in sorted({ADDR[i : i + 2] for i in range(ADDR.index("'USCA") + 1, ADDR.index("'USCA") + 51, 2)}) for t in _TAILS for v in expand_street(cc, t))


@query(f""", sp(country, tail, variant) AS (VALUES {_SPELLINGS}),
  s AS (SELECT DISTINCT country, street_lower FROM addr),
  w AS (SELECT s.country, s.street_lower AS typed, s2.street_lower AS stored FROM s JOIN sp ON sp.country = s.country AND sp.tail = list_extract(string_split(s.street_lower, ' '), -1)
        JOIN s s2 ON s2.country = s.country AND starts_with(s2.street_lower, concat(regexp_replace(s.street_lower, '[^ ]+$', ''), sp.variant)) WHERE s.country != 'JP'),
  m AS (SELECT q.address_id AS query_id, a.address_id, a.full_address, length(a.street_lower) AS n FROM addr q JOIN (SELECT DISTINCT * FROM w) w ON w.country = q.country AND w.typed = q.street_lower
        JOIN addr a ON a.country = q.country AND a.street_lower = w.stored AND a.number = q.number
        UNION ALL SELECT q.address_id, a.address_id, a.full_address, length(a.street_lower) FROM addr q JOIN addr a ON a.country = 'JP' AND split_part(a.number, '-', 1) = split_part(q.number, '-', 2) WHERE q.country = 'JP'),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n, address_id) AS rank FROM m) SELECT query_id, CAST(rank AS INT) AS rank, address_id, full_address FROM r WHERE rank = 1""")
def geocode_batch(addr, spark, sf_dir):
    q = addr.select(F.col("address_id").alias("query_id"), "country", F.when(F.col("country").isin(sorted(text.NUMBER_FIRST - {"BR"})), F.concat_ws(" ", "number", "street")).otherwise(F.concat_ws(" ", "street", "number")).alias("text"))
    return G.geocode_batch(addr, q).select("query_id", "rank", "address_id", "full_address")


_NUMBER = "[0-9]+[a-zA-Z]?"
_SUFFIXES = "|".join(sorted(US_SUFFIXES))


def _parse_sql(cc: str) -> str:
    """The country's rules as patterns over the typed text: postcode out, then house number, then what is left of the street."""
    first = cc in ("US", "CA", "AU", "FR")
    typed = "concat_ws(' ', number, street, postcode)" if first else "concat_ws(' ', street, number, postcode)"
    code = {"US": "[0-9]{5}(?:-[0-9]{4})?", "DE": "[0-9]{5}", "FR": "[0-9]{5}", "ES": "[0-9]{5}", "IT": "[0-9]{5}", "NL": "[0-9]{4}[a-zA-Z]{0,2}", "AU": "[0-9]{4}", "BR": "[0-9]{5}-?[0-9]{3}", "CA": "[a-zA-Z][0-9][a-zA-Z](?: ?[0-9][a-zA-Z][0-9])?", "JP": "[0-9]{3}-?[0-9]{4}"}.get(cc)
    found = f"nullif(regexp_extract(typed, '(?:^| )({code})(?: |$)', 1), '')" if code else "NULL"
    rest = f"trim(regexp_replace(typed, '(?:^| )(?:{code})(?: |$)', ' '))" if code else "typed"
    if first or cc == "GB":  # GB: numbers come first, and typed behind the street one stays in it
        number, street = f"nullif(regexp_extract(rest, '^({_NUMBER}) ', 1), '')", f"regexp_replace(rest, '^{_NUMBER} ', '')"
        if cc == "FR":
            number = f"coalesce({number}, nullif(regexp_extract(rest, ' ({_NUMBER})$', 1), ''))"
        if cc == "US":
            street = f"coalesce(nullif(regexp_extract({street}, '^(?:.* )?(?:{_SUFFIXES})(?: |$)'), ''), {street})"
    elif cc == "JP":  # Latin letters are no street; of dashed digits the second
        number, street = "coalesce(nullif(regexp_extract(rest, '([0-9]+)-([0-9]+)$', 2), ''), nullif(regexp_extract(rest, '([0-9]+)$', 1), ''))", "CAST(NULL AS STRING)"
    else:
        last = "[0-9]+[a-zA-Z]?(?:-[0-9]+[a-zA-Z]?)?" if cc == "DE" else _NUMBER
        number, street = f"nullif(regexp_extract(rest, ' ({last})$', 1), '')", f"regexp_replace(rest, ' {last}$', '')"
    return f", t AS (SELECT address_id, {typed} AS typed FROM addr WHERE country = '{cc}'), p AS (SELECT *, {found} AS postcode, {rest} AS rest FROM t) SELECT address_id, typed, trim({street}) AS street, {number} AS number, CAST(NULL AS STRING) AS unit, postcode FROM p"


def _parse(cc: str):
    def f(addr, spark, sf_dir):
        typed = F.concat_ws(" ", "number", "street", "postcode") if cc in ("US", "CA", "AU", "FR") else F.concat_ws(" ", "street", "number", "postcode")
        d = addr.where(F.col("country") == cc).select("address_id", typed.alias("typed"), F.lit(cc).alias("cc"))
        return d.select("address_id", "typed", parse_column(F.col("typed"), F.col("cc")).alias("a")).select("address_id", "typed", "a.street", "a.number", "a.unit", "a.postcode")

    f.__name__ = f"parse_{cc.lower()}"
    query(_parse_sql(cc))(f)


for _cc in ("US", "CA", "AU", "BR", "DE", "ES", "FR", "IT", "JP", "NL", "GB"):
    _parse(_cc)


def _search_sql(items: str, name: str, query_text: str, variants: list[str], limit: int) -> str:
    """Those with a prefix; if they are fewer than three, those that contain the query too; the largest 2 * limit by similarity."""
    starts = " OR ".join(f"starts_with({_fold_sql(name)}, '{v}')" for v in variants)
    return f""", items AS ({items}), near AS (SELECT * FROM items WHERE {starts}),
  found AS (SELECT * FROM near UNION ALL SELECT * FROM items WHERE (SELECT count(*) FROM near) < 3 AND NOT ({starts}) AND contains({_fold_sql(name)}, '{query_text}') AND {name} NOT IN (SELECT {name} FROM near)),
  largest AS (SELECT *, {_jac(name, "'" + query_text + "'")} AS score FROM found ORDER BY addr_count DESC, pos LIMIT {2 * limit}), best AS (SELECT * FROM largest ORDER BY score DESC, addr_count DESC, pos LIMIT {limit})"""


@query(_search_sql(f"SELECT *, street_lower AS pos FROM ({STREETS}) WHERE country = 'US'", "street_lower", "small ring avenue", ["small ring avenue", "small ring ave", "small ring av"], 15) + " SELECT street_lower, addr_count, primary_city FROM best")
def search_streets(addr, spark, sf_dir):
    s = indexes.street_index(G.in_tiles(addr, "US")).withColumn("pos", F.col("street_lower"))
    return S.search_streets(s, "small ring avenue", "US").select("street_lower", "addr_count", "primary_city")


_CITIES = f"SELECT country, {MERGED} AS city, region, CAST(count(*) AS INT) AS addr_count, concat(country, ' ', {MERGED}, ' ', region) AS pos FROM addr GROUP BY country, {MERGED}, region"


def _cities(addr):
    return indexes.merged_cities(indexes.city_index(addr)).withColumn("pos", F.concat_ws(" ", "country", "city", "region"))


@query(_search_sql(_CITIES, "city", "paris", ["paris"], 20) + " SELECT country, city, addr_count FROM best")
def search_cities(addr, spark, sf_dir):
    return S.search_cities(_cities(addr), "paris").select("country", "city", "addr_count")


@query(_search_sql(_CITIES, "city", "ding 1", ["ding 1"], 20) + " SELECT country, city, addr_count FROM best")
def search_cities_within(addr, spark, sf_dir):
    return S.search_cities(_cities(addr), "ding 1").select("country", "city", "addr_count")


@query("SELECT postcode, CAST(count(*) AS INT) AS addr_count FROM addr WHERE country = 'DE' AND starts_with(upper(postcode), '3') GROUP BY postcode ORDER BY addr_count DESC, postcode LIMIT 15")
def search_postcodes(addr, spark, sf_dir):
    return S.search_postcodes(indexes.postcode_index(G.in_tiles(addr, "DE")).withColumn("pos", F.col("postcode")), "3").select("postcode", "addr_count")


@query("SELECT postcode, CAST(count(*) AS INT) AS addr_count FROM addr WHERE country = 'DE' AND postcode = '31598' GROUP BY postcode")
def narrow_postcode(addr, spark, sf_dir):
    return S.narrow_postcode(indexes.postcode_index(G.in_tiles(addr, "DE")), "315 98").select("postcode", "addr_count")


_SCORE = f"""CASE WHEN street_lower = 'blue b' THEN 100.0 WHEN contains(concat(' ', street_lower, ' '), ' blue b ') THEN 80.0 WHEN starts_with(street_lower, 'blue b') THEN 60 + 1 / length(street_lower) WHEN contains(street_lower, 'blue b') THEN 40.0 ELSE 30 * {_jac("street_lower", "'blue b'")} END"""


@query(f", s AS ({STREETS}) SELECT street_lower AS label, primary_city FROM s WHERE country = 'US' ORDER BY (lower(primary_city) = 'furniture 4' OR list_has_any(tiles, ['t40x60', 't41x61'])) DESC, round({_SCORE}, 9) DESC, street_lower LIMIT 40")
def rank_suggestions(addr, spark, sf_dir):
    items = S.suggestion_rows(indexes.street_index(G.in_tiles(addr, "US")), "street").withColumn("pos", F.col("label"))
    return S.rank_suggestions(items, "blue b", "Furniture 4", ["t40x60", "t41x61"]).limit(40).select("label", "primary_city")


@query(f"SELECT address_id, round({HAVERSINE.format(lat='-20.5', lon='-48.5')}, 3) AS distance_m FROM addr WHERE lat BETWEEN {_BOX.min_lat} AND {_BOX.max_lat} AND lon BETWEEN {_BOX.min_lon} AND {_BOX.max_lon} AND {HAVERSINE.format(lat='-20.5', lon='-48.5')} <= 9000 ORDER BY {HAVERSINE.format(lat='-20.5', lon='-48.5')}, address_id LIMIT 25")
def reverse_within(addr, spark, sf_dir):
    return G.reverse(addr, -20.5, -48.5, 20000, limit=25, max_m=9000).select("address_id", F.round("distance_m", 3).alias("distance_m"))


@query(f", near AS (SELECT country, {MERGED} AS city FROM addr WHERE lat BETWEEN {_BOX.min_lat} AND {_BOX.max_lat} AND lon BETWEEN {_BOX.min_lon} AND {_BOX.max_lon} ORDER BY {HAVERSINE.format(lat='-20.5', lon='-48.5')}, address_id LIMIT 1) SELECT a.country, {MERGED} AS city, CAST(count(*) AS INT) AS addr_count FROM addr a WHERE a.country = (SELECT country FROM near) AND {MERGED} = (SELECT city FROM near) GROUP BY ALL")
def place_of_point(addr, spark, sf_dir):
    return G.place_of(G.reverse(addr, -20.5, -48.5, 20000), indexes.merged_cities(indexes.city_index(addr))).select("country", "city", "addr_count")


@query(f", t AS ({TILES}), s AS (SELECT country, CAST(avg(address_count) AS INT) AS mean, CAST(median(address_count) AS INT) AS half, max(address_count) AS most FROM t GROUP BY country), b AS (SELECT country, max(lon) - min(lon) > 100 AS oversized_box FROM addr GROUP BY country) SELECT country, round(mean / half, 9) AS skew, round(most * 50 / 1024 / 1024, 9) AS estimated_mb, oversized_box FROM s JOIN b USING (country)")
def index_skew(addr, spark, sf_dir):
    out = stats.availability(stats.country_stats(indexes.tile_index(addr)), indexes.manifest(addr, "2026-03-18.0"))
    return out.select("country", F.round("skew", 9).alias("skew"), F.round("estimated_mb", 9).alias("estimated_mb"), "oversized_box")


@query("SELECT address_id, round(lat + 0.00002, 4) AS lat, round(lon + 0.00002, 4) AS lon FROM addr")
def clicked_points(addr, spark, sf_dir):
    lat, lon = geo.clicked(F.col("lat") + 0.00002, F.col("lon") + 0.00002)
    return addr.select("address_id", lat.alias("lat"), lon.alias("lon"))


# Lookups in a written index
_written: dict[tuple[str, str], str] = {}


def catalog(addr, spark: SparkSession, sf_dir: str) -> Catalog:
    """A catalog over the written index of the folder; the index is written on first use, where driver and executors share a folder."""
    import tempfile
    import uuid

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{(shared or tempfile.mkdtemp(prefix='index-')).rstrip('/')}/index-{uuid.uuid4().hex}"
        indexes.write_indexes(addr, root, "2026-03-18.0")
        _written[key] = root
    return Catalog(spark, _written[key])


@query(f"SELECT {P1} FROM addr WHERE country = 'US' AND tile IN ('t40x60', 't41x61') AND street_lower LIKE 'red%'")
def catalog_tiles(addr, spark, sf_dir):
    c = catalog(addr, spark, sf_dir)
    return G.in_tiles(c.addresses(), "US", ["t40x60", "t41x61"]).where(F.col("street_lower").startswith("red")).select(*G.FIELDS)


@query(f", s AS ({STREETS}) SELECT street_lower, addr_count, primary_city FROM s WHERE country = 'US' AND street_lower LIKE 'red%' ORDER BY addr_count DESC, street_lower LIMIT 15")
def catalog_streets(addr, spark, sf_dir):
    return S.suggest_streets(catalog(addr, spark, sf_dir).country_table("streets", "US"), "red").select("street_lower", "addr_count", "primary_city")


@query("SELECT street_lower, array_to_string(list_sort(list(DISTINCT number)), ',') AS numbers FROM addr WHERE country = 'DE' AND street_lower = 'red ring avenue' GROUP BY street_lower")
def catalog_numbers(addr, spark, sf_dir):
    n = catalog(addr, spark, sf_dir).table("number_index").where("country = 'DE'")
    return S.street_numbers(n, "Red Ring Avenue").select("street_lower", F.array_join("numbers", ",").alias("numbers"))


@query("SELECT country, count(*) AS address_count, '2026-03-18.0' AS release_tag FROM addr GROUP BY country")
def catalog_manifest(addr, spark, sf_dir):
    return catalog(addr, spark, sf_dir).globals()["manifest"].select("country", "address_count", "release_tag")


@query("SELECT 'geocoder' AS name, count(*) AS num_rows FROM addr")
def catalog_footers(addr, spark, sf_dir):
    from ..sources.parquet_meta import file_metadata

    return file_metadata(spark, catalog(addr, spark, sf_dir).path("geocoder")).agg(F.sum("num_rows").alias("num_rows")).select(F.lit("geocoder").alias("name"), "num_rows")


@query()
def parquet_footers(addr, spark, sf_dir):
    from ..sources.parquet_meta import column_metadata

    return column_metadata(spark, f"{sf_dir}/nation.parquet").select("name", "type", "compression", "has_bloom", "bytes_per_value")


@query("SELECT user_id, ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC, value DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_user(addr, spark, sf_dir):
    return S.latest_per_session(table(spark, sf_dir, "events"), "user_id", "ts", ["event_type", "value"])
