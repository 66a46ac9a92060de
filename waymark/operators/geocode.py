"""Forward and reverse geocoding, for one query and for tables of queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import DEGREE_M, Box, DegreeGrid, Grid, haversine, in_box, point_key, radius_box
from ..functions.synonyms import DEFAULT, Dictionary
from ..functions.text import check, check_limit, check_number, normalize
from .parsing import Address, parse
from .predicates import address_filter, conditions
from .search import LONGEST

FIELDS = ("full_address", "street", "number", "unit", "city", "region", "postcode", "lat", "lon", "cell")


def in_tiles(addresses: DataFrame, cc: str | None = None, tiles: list[str] | None = None, buckets: list[str] | None = None) -> DataFrame:
    """Partition filters in place of path lists: only the files of these tiles are read."""
    out = addresses if cc is None else addresses.where(F.col("country") == check("country", cc))
    if tiles is not None:
        if not tiles:
            raise ValueError("no tiles")
        out = out.where(F.col("tile").isin(list(tiles)))
    return out if buckets is None else out.where(F.col("bucket").isin([check("bucket", b) for b in buckets]))


def forward(addresses: DataFrame, where, limit: int = 100) -> DataFrame:
    """Addresses that meet a filter; which ones, if more do, is left open, so that the scan can stop early."""
    return addresses.where(where).select(*FIELDS).limit(check_limit(limit, 100_000))


def geocode(addresses: DataFrame, text: str, cc: str, tiles: list[str] | None = None, limit: int = 100, dictionary: Dictionary = DEFAULT, normalized: bool = False) -> DataFrame:
    a: Address = parse(text, check("country", cc))
    return forward(in_tiles(addresses, cc, tiles), address_filter(a, dictionary, normalized), limit)


def narrow_tiles(tiles: list[str], city_tiles: list[str] | None, only_city: bool) -> list[str]:
    """Tiles of a match within the city; where the city is only a preference, the others follow."""
    if city_tiles is None:
        return tiles
    inside = [t for t in tiles if t in set(city_tiles)]
    return inside if only_city else inside + [t for t in tiles if t not in set(city_tiles)]


def asked_for(text: Column, cc: Column, dictionary: Dictionary = DEFAULT, normalized: bool = False) -> Column:
    """The conditions of each text: a struct of prefixes, numbers, postcode. Parsed and expanded in Arrow batches."""

    @F.pandas_udf("prefixes array<string>, numbers array<string>, postcode string")
    def each(texts: pd.Series, codes: pd.Series) -> pd.DataFrame:
        rows = [conditions(parse(t or "", c or ""), dictionary, normalized) for t, c in zip(texts, codes, strict=True)]
        return pd.DataFrame({"prefixes": [r.prefixes for r in rows], "numbers": [r.numbers for r in rows], "postcode": [r.postcode for r in rows]})

    return each(text, cc)


def geocode_batch(addresses: DataFrame, queries: DataFrame, limit: int = 1, streets: DataFrame | None = None, dictionary: Dictionary = DEFAULT, normalized: bool = False) -> DataFrame:
    """The best addresses for many texts: of those that geocode() finds, the shortest streets first, then by id.

    queries: query_id, country, text. streets: country, street_lower (street_norm if normalized), if there is an index.
    Typed streets, in all their spellings, are prefixes of stored ones: they are resolved on the distinct streets, which are
    keyed by their prefixes of the lengths that occur among the queries of the country, and then addresses join on country,
    street and number. All joins are equalities, so a common beginning (a street type) is no hot pair. Texts without a
    street are looked up by postcode or number; of a number alone only the best `limit` of its country are joined. Texts
    that give no street, number or postcode match nothing (geocode() looks for their words instead).
    """
    check_limit(limit, 10_000)
    jp = F.col("country") == "JP"
    norm = F.col("street_norm") if "street_norm" in addresses.columns else normalize(F.col("street_lower"))
    name = F.when(jp, F.col("street_lower")).otherwise(norm) if normalized else F.col("street_lower")
    number = F.when(jp, F.split_part("number", F.lit("-"), F.lit(1))).otherwise(F.col("number"))
    stored = addresses.withColumns({"__name": name, "__num": number, "__code": F.replace(F.lower("postcode"), F.lit(" "), F.lit(""))})
    q = queries.select("query_id", "country", asked_for(F.col("text"), F.col("country"), dictionary, normalized).alias("a")).select("query_id", "country", "a.prefixes", "a.numbers", F.col("a.postcode").alias("code"))

    typed = q.select("query_id", "country", "numbers", "code", F.explode("prefixes").alias("prefix"))
    # % and _ of a typed street are wildcards in stored lower-case ones, as in geocode()
    plain = F.lit(True) if normalized else (F.col("country") == "JP") | ~F.col("prefix").rlike("[%_]")
    stem = F.when(plain, F.col("prefix")).otherwise(F.regexp_extract("prefix", "^[^%_]*", 0))
    typed = typed.withColumn("key", F.substring(stem, 1, LONGEST))
    sizes = typed.select("country", F.length("key").alias("size")).distinct()  # LONGEST rows a country at most
    names = (streets.select("country", F.col("street_norm" if normalized else "street_lower").alias("__name")) if streets is not None else stored.select("country", "__name")).distinct()
    keyed = names.join(F.broadcast(sizes), "country").where(F.length("__name") >= F.col("size")).select("country", "__name", F.substr("__name", F.lit(1), F.col("size")).alias("key"))
    pattern = F.concat(F.replace(F.col("prefix"), F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    starts = F.when(plain, F.startswith("__name", "prefix")).otherwise(F.like("__name", pattern))
    met = typed.select("country", "key", "prefix").distinct().join(keyed, ["country", "key"]).where(starts).select("country", "prefix", "__name")
    wanted = typed.drop("key").join(met, ["country", "prefix"]).select("query_id", "country", "__name", "numbers", "code").distinct()

    same_code = F.col("code").isNull() | (F.col("__code") == F.col("code"))
    exact = wanted.where(F.size("numbers") > 0).withColumn("__num", F.explode("numbers"))
    found = stored.join(exact, ["country", "__name", "__num"]).where(same_code)
    open_ = stored.join(wanted.where(F.size("numbers") == 0), ["country", "__name"]).where(same_code)
    bare = q.where((F.size("prefixes") == 0) & F.col("code").isNotNull()).select("query_id", "country", F.col("code").alias("__code"), "numbers")
    coded = stored.join(bare, ["country", "__code"]).where((F.size("numbers") == 0) | F.array_contains("numbers", F.col("__num")))
    best = Window.partitionBy("country", "__num").orderBy(F.length("__name"), "address_id")
    first = stored.where(F.col("__num").isNotNull()).withColumn("r", F.row_number().over(best)).where(F.col("r") <= limit)
    lone = q.where((F.size("prefixes") == 0) & F.col("code").isNull()).select("query_id", "country", F.explode("numbers").alias("__num"))
    numbered = first.join(lone, ["country", "__num"])
    columns = ["query_id", "address_id", "__name", *FIELDS]
    every = found.select(*columns).unionByName(open_.select(*columns)).unionByName(coded.select(*columns)).unionByName(numbered.select(*columns))
    order = Window.partitionBy("query_id").orderBy(F.length("__name"), "address_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "rank", "address_id", *FIELDS)


def tiles_at(tile_index: DataFrame, points: DataFrame, steps: int = 0, grid: Grid | None = None) -> DataFrame:
    """Tile buckets whose cells may hold a point's surroundings. points: point_id, lat, lon.

    An equi-join on the tile with a range condition on the cell; with rings, each bucket counts once for a point.
    """
    grid = grid or DegreeGrid()
    own = grid.cell(F.col("lat"), F.col("lon"))
    cells = points.select("point_id", F.explode(grid.ring(own, steps) if steps else F.array(own)).alias("cell"))
    keyed = cells.withColumn("tile", grid.tile(F.col("cell")))
    met = keyed.join(tile_index, "tile").where((F.col("cell_min") <= F.col("cell")) & (F.col("cell_max") >= F.col("cell")))
    return met.select("point_id", "country", F.coalesce("primary_region", F.lit("")).alias("region"), "tile", "bucket", "address_count").distinct()


def reverse(addresses: DataFrame, lat: float, lon: float, radius_m: float = 250, limit: int = 10, max_m: float | None = None, box: Box | None = None) -> DataFrame:
    """The nearest addresses within a box, by distance. The box is a range filter of stored columns and reaches the scan."""
    check_number(lat, "lat", -90, 90), check_number(lon, "lon", -180, 180), check_limit(limit, 10_000)
    if max_m is not None and check_number(max_m, "max_m") <= 0:
        raise ValueError(f"max_m is not positive: {max_m!r}")
    near = addresses.where(in_box(F.col("lat"), F.col("lon"), box or radius_box(lat, lon, radius_m)))
    out = near.select(*FIELDS, "country", "address_id", haversine(F.col("lat"), F.col("lon"), lat, lon).alias("distance_m"))
    if max_m is not None:
        out = out.where(F.col("distance_m") <= max_m)
    return out.orderBy("distance_m", "address_id").limit(limit)


def reverse_batch(addresses: DataFrame, points: DataFrame, radius_m: float = 250, k: int = 10) -> DataFrame:
    """The k nearest addresses of every point within radius_m. points: point_id, lat, lon.

    Addresses are put into rows of one radius in height and columns of one radius in width (as wide in degrees as their
    row needs), points into the nine or so of these that their radius touches. So the join is an equality and meets about
    what the radius holds, in a dense town as well. The window keeps k rows a point, and does so before the shuffle too.
    """
    check_number(radius_m, "radius_m", 1e-3), check_limit(k, 10_000)
    d = radius_m / DEGREE_M * 1.002  # a degree of the sphere used for distances is a little longer than DEGREE_M
    edge = lambda row: F.least(F.lit(89.9), F.greatest(F.abs(row * d), F.abs((row + 1) * d)))
    width = lambda row: F.lit(d) / F.cos(F.radians(edge(row)))
    row_of = lambda lat: F.floor(lat / d)
    stored = addresses.withColumn("__row", row_of(F.col("lat"))).withColumn("__col", F.floor(F.col("lon") / width(F.col("__row"))))
    p = points.select("point_id", F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    rows = p.withColumn("__row", F.explode(F.sequence(row_of(F.col("plat") - d), row_of(F.col("plat") + d))))
    # as wide as the radius is at the row's edge that is nearest to a pole
    around = rows.withColumn("__col", F.explode(F.sequence(F.floor((F.col("plon") - width(F.col("__row"))) / width(F.col("__row"))), F.floor((F.col("plon") + width(F.col("__row"))) / width(F.col("__row"))))))
    met = stored.join(around, ["__row", "__col"])
    far = met.withColumn("distance_m", haversine(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))).where(F.col("distance_m") <= radius_m)
    rank = F.row_number().over(Window.partitionBy("point_id").orderBy("distance_m", "address_id"))
    return far.withColumn("rank", rank).where(F.col("rank") <= k).select("point_id", "rank", "address_id", "full_address", "country", "city", "distance_m")


def point_groups(results: DataFrame) -> DataFrame:
    """Results that share a place to six digits: its key, how many, and the members by id. Rows without a place go."""
    placed = results.where("lat is not null and lon is not null and lat != 0 and lon != 0")
    members = F.array_sort(F.collect_list(F.struct("address_id", "full_address")))
    return placed.groupBy(point_key(F.col("lat"), F.col("lon")).alias("point")).agg(F.count("*").alias("n"), members.alias("members"))


def place_of(nearest: DataFrame, cities: DataFrame) -> DataFrame:
    """Country and city row of the nearest result: what a reverse search fills in for the next forward one."""
    from .predicates import city_name

    top = nearest.orderBy("distance_m", "address_id").limit(1).select("country", city_name(F.col("city")).alias("city"))
    return top.join(cities, ["country", "city"], "left").orderBy(F.desc("addr_count")).limit(1)
