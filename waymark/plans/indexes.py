"""The index tables, built from an address table by one grouping each.

Input columns: address_id, full_address, street, street_lower, number, unit, city, region, postcode, country, lat, lon,
tile, cell, bucket. Every index has `country`, so that they can be written partitioned by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import e6
from ..functions.text import normalize


def _count() -> F.Column:
    return F.count("*").cast("int").alias("addr_count")


def _tiles():
    return F.array_sort(F.collect_set("tile")).alias("tiles")


def city_index(addr: DataFrame) -> DataFrame:
    box = [e6(f(c)).alias(f"bbox_{n}_{c}_e6") for c in ("lon", "lat") for n, f in (("min", F.min), ("max", F.max))]
    return addr.where("city is not null").groupBy("country", "city", "region").agg(_tiles(), _count(), *box)


def postcode_index(addr: DataFrame) -> DataFrame:
    centre = [e6(F.avg(c)).alias(f"centroid_{c}_e6") for c in ("lon", "lat")]
    return addr.where("postcode is not null and postcode != ''").groupBy("country", "postcode").agg(_tiles(), _count(), *centre)


def street_index(addr: DataFrame) -> DataFrame:
    """primary_city: the city with the most addresses on the street, of equals the first by name. Two groupings, the
    second of far fewer rows, so a street that many cities share is no hot key."""
    per_city = addr.where("street_lower is not null").groupBy("country", "street_lower", "city").agg(F.count("*").alias("n"), F.collect_set("tile").alias("t"), F.sum("lon").alias("lon"), F.sum("lat").alias("lat"))
    best = F.min_by("city", F.struct(-F.col("n"), F.coalesce("city", F.lit(""))))
    out = per_city.groupBy("country", "street_lower").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("t")))).alias("tiles"),
        F.sum("n").cast("int").alias("addr_count"),
        F.coalesce(best, F.lit("")).alias("primary_city"),
        *[e6(F.sum(c) / F.sum("n")).alias(f"centroid_{c}_e6") for c in ("lon", "lat")],
    )
    return out.withColumn("street_norm", normalize(F.col("street_lower")))


def number_index(addr: DataFrame) -> DataFrame:
    """House numbers of each street. Write with write_number_index, which sorts and filters for lookups of one street."""
    return addr.where("street_lower is not null and number is not null").groupBy("country", "street_lower").agg(F.array_sort(F.collect_set("number")).alias("numbers"))


def tile_index(addr: DataFrame) -> DataFrame:
    per_region = addr.groupBy("country", "tile", "bucket", "region").agg(F.count("*").alias("n"))
    region = per_region.groupBy("country", "tile", "bucket").agg(F.min_by("region", F.struct(-F.col("n"), "region")).alias("primary_region"))
    stats = addr.groupBy("country", "tile", "bucket").agg(
        F.count("*").cast("int").alias("address_count"),
        F.min("cell").alias("cell_min"),
        F.max("cell").alias("cell_max"),
        F.count_distinct("city").cast("int").alias("unique_cities"),
        F.count_distinct("postcode").cast("int").alias("unique_postcodes"),
    )
    return stats.join(region, ["country", "tile", "bucket"])


def manifest(addr: DataFrame, release: str) -> DataFrame:
    box = [f(c).alias(f"bbox_{n}_{c}") for c in ("lon", "lat") for n, f in (("min", F.min), ("max", F.max))]
    return addr.groupBy("country").agg(
        F.count("*").alias("address_count"),
        F.count_distinct("tile").cast("int").alias("tile_count"),
        F.count_distinct("tile", "bucket").cast("int").alias("bucket_count"),
        *box,
        F.lit(release).alias("release_tag"),
    )


def region_index(addr: DataFrame) -> DataFrame:
    box = [f(c).alias(f"bbox_{n}_{c}") for c in ("lon", "lat") for n, f in (("min", F.min), ("max", F.max))]
    return addr.groupBy("country", "region").agg(_tiles(), _count(), *box)


INDEXES = {"city_index": city_index, "postcode_index": postcode_index, "street_index": street_index, "number_index": number_index}


def with_buckets(addr: DataFrame, most: int = 500_000) -> DataFrame:
    """Sets bucket: `_` for tiles of up to `most` addresses, else 01, 02 and so on by a hash of the id, as many as it takes."""
    size = addr.groupBy("country", "tile").agg(F.ceil(F.count("*") / most).alias("__parts"))
    number = F.lpad((F.pmod(F.xxhash64("address_id"), F.col("__parts")) + 1).cast("string"), 2, "0")
    bucket = F.when(F.col("__parts") == 1, F.lit("_")).otherwise(number)
    return addr.drop("bucket").join(size, ["country", "tile"]).withColumn("bucket", bucket).select(*addr.columns)


def write_tiles(addr: DataFrame, root: str) -> None:
    """The address table by country, tile and bucket. A tile's rows go to one task unless it has buckets: that is what
    buckets are for. Rows are sorted by street, so that a prefix touches few row groups."""
    keys = ["country", "tile", "bucket"]
    addr.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "street_lower").write.partitionBy(*keys).parquet(f"{root}/geocoder")


def write_indexes(addr: DataFrame, root: str, release: str, bucket_rows: int = 500_000) -> None:
    """Everything a catalog reads, under root/release=<release>. Tiles of more than bucket_rows addresses get buckets.

    Country tables are dealt out by ranges of country and key, so a large country is many tasks and files, each of which
    holds a range of keys: a lookup reads one of them.
    """
    base = f"{root}/release={release}"
    addr = with_buckets(addr, bucket_rows)
    write_tiles(addr, base)
    for name, build in INDEXES.items():
        key = {"city_index": "city", "postcode_index": "postcode"}.get(name, "street_lower")
        out = build(addr).repartitionByRange("country", key).sortWithinPartitions("country", key)
        writer = out.write.partitionBy("country")
        if name == "number_index":
            # a lookup of one street reads one small row group, and none where the filter says no
            writer = writer.option("parquet.block.size", 1 << 20).option("parquet.bloom.filter.enabled#street_lower", "true")
        writer.parquet(f"{base}/{name}")
    tile_index(addr).write.parquet(f"{base}/tile_index")
    region_index(addr).write.parquet(f"{base}/region_index")
    manifest(addr, release).write.parquet(f"{base}/manifest")


def merged_cities(cities: DataFrame) -> DataFrame:
    """Cities with their districts merged: tiles united, counts summed, boxes joined; missing box sides are 0."""
    from ..operators.predicates import city_name

    side = lambda n, f: F.coalesce(f(n), F.lit(0)).alias(n)
    return (
        cities.withColumn("city", city_name(F.col("city")))
        .groupBy("country", "city", "region")
        .agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("tiles")))).alias("tiles"),
            F.sum("addr_count").cast("int").alias("addr_count"),
            side("bbox_min_lon_e6", F.min),
            side("bbox_max_lon_e6", F.max),
            side("bbox_min_lat_e6", F.min),
            side("bbox_max_lat_e6", F.max),
        )
    )
