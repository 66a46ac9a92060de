"""Statistics of an index release: what the status and benchmark views show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Size classes of tiles, by addresses above.
SIZE_CLASSES = ((1_000_000, ">1M"), (500_000, "500K-1M"), (100_000, "100K-500K"), (50_000, "50K-100K"), (10_000, "10K-50K"), (1_000, "1K-10K"))


def size_class(n: Column) -> tuple[Column, Column]:
    """Label and sort key, the largest class first."""
    label, key = F.lit("<1K"), F.lit(len(SIZE_CLASSES) + 1)
    for i, (above, name) in reversed(list(enumerate(SIZE_CLASSES, 1))):
        label, key = F.when(n > above, F.lit(name)).otherwise(label), F.when(n > above, F.lit(i)).otherwise(key)
    return label, key


def country_stats(tiles: DataFrame) -> DataFrame:
    n = F.col("address_count")
    return tiles.groupBy("country").agg(
        F.count("*").cast("int").alias("tiles"),
        F.sum(n).alias("addresses"),
        F.bround(F.avg(n)).cast("int").alias("avg_addr"),
        F.bround(F.median(n)).cast("int").alias("median_addr"),
        F.max(n).alias("max_addr"),
        F.min(n).alias("min_addr"),
        F.sum("unique_cities").alias("total_cities"),
        F.sum("unique_postcodes").alias("total_postcodes"),
        F.count_distinct(F.when(F.col("primary_region") != "", F.col("primary_region"))).cast("int").alias("regions"),
    )


def histogram(tiles: DataFrame) -> DataFrame:
    label, key = size_class(F.col("address_count"))
    return tiles.groupBy(label.alias("label"), key.alias("sort_key")).agg(F.count("*").cast("int").alias("tiles"), F.sum("address_count").alias("addresses"))


def top_values(addr: DataFrame, column: str, n: int = 15) -> DataFrame:
    """The n commonest values; a top-k report, ties by value."""
    c = F.col(column)
    return addr.where(c.isNotNull() & (c != "")).groupBy(c.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def tile_rollup(tiles: DataFrame) -> DataFrame:
    """Tiles over their buckets; country and region of the first bucket by name."""
    return tiles.groupBy("tile").agg(
        F.sum("address_count").alias("address_count"),
        F.sum("unique_cities").alias("unique_cities"),
        F.sum("unique_postcodes").alias("unique_postcodes"),
        F.count("*").cast("int").alias("buckets"),
        F.min_by("country", F.struct("bucket", "country")).alias("country"),
        F.coalesce(F.min_by("primary_region", F.struct("bucket", "country")), F.lit("-")).alias("region"),
    )


def totals(manifest: DataFrame) -> DataFrame:
    m = F.col("address_count")
    return manifest.agg(F.sum(m).alias("addresses"), F.sum("tile_count").alias("tiles"), F.max(m).alias("max_addresses"), F.max_by("country", F.struct(m, "country")).alias("largest"), F.count("*").alias("countries"))


def availability(stats: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per country what can be searched, oddities and skew."""
    joined = manifest.join(stats.drop("tiles", "addresses"), "country", "left")
    has_postcode, has_city = F.coalesce(F.col("total_postcodes") > 0, F.lit(False)), F.coalesce(F.col("total_cities") > 0, F.lit(False))
    skew = F.when(F.col("median_addr") > 0, F.col("avg_addr") / F.col("median_addr"))
    return joined.select(
        "country",
        "address_count",
        has_postcode.alias("has_postcode"),
        F.lit(True).alias("has_street"),
        has_city.alias("has_city"),
        F.when(has_postcode & has_city, F.lit("Full")).when(has_city, F.lit("Street + City")).otherwise(F.lit("Fallback")).alias("readiness"),
        (F.col("bbox_max_lon") - F.col("bbox_min_lon") > 100).alias("oversized_box"),
        (F.coalesce("regions", F.lit(0)) == 0).alias("no_region"),
        skew.alias("skew"),
        (F.col("max_addr") * 50 / 1024 / 1024).alias("estimated_mb"),
    )


def counts_by_flag(available: DataFrame) -> DataFrame:
    return available.agg(*[F.count_if(c).alias(c) for c in ("has_postcode", "has_street", "has_city", "oversized_box", "no_region")])


def sample(addr: DataFrame, n: int = 10, seed: int | None = None) -> DataFrame:
    """n rows at random: a sampling operator. Every row draws a number, the smallest n are taken."""
    return addr.withColumn("__r", F.rand(seed)).orderBy("__r").limit(n).drop("__r")


def duplicate_profile(addr: DataFrame) -> DataFrame:
    """How often full addresses repeat, as where units are left out of them."""
    per = addr.groupBy("full_address").agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("rows"), F.count("*").alias("addresses"), F.count_if(F.col("n") > 1).alias("duplicated"), F.max("n").alias("most"))
