"""Geocoding of streams. Parsing keeps no state; lookups are stream-static joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..operators.parsing import parse_column


def parsed_stream(texts: DataFrame) -> DataFrame:
    """A stream (or table) of query_id, country, text with the parsed fields."""
    return texts.withColumn("a", parse_column(F.col("text"), F.col("country"))).select("*", "a.street", "a.number", "a.unit", "a.postcode").drop("a")


def geocoded_stream(texts: DataFrame, streets: DataFrame) -> DataFrame:
    """Every query with the street index row of its street, if there is one. streets is static and read anew each batch."""
    p = parsed_stream(texts).withColumn("street_norm", normalize(F.col("street")))
    index = streets.select("country", "street_norm", "street_lower", "tiles", "addr_count", "primary_city")
    return p.join(index, ["country", "street_norm"], "left")


def latest_queries(events: DataFrame, session: str, at: str, text: str, delay: str = "10 minutes", gap: str = "1 second") -> DataFrame:
    """The last text of every burst of events of a session; a burst ends where the session is silent for `gap`."""
    burst = F.session_window(at, gap)
    return events.withWatermark(at, delay).groupBy(session, burst.alias("burst")).agg(F.max_by(text, at).alias(text), F.max(at).alias(at))
