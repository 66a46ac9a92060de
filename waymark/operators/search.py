"""Search of index tables: autocomplete, narrowing, similarity ranking.

Functions on one query take plain strings and give DataFrames (top-k plans); *_batch take a table of queries and rank
within each by a window. `pos`, the order of the index, breaks ties where the ranking is by order of appearance.
"""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.synonyms import DEFAULT, Dictionary, expand_street
from ..functions.text import DIGITS, check_limit, jaccard, jaccard_py, like_prefix, normalize, normalize_py, partial_postcode_py, specificity_py, strip_zone, street_query_py, suggestion_score, suggestion_score_py
from .parsing import Address, parse
from .predicates import same_postcode, street_filter

READY_SPECIFICITY = 4


class SearchCache:
    """The most recently used results, forgotten after a time. Keys differ neither by case nor by outer blanks."""

    def __init__(self, size: int = 100, ttl_s: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.size, self.ttl_s, self.clock, self._held = size, ttl_s, clock, OrderedDict()

    def get(self, key: str) -> Any | None:
        k = key.lower().strip()
        if k not in self._held:
            return None
        value, at = self._held[k]
        if self.clock() - at > self.ttl_s:
            del self._held[k]
            return None
        self._held.move_to_end(k)
        return value

    def set(self, key: str, value: Any) -> None:
        k = key.lower().strip()
        self._held.pop(k, None)
        while len(self._held) >= self.size:
            self._held.popitem(last=False)
        self._held[k] = (value, self.clock())

    def clear(self) -> None:
        self._held.clear()


@dataclass
class Classification:
    raw: str
    cc: str
    parsed: Address
    street_query: str
    has_postcode: bool
    has_number: bool
    mode: str  # street, postcode, mixed, ready


def classify(text: str, cc: str) -> Classification:
    """What the text so far asks for. A street with a number is ready once the street is specific enough."""
    raw = text.strip()
    if not raw:
        return Classification(raw, cc, Address(raw, cc), "", False, False, "ready")
    a = parse(raw, cc)
    street = a.street if a.street and a.number else street_query_py(raw, cc)
    if a.street and a.number and specificity_py(a.street) >= READY_SPECIFICITY:
        mode = "ready"
    elif a.postcode:
        mode = "postcode"
    elif partial_postcode_py(raw, cc):
        mode = "mixed" if len(street) >= 2 and street != raw else "postcode"
    elif DIGITS.match(raw):
        mode = "mixed"
    else:
        mode = "street"
    return Classification(raw, cc, a, street, bool(a.postcode), bool(a.number), mode)


def _boost(tiles: list[str] | None) -> list[Column]:
    return [F.desc(F.arrays_overlap("tiles", F.array(*[F.lit(t) for t in tiles])))] if tiles else []


def suggest_streets(streets: DataFrame, query: str, city_tiles: list[str] | None = None, limit: int = 15) -> DataFrame:
    """Streets by prefix, those of the city first, then by size."""
    return streets.where(like_prefix(F.col("street_lower"), query.lower())).orderBy(*_boost(city_tiles), F.desc("addr_count"), "street_lower").limit(limit)


def suggest_postcodes(postcodes: DataFrame, query: str, city_tiles: list[str] | None = None, limit: int = 15) -> DataFrame:
    return postcodes.where(like_prefix(F.lower("postcode"), query.lower())).orderBy(*_boost(city_tiles), F.desc("addr_count"), "postcode").limit(limit)


def narrow_postcode(postcodes: DataFrame, postcode: str) -> DataFrame:
    return postcodes.where(same_postcode(postcode)).orderBy(F.desc("addr_count"), "postcode").limit(1)


def narrow_street(streets: DataFrame, street: str, cc: str, exact: bool, dictionary: Dictionary = DEFAULT) -> DataFrame:
    """The street itself, or the largest that one of its spellings is a prefix of."""
    where = F.col("street_lower") == street.lower() if exact else street_filter(street, cc, dictionary)
    return streets.where(where).orderBy(F.desc("addr_count"), "street_lower").limit(1)


def house_numbers(addresses: DataFrame, street: str, prefix: str, limit: int = 15) -> DataFrame:
    """Distinct numbers of a street by prefix, in text order, nulls last."""
    found = addresses.where((F.col("street_lower") == street.lower()) & like_prefix(F.col("number"), prefix))
    return found.select("number", "street", "city", "postcode").distinct().orderBy(*[F.asc_nulls_last(c) for c in ("number", "city", "postcode")]).limit(check_limit(limit, 10000))


def number_matches(numbers: Column, prefix: Column, japanese: bool = False, limit: int = 10) -> Column:
    """Of an array of house numbers those with the prefix, in stored order, each once; Japanese ones without their zone."""
    bare = F.transform(numbers, strip_zone) if japanese else numbers
    return F.slice(F.array_distinct(F.filter(bare, lambda n: F.startswith(F.lower(n), F.lower(prefix)))), 1, limit)


def street_numbers(number_index: DataFrame, street: str) -> DataFrame:
    return number_index.where(F.col("street_lower") == street.lower()).limit(1)


def query_variants(cc: str | None, query: str, dictionary: Dictionary = DEFAULT) -> list[str]:
    """A normalised query with its last word expanded; the query as typed comes first."""
    t = query.split()
    if not cc or not t:
        return [query]
    out = [" ".join([*t[:-1], v]) for v in expand_street(cc, t[-1], dictionary)]
    return list(dict.fromkeys([query, *out] if query not in out else out)) if len(out) > 1 else [query]


def _ranked(found: DataFrame, name: str, query: str, limit: int) -> DataFrame:
    """The largest 2 * limit, by similarity to the query as typed; equals keep the order of size, then of pos."""
    largest = found.orderBy(F.desc("addr_count"), "pos").limit(2 * limit)
    if len(query) < 2:
        return largest.limit(limit)
    return largest.orderBy(F.desc(jaccard(F.lit(query), F.col(name))), F.desc("addr_count"), "pos").limit(limit)


def _prefix_or_contains(items: DataFrame, norm: Column, prefixes: list[str], query: str, same: str) -> DataFrame:
    """Rows with one of the prefixes; if they are fewer than three, also those that contain the query.

    Whether they are fewer is a small job of its own, which reads until it has three.
    """
    starts = F.lit(False)
    for p in prefixes:
        starts = starts | norm.startswith(p)
    found = items.where(starts)
    if found.limit(3).count() == 3:
        return found
    names = found.select(F.col(same).alias("__same"))  # two at most
    return found.unionByName(items.where(~starts & F.contains(norm, F.lit(query))).join(names, F.col(same) == F.col("__same"), "left_anti"))


def search_streets(streets: DataFrame, query: str, cc: str | None = None, limit: int = 15, dictionary: Dictionary = DEFAULT) -> DataFrame:
    """Streets by any spelling of the query, on normalised text. streets: street_lower, addr_count, pos, and street_norm if it is stored."""
    q = normalize_py(query)
    norm = F.col("street_norm") if "street_norm" in streets.columns else normalize(F.col("street_lower"))
    return _ranked(_prefix_or_contains(streets, norm, query_variants(cc, q, dictionary), q, "street_lower"), "street_lower", query, limit)


def search_cities(cities: DataFrame, query: str, limit: int = 20) -> DataFrame:
    q = normalize_py(query)
    norm = F.col("city_norm") if "city_norm" in cities.columns else normalize(F.col("city"))
    return _ranked(_prefix_or_contains(cities, norm, [q], q, "city"), "city", query, limit)


def search_postcodes(postcodes: DataFrame, query: str, limit: int = 15) -> DataFrame:
    return postcodes.where(F.startswith(F.upper("postcode"), F.lit(query.upper()))).orderBy(F.desc("addr_count"), "pos").limit(limit)


def rank_by_similarity(items: list, query: str, text: Callable[[Any], str]) -> list:
    return items if len(items) <= 1 or len(query) < 2 else sorted(items, key=lambda x: -jaccard_py(query, text(x)))


def rank_suggestions(items: DataFrame, query: str, city: str | None, city_tiles: list[str] | None) -> DataFrame:
    """By score; with a city, its suggestions (by name, or by a shared tile) come first. items: label, primary_city, tiles, pos."""
    score = suggestion_score(F.col("label"), F.lit(query))
    order = [F.desc(score), F.asc("pos")]
    if city:
        named = F.lower("primary_city") == city.lower()
        near = F.arrays_overlap("tiles", F.array(*[F.lit(t) for t in city_tiles])) if city_tiles else F.lit(False)
        order = [F.desc(F.coalesce(named, F.lit(False)) | F.coalesce(near, F.lit(False))), *order]
    return items.orderBy(*order)


def _rank_rows(rows: list[dict], query: str, city: str | None, tiles: set[str] | None) -> list[dict]:
    def home(r: dict) -> bool:
        return bool(city) and ((r.get("primary_city") or "").lower() == city.lower() or bool(tiles and tiles & set(r.get("tiles") or ())))

    return rows if len(rows) <= 1 else sorted(rows, key=lambda r: (not home(r), -suggestion_score_py(r["label"], query)))


def resolve_tiles(suggestion: dict | None, city: dict | None, city_tiles: set[str] | None) -> tuple[list[str], str]:
    """Where to look: the suggestion's tiles within the city if there are such, else all of them, else the city's."""
    if suggestion:
        tiles = list(suggestion.get("tiles") or [])
        inside = [t for t in tiles if t in city_tiles] if city and city_tiles else []
        return (inside, f"{suggestion['type']} within city") if inside else (tiles, f"{suggestion['type']} {suggestion['label']}")
    if city and city_tiles is not None:
        return sorted(city_tiles), f"city {city['city']}"
    return [], "none"


class Lookups(Protocol):
    """Where suggest() gets rows from; each gives dicts of type, label, tiles, addr_count, primary_city."""

    def postcodes(self, cc: str, query: str, city_tiles: list[str]) -> list[dict]: ...
    def streets(self, cc: str, query: str, city_tiles: list[str]) -> list[dict]: ...
    def addresses(self, cc: str, street: str, number: str, tiles: list[str]) -> list[dict]: ...


def suggest(text: str, cc: str, city: str | None, city_tiles: set[str] | None, lookups: Lookups, cache: SearchCache) -> tuple[Classification, list[dict]]:
    """Suggestions for a text that is being typed. The cache is by country, city and text."""
    c = classify(text, cc)
    if len(c.raw) < 2 or c.mode == "ready" and not (c.parsed.street and c.parsed.number):
        return c, []
    tiles = sorted(city_tiles or ())
    key = f"{cc}:{c.mode == 'ready'}:{city or ''}:{','.join(tiles)}:{c.raw}"
    rows = cache.get(key)
    if rows is None:
        if c.mode == "ready":
            rows = _ready(c, cc, city_tiles, tiles, lookups)
            if not rows:
                return c, []
        else:
            rows = lookups.postcodes(cc, c.parsed.postcode or c.raw, tiles) if c.mode in ("postcode", "mixed") else []
            street = c.street_query if len(c.street_query) >= 2 else c.raw
            rows = rows + (lookups.streets(cc, street, tiles) if c.mode in ("street", "mixed") else [])
        cache.set(key, rows)
    return c, rows if c.mode == "ready" else _rank_rows(rows, c.street_query or c.raw, city, city_tiles)


def _ready(c: Classification, cc: str, city_tiles: set[str] | None, tiles: list[str], lookups: Lookups) -> list[dict]:
    streets = lookups.streets(cc, c.parsed.street, tiles)
    if not streets:
        return []
    best = streets[0]
    inside = [t for t in best.get("tiles") or [] if city_tiles and t in city_tiles]
    found = lookups.addresses(cc, c.parsed.street, c.parsed.number, inside or list(best.get("tiles") or []))
    return found or [best | {"type": "address", "label": f"{best['label']} {c.parsed.number}"}]


def suggestion_rows(df: DataFrame, kind: str) -> DataFrame:
    """Index rows as suggestions: type, label, tiles, addr_count, primary_city."""
    label = {"street": "street_lower", "postcode": "postcode", "address": "number"}[kind]
    city = F.col("primary_city") if "primary_city" in df.columns else F.lit(None).cast("string")
    return df.select(F.lit(kind).alias("type"), F.col(label).alias("label"), "tiles", "addr_count", city.alias("primary_city"))


LONGEST = 100  # letters of a key; the rest of a longer prefix is compared after the join


def suggest_streets_batch(streets: DataFrame, queries: DataFrame, limit: int = 15) -> DataFrame:
    """The top streets of many queries. queries: query_id, country, query.

    Streets are keyed by their prefixes of the lengths that occur among the queries, so the join is an equality of country
    and prefix. The top of a prefix is found once, however many queries ask for it, and a prefix that many streets
    share (a street type) is cut to `limit` rows before it is shuffled to one task.
    """
    q = queries.select("query_id", "country", F.lower("query").alias("prefix")).where(F.length("prefix") >= 1).withColumn("key", F.substring("prefix", 1, LONGEST))
    lengths = sorted(r["n"] for r in q.select(F.length("key").alias("n")).distinct().collect())  # LONGEST rows at most
    sizes = F.array(*map(F.lit, lengths)).cast("array<int>")
    keyed = streets.withColumn("n", F.explode(F.filter(sizes, lambda n: n <= F.length("street_lower")))).withColumn("key", F.substr("street_lower", F.lit(1), F.col("n")))
    asked = keyed.join(q.select("country", "key", "prefix").distinct(), ["country", "key"]).where(F.startswith("street_lower", "prefix"))
    rank = F.row_number().over(Window.partitionBy("country", "prefix").orderBy(F.desc("addr_count"), "street_lower"))
    top = asked.withColumn("rank", rank).where(F.col("rank") <= limit)
    return q.join(top, ["country", "prefix"]).select("query_id", "rank", "street_lower", "tiles", "addr_count", "primary_city")


def latest_per_session(events: DataFrame, session: str, at: str, columns: list[str]) -> DataFrame:
    """The last row of each session: what a burst of keystrokes comes to. No window, one aggregate."""
    last = F.max_by(F.struct(*columns), F.struct(at, *columns)).alias("last")
    return events.groupBy(session).agg(F.max(at).alias(at), last).select(session, at, "last.*")
