"""Parsed addresses to filters over stored ones."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.synonyms import DEFAULT, Dictionary, street_prefixes
from ..functions.text import like_prefix, normalize, normalize_py
from .parsing import Address, chome_spellings


def street_filter(street: str, cc: str | None, dictionary: Dictionary = DEFAULT, column: str = "street_lower") -> Column:
    """Any of the street's spellings as a prefix. Plain prefixes on the stored lower-case column are pushed to the scan."""
    return reduce(or_, (like_prefix(F.col(column), p) for p in street_prefixes(street, cc, dictionary)))


def normalized_street_filter(street: str, cc: str | None, dictionary: Dictionary = DEFAULT) -> Column:
    """The same on street_norm, so that typed and stored accents don't matter."""
    prefixes = dict.fromkeys(normalize_py(p) for p in street_prefixes(normalize_py(street), cc, dictionary))
    return reduce(or_, (F.col("street_norm").startswith(p) for p in prefixes))


def token_filter(tokens: list[str], least: int) -> Column:
    """Every token of that length at least, anywhere in the full address, in either case; without tokens all rows."""
    return reduce(and_, (F.contains(F.lower("full_address"), F.lit(t.lower())) for t in tokens if len(t) >= least), F.lit(True))


def same_postcode(postcode: str) -> Column:
    """Equal but for case and blanks: Canadian codes are typed with one and stored without."""
    bare = "".join(postcode.lower().split())
    return (F.lower("postcode") == bare) | (F.replace(F.lower("postcode"), F.lit(" "), F.lit("")) == bare)


@dataclass(frozen=True)
class Conditions:
    """What a stored address must meet: any of the prefixes, any of the numbers, the postcode; what is empty asks for nothing."""

    prefixes: list[str]
    numbers: list[str]
    postcode: str | None


def conditions(a: Address, dictionary: Dictionary = DEFAULT, normalized: bool = False) -> Conditions:
    """Italian and Japanese data have no postcodes, so those are not asked for. Japanese numbers are first parts of stored ones."""
    if a.cc == "JP":
        return Conditions([s.lower() for s in chome_spellings(a.street)] if a.street else [], a.number_variants or ([a.number] if a.number else []), None)
    street = a.street or ""
    prefixes = street_prefixes(normalize_py(street) if normalized else street, a.cc, dictionary) if street else []
    if normalized:
        prefixes = list(dict.fromkeys(map(normalize_py, prefixes)))
    code = "".join(a.postcode.lower().split()) if a.postcode and a.cc != "IT" else None
    return Conditions(prefixes, [a.number] if a.number else [], code)


def address_filter(a: Address, dictionary: Dictionary = DEFAULT, normalized: bool = False) -> Column:
    """The conditions as a filter; without any, every token of the text is looked for in the full address."""
    c, jp, parts = conditions(a, dictionary, normalized), a.cc == "JP", []
    if c.postcode:
        parts.append(same_postcode(c.postcode))
    if c.prefixes:
        starts = F.col("street_norm" if normalized and not jp else "street_lower")
        parts.append(reduce(or_, (starts.startswith(p) if jp or normalized else like_prefix(starts, p) for p in c.prefixes)))
    if c.numbers:
        parts.append(F.split_part("number", F.lit("-"), F.lit(1)).isin(c.numbers) if jp else F.col("number") == c.numbers[0])
    return reduce(and_, parts) if parts else token_filter(a.tokens, 1 if jp else 2)


def city_name(city: Column) -> Column:
    """Districts of the three French cities count as the city."""
    out = city
    for name in ("Paris", "Lyon", "Marseille"):
        out = F.when(city.like(f"{name} % Arrondissement"), F.lit(name)).otherwise(out)
    return out


def with_norms(df, **columns: str):
    """Adds normalised copies of text columns: with_norms(df, street_norm='street_lower')."""
    return df.withColumns({new: normalize(F.col(old)) for new, old in columns.items()})
