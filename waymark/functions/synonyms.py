"""Spellings of street types and directions, by language.

A dictionary is lines of spellings separated by |, the canonical one first; every spelling of a line stands for all of
it. Lines come from the tables below, or from files of the same form in a folder (language/street_types.txt,
directionals.txt, ambiguous_expansions.txt), which are read with Spark.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import check, normalize_py

# Common street types by language.
STREET_TYPES = {
    "en": "avenue|ave|av\nstreet|st\nroad|rd\nboulevard|blvd\ndrive|dr\nlane|ln\ncourt|crt\nplace|pl\ncircle|cir\nterrace|ter\nparkway|pkwy\nhighway|hwy\nsquare|sq\ntrail|trl\nalley|aly",
    "de": "allee|al\nbahnhof|bhf|bf\nboulevard|bd\nbrucke|br|bruecke\nchaussee|ch\nplatz|pl\nsiedlung|sdlg\nstiege|stg\nstrasse|str\nweg|w\ngasse|g",
    "fr": "allee|all\navenue|av|ave\nboulevard|bd|blvd|boul\nchemin|ch|che\ncours|crs\nesplanade|esp\nimpasse|imp\npassage|pass\nplace|pl\nquai|qu\nroute|rte\nrue|r\nruelle|rle\nsquare|sq",
    "es": "avenida|av|avd|avda\ncalle|c|cl\ncamino|cno|cmno\ncarretera|ctra\npaseo|po|pso\nplaza|pl|pza\nronda|rda\ntravesia|trva",
    "it": "corso|c.so|cso\nlargo|lgo\npiazza|p.za|pza\npiazzale|p.le|ple\nstrada|str\nvia|v\nviale|v.le|vle\nvicolo|vic",
    "nl": "dijk|dk\ngracht|gr\nkade|kd\nlaan|ln\nplein|pln\nsingel|sngl\nstraat|str\nweg|wg",
    "pt": "alameda|al\navenida|av\nestrada|est\nlargo|lg\npraca|pc|pca\nrua|r\ntravessa|tv",
    "da": "vej|v\ngade|g\nalle|al",
    "sv": "gatan|g\nvagen|v",
    "nb": "gate|gt|g\nvei|v\nveien|vn",
    "fi": "katu|k\ntie|t",
    "pl": "ulica|ul\naleja|al\nplac|pl\nosiedle|os",
    "cs": "ulice|ul\nnamesti|nam\ntrida|tr",
}
# Directions by language.
DIRECTIONS = {
    "en": "north|n\nsouth|s\neast|e\nwest|w\nnortheast|ne|north east\nnorthwest|nw|north west\nsoutheast|se|south east\nsouthwest|sw|south west",
    "fr": "nord|n\nsud|s\nest|e\nouest|o",
    "es": "norte|n\nsur|s\neste|e\noeste|o",
    "de": "nord|n\nsud|s\nost|o\nwest|w",
}
# Spellings that stand for too much to be expanded.
AMBIGUOUS = {
    "en": "a b c d e f g h i j k l m n o p q r s t u v w x y z ne nw se sw ct no la de al ar",
    "fr": "a c d e l n o r s",
    "es": "a c d e n o s",
    "de": "a d g h k n o s u w",
    "it": "a c v",
    "pt": "a c r",
    "nl": "h l",
    "da": "v g",
    "sv": "v g",
    "nb": "v g",
    "fi": "k t",
}
# Languages of countries, the main one first; elsewhere English.
LANGUAGES = {
    "US": ["en"], "GB": ["en"], "AU": ["en"], "NZ": ["en"], "IE": ["en"], "SG": ["en"], "HK": ["en"], "TW": ["en"],
    "CA": ["en", "fr"], "CH": ["de", "fr", "it"], "BE": ["nl", "fr"], "LU": ["fr", "de"], "FI": ["fi", "sv"],
    "IS": ["is"], "GL": ["da"], "FO": ["da"], "FR": ["fr"], "IT": ["it"], "ES": ["es"], "PT": ["pt"], "RO": ["ro"],
    "DE": ["de"], "AT": ["de"], "LI": ["de"], "NL": ["nl"], "DK": ["da"], "NO": ["nb"], "SE": ["sv"],
    "EE": ["et"], "LT": ["lt"], "LV": ["lv"], "HR": ["hr"], "SI": ["sl"], "RS": ["sr"],
    "PL": ["pl"], "CZ": ["cs"], "SK": ["sk"], "HU": ["hu"],
    "BR": ["pt"], "MX": ["es"], "CL": ["es"], "CO": ["es"], "UY": ["es"], "JP": ["ja"],
}


def languages_of(cc: str) -> list[str]:
    return LANGUAGES.get(check("country", cc), ["en"])


def normalize_token(token: str) -> str:
    return normalize_py(token).strip()


def parse_lines(lines: list[str]) -> list[list[str]]:
    """Groups of spellings: comments and blanks go, spellings are normalised, each stands once."""
    out = []
    for line in lines:
        forms = list(dict.fromkeys(f for f in (normalize_token(x) for x in line.split("#")[0].split("|")) if f))
        if forms:
            out.append(forms)
    return out


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """parse_lines over text files: canonical, variants. Normalisation of accents is left to the expression `normalize`."""
    from .text import normalize

    raw = spark.read.text(path).select(F.regexp_replace("value", "#.*$", "").alias("line"))
    forms = F.array_distinct(F.filter(F.transform(F.split("line", r"\|"), lambda x: F.trim(normalize(x))), lambda x: x != ""))
    rows = raw.select(forms.alias("forms")).where(F.size("forms") > 0)
    return rows.select(F.element_at("forms", 1).alias("canonical"), F.slice("forms", 2, 1 << 20).alias("variants")).dropDuplicates(["canonical"])


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Dictionary files in JSON, {"entries": [{"canonical": ..., "variants": [...]}]}: canonical, variants, as read_lines gives them."""
    from .text import normalize

    raw = spark.read.schema("entries array<struct<canonical:string,variants:array<string>>>").option("multiLine", True).json(path)
    e = raw.select(F.explode("entries").alias("e")).select(F.concat(F.array("e.canonical"), F.coalesce("e.variants", F.array().cast("array<string>"))).alias("forms"))
    clean = e.select(F.array_distinct(F.filter(F.transform("forms", lambda x: F.trim(normalize(x))), lambda x: x != "")).alias("forms")).where(F.size("forms") > 0)
    return clean.select(F.element_at("forms", 1).alias("canonical"), F.slice("forms", 2, 1 << 20).alias("variants")).dropDuplicates(["canonical"])


@dataclass
class Dictionary:
    """Spellings by language. expand() gives what one token may also be written as."""

    streets: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    directions: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    ambiguous: dict[str, set[str]] = field(default_factory=dict)

    @staticmethod
    def _closed(groups: list[list[str]]) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for forms in groups:
            for f in forms:
                out[f] = list(dict.fromkeys([*out.get(f, []), *forms]))
        return out

    @classmethod
    def of(cls, streets: dict[str, str], directions: dict[str, str], ambiguous: dict[str, str]) -> "Dictionary":
        groups = lambda tables: {lang: cls._closed(parse_lines(text.split("\n"))) for lang, text in tables.items()}
        return cls(groups(streets), groups(directions), {lang: {normalize_token(t) for t in text.split()} for lang, text in ambiguous.items()})

    def expand(self, kind: str, cc: str, token: str) -> list[str]:
        """The normalised token, then its other spellings; alone if a language of the country calls it ambiguous."""
        t, langs = normalize_token(token), languages_of(cc)
        if not t:
            return []
        if any(t in self.ambiguous.get(lang, ()) for lang in langs):
            return [t]
        tables = self.streets if kind == "street" else self.directions
        return list(dict.fromkeys([t, *(s for lang in langs for s in tables.get(lang, {}).get(t, []))]))

    @classmethod
    def from_groups(cls, streets: dict[str, list[list[str]]], directions: dict[str, list[list[str]]] | None = None, ambiguous: dict[str, list[str]] | None = None) -> "Dictionary":
        """From groups of spellings by language, as collected from read_lines or read_entries."""
        closed = lambda tables: {lang: cls._closed([[normalize_token(f) for f in g] for g in groups]) for lang, groups in (tables or {}).items()}
        return cls(closed(streets), closed(directions), {lang: {normalize_token(t) for t in ts} for lang, ts in (ambiguous or {}).items()})

    def rows(self) -> list[tuple[str, str, str, list[str]]]:
        """lang, kind, form, variants: the dictionary as a table, for joins with many tokens."""
        return [(lang, kind, form, forms) for kind, tables in (("street", self.streets), ("direction", self.directions)) for lang, table in tables.items() for form, forms in table.items()]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), "lang string, kind string, form string, variants array<string>")


DEFAULT = Dictionary.of(STREET_TYPES, DIRECTIONS, AMBIGUOUS)


def expand_street(cc: str, token: str, dictionary: Dictionary = DEFAULT) -> list[str]:
    return dictionary.expand("street", cc, token)


def expand_direction(cc: str, token: str, dictionary: Dictionary = DEFAULT) -> list[str]:
    return dictionary.expand("direction", cc, token)


def expand_tokens(tokens: DataFrame, dictionary: Dictionary = DEFAULT, kind: str = "street") -> DataFrame:
    """Dictionary.expand for many tokens: country, token, variants. Tokens are taken as normalised.

    Languages of countries, ambiguous tokens and spellings are joined as tables (spellings by an equality of language and
    form), and each distinct pair of country and token is expanded once.
    """
    spark = tokens.sparkSession
    known = spark.createDataFrame([(cc, lang, k) for cc, langs in LANGUAGES.items() for k, lang in enumerate(langs)], "country string, lang string, place int")
    vague = spark.createDataFrame([(lang, t, True) for lang, ts in dictionary.ambiguous.items() for t in sorted(ts)], "lang string, token string, vague boolean")
    forms = dictionary.table(spark).where(F.col("kind") == kind).select("lang", F.col("form").alias("token"), "variants")
    each = tokens.select("country", "token").distinct().join(F.broadcast(known), "country", "left").withColumns({"lang": F.coalesce("lang", F.lit("en")), "place": F.coalesce("place", F.lit(0))})
    met = each.join(forms, ["lang", "token"], "left").join(vague, ["lang", "token"], "left")
    spelled = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("variants").isNotNull(), F.struct("place", "variants")))), lambda x: x["variants"]))
    out = met.groupBy("country", "token").agg(F.bool_or("vague").alias("vague"), spelled.alias("more"))
    alone = F.array("token")
    return out.select("country", "token", F.when(F.col("vague"), alone).otherwise(F.array_distinct(F.concat(alone, "more"))).alias("variants"))


def street_prefixes(street: str, cc: str | None, dictionary: Dictionary = DEFAULT) -> list[str]:
    """Lower-case prefixes that a stored street may have for a typed one: its type is expanded, else its leading direction."""
    from .text import NUMBER_FIRST

    base = street.lower()
    t = base.split()
    if not cc or not t:
        return [base]
    tails = expand_street(cc, t[-1], dictionary)
    if len(tails) > 1:
        return list(dict.fromkeys(" ".join([*t[:-1], v]) for v in tails))
    if cc in NUMBER_FIRST and len(t) > 1:
        heads = expand_direction(cc, t[0], dictionary)
        if len(heads) > 1:
            return list(dict.fromkeys(" ".join([v, *t[1:]]) for v in heads))
    return [base]
