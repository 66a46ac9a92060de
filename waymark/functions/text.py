"""Text expressions. All are built from built-in functions, so they stay in generated code and need no Python worker.

Each has a counterpart on plain strings, suffixed _py, for values that the driver handles (a query typed by a user).
"""

from __future__ import annotations

import re
import unicodedata
from decimal import ROUND_HALF_UP, Decimal
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that have no decomposition, and what they are searched as.
LIGATURES = {"ß": "ss", "ẞ": "ss", "ø": "o", "Ø": "o", "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe", "đ": "d", "Đ": "d", "ł": "l", "Ł": "l"}
MARKS = range(0x300, 0x370)


def normalize_py(text: str) -> str:
    """Compatibility decomposition without combining marks, ligatures spelled out, lower case."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if ord(c) not in MARKS)
    return "".join(LIGATURES.get(c, c) for c in bare).lower()


def _folded(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if ord(x) not in MARKS)


@cache
def _translation() -> tuple[str, str]:
    """Characters of the basic plane that fold to one other character, and those; marks fold to nothing, at the end."""
    source, target = [], []
    for code in range(0x80, 0x10000):
        if 0xD800 <= code < 0xE000 or code in MARKS:
            continue
        c = chr(code)
        if len(f := _folded(c)) == 1 and f != c:
            source.append(c)
            target.append(f)
    return "".join(source) + "".join(map(chr, MARKS)), "".join(target)


@cache
def _expansions() -> tuple[tuple[str, str], ...]:
    """Characters that fold to several, without Hangul syllables (their parts are a rule of their own)."""
    out = []
    for code in range(0x80, 0x10000):
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xD7A4 or code in MARKS:
            continue
        if len(f := _folded(chr(code))) > 1:
            out.append((chr(code), f))
    return tuple(out)


#: The expansions that occur in addresses, beside those of kana; a chain of replacements for all of them would cost more than it finds.
COMMON = "ﬀﬁﬂﬃﬄﬅﬆĳĲŉǆǅǄǉǈǇǌǋǊ½¼¾…№℡™㎡"


def normalize(text: Column) -> Column:
    """normalize_py as an expression: one translate for characters that fold to one, replacements for the others.

    Exact for text whose multi-character foldings are kana or in COMMON or LIGATURES, and without Hangul.
    """
    source, target = _translation()
    rare = {c: f for c, f in _expansions() if c in COMMON or "\u3040" <= c <= "\u30ff"}
    plain = F.octet_length(text) == F.length(text)
    folded = _let(F.translate(text, source, target), lambda t: _let(_spelled(t, LIGATURES), lambda u: _spelled(u, rare)))
    return F.lower(F.when(plain, text).otherwise(folded))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spelled(text: Column, spellings: dict[str, str]) -> Column:
    """The replacements, for text that needs one. They are a fold over a literal array: the code of a chain grows too large."""
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(f).alias("f")) for c, f in spellings.items()])
    odd = text.rlike("[" + "".join(spellings) + "]")
    return F.when(odd, F.aggregate(pairs, text, lambda acc, p: F.replace(acc, p["c"], p["f"]))).otherwise(text)


def bigrams_py(text: str) -> set[str]:
    s = text.upper()
    return {s[i : i + 2] for i in range(len(s) - 1)}


def jaccard_py(a: str, b: str) -> float:
    x, y = bigrams_py(a), bigrams_py(b)
    return 1.0 if not x and not y else len(x & y) / len(x | y)


def bigrams(text: Column) -> Column:
    s = F.upper(text)
    pairs = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substr(s, i, F.lit(2)))
    return F.when(F.length(s) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


def jaccard(a: Column, b: Column) -> Column:
    """Shared bigrams over all bigrams, upper-cased; 1 if neither text has any."""
    x, y = bigrams(a), bigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def suggestion_score_py(label: str, query: str) -> float:
    l, q = label.lower(), query.lower()
    if l == q:
        return 100.0
    if re.search(rf"(?:^|\s){re.escape(q)}(?:\s|$)", l):
        return 80.0
    if l.startswith(q):
        return 60 + 1 / len(l)
    return 40.0 if q in l else jaccard_py(q, l) * 30


def suggestion_score(label: Column, query: Column) -> Column:
    """100 if equal, 80 for whole words, 60 and a bit for a prefix, 40 for a part, else up to 30 by similarity."""
    l, q = F.lower(label), F.lower(query)
    spaced = lambda c: F.concat(F.lit(" "), F.regexp_replace(c, r"\s", " "), F.lit(" "))
    return (
        F.when(l == q, F.lit(100.0))
        .when(F.contains(spaced(l), spaced(q)), F.lit(80.0))
        .when(F.startswith(l, q), 60 + 1 / F.length(l))
        .when(F.contains(l, q), F.lit(40.0))
        .otherwise(jaccard(q, l) * 30)
    )


def like_prefix(column: Column, prefix: str) -> Column:
    """column LIKE 'prefix%' in which % and _ of the prefix are wildcards and nothing escapes; a plain prefix is pushed down."""
    if "%" not in prefix and "_" not in prefix:
        return column.startswith(prefix)
    parts = ["[\\s\\S]*" if c == "%" else "[\\s\\S]" if c == "_" else re.escape(c) for c in prefix]
    return column.rlike("^" + "".join(parts))


HOUSE_NUMBER = re.compile(r"^\d+[a-z]?$", re.IGNORECASE | re.ASCII)

# Countries that write the house number first.
NUMBER_FIRST = frozenset("US CA AU NZ BR MX CL CO UY SG HK TW GB IE".split())

# Whole postcodes by country.
POSTCODE = {
    "US": r"^\d{5}(-\d{4})?$",
    "DE": r"^\d{5}$",
    "FR": r"^\d{5}$",
    "ES": r"^\d{5}$",
    "IT": r"^\d{5}$",
    "MX": r"^\d{5}$",
    "NL": r"^\d{4}[a-z]{0,2}$",
    "CA": r"^[a-z]\d[a-z]\s?\d[a-z]\d$",
    "BR": r"^\d{5}-?\d{3}$",
    "AU": r"^\d{4}$",
    "AT": r"^\d{4}$",
    "BE": r"^\d{4}$",
    "PL": r"^\d{2}-?\d{3}$",
    "JP": r"^\d{3}-?\d{4}$",
    "CH": r"^\d{4}$",
    "DK": r"^\d{4}$",
    "FI": r"^\d{5}$",
    "NO": r"^\d{4}$",
    "PT": r"^\d{4}(-\d{3})?$",
    "SE": r"^\d{3}\s?\d{2}$",
}

# Beginnings of postcodes by country; elsewhere digits only.
PARTIAL_POSTCODE = {
    "US": r"^\d{1,5}$",
    "DE": r"^\d{1,5}$",
    "FR": r"^\d{1,5}$",
    "ES": r"^\d{1,5}$",
    "IT": r"^\d{1,5}$",
    "NL": r"^\d{1,4}[a-z]{0,2}$",
    "CA": r"^[a-z]\d[a-z]?(\s?\d[a-z]\d)?$",
    "BR": r"^\d{1,5}(-?\d{0,3})?$",
    "AU": r"^\d{1,4}$",
    "JP": r"^\d{1,3}(-?\d{0,4})?$",
    "CH": r"^\d{1,4}$",
    "AT": r"^\d{1,4}$",
    "BE": r"^\d{1,4}$",
    "DK": r"^\d{1,4}$",
    "NO": r"^\d{1,4}$",
    "FI": r"^\d{1,5}$",
    "PT": r"^\d{1,4}(-?\d{0,3})?$",
    "PL": r"^\d{1,2}(-?\d{0,3})?$",
}
_flags = re.IGNORECASE | re.ASCII
POSTCODE_RE = {cc: re.compile(p, _flags) for cc, p in POSTCODE.items()}
PARTIAL_RE = {cc: re.compile(p, _flags) for cc, p in PARTIAL_POSTCODE.items()}
DIGITS = re.compile(r"^\d+$", re.ASCII)


def _by_country(text: Column, cc: Column, patterns: dict[str, str], other: Column) -> Column:
    """Whether text matches the pattern of its country; one test for each distinct pattern."""
    out = other
    for pattern in dict.fromkeys(patterns.values()):
        codes = [c for c, p in patterns.items() if p == pattern]
        out = F.when(cc.isin(codes), text.rlike("(?i)" + pattern)).otherwise(out)
    return out


def whole_postcode(text: Column, cc: Column) -> Column:
    """Whether the text is a postcode of the country; false for countries whose form is not known."""
    return _by_country(F.trim(text), cc, POSTCODE, F.lit(False))


def partial_postcode_py(text: str, cc: str) -> bool:
    return bool(PARTIAL_RE.get(cc, DIGITS).match(text.strip()))


def partial_postcode(text: Column, cc: Column) -> Column:
    t = F.trim(text)
    return _by_country(t, cc, PARTIAL_POSTCODE, t.rlike(DIGITS.pattern))


def street_query_py(text: str, cc: str) -> str:
    t = text.strip().split()
    if len(t) > 1 and HOUSE_NUMBER.match(t[0]):
        return " ".join(t[1:])
    if len(t) > 1 and cc not in NUMBER_FIRST and HOUSE_NUMBER.match(t[-1]):
        return " ".join(t[:-1])
    return text.strip()


def street_query(text: Column, cc: Column) -> Column:
    """The text without its house number: a leading one anywhere, a trailing one where numbers come last."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    number = lambda w: w.rlike("(?i)" + HOUSE_NUMBER.pattern)
    rest = lambda start, n: F.array_join(F.slice(words, start, n), " ")
    many = F.size(words) > 1
    return (
        F.when(many & number(F.get(words, F.lit(0))), rest(F.lit(2), F.greatest(F.lit(0), F.size(words) - 1)))
        .when(many & ~cc.isin(sorted(NUMBER_FIRST)) & number(F.get(words, F.size(words) - 1)), rest(F.lit(1), F.greatest(F.lit(0), F.size(words) - 1)))
        .otherwise(t)
    )


WIDE = r"[　-鿿]"


def specificity_py(street: str) -> int:
    """Length, with ideographs, kana and their marks twice."""
    return len(street) + len(re.findall(WIDE, street))


def specificity(street: Column) -> Column:
    return F.length(street) + F.regexp_count(street, F.lit(WIDE))


def strip_zone_py(number: str) -> str:
    """Without the part from the last dash on (a survey zone in Japanese data)."""
    return number.rpartition("-")[0] if "-" in number else number


def strip_zone(number: Column) -> Column:
    return F.regexp_replace(number, r"-[^-]*$", "")


def html_escape_py(text: str) -> str:
    for c, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = text.replace(c, entity)
    return text


def html_escape(text: Column) -> Column:
    for c, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(c), F.lit(entity))
    return text


def sql_escape(text: str) -> str:
    """For a string literal in SQL text; expressions and spark.sql(args=...) need none."""
    return text.replace("'", "''")


def compact_py(n: float) -> str:
    """To one place by the exact value of the quotient, exact halves up (as toFixed does)."""
    for size, unit in ((1e9, "B"), (1e6, "M"), (1e3, "K")):
        if n >= size:
            return f"{Decimal(n / size).quantize(Decimal('0.1'), ROUND_HALF_UP)}{unit}"
    return f"{n:,}"


def full_py(n: float) -> str:
    return f"{n:,}"


def _tenths(x: Column) -> Column:
    """x > 0 to one place. 20 x - (2 k + 1), whose sign tells the half, is exact: both differences are of numbers within a factor of two."""
    k = F.floor(x * 10).cast("long")
    odd = (k * 2 + 1).cast("double")
    t = F.when((x * 16 - odd) + x * 4 >= 0, k + 1).otherwise(k)
    return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))


def compact(n: Column) -> Column:
    """compact_py as an expression, with its rounding."""
    out = F.format_number(n, 0)
    for size, unit in ((1e3, "K"), (1e6, "M"), (1e9, "B")):
        out = F.when(n >= size, F.concat(_tenths(n / size), F.lit(unit))).otherwise(out)
    return out


def byte_size_py(n: float) -> str:
    if n < 0:
        return "N/A"
    return f"{n:.0f}B" if n < 1024 else f"{n / 1024:.0f}KB" if n < 1048576 else f"{n / 1048576:.1f}MB"


def distance_text(metres: Column) -> Column:
    return F.when(metres < 1000, F.concat(F.round(metres).cast("long").cast("string"), F.lit(" m"))).otherwise(F.format_string("%.1f km", metres / 1000))


def elapsed(seconds: float) -> str:
    return f"{seconds:.2f}s"


_CHECKS = {"country": r"[A-Z]{2}", "tile": r"[0-9a-fA-F]+|t\d+x\d+", "bucket": r"[0-9a-zA-Z_]+", "release": r"\d{4}-\d{2}-\d{2}\.\d+"}


def check(kind: str, value: str) -> str:
    """value, if it has the form of a country, tile, bucket or release; else ValueError."""
    if not isinstance(value, str) or not re.fullmatch(_CHECKS[kind], value, re.ASCII):
        raise ValueError(f"not a {kind}: {value!r}")
    return value


def check_number(value: float, label: str, low: float = float("-inf"), high: float = float("inf")) -> float:
    if isinstance(value, bool) or not isinstance(value, int | float) or value != value or abs(value) == float("inf") or not low <= value <= high:
        raise ValueError(f"{label} is not a finite number in range: {value!r}")
    return value


def check_limit(limit: int, most: int) -> int:
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= most:
        raise ValueError(f"limit is not a whole number from 1 to {most}: {limit!r}")
    return limit
