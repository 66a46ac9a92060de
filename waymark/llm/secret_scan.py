"""Secret scans: fixed patterns, and the guess cost of values that stand in a credential context.

The base finds assignments, access keys and hexadecimal runs by pattern. The method looks at values behind further
credential words and at assigned values that the base finds too short: the cheapest segmentation of the value into
dictionary words, dates, repeats, keyboard walks or sequences, and brute-force characters, by dynamic programming,
gives the number of guesses an informed attacker needs. A brute-force character costs as many guesses as the character
classes of the value have members, so random values of 8 characters reach the bound if they mix classes or are letters;
digits alone need 11. A value of MIN_LOG10_GUESSES or more is reported as `guess`.

Words are those of WORDS, the commonest in passwords first, then those of a public vocabulary file in the order of its
ids (frequent ones first); its path is a parameter. Runs and walks count from any of their first LONGEST places, which
is all that can matter: further in, to have begun earlier is cheaper.

Offsets are code points, ends exclusive. Overlapping spans of different kinds are all reported; a `guess` span that
base spans cover wholly is dropped, for the base has it. One that they meet in part is reported whole, so that no end of
the value is left.

Cases: a null or empty text has no spans; long values are segmented whole, in time linear in their length; repeated rows
give repeated results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .packing import vocabulary_path

KINDS = ("assign", "access", "hex", "guess")
MIN_LOG10_GUESSES = 11.0

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api_?key|credentials?|auth(?:orization)?|bearer|(?:private|access|signing|encryption|client)[_-]?(?:key|secret))["']?\x20*[:=]\x20*["']?(?:bearer\x20+|basic\x20+)?([^\s"'<>,;]{8,})""",
    re.ASCII | re.IGNORECASE,
)
#: Every match of ASSIGN or CONTEXT holds one of these; looking for them first is cheap.
HINTS = ("pass", "pwd", "secret", "token", "api", "credential", "auth", "bearer", "key")

# Words that people use in passwords, the commonest first.
WORDS = (
    "password secret admin welcome love monkey dragon master hello login shadow sunshine princess football baseball "
    "letmein qwerty test user root guest default changeme example sample demo temp access system server database "
    "summer winter spring autumn monday friday january march april june july august october december "
    "michael jennifer jordan thomas charlie daniel andrew joshua jessica ashley george robert william james john david "
    "super hunter killer ranger soccer hockey tennis golf tiger eagle falcon chicken cheese cookie coffee banana apple "
    "orange purple yellow silver golden black white green blue red happy lucky magic star king queen angel devil "
    "heaven flower summer ginger pepper freedom trust power money computer internet google windows apple mobile phone "
    "house school office company public private service account email token key value none null true false your here "
    "name the and for with this that from not are was"
).split()
RANK = {w: i + 1 for i, w in reversed(list(enumerate(WORDS)))}
LONGEST = 15  # letters of a word
LOOKALIKE = str.maketrans("4@831!05$7", "aabeilosst")
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_PLACE = {c: (x + y * 0.5, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")


@cache
def words_of_file(path: str) -> dict[str, int]:
    """Ranks of WORDS and, behind them, of the whole words of letters in a vocabulary, by id."""
    with open(path) as f:
        vocabulary = json.load(f)["model"]["vocab"]
    whole = (x[:-4] for x, _ in sorted(vocabulary.items(), key=lambda kv: kv[1]) if x.endswith("</w>"))
    out = dict(RANK)
    for w in whole:
        if 4 <= len(w) <= LONGEST and w.isascii() and w.isalpha():
            out.setdefault(w, len(out) + 1)
    return out


def _near(a: str, b: str) -> bool:
    """Neighbours on the keyboard or in the alphabet or digits."""
    p, q = _PLACE.get(a), _PLACE.get(b)
    if p and q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1:
        return True
    return a.isascii() and b.isascii() and a.isalnum() and b.isalnum() and abs(ord(a) - ord(b)) == 1


LETTERS = re.compile(r"[^\W\d_]{4,}")
# Pairs of letters that words of English, German, French and Spanish hardly have, and five consonants or vowels in a row.
NO_WORD = re.compile(
    "b[qx]|c[bfgjpvwxz]|d[qx]|f[cjqvx]|g[cjqvx]|h[jqx]|j[b-df-hj-np-tv-z]|k[jqvx]|l[qx]|m[jqvx]|p[jqvxz]|q[^u]|r[jqx]|sx|t[jqx]|u[jq]|v[b-df-hjkmnpqstvwxz]|w[cgjqvx]|x[bdfgjkmnrsvwz]|y[jqy]|z[cjqrvx]"
    "|[b-df-hj-np-tv-xz]{5}|[aeiouy]{5}"
)


def _alphabet(value: str) -> int:
    """How many characters the classes have from which value is drawn."""
    sizes = ((26, str.islower), (26, str.isupper), (10, str.isdigit), (33, lambda c: c.isascii() and not c.isalnum()), (100, lambda c: not c.isascii()))
    return sum(size for size, kind in sizes if any(map(kind, value)))


def _brute_force(value: str) -> list[float]:
    """log10 cost of every character. Letters of one case that read like a word are more likely one that the list lacks than drawn at random."""
    out = [math.log10(_alphabet(value))] * len(value) if value else []
    for m in LETTERS.finditer(value):
        start = m.start()
        for i in range(start + 1, m.end() + 1):
            if i < m.end() and not (value[i].isupper() and not value[i - 1].isupper()):
                continue
            part = value[start:i]
            if i - start >= 4 and (part[1:].islower() or part.isupper() or not part.isascii()) and not NO_WORD.search(part.lower()):
                out[start:i] = [math.log10(4)] * (i - start)
            start = i
    return out


def log10_guesses(value: str, ranks: dict[str, int] = RANK) -> float:
    """The least sum of log10 costs over all segmentations of value; 0 for an empty one."""
    n, low = len(value), value.lower()
    plain = low.translate(LOOKALIKE)
    brute = _brute_force(value)
    best = [0.0] * (n + 1)
    same = walk = 0  # where the run of one character, and the keyboard walk, that end here begin
    for j in range(1, n + 1):
        cost = best[j - 1] + brute[j - 1]
        if j > 1 and low[j - 1] != low[j - 2]:
            same = j - 1
        if j > 1 and not _near(low[j - 1], low[j - 2]):
            walk = j - 1
        for i in range(same, min(same + LONGEST, j - 2)):
            cost = min(cost, best[i] + math.log10(36 * (j - i)))
        for i in range(walk, min(walk + LONGEST, j - 2)):
            cost = min(cost, best[i] + math.log10(47 * 4 * (j - i)))
        for i in range(max(0, j - LONGEST), j - 2):
            if rank := ranks.get(low[i:j]) or ranks.get(plain[i:j]):
                varied = 0.0 if value[i:j].islower() else math.log10(2) if value[i : i + 1].isupper() and value[i + 1 : j].islower() or value[i:j].isupper() else math.log10(2 + (j - i))
                cost = min(cost, best[i] + math.log10(rank + 1) + varied + (0 if low[i:j] in ranks else math.log10(4)))
        if value[j - 1].isdigit():
            for size in (4, 8, 9, 10):
                if j >= size and value[j - size].isdigit() and DATE.fullmatch(value, j - size, j):
                    cost = min(cost, best[j - size] + math.log10(365 * 60 if size > 4 else 60))
        for width in (2, 3, 4):  # a block again
            if j >= 2 * width and low[j - width : j] == low[j - 2 * width : j - width]:
                cost = min(cost, best[j - width] + math.log10(2))
        best[j] = cost
    return best[n]


def _union(spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The places that spans cover, in order, without overlaps."""
    out: list[tuple[int, int]] = []
    for a, b, _ in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def secrets(text: str | None, ranks: dict[str, int] = RANK) -> list[tuple[int, int, str]]:
    """start, end and kind of every span, by start, then by kind as listed in KINDS."""
    if not text:
        return []
    base = [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)] if "AKIA" in text else []
    base += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    more = []
    low = text.lower()
    if any(h in low for h in HINTS):
        base += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        covered = _union(base)
        for m in CONTEXT.finditer(text):
            a, b = m.span(1)
            if not any(x <= a and b <= y for x, y in covered) and log10_guesses(m[1], ranks) >= MIN_LOG10_GUESSES:
                more.append((a, b, "guess"))
    return sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    out, end = [], 0
    for a, b, _ in spans:
        if a >= end:
            out += [text[end:a], mark]
        end = max(end, b)
    return "".join(out) + text[end:] if spans else text


def _scan(path: str):
    def each(batches):
        ranks = words_of_file(path)
        for batch in batches:
            rows = [[], [], [], [], []]
            for text in batch.column(1):
                spans = secrets(text.as_py(), ranks)
                base = [s for s in spans if s[2] != "guess"]
                for column, kind in zip(rows, KINDS[:3], strict=False):
                    column.append(sum(s[2] == kind for s in spans))
                rows[3].append(hashlib.sha256(joined(base).encode()).hexdigest())
                rows[4].append(joined(spans))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(r, k) for r, k in zip(rows, kinds, strict=True)]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return each


def secret_scan(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans. vocabulary: the path of a file of words that every executor has."""
    scan = _scan(vocabulary or vocabulary_path())
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[redacted]", vocabulary: str | None = None) -> DataFrame:
    """The documents with every span replaced by mark, and n_chars, where there is such a column, counted anew. Every row
    stays; null and empty texts are as they were."""
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    path = vocabulary or vocabulary_path()

    def each(batches):
        ranks = words_of_file(path)
        for batch in batches:
            arrays = list(batch.columns)
            old = [x.as_py() for x in arrays[at]]
            new = [x and redacted(x, secrets(x, ranks), mark) for x in old]
            arrays[at] = pa.array(new, batch.schema.field(at).type)
            if chars is not None:
                held = arrays[chars].to_pylist()
                arrays[chars] = pa.array([h if a == b else len(b) for a, b, h in zip(old, new, held, strict=True)], batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(each, docs.schema)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(documents(spark, sf_dir))
