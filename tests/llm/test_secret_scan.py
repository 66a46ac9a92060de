import math
import random
import re
import string

import pytest

from waymark.llm import secret_scan as S

WORDS = S.words_of_file(S.vocabulary_path())


def segment_cost(value, i, j, brute):
    """The cheapest kind that value[i:j] is as a whole; infinite if it is none."""
    part, low, n = value[i:j], value[i:j].lower(), j - i
    out = [math.inf]
    if n == 1:
        out.append(brute[i])
    if n >= 3 and len(set(low)) == 1:
        out.append(math.log10(36 * n))
    if n >= 3 and all(S._near(a, b) for a, b in zip(low[1:], low, strict=False)):
        out.append(math.log10(188 * n))
    if 3 <= n <= S.LONGEST:
        plain = value.lower().translate(S.LOOKALIKE)[i:j]
        if rank := WORDS.get(low) or WORDS.get(plain):
            case = 0 if part.islower() else math.log10(2) if part[:1].isupper() and part[1:].islower() or part.isupper() else math.log10(2 + n)
            out.append(math.log10(rank + 1) + case + (0 if low in WORDS else math.log10(4)))
    if S.DATE.fullmatch(part):
        out.append(math.log10(365 * 60 if n > 4 else 60))
    if n in (2, 3, 4) and i >= n and value[i - n : i].lower() == low:
        out.append(math.log10(2))
    return min(out)


def exhaustive(value):
    """Every way to cut value into segments."""
    n, brute = len(value), S._brute_force(value)
    return min(
        sum(segment_cost(value, a, b, brute) for a, b in zip([0, *cuts], [*cuts, n], strict=True))
        for mask in range(1 << (n - 1))
        for cuts in [[k + 1 for k in range(n - 1) if mask >> k & 1]]
    )


def test_dynamic_programme_equals_every_segmentation():
    rng = random.Random(8)
    pieces = ["password", "love", "2024", "20240131", "aaa", "qwe", "abc", "x", "Q", "!", "p4ss", "dd", "31-12-1999", "Hello", "zz9", "99", "sun"]
    values = ["passwordddd", "asdfffff", "loveeee1", "aaaaaaaaaaaa", "abababab", "1234512345", "p@ssw0rd", "HELLOhello"]
    while len(values) < 120:
        v = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 4)))
        if len(v) <= 12:
            values.append(v)
    values += ["".join(rng.choice("ab12!") for _ in range(rng.randint(1, 11))) for _ in range(60)]
    for v in values:
        assert S.log10_guesses(v, WORDS) == pytest.approx(exhaustive(v), abs=1e-9), v


def runs(text, letters, least, start=""):
    """Leftmost maximal runs of letters, with a beginning that must stand there."""
    i, out = 0, []
    while i < len(text):
        if text.startswith(start, i) and (start or text[i] in letters):
            j = i + len(start)
            while j < len(text) and text[j] in letters:
                j += 1
            if j > i + len(start):
                if j - i >= least:
                    out.append((i, j))
                i = j
                continue
        i += 1
    return out


NAMES = ["password", "passwd", "secret", "token", "api_key", "apikey"]


def assigns(text):
    i, out, ok = 0, [], set(string.ascii_letters + string.digits + "+/_.=-")
    while i < len(text):
        name = next((n for n in NAMES if "".join(c.lower() if c in string.ascii_letters else c for c in text[i : i + len(n)]) == n), None)
        end = None
        if name:
            for quote in ((1, 0) if text[i + len(name) : i + len(name) + 1] in ('"', "'") else (0,)):
                j = i + len(name) + quote
                while text[j : j + 1] == " ":
                    j += 1
                if text[j : j + 1] in (":", "=") and text[j : j + 1]:
                    j += 1
                    while text[j : j + 1] == " ":
                        j += 1
                    j += text[j : j + 1] in ('"', "'") and bool(text[j : j + 1])
                    k = j
                    while k < len(text) and text[k] in ok:
                        k += 1
                    if k > j:
                        end = (j, k)
                        break
        if end:
            if end[1] - end[0] >= 12:
                out.append((i, end[1]))
            i = end[1]
        else:
            i += 1
    return out


def base(text):
    found = [(a, b, "assign") for a, b in assigns(text)] + [(a, b, "access") for a, b in runs(text, set(string.ascii_uppercase + string.digits), 18, "AKIA")]
    found += [(a, b, "hex") for a, b in runs(text, set("0123456789abcdef"), 16)]
    return sorted(found, key=lambda s: (s[0], S.KINDS.index(s[2])))


def test_base_equals_plain_scanning(spark):
    rng = random.Random(9)
    parts = [*NAMES, "PassWord", "Token", "toKen", "ſecret", '"', "'", " ", ":", "=", "AKIA", "AKIAAKIA", "0123456789abcdef", "deadbeef", "Zx9", "abcdefghijkl", "é", "\n", "ABCDEFGHIJKLMN", "-", "!", "_"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for t in texts:
        assert [s for s in S.secrets(t) if s[2] != "guess"] == base(t), t


def test_method_spans_are_the_context_values_that_cost_enough(spark):
    rng = random.Random(10)
    values = ["".join(rng.choice(string.ascii_letters + string.digits + "!#%&*") for _ in range(rng.randint(8, 11))) for _ in range(60)]
    values += ["sunflower", "mountains", "Wonderful1", "correcthorse", "20240131", "qwertyuiop", "letmein2024", "blanchett", "serendipity", "aaaaaaaaaa"]
    rows = [(i, f"note {i}\n{c}{v} and more") for i, (c, v) in enumerate((c, v) for c in ("pwd: ", "passphrase = ", "bearer=") for v in values)]
    out = {r["doc_id"]: r["spans"] for r in S.secret_scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    found = 0
    for i, text in rows:
        m = re.search(r"(?:pwd: |passphrase = |bearer=)(\S+)", text)
        strong = S.log10_guesses(m[1], WORDS) >= S.MIN_LOG10_GUESSES
        covered = any(a <= m.start(1) and m.end(1) <= b for a, b, _ in base(text))
        assert (f"guess:{m.start(1)}:{m.end(1)}" in out[i]) == (strong and not covered), text
        found += strong
    assert found > 100 and not any("guess" in out[i] for i, t in rows if t.split("\n")[1].split()[-3].split("=")[-1] in values[60:])


def test_vocabulary_is_a_parameter(spark, tmp_path):
    path = tmp_path / "words.json"
    path.write_text('{"model": {"vocab": {"qzwxvk</w>": 5, "jjqq</w>": 6}}}')
    df = spark.createDataFrame([(1, "pwd: qzwxvkjjqq end")], "doc_id long, text string")
    assert "guess" in S.secret_scan(df).head()["spans"] and S.secret_scan(df, str(path)).head()["spans"] == ""
