"""Mixing against a plain version: weights by a bisection in Python, blocks in order with running sums."""

import math
import re
import struct
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from waymark.llm import mixing as M


def hashed(*values):
    """Spark's xxhash64 as signed 64-bit: each value's hash is the seed of the next."""
    seed = 42
    for kind, v in values:
        data = v.encode() if kind == "s" else struct.pack({"i": "<i", "l": "<q"}[kind], v)
        seed = xxhash.xxh64(data, seed=seed).intdigest()
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def plain_weights(tokens, entropy, max_repeats):
    """Per source with tokens its weight, and the budget that takes each once."""
    whole = sum(tokens.values())
    share = {s: t / whole for s, t in tokens.items() if t}

    def weights(a):
        z = sum(p**a for p in share.values())
        return {s: p**a / z for s, p in share.items()}

    def meets(a):
        w = weights(a).values()
        if entropy is not None:
            return -sum(x * math.log(x) for x in w) >= entropy * math.log(len(w))
        repeats = [x / p for x, p in zip(w, share.values())]
        return max(repeats) / min(repeats) <= max_repeats

    low, high = 0.0, 1.0
    if entropy is not None and meets(1.0):
        low = high = 1.0
    for _ in range(60):
        mid = (low + high) / 2
        # an entropy is met up to some exponent, a limit from some exponent on
        if meets(mid) == (entropy is not None):
            low = mid
        else:
            high = mid
    w = weights(low if entropy is not None else high)
    return w, max(tokens[s] / w[s] for s in w)


def plain_plan(rows, quota, blocks, seed):
    """Taken copies: (doc_id, source, epoch, block, start)."""
    members, total = defaultdict(list), defaultdict(lambda: defaultdict(int))
    for doc, source, n in rows:
        block = hashed(("i", seed), ("s", str(doc))) % blocks
        members[source, block].append(doc)
        total[source][block] += n
    out = []
    for source, of_block in total.items():
        whole = sum(of_block.values())
        for epoch in range(quota[source] // whole + 1 if whole else 2):
            start = epoch * whole
            for block in sorted(of_block, key=lambda b: (hashed(("i", seed), ("l", epoch), ("l", b)) % (1 << 40), b)):
                t = of_block[block]
                if start + t / 2 <= quota[source] if t else epoch == 0:
                    out += [(d, source, epoch, block, start) for d in members[source, block]]
                start += t
    return out


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def corpus(seed):
    r = np.random.default_rng(seed)
    size = {"web": 600, "books": 90, "code": 25, None: 12, "void": 5}
    rows = [(s, None if r.random() < 0.03 else "" if s == "void" else " ".join(["w"] * int(r.integers(0, 60)))) for s, n in size.items() for _ in range(n)]
    rows += rows[:20]
    return [(i, s, t) for i, (s, t) in enumerate(rows)] + [(3, "web", "the same id again")]


@pytest.mark.parametrize("targets", [{}, {"max_repeats": 5.0}, {"entropy": 0.8}, {"budget": 9000}])
def test_equals_the_plain_version(spark, targets):
    rows = corpus(len(targets) + 1)
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out, sources = M.mixed(docs, **targets)
    sources = {r["source"]: r for r in sources.collect()}
    counted = [(d, s, words(t)) for d, s, t in rows]
    tokens = defaultdict(int)
    for _, s, n in counted:
        tokens[s] += n
    assert {s: r["tokens"] for s, r in sources.items()} == tokens

    weights, once = plain_weights(tokens, targets.get("entropy"), targets.get("max_repeats", M.MAX_REPEATS))
    assert {s: r["weight"] for s, r in sources.items()} == pytest.approx({s: weights.get(s, 0.0) for s in tokens}, abs=1e-9)
    wanted = {s: weights.get(s, 0.0) * targets.get("budget", once) for s in tokens}
    assert {s: r["quota"] for s, r in sources.items()} == pytest.approx(wanted, abs=0.51)

    got = [(r["row"]["doc_id"], r["row"]["source"], r["epoch"], r["block"], r["start"]) for r in out.collect()]
    plain = plain_plan(counted, {s: r["quota"] for s, r in sources.items()}, M.LEAST_BLOCKS, M.SEED)
    key = lambda x: (x[0], str(x[1]), *x[2:])
    assert sorted(got, key=key) == sorted(plain, key=key)
    if "budget" not in targets:
        assert {d for d, *_ in got} == {d for d, *_ in rows}


def test_nothing_has_tokens(spark):
    rows = [(1, "a", None), (2, "a", ""), (3, None, " ")]
    out, _ = M.mixed(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    assert sorted(r["row"]["doc_id"] for r in out.collect()) == [1, 2, 3]
