"""A quality classifier by attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE bytes. Every passage is encoded: character shares, repetition within the text, and
a random projection of its hashed byte trigrams go through a learned tanh layer. Gated attention (a tanh gate times a
sigmoid gate) weighs the passages, and a logistic unit scores the weighted sum. Only documents have labels; encoder,
gates and scorer are learned from them together by Adam in numpy, on a bounded sample.

Sample: at most SAMPLE labelled rows of at most SAMPLE_BYTES bytes, by a hash of the id.

Cases: a null or empty text is one passage without bytes, and gets the score of that; every passage of a long text is
encoded and weighed; without labels, or with one class only, the score is the share of label 1 (0.5 without any);
contradicting labels count as 1; a score is a function of the text alone, to the last bit, so repeated rows give repeated
results however rows are dealt out; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_of_id, documents
from .near_duplicates import buffers_of, pieces
from .quality_rules import labels_of

PASSAGE = 400
BUCKETS = 1 << 12
PROJECTED = 16
HIDDEN = 16
GATES = 8
SAMPLE = 4000
THIN = 4  # labels drawn for each sampled row; some are of documents not to learn from
SAMPLE_BYTES = 40_000
STEPS = 600
DECAY = 1e-3
SEED = 3

PROJECTION = np.random.default_rng(SEED).choice(np.array([-1, 1], np.float32), (BUCKETS, PROJECTED))


def _classes() -> np.ndarray:
    """Rows of 0 or 1 for bytes: upper case, digit, blank, sentence mark, other ASCII mark, beyond ASCII."""
    kinds = np.zeros((6, 256), np.float32)
    kinds[0, 65:91] = kinds[1, 48:58] = kinds[5, 128:] = 1
    kinds[2, [32, *range(9, 14)]] = kinds[3, [33, 44, 46, 58, 59, 63]] = 1
    kinds[4] = 1 - kinds.sum(axis=0)
    kinds[4, 97:123] = 0
    return kinds


CLASSES = _classes()
FEATURES = len(CLASSES) + 3 + PROJECTED


def passages(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of the texts in one buffer, and each text's bounds among them (one more than texts)."""
    n, size = len(offsets) - 1, len(data)
    lengths = np.diff(offsets)
    count = np.maximum(1, -(-lengths // PASSAGE))
    bounds = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(offsets[:-1], count) + (np.arange(bounds[-1]) - np.repeat(bounds[:-1], count)) * PASSAGE
    last = np.minimum(first + PASSAGE, np.repeat(offsets[1:], count))
    x = np.zeros((bounds[-1], FEATURES), np.float32)
    if size == 0:
        return x, bounds
    width = np.maximum(1, last - first).astype(np.float32)
    sums = lambda values: np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.float64)])[np.stack([first, last])], axis=0)[0]
    for i, kind in enumerate(CLASSES):
        x[:, i] = sums(kind[data]) / width
    k = len(CLASSES)
    # repetition: of the 5-byte strings that begin here, how many stand elsewhere in the text too
    owner = np.repeat(np.arange(n), lengths)
    wide = data.astype(np.uint64)
    m = size - 4
    if m > 0:
        string = wide[:m] | wide[1 : m + 1] << np.uint64(8) | wide[2 : m + 2] << np.uint64(16) | wide[3 : m + 3] << np.uint64(24) | wide[4 : m + 4] << np.uint64(32)
        at = np.flatnonzero(owner[:m] == owner[4:])
        key = string[at] | owner[at].astype(np.uint64) << np.uint64(40)  # exact: a batch has fewer than 2 ** 24 texts
        by = np.argsort(key, kind="stable")
        s = key[by]
        same = s[1:] == s[:-1]
        again = np.zeros(len(s), bool)
        again[1:] |= same
        again[:-1] |= same
        repeated = np.zeros(size, np.float32)
        repeated[at[by[again]]] = 1
        seen = np.zeros(size, np.float32)
        seen[at] = 1
        x[:, k] = sums(repeated) / np.maximum(1, sums(seen))
    x[:, k + 1] = np.log1p(np.repeat(lengths, count)) / 10
    x[:, k + 2] = np.log1p(last - first) / 10
    t = size - 2
    if t > 0:
        b = data.astype(np.uint32)
        g = (b[:t] * np.uint32(0x01000193) ^ b[1 : t + 1]) * np.uint32(0x01000193) ^ b[2 : t + 2]
        g *= np.uint32(0x9E3779B1)
        rows = np.zeros((size + 1, PROJECTED), np.float32)
        rows[:t] = PROJECTION[g >> np.uint32(20)]  # 12 bits
        rows[:t][owner[:t] != owner[2:]] = 0  # a trigram lies in one text
        full = np.flatnonzero(last > first)
        edges = np.stack([first[full], last[full]], axis=1).ravel()
        x[full, k + 3 :] = np.add.reduceat(rows, edges, axis=0)[::2] / width[full, None]
    return x, bounds


def _product(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w, summed in one order whatever the number of rows, so that a text's score doesn't depend on its neighbours in a batch."""
    out = np.zeros((len(x), *w.shape[1:]))
    for i, row in enumerate(w):
        out += x[:, i, None] * row if w.ndim == 2 else x[:, i] * row
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        p = self.p
        h = np.tanh(_product(x, p["A"]) + p["a"])
        t, s = np.tanh(_product(h, p["V"])), _sigmoid(_product(h, p["U"]))
        e = _product(t * s, p["w"])
        top = np.maximum.reduceat(e, bounds[:-1])
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        e = np.exp(e - top[owner])
        attention = e / np.add.reduceat(e, bounds[:-1])[owner]
        z = np.add.reduceat(attention[:, None] * h, bounds[:-1], axis=0)
        logit = _product(z, p["c"]) + p["b"]
        return logit, {"h": h, "t": t, "s": s, "attention": attention, "z": z, "owner": owner}

    def scores(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(offsets) - 1)
        for a, b in pieces(offsets):
            x, bounds = passages(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
            out[a:b] = _sigmoid(self.forward((x - self.mean) / self.spread, bounds)[0])
        return out


def gradients(model: Model, x: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    p = model.p
    logit, f = model.forward(x, bounds)
    d = (_sigmoid(logit) - y) / len(y)
    h, t, s, att, owner = f["h"], f["t"], f["s"], f["attention"], f["owner"]
    out = {"c": f["z"].T @ d, "b": d.sum()}
    dz = (d[:, None] * p["c"])[owner]
    pull = (dz * h).sum(axis=1)
    de = att * (pull - np.add.reduceat(att * pull, bounds[:-1])[owner])
    out["w"] = (t * s).T @ de
    dts = de[:, None] * p["w"]
    dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
    out["V"], out["U"] = h.T @ dt, h.T @ ds
    dh = (att[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
    out["A"], out["a"] = x.T @ dh, dh.sum(axis=0)
    return out


def train(texts: list[str], labels: np.ndarray) -> Model:
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    parts = [passages(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]) for a, b in pieces(offsets)]
    x = np.concatenate([q[0] for q in parts]).astype(np.float64)
    bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(q[1]) for q in parts]))])
    rng = np.random.default_rng(SEED)
    model = Model(x.mean(axis=0), x.std(axis=0) + 1e-3, {
        "A": rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), "a": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATES)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATES)),
        "w": rng.normal(0, GATES**-0.5, GATES), "c": rng.normal(0, HIDDEN**-0.5, HIDDEN), "b": np.zeros(()),
    })
    x = (x - model.mean) / model.spread
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    n, batch = len(labels), 512
    mean = {k: np.zeros_like(v) for k, v in model.p.items()}
    for step in range(1, STEPS + 1):
        pick = np.sort(rng.choice(n, min(n, batch), replace=False))
        size = np.diff(bounds)[pick]
        inner = np.concatenate([[0], np.cumsum(size)])
        rows = np.repeat(bounds[pick] - inner[:-1], size) + np.arange(inner[-1])
        for k, g in gradients(model, x[rows], inner, labels[pick]).items():
            g = g + (DECAY * model.p[k] if k not in "ab" else 0)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            model.p[k] = model.p[k] - 0.02 * (1 - 0.9 * step / STEPS) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            mean[k] = mean[k] + (model.p[k] if step > STEPS // 2 else 0)
    model.p = {k: v / (STEPS - STEPS // 2) for k, v in mean.items()}  # of the later half: steadier than the last
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Model | float:
    """docs: doc_id, text of the documents to learn from. The share of label 1 where there is nothing to tell apart."""
    known = docs.where(F.octet_length(F.coalesce("text", F.lit(""))) <= SAMPLE_BYTES)
    marked = labels_of(labels)
    draw = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    thin = marked.where(draw * F.lit(marked.count()) <= THIN * SAMPLE)  # about THIN * SAMPLE labels, whatever there are
    rows = known.join(F.broadcast(thin), "doc_id").orderBy(draw, "doc_id", "text").limit(SAMPLE).select("text", F.col("quality").cast("double").alias("y")).toArrow()
    y = np.array(rows.column("y").to_pylist(), float)
    if len(set(y)) < 2:
        return float(y.mean()) if len(y) else 0.5
    return train([t or "" for t in rows.column("text").to_pylist()], y)


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """Per document: doc_id, score."""

    def each(batches):
        for batch in batches:
            s = np.full(batch.num_rows, model) if isinstance(model, float) else model.scores(*buffers_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(each, "doc_id long, score double")


def op7_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = F.coalesce(F.pmod(crc32_of_id(F.col("doc_id")), F.lit(3)) == 1, F.lit(False))
    model = fit(docs.where(~out).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
