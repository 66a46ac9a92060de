"""Language identification by averaged hashed subword embeddings.

A text's subwords are the byte n-grams of its words, with word ends as marks; each hashes to an embedding, the mean of
all embeddings goes through a linear softmax. Both are trained by stochastic gradient descent in numpy, on windows of a
bounded sample of labelled rows. A temperature, fitted on whole texts of sampled rows kept out of training, calibrates the
scores, as whole texts are what is scored; the least score at which accepted predictions reach ACCEPT accuracy there
rejects the rest.

As mean and softmax are linear, embeddings and weights multiply out to one score row a bucket; a prediction is a gather
and a sum over the whole text.

Sample: of each of the LANGUAGES commonest languages at most SAMPLE rows of at most SAMPLE_BYTES bytes, by a hash of the
id, and at most SAMPLE_ROWS ids in all.

Cases: a text that is null, empty or without a letter is `und` with score 0; without any labelled row every text is; long
texts are summed whole; repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_of_id, documents
from .near_duplicates import buffers_of, pieces

BUCKETS = 1 << 15
DIMENSIONS = 16
LENGTHS = (2, 3, 4)
SAMPLE = 400
SAMPLE_BYTES = 20_000
SAMPLE_ROWS = 20_000
LANGUAGES = 1000
WINDOW = 256  # bytes of a training instance
EPOCHS = 3
ACCEPT = 0.99
SEED = 11

#: Bytes as subwords see them: A-Z as a-z, bytes of other characters as they are, all else an end of a word.
FOLD = np.zeros(256, np.uint32)
FOLD[97:123] = FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def subwords(offsets: np.ndarray, data: np.ndarray):
    """For texts in one buffer and each of LENGTHS: buckets, and bounds of each text's among them (one more than texts)."""
    n, size = len(offsets) - 1, len(data)
    lengths = np.diff(offsets)
    b = np.zeros(size + n + 1, np.uint32)  # a word end before and after each text
    b[np.arange(size) + np.repeat(np.arange(n), lengths) + 1] = FOLD[data]
    starts = offsets + np.arange(n + 1)
    ends = np.concatenate([[0], np.cumsum(b == 0)])
    for k in LENGTHS:
        m = len(b) - k + 1
        if m <= 0:
            yield np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
            continue
        h = np.full(m, k, np.uint32)
        for i in range(k):
            h = (h ^ b[i : m + i]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        inside = ends[k - 1 : m + k - 1] == ends[1 : m + 1]  # no word end but first and last
        if k == 2:
            inside = (b[:m] != 0) | (b[1:] != 0)
        at = np.flatnonzero(inside)
        yield ((h[at] >> np.uint32(7)) & np.uint32(BUCKETS - 1)).astype(np.int64), np.searchsorted(at, np.minimum(starts, m))


def segment_sums(rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of rows[bounds[i]:bounds[i + 1]], zero where that is empty."""
    out = np.zeros((len(bounds) - 1, rows.shape[1]))
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.add.reduceat(rows, bounds[full], axis=0, dtype=np.float64)
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float
    least: float  # the score below which a prediction is rejected

    def scores(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        total, count = np.zeros((len(offsets) - 1, len(self.languages))), np.zeros(len(offsets) - 1)
        for a, b in pieces(offsets):
            for buckets, bounds in subwords(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]):
                total[a:b] += segment_sums(self.table[buckets], bounds)
                count[a:b] += np.diff(bounds)
        return total / np.maximum(count, 1)[:, None] + self.bias

    def probabilities(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        return softmax(self.scores(offsets, data) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts cut into windows of about WINDOW bytes: which text, offsets, bytes."""
    owner, size = [], []
    for i, t in enumerate(texts):
        parts = max(1, len(t) // WINDOW)
        cut = np.linspace(0, len(t), parts + 1).astype(int)
        owner += [i] * parts
        size += list(np.diff(cut))
    return np.array(owner, np.int64), np.concatenate([[0], np.cumsum(size)]).astype(np.int64), np.frombuffer(b"".join(texts), np.uint8)


def train(texts: list[str], langs: list[str]) -> Model:
    names = sorted(set(langs))
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(texts))
    out = max(1, len(texts) // 5) if len(texts) >= 10 else 0
    held, used = order[:out], order[out:]
    label = np.array([names.index(x) for x in langs], np.int64)
    owner, offsets, data = windows([texts[i].encode() for i in used])
    y = label[used][owner]
    per = list(subwords(offsets, data))
    instances = []
    for i in range(len(y)):
        ids = np.concatenate([b[s[i] : s[i + 1]] for b, s in per])
        u, c = np.unique(ids, return_counts=True)
        instances.append((u, (c / max(1, c.sum())).astype(np.float32)))
    emb = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    weight, bias = np.zeros((DIMENSIONS, len(names)), np.float32), np.zeros(len(names), np.float32)
    steps, step = EPOCHS * len(instances), 0
    share = np.bincount(y, minlength=len(names)) / max(1, len(y))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(instances)):
            rate = np.float32(0.5 * (1 - step / steps) + 0.01)
            step += 1
            u, c = instances[i]
            mean = c @ emb[u]
            g = softmax(mean @ weight + bias).astype(np.float32)
            g[y[i]] -= 1
            g *= np.float32(1 / (len(names) * share[y[i]]))  # languages count alike
            back = weight @ g
            weight -= rate * np.outer(mean, g)
            bias -= rate * g
            emb[u] -= (rate * 10) * c[:, None] * back
    model = Model(names, (emb @ weight).astype(np.float32), bias.astype(np.float64), 1.0, 0.0)
    if out:
        whole = [texts[i].encode() for i in held]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in whole])]).astype(np.int64)
        raw, y = model.scores(offsets, np.frombuffer(b"".join(whole), np.uint8)), label[held]
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
        loss = [-np.log(np.maximum(softmax(raw / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = softmax(raw / model.temperature)
        best = p.max(axis=1)
        by = np.argsort(-best)
        right = np.cumsum(p.argmax(axis=1)[by] == y[by]) / np.arange(1, len(y) + 1)
        good = np.flatnonzero(right >= ACCEPT)
        model.least = float(best[by[good[-1]]]) if len(good) else 1.0
    return model


def sample(docs: DataFrame) -> tuple[list[str], list[str]]:
    """Texts and languages to learn from. docs: doc_id, text, lang.

    Ids are thinned by hash before they are ranked, so that no task ranks many; texts are fetched for the chosen ids only.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES) & F.col("text").rlike(r"\p{L}") & F.col("doc_id").isNotNull())
    common = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    draw = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    thin = known.select("lang", "doc_id").join(F.broadcast(common), "lang").where(draw * F.col("count") <= 4 * SAMPLE)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(draw, "doc_id"))
    ids = thin.withColumn("place", place).where(F.col("place") <= SAMPLE).orderBy("place", "lang").limit(SAMPLE_ROWS).select("doc_id").distinct()
    rows = known.join(F.broadcast(ids), "doc_id", "left_semi").select("lang", "text").limit(2 * SAMPLE_ROWS).toArrow()  # ids: SAMPLE_ROWS at most
    order = sorted(range(rows.num_rows), key=lambda i: (rows.column("lang")[i].as_py(), rows.column("text")[i].as_py()))
    return [rows.column("text")[i].as_py() for i in order], [rows.column("lang")[i].as_py() for i in order]


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per document: doc_id, lang_pred, score, rejected. docs: doc_id, text."""

    def each(batches):
        for batch in batches:
            n = batch.num_rows
            letter = np.array(batch.column(2).to_pylist(), bool)
            lang, score = np.full(n, "und", object), np.zeros(n)
            if model is not None and n:
                p = model.probabilities(*buffers_of(batch.column(1)))
                lang[letter] = np.array(model.languages, object)[p.argmax(axis=1)][letter]
                score[letter] = p.max(axis=1)[letter]
            least = model.least if model is not None else 1.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(score < least)], names=["doc_id", "lang_pred", "score", "rejected"])

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), letter.alias("letter"))
    return narrow.mapInArrow(each, "doc_id long, lang_pred string, score double, rejected boolean")


def fit(docs: DataFrame) -> Model | None:
    texts, langs = sample(docs)
    return train(texts, langs) if texts else None


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = F.coalesce(F.pmod(crc32_of_id(F.col("doc_id")), F.lit(4)) == 2, F.lit(False))
    model = fit(docs.where(~out).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")
