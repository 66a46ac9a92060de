"""Packing by concatenation: token ids of all documents in one order, cut into fixed windows.

Two passes. The first tokenises: every partition numbers its documents' ids from 0 and writes them. The totals of the
partitions, summed up in order, turn those numbers into global offsets. The second cuts: a document whose ids lie in
several windows gives a boundary record for each. So every id lies in one piece, sequences are full but for the last,
and no task sees more than its own documents.

Tokenising: the vocabulary's normalizer and pre-tokenizer cut a text at blanks at least, and letters from marks behind
them, so such units are encoded alone. They are found in the bytes of many texts at once, and the ids of a unit are looked
up where it has occurred before; new units are encoded together by the library. Texts with characters outside the range
where this is known to equal the library's own cutting go to the library whole.

Cases: a null or empty text has only the end id; a text longer than a sequence spans several; repeated rows are packed
each; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, documents
from .near_duplicates import buffers_of, pieces
from .sharding import ahead

SEQUENCE = 2048
END = 1
VOCABULARY = "word_bpe_49k.json"
MARKS = ".,;:!?|%$&*#"  # ASCII marks that begin no unit with a letter behind them
PARTS = 1024  # totals that one window sums up
BROADCAST_ROWS = 1_000_000  # of the partitions' offsets, 16 bytes each
CACHED = 300_000  # units; beyond, those that have come once are forgotten


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts, as the library gives them with add_special_tokens=False."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        # lower-case ASCII letters pass the normalizer and the byte mapping unchanged, other letters of the range pass the
        # normalizer so and the mapping is done here: for them cutting at blanks is enough
        own = json.loads(self.library.to_str())
        self.bare = Tokenizer.from_str(json.dumps(own | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}}))
        self.bytewise = "ByteLevel" in json.dumps(own["pre_tokenizer"])
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.seen = np.zeros(0, np.int64)

    def forget(self, room: int) -> None:
        """Keeps the units that have come again since the last time, the commonest, and no more than room."""
        if len(self.number) <= room:
            return
        bound = max(2, int(np.partition(self.seen, -room)[-room]))
        kept = [(w, i) for w, i in self.number.items() if self.seen[i] >= bound][:room]
        old = np.array([i for _, i in kept], np.int64)
        size = self.begin[old + 1] - self.begin[old]
        begin = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        self.flat = self.flat[np.repeat(self.begin[old] - begin[:-1], size) + np.arange(begin[-1])]
        self.begin, self.seen = begin, np.ones(len(old), np.int64)
        self.number = {w: n for n, (w, _) in enumerate(kept)}

    def _ids(self, tokenizer, words: list[str]) -> np.ndarray:
        texts = [" ".join(words[i : i + 64]) for i in range(0, len(words), 64)]  # the time per word is least there
        return np.fromiter(chain.from_iterable(e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)), np.uint32)

    def _learn(self, letters: list[str], other: list[str]) -> None:
        """Units of letters alone are encoded in texts of many, as the last id of one ends a word. The others are encoded
        each. They are numbered in this order."""
        plain = [w for w in letters if w.isascii()]
        beyond = [w for w in letters if not w.isascii()]
        mapped = _MAPPED[np.frombuffer("\n".join(beyond).encode(), np.uint8)].tobytes().decode("utf-16-le").split("\n") if beyond else []
        if self.bytewise:
            joined = self._ids(self.bare, plain + mapped)
        else:
            joined = np.concatenate([self._ids(self.bare, plain), self._ids(self.library, beyond)])
        letters = plain + beyond
        ends = np.flatnonzero(self.ends[joined])
        if len(ends) != len(letters):  # not so with this vocabulary
            letters, other, ends, joined = [], letters + other, ends[:0], joined[:0]
        ids = [e.ids for e in self.library.encode_batch_fast(other, add_special_tokens=False)]
        size = np.concatenate([np.diff(ends, prepend=-1), np.fromiter(map(len, ids), np.int64, len(ids))])
        rest = np.fromiter(chain.from_iterable(ids), np.uint32, int(size[len(letters) :].sum()))
        self.number.update(zip(chain(letters, other), range(len(self.number), len(self.number) + len(size)), strict=True))
        self.flat = np.concatenate([self.flat, joined, rest])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(size)])
        self.seen = np.concatenate([self.seen, np.zeros(len(size), np.int64)])

    def _cut(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of plain texts."""
        inside, starts, ends, between = units(texts)
        bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        cut = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(inside)).dictionary_encode()
        which, (bounds, letters) = cut.indices.to_numpy(), buffers_of(cut.dictionary)
        distinct = np.insert(letters, bounds[1:], ord("\n")).tobytes().decode().split("\n")[:-1]
        k = np.fromiter(map(self.number.get, distinct, repeat(-1)), np.int64, len(distinct))
        unknown = np.flatnonzero(k < 0)
        if len(unknown):
            new = [distinct[i] for i in unknown]
            self._learn([w for w in new if w.isalpha()], [w for w in new if not w.isalpha()])
            k[unknown] = np.fromiter(map(self.number.__getitem__, new), np.int64, len(new))
        self.seen[k] += np.bincount(which, minlength=len(k))
        # the ids of the distinct units, then those of all
        size = self.begin[k + 1] - self.begin[k]
        first = np.cumsum(size) - size
        own = self.flat[np.repeat(self.begin[k] - first, size) + np.arange(size.sum())]
        sizes = size[which]
        after = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        flat = own[np.repeat(first[which] - after[:-1], sizes) + np.arange(after[-1])]
        return np.split(flat, after[np.searchsorted(starts, between)])

    def encode_bytes(self, texts: list[bytes], plain: np.ndarray) -> list[np.ndarray]:
        """plain: whether a text has only characters that are cut here as the library cuts them."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        rest = [i for i in range(len(texts)) if not plain[i]]
        for i, e in zip(rest, self.library.encode_batch_fast([texts[i].decode() for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32)
        if len(self.number) > CACHED:
            self.forget(CACHED // 2)
        own = [i for i in range(len(texts)) if plain[i]]
        if own:
            for i, ids in zip(own, self._cut([texts[i] for i in own]), strict=True):
                out[i] = ids
        return out

    def encode(self, texts: list[str], plain: np.ndarray) -> list[np.ndarray]:
        return self.encode_bytes([t.encode() for t in texts], plain)


BLANK, LETTER, MARK, OTHER = range(4)
_KIND = np.full(256, OTHER, np.uint8)  # of the bytes of lower-cased texts; 0 stands between two texts
_KIND[[0, *range(9, 14), 32]] = BLANK
_KIND[[*range(ord("a"), ord("z") + 1), *range(0x80, 0xC0), *range(0xC3, 0xCB)]] = LETTER  # U+00C0 to U+02BF: letters but for two signs
_KIND[list(MARKS.encode())] = MARK


def _mapped() -> np.ndarray:
    """The library's characters for bytes, but for the line feed, which stands between units here."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = np.arange(256, dtype="<u2")
    hidden = np.setdiff1d(out, shown)
    out[hidden] = 256 + np.arange(len(hidden))
    out[10] = 10
    return out


_MAPPED = _mapped()


def lowered(texts: list[bytes]) -> np.ndarray:
    """The lower-cased bytes of texts of characters up to U+02FF, a 0 between two."""
    joined = b"\0".join(texts)
    if joined and np.frombuffer(joined, np.uint8).max() > 0xC3:  # characters from U+0100 on
        joined = joined.decode().lower().encode()
    data = np.frombuffer(bytearray(joined.lower()), np.uint8)
    second = np.flatnonzero(data[:-1] == 0xC3) + 1  # U+00C0 to U+00FF
    capital = second[(data[second] <= 0x9E) & (data[second] != 0x97)]
    data[capital] += 0x20
    return data


def units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The units of plain texts: words, those of letters with marks behind as two. Their lower-cased bytes, one unit behind
    the other; where they begin and end in all bytes; and where one text ends and the next begins."""
    data = lowered(texts)
    kind = _KIND[data]
    signs = np.flatnonzero((data[1:] == 0x97) | (data[1:] == 0xB7)) + 1
    kind[signs[data[signs - 1] == 0xC3]] = OTHER  # U+00D7 and U+00F7
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind != BLANK
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    at = np.flatnonzero(kind >= MARK)
    word = np.searchsorted(starts, at, "right") - 1
    first = np.flatnonzero(np.diff(word, prepend=-1))  # of each word's
    if len(first):
        marks = np.add.reduceat((kind[at] == MARK).astype(np.int64), first)
        at, word = at[first], word[first]
        two = (at > starts[word]) & (marks == ends[word] - at)
        starts, ends = np.insert(starts, word[two] + 1, at[two]), np.insert(ends, word[two], at[two])
    return data[inside[1:-1]], starts, ends, np.flatnonzero(data == 0)


_ALONE = np.ones(256, dtype=bool)  # bytes of characters up to U+02FF, without controls and U+0080-U+00BF
_ALONE[[*range(9), *range(14, 32), 127, 0xC2, *range(0xCC, 256)]] = False
_encoders: dict[str, Encoder] = {}


def encoded(column: pa.Array, path: str, most: int = 1 << 20):
    """Row ranges of a column, and for each range the ids of its texts, the end id included."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    encoder = _encoders[path]
    offsets, data = buffers_of(column)
    for a, b in pieces(offsets, most):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        odd = np.searchsorted(np.flatnonzero(~_ALONE[part]), at)
        texts = [part[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
        yield a, b, [np.append(ids, np.uint32(END)) for ids in encoder.encode_bytes(texts, odd[1:] == odd[:-1])]


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, part (its partition), first (ids of the partition before it), n, ids (little-endian, 16 bits each if all fit, else 32)."""

    def each(batches):
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b, all_ids in encoded(batch.column(1), path):
                sizes = np.array([len(x) for x in all_ids], np.int64)
                first = before + np.cumsum(sizes) - sizes
                before += int(sizes.sum())
                ids = pa.array([x.astype("<u2" if x.max() < 1 << 16 else "<u4").tobytes() for x in all_ids], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.full(len(sizes), part, np.int64)), pa.array(first), pa.array(sizes), ids], names=["doc_id", "part", "first", "n", "ids"])
        if path in _encoders:
            _encoders[path].forget(CACHED // 8)  # the worker stays, for tasks of other kinds as well

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(each, "doc_id long, part long, first long, n long, ids binary")


def _cut(batches):
    for batch in batches:
        doc, place, sizes, ids = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
        owner, rows = [], [[], [], [], [], [], []]
        for i, (at, n, raw) in enumerate(zip(place, sizes, ids, strict=True)):
            stored = memoryview(raw.as_buffer())
            data = stored if len(stored) == 4 * n else np.frombuffer(stored, "<u2").astype("<u4").tobytes()
            start = 0
            while start < n:
                sequence, offset = divmod(at + start, SEQUENCE)
                length = min(SEQUENCE - offset, n - start)
                owner.append(i)
                for column, value in zip(rows, (start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), n, sequence, offset), strict=True):
                    column.append(value)
                start += length
        yield pa.RecordBatch.from_arrays([doc.take(pa.array(owner, pa.int64())), *[pa.array(r, pa.int64()) for r in rows]], names=PIECE.split())


PIECE = "doc_id start length ids_crc32 doc_tokens sequence_id offset"


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    tables = Tables(docs.sparkSession, "packing")
    held = tables.put(tokenised(docs, path or vocabulary_path()))
    # a row for each partition of the input; their sums ahead, in two passes
    totals = held.groupBy("part").agg(F.sum("n").alias("n")).withColumn("all", F.lit(0))
    base = tables.put(ahead(totals, ["all"], F.floor(F.col("part") / PARTS), ["part"], "n").select("part", F.col("before").alias("ahead")))
    if base.count() <= BROADCAST_ROWS:
        base = F.broadcast(base)
    placed = held.join(base, "part").select("doc_id", (F.col("first") + F.col("ahead")).alias("at"), "n", "ids")
    return placed.mapInArrow(_cut, ", ".join(f"{c} long" for c in PIECE.split()))


def op6_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
