"""Problem 7: documents that contain passages of test items, by MinHash containment search with exact verification.

A short item inside a long document has almost no weight in a signature of the whole document, which is why containment
search partitions by size. Here the partition is taken to its end: texts of any size are cut into domains of one size,
the windows of ``passage`` words, for which containment and Jaccard similarity are the same and a signature of one
MinHash over the five-word shingles suffices. Two equal windows have equal MinHashes, so no passage is missed; a window
shares its MinHash with most of its neighbours, so a text has about two signatures for ``passage`` words. Candidates are
then verified by the exact words of the window.

The documents are read once: every task has filters of the items' MinHashes and windows, of a fixed number of bits whatever
the number of items, and passes on only windows that collide with both. The more windows the items have, the more pass in vain, but none
is missed; items and windows are then joined by signature and words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
CHUNK = 2_000_000  # bytes whose words are hashed at a time

LOWER = np.zeros(256, np.uint8)  # letters and digits in lower case, everything else is no part of a word
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    LOWER[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    LOWER[_c] = _c + 32

WINDOW_DDL = "id bigint, band bigint, words string"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a batch of texts given as one buffer of bytes with offsets."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        self.text = LOWER[data]
        inside = self.text != 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = offsets[1:-1]
        edges = edges[edges < len(inside)]
        first[edges] |= inside[edges]  # a word ends where its text ends
        last = np.append(first[1:] | ~inside[1:], True) & inside if len(inside) else inside
        self.begin, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.owner = np.searchsorted(offsets, self.begin, side="right") - 1
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        out = np.zeros(len(self.begin), np.uint64)
        at = 0
        while at < len(out):
            to = max(at + 1, int(np.searchsorted(self.begin, self.begin[at] + CHUNK)))
            begin, end = self.begin[at:to], self.end[at:to]
            size = end - begin
            starts = np.cumsum(size) - size
            place = np.arange(size.sum()) - np.repeat(starts, size)
            power = np.cumprod(np.full(size.max() + 1, 0x9E3779B97F4A7C15, np.uint64))
            letters = self.text[np.repeat(begin, size) + place].astype(np.uint64)
            out[at:to] = _mix(np.add.reduceat(letters * power[place], starts))
            at = to
        return out

    def rolled(self, width: int) -> np.ndarray:
        """A hash of each run of width words, across texts too."""
        m = len(self.hash) - width + 1
        out = np.zeros(max(m, 0), np.uint64)
        for j in range(width if m > 0 else 0):
            out = out * np.uint64(0xD6E8FEB86659FD93) + self.hash[j : j + m]
        return _mix(out)

    def rolled_at(self, at: np.ndarray, width: int) -> np.ndarray:
        """The same for the runs that begin at some places only."""
        out = np.zeros(len(at), np.uint64)
        for j in range(width):
            out = out * np.uint64(0xD6E8FEB86659FD93) + self.hash[at + j]
        return _mix(out)

    def windows(self, passage: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where a window lies in one text, and each window's MinHash."""
        m = len(self.hash) - passage + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        low, power, width = self.rolled(SHINGLE), 1, passage - SHINGLE + 1
        while power * 2 <= width:
            low = np.minimum(low[:-power], low[power:])
            power *= 2
        low = np.minimum(low[:m], low[width - power : width - power + m])
        at = np.flatnonzero(self.owner[:m] == self.owner[passage - 1 :])
        return at, low[at]

    def words(self, at: int, passage: int) -> str:
        return b" ".join(self.text[b:e].tobytes() for b, e in zip(self.begin[at : at + passage], self.end[at : at + passage])).decode()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Words]]:
    """Ids and words of some texts at a time, as many as make up a bounded number of bytes."""
    for batch in batches:
        ids, column = batch.column(0).to_numpy(), batch.column(1).cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + 2 * CHUNK)) - 1)
            yield ids[at:to], Words(offsets[at : to + 1] - offsets[at], data[offsets[at] : offsets[to]])
            at = to


class Filter:
    """The bits set for the items' windows, as sorted places of numbers of 64 bits that are not zero."""

    def __init__(self, place: np.ndarray, bits: np.ndarray, digits: int):
        order = np.argsort(place)
        self.place, self.bits, self.digits = place[order], bits[order].view(np.uint64), digits

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.place):
            return np.zeros(len(hashes), bool)
        place, bit = _filter_place(hashes, self.digits)
        at = np.minimum(np.searchsorted(self.place, place), len(self.place) - 1)
        return (self.place[at] == place) & (((self.bits[at] >> bit) & np.uint64(1)) == 1)


def _filter_place(hashes: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray]:
    top = hashes >> np.uint64(64 - digits)
    return (top >> np.uint64(6)).astype(np.int32), top & np.uint64(63)


def _colliding(passage: int, sent=None):
    """(id, band, words) of each text's windows; sent: the filters that MinHashes and windows must pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words in _texts(batches):
            at, low = words.windows(passage)
            if sent is not None:
                bands, whole = sent.value
                hit = bands.passes(low)
                at, low = at[hit], low[hit]
                hit = whole.passes(words.rolled_at(at, passage))
                at, low = at[hit], low[hit]
            found = {(int(words.owner[i]), words.words(i, passage)): int(b) for i, b in zip(at, low.view(np.int64))}
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(ids[o]) for o, _ in found], pa.int64()), pa.array(list(found.values()), pa.int64()), pa.array([w for _, w in found], pa.string())], names=["id", "band", "words"]
            )

    return run


def _keys(passage: int, digits: int):
    """(whole, place, bits) of the filters that a batch's windows set: by their MinHash, and by a hash of all their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words in _texts(batches):
            at, low = words.windows(passage)
            for whole, hashes in ((False, low), (True, words.rolled_at(at, passage))):
                place, bit = _filter_place(np.unique(hashes), digits)
                first = np.flatnonzero(np.append(True, place[1:] != place[:-1])[: len(place)])
                bits = np.bitwise_or.reduceat(np.uint64(1) << bit, first).view(np.int64) if len(first) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), whole)), pa.array(place[first]), pa.array(bits)], names=["whole", "place", "bits"])

    return run


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).filter("id is not null and length(text) > 0")


def _send(spark: SparkSession, wanted: DataFrame, passage: int, digits: int):
    """The filters in every task: an aggregate with at most 2 to the power of digits - 5 rows."""
    found = wanted.mapInArrow(_keys(passage, digits), "whole boolean, place int, bits bigint").groupBy("whole", "place").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    whole, place, bits = (found.column(c).to_numpy() for c in ("whole", "place", "bits"))
    return spark.sparkContext.broadcast(tuple(Filter(place[whole == w], bits[whole == w], digits) for w in (False, True)))


def leaked_items(items: DataFrame, item: str, item_text: str, documents: DataFrame, doc: str, doc_text: str, *, passage: int = 20, filter_digits: int = 27) -> DataFrame:
    """``item_id``, ``doc_id``: items and documents that have ``passage`` consecutive words in common.

    - A word is a longest run of ASCII letters and digits, case ignored; whatever stands between words is ignored.
    - Null and empty texts, texts of fewer words, and null ids give no rows. Repeated rows change nothing. Whole texts
      of any length are read. Other columns are ignored, whatever they are called.

    filter_digits: binary digits of a window's hash that tell its bit in a filter; 27 make at most 2 million numbers in either.
    """
    if passage < SHINGLE:
        raise ValueError(f"a passage has at least {SHINGLE} words")
    wanted, corpus = _rows(items, item, item_text), _rows(documents, doc, doc_text)
    found = corpus.mapInArrow(_colliding(passage, _send(documents.sparkSession, wanted, passage, filter_digits)), WINDOW_DDL)
    passages = wanted.mapInArrow(_colliding(passage), WINDOW_DDL).select(F.col("id").alias("item_id"), "band", "words")
    return found.select(F.col("id").alias("doc_id"), "band", "words").join(passages, ["band", "words"]).select("item_id", "doc_id").distinct()
