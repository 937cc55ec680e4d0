"""Problem 3: stretches of at least a given length that occur verbatim in more than one record.

The sequences are cut into overlapping paragraphs: a paragraph is a run of consecutive windows of ``span`` letters that
have the same MinHash, the smallest hash among a window's k-mers. One band of one row is the banding with the highest
recall: equal windows have equal MinHashes, so every shared window collides and none is missed. A similarity of
paragraphs, as the method has it for near-duplicates, could not give the exact ends of the spans, so colliding
paragraphs are verified by equality of their windows. The k-mer hash is a bijection and letters are packed two bits
each, so no comparison rests on a digest.

Only band keys are shuffled for all paragraphs: which of them occur in several records is found by an aggregate with
map-side combining. Each record learns its colliding keys, and only those paragraphs are sent on with their letters, to
be compared in a stream sorted by key. A key with more than ``hot_rows`` paragraphs is no group of that stream: its
windows are spread and aggregated by their own letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringweave.llm.groups import linked_groups
from ringweave.operators.sweep import periods_and_gaps
from ringweave.session import Scratch, union_all

K = 24  # letters of a k-mer, two bits each
MASK = 62  # at most so many windows of a paragraph, a bit each
STRETCH = 500_000  # windows that a task holds in arrays at a time
HOT_ROWS = 100_000  # paragraphs of one key that are compared in one task

CODES = np.full(256, 255, np.uint8)
for _i, _c in enumerate(b"ACGT"):
    CODES[_c] = CODES[_c + 32] = _i
for _c in b"BDEFHIJKLMNOPQRSUVWXYZ":
    CODES[_c] = CODES[_c + 32] = 4  # letters that count as positions but are in no window


def _most(span: int) -> int:
    """Windows of a paragraph: neighbours share their MinHash for no longer than it stays inside the window."""
    return min(span - K + 1, MASK)


def _words(span: int) -> list[str]:
    """Columns with a paragraph's letters, 32 in each."""
    return [f"w{i}" for i in range(-(-(span + _most(span) - 1) // 32))]


def _run_ddl(span: int) -> str:
    return "rec bigint, band bigint, start int, n int, hot boolean, " + ", ".join(f"{w} bigint" for w in _words(span))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _packed(codes: np.ndarray, length: int) -> np.ndarray:
    """For each position the next ``length`` (at most 32) letters as one number."""
    parts, power = {1: codes}, 1
    while power * 2 <= length:
        x = parts[power]
        parts[power * 2] = (x[:-power] << np.uint64(2 * power)) | x[power:]
        power *= 2
    m = len(codes) - length + 1
    out, at = np.zeros(m, np.uint64), 0
    for p in sorted(parts, reverse=True):
        if at + p <= length:
            out = (out << np.uint64(2 * p)) | parts[p][at : at + m]
            at += p
    return out


def _window_min(h: np.ndarray, width: int) -> np.ndarray:
    power = 1
    while power * 2 <= width:
        h = np.minimum(h[:-power], h[power:])
        power *= 2
    rest = width - power
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


class Letters:
    """The letters of a batch of records given as one buffer of bytes with offsets."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        code = CODES[np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
        keep = code != 255
        self.owner = np.repeat(np.arange(len(column), dtype=np.int32), np.diff(offsets))[keep]
        self.code = code[keep]
        self.first = np.searchsorted(self.owner, np.arange(len(column)))  # where each record's letters begin

    def paragraphs(self, span: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """First window, number of windows and band key of the paragraphs, a bounded stretch of letters at a time."""
        for at in range(0, len(self.code) - span + 1, STRETCH):
            part = slice(at, at + STRETCH + span - 1)
            begin, length, band = _paragraphs(self.code[part], self.owner[part], span)
            yield at + begin, length, band

    def packed(self, begin: np.ndarray, length: np.ndarray, span: int) -> list[np.ndarray]:
        """The letters of paragraphs, 32 in each number, zeros behind the last."""
        if not len(begin):
            return [np.zeros(0, np.int64) for _ in _words(span)]
        out, (low, high) = [], (int(begin.min()), int(begin.max()) + 32 * len(_words(span)) + 32)
        code = self.code[low:high]
        letters = np.concatenate([np.where(code == 4, 0, code).astype(np.uint64), np.zeros(high - low - len(code), np.uint64)])
        packed = _packed(letters, 32)
        for j in range(len(_words(span))):
            used = np.clip(length + span - 1 - 32 * j, 0, 32)
            drop = np.minimum(2 * (32 - used), 63).astype(np.uint64)
            out.append(np.where(used == 0, np.uint64(0), (packed[begin - low + 32 * j] >> drop) << drop).view(np.int64))
        return out


def _paragraphs(code: np.ndarray, owner: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = len(code) - span + 1
    bad = np.concatenate([[0], np.cumsum(code == 4)])
    valid = (bad[span:] == bad[:-span]) & (owner[:m] == owner[span - 1 :])
    letters = np.where(code == 4, 0, code).astype(np.uint64)
    low = _window_min(_mix(_packed(letters, K)), span - K + 1)
    # A paragraph ends where the MinHash or the record changes, at an invalid window, and after as many windows as fit.
    new = np.ones(m, bool)
    new[1:] = (low[1:] != low[:-1]) | (owner[1:m] != owner[: m - 1]) | (valid[1:] != valid[:-1])
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, m))
    most = _most(span)
    if (length > most).any():
        pieces = -(-length // most)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin, whole = np.repeat(begin, pieces) + nth * most, np.repeat(length, pieces)
        length = np.minimum(most, whole - nth * most)
    ok = valid[begin]
    begin, length = begin[ok], length[ok]
    return begin, length, low[begin].view(np.int64)


def _bands(span: int):
    """(rec, band): the band keys of each record's paragraphs, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rec, letters = batch.column(0).to_numpy(), Letters(batch.column(1))
            for begin, _, band in letters.paragraphs(span):
                owner = letters.owner[begin]
                order = np.lexsort((band, owner))
                new = np.append(True, (band[order][1:] != band[order][:-1]) | (owner[order][1:] != owner[order][:-1]))[: len(order)]
                keep = order[new]
                yield pa.RecordBatch.from_arrays([pa.array(rec[owner[keep]]), pa.array(band[keep])], names=["rec", "band"])

    return run


def _marked(owner: np.ndarray, band: np.ndarray) -> np.ndarray:
    """One number for a record of the batch and a key; that two may share one only sends a paragraph in vain."""
    return _mix(owner.astype(np.uint64)) ^ band.view(np.uint64)


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    among = np.sort(among)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values if len(among) else np.zeros(len(values), bool)


def _cut(span: int):
    """(rec, seq, bands, hot) -> the record's paragraphs with one of these keys, with their letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rec, letters = batch.column(0).to_numpy(), Letters(batch.column(1))
            told = [_marked(np.repeat(np.arange(len(rec)), np.diff(c.offsets.to_numpy())), c.flatten().to_numpy()) for c in (batch.column(2), batch.column(3))]
            for begin, length, band in letters.paragraphs(span):
                mark = _marked(letters.owner[begin], band)
                keep = _member(mark, told[0])
                begin, length, band, mark = begin[keep], length[keep], band[keep], mark[keep]
                who = letters.owner[begin]
                start = (begin - letters.first[who] + 1).astype(np.int32)
                columns = [rec[who], band, start, length.astype(np.int32), _member(mark, told[1]), *letters.packed(begin, length, span)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rec", "band", "start", "n", "hot", *_words(span)])

    return run


def _expanded(words: np.ndarray, n: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place, and letters as a row of numbers, of each window of paragraphs given as rows of words."""
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    words = np.column_stack([words, np.zeros(len(words), np.uint64)])
    out = np.empty((len(row), -(-span // 32)), np.uint64)
    for j in range(out.shape[1]):
        word, shift = (at + 32 * j) // 32, (2 * (at % 32)).astype(np.uint64)
        here, more = words[row, word], words[row, np.minimum(word + 1, words.shape[1] - 1)]
        x = np.where(shift == 0, here, (here << shift) | (more >> ((np.uint64(64) - shift) & np.uint64(63))))
        drop = np.uint64(2 * (32 - min(32, span - 32 * j)))
        out[:, j] = (x >> drop) << drop
    return row, at, out


def _groups(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal rows are neighbours, and where each of them begins in it."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    return order, np.flatnonzero(new)


def _batch_words(batch: pa.RecordBatch | pa.Table, span: int) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy().view(np.uint64) for c in _words(span)])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by band as tables in which no band is cut."""
    rest = None
    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([*(rest.to_batches() if rest is not None else []), batch]).combine_chunks()
            band = rows.column("band").to_numpy()
            cut = int(np.searchsorted(band, band[-1]))  # the last key may go on in the next batch
            if cut:
                yield rows.slice(0, cut).combine_chunks()
            rest = rows.slice(cut)
    if rest is not None:
        yield rest.combine_chunks()


class Compared:
    """The windows of some paragraphs, whole keys, grouped by their letters; equal paragraphs of a key are taken as one."""

    def __init__(self, rows: pa.Table, span: int):
        self.rec, band, n = (rows.column(c).to_numpy() for c in ("rec", "band", "n"))
        self.n, words = n.astype(np.int64), _batch_words(rows, span)
        order, starts = _groups([*words.T, n, band])
        kind = np.empty(len(order), np.int64)
        kind[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
        self.kind, first = kind, order[starts]
        self.low, self.high = np.minimum.reduceat(self.rec[order], starts), np.maximum.reduceat(self.rec[order], starts)
        self.row, self.at, letters = _expanded(words[first], self.n[first], span)
        order, starts = _groups([*letters.T, band[first][self.row]])
        size = np.diff(np.append(starts, len(order)))
        least = np.minimum.reduceat(self.low[self.row][order], starts) if len(order) else self.low
        most = np.maximum.reduceat(self.high[self.row][order], starts) if len(order) else self.high
        self.least, self.shared = np.empty(len(order), np.int64), np.empty(len(order), bool)
        self.least[order], self.shared[order] = np.repeat(least, size), np.repeat(least < most, size)

    def masks(self) -> np.ndarray:
        """For each paragraph, a bit for each window that another record has."""
        bits = np.bitwise_or.reduceat(self.shared.astype(np.int64) << self.at, np.flatnonzero(self.at == 0))
        return bits[self.kind]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Different (smallest record of a window, record that has it)."""
        order, starts = _groups([self.least[self.shared], self.row[self.shared]])
        least, kind = self.least[self.shared][order[starts]], self.row[self.shared][order[starts]]
        by, at = np.argsort(self.kind, kind="stable"), np.searchsorted(np.sort(self.kind), np.arange(len(self.low) + 1))
        many = np.diff(at)[kind]
        place = np.repeat(at[:-1][kind], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        left, right = np.repeat(least, many), self.rec[by[place]]
        order, starts = _groups([left, right])
        left, right = left[order[starts]], right[order[starts]]
        return left[left < right], right[left < right]


def _masks(span: int):
    """(rec, start, mask) of paragraphs with shared windows, from paragraphs sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _streamed(batches):
            mask = Compared(rows, span).masks()
            keep = np.flatnonzero(mask)
            yield pa.RecordBatch.from_arrays([pa.array(rows.column(c).to_numpy()[keep]) for c in ("rec", "start")] + [pa.array(mask[keep])], names=["rec", "start", "mask"])

    return run


def _links(span: int):
    """(l, r): each record linked to the smallest record with the same window, from paragraphs sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _streamed(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in Compared(rows, span).links()], names=["l", "r"])

    return run


def _spread(span: int):
    """(rec, start, at, x0, ...): each window of a paragraph, its letters as numbers."""
    names = [f"x{j}" for j in range(-(-span // 32))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, letters = _expanded(_batch_words(batch, span), batch.column("n").to_numpy().astype(np.int64), span)
            columns = [batch.column("rec").to_numpy()[row], batch.column("start").to_numpy()[row], at.astype(np.int32), *letters.T.copy().view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rec", "start", "at", *names])

    return run, names


def _colliding(records: DataFrame, record: str, seq: str, span: int, hot_rows: int, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """Paragraphs whose key several records have, sorted by key, and the windows of those of hot keys, if there are any."""
    if span < K:
        raise ValueError(f"a span has at least {K} letters")
    rows = records.select(F.col(record).cast("bigint").alias("rec"), F.col(seq).alias("seq")).filter("rec is not null and length(seq) > 0")
    keys = rows.mapInArrow(_bands(span), "rec bigint, band bigint")
    several = keys.groupBy("band").agg(F.min("rec").alias("low"), F.max("rec").alias("high"), F.count("*").alias("n")).filter("low < high")
    shared = scratch.write(several.select("band", (F.col("n") > hot_rows).alias("hot")), "shared")
    # A record's keys are no more than its own letters.
    told = keys.join(shared, "band").groupBy("rec").agg(F.collect_set("band").alias("bands"), F.collect_set(F.when(F.col("hot"), F.col("band"))).alias("hot_bands"))
    found = rows.join(told, "rec").select("rec", "seq", "bands", "hot_bands").mapInArrow(_cut(span), _run_ddl(span))
    if shared.filter("hot").isEmpty():
        return found.repartition("band").sortWithinPartitions("band"), None
    found = scratch.write(found, "paragraphs")
    run, names = _spread(span)
    windows = found.filter("hot").mapInArrow(run, "rec bigint, start int, at int, " + ", ".join(f"{x} bigint" for x in names))
    least = windows.groupBy(*names).agg(F.min("rec").alias("low"), F.max("rec").alias("high")).filter("low < high").select(*names, "low")
    return found.filter("not hot").repartition("band").sortWithinPartitions("band"), windows.join(least, names)


def shared_paragraphs(records: DataFrame, record: str, seq: str, span: int = 60, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(rec, start, mask): paragraphs with shared windows; bit i of mask is set if window start + i is shared."""
    stream, windows = _colliding(records, record, seq, span, hot_rows, Scratch(records.sparkSession, "spans"))
    found = stream.mapInArrow(_masks(span), "rec bigint, start int, mask bigint")
    if windows is None:
        return found
    return found.unionByName(windows.groupBy("rec", "start").agg(F.expr("bit_or(shiftleft(1L, at))").alias("mask")))


def _stretches(span: int):
    """The covered stretches of each paragraph, from its mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rec, start, mask = (batch.column(c).to_numpy() for c in ("rec", "start", "mask"))
            bits = (mask.view(np.uint64)[:, None] >> np.arange(MASK + 1, dtype=np.uint64)) & np.uint64(1)
            step = np.diff(np.pad(bits.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            row, at = np.nonzero(step == 1)
            _, past = np.nonzero(step == -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rec[row]), pa.array((start[row] + at).astype(np.int32)), pa.array((start[row] + past - 1 + span - 1).astype(np.int32))], names=["rec", "a", "b"]
            )

    return run


def shared_spans(records: DataFrame, record: str, seq: str, *, span: int = 60, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``ref_no``, ``span_from``, ``span_to``: the longest runs of positions that each lie in a shared window.

    - Positions count the letters A-Z of the sequence, case ignored, from 1; everything else is dropped. A window is
      shared if it occurs in a record of another number and consists of A, C, G and T. span: any number from 24 on.
    - Null and empty sequences, sequences shorter than the span, and null record numbers give no rows. Rows that repeat
      a record number are the same record. Sequences of any length are taken whole. Other columns are ignored.
    """
    found = shared_paragraphs(records, record, seq, span, hot_rows).mapInArrow(_stretches(span), "rec bigint, a int, b int")
    found = Scratch(records.sparkSession, "stretches").write(found, "stretches")  # the sweep reads it several times
    merged = periods_and_gaps(found, ["rec"], {"": ("a", "b")}).filter("kind = 'period'")
    return merged.select(F.col("rec").alias("ref_no"), F.col("pos_from").cast("int").alias("span_from"), F.col("pos_to").cast("int").alias("span_to"))


def span_clusters(records: DataFrame, record: str, seq: str, *, span: int = 60, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``ref_no``, ``cluster``: records joined, directly or through others, by shared spans, under the smallest number.

    Each window links its records to the smallest of them, so a span in many records gives no pairs. Records without a
    shared span do not appear.
    """
    stream, windows = _colliding(records, record, seq, span, hot_rows, Scratch(records.sparkSession, "clusters"))
    parts = [stream.mapInArrow(_links(span), "l bigint, r bigint")]
    if windows is not None:
        parts.append(windows.filter("low < rec").select(F.col("low").alias("l"), F.col("rec").alias("r")).distinct())
    return linked_groups(union_all(*parts).distinct(), "l", "r", seq="ref_no").withColumnRenamed("group_id", "cluster")
