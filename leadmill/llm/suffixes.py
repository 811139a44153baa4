"""Exact substring de-duplication with a logarithmic family of suffix indexes.

A byte goes when it lies in a string of ``length`` bytes that also starts earlier: in a document with a
smaller id, or further up in the same one.

Suffixes that matter are those with ``length`` bytes ahead. Winnowing groups them: each one points to the
smallest hash of a ``gram``-byte string in its first ``length`` bytes, the last on a tie, and neighbouring
suffixes that point to one place form a group, about one per 19 bytes of text. A suffix array here is sparse:
one entry per group, in the order of its first eight bytes, then of a 128-bit hash of all that the group's
strings cover. Groups and strings are equal when those bytes and hashes are.

Documents come in batches by ascending id. A batch's entries are dealt to ranges of the suffix order
and sorted; ``merge_scan`` runs over them and the entries of all levels side by side, in that order, and what
no level has becomes a level of its own. Levels of as many batches are merged into one of twice as many. The
levels hold the first occurrence of every group.

* A group that occurred before is a match of full length: all its strings are repeats.
* The ends of matches are groups that are new although their smallest hash is shared with another group.
  Only there are strings compared one by one, by 128-bit hash and first position, sorted by both.

``dedup_substrings`` knows the whole corpus, so groups whose smallest hash occurs once in it stay out of the
index; a bitmap of the others filters them in the tasks while it is at most ``BITMAP`` bytes, and a join does
beyond. A ``SuffixIndex`` keeps its levels in a folder, with every group, and takes further batches in later
sessions.

Equal groups and equal strings of one list of texts (``CHUNK`` bytes, or the strings of ``ROWS`` texts) are told
apart where they are made: only the first one is dealt to a range, so a passage in a third of all documents is never
paired with itself and is one row for each list there. Texts longer than ``CHUNK`` are read in
pieces that overlap by a string; a group that a piece's end cuts is an end of a match like any other.

Nulls: a null text is empty; rows with a null id are never cut and cut nothing. Ids should be unique: rows
with one id share what is removed from any of them. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.llm.columns import col
from leadmill.llm.scratch import Scratch, delete
from leadmill.llm.words import mix

LENGTH, GRAM, BATCHES = 100, 64, 3
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Base and bytes of the second hash, which makes 128 bits of the first.
_BASE2, _BYTE2 = np.uint64(0x94D049BB133111EB), mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
#: Bytes that the bitmap of shared anchors may have, and bits for each of them.
BITMAP, BITS_EACH = 1 << 26, 16
BLOCK = 4096
#: Bytes of text that are hashed at once; rows, and bytes of them, that a task turns into one batch.
CHUNK = 1 << 20
#: Bytes whose hashes are made at once, so that their arrays stay in the processor's cache.
STEP = 1 << 15
ROWS, BYTES = 512, 1 << 25


@lru_cache
def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, base, np.uint64)]), dtype=np.uint64)


def rolling(data: np.ndarray, size: int, at: np.ndarray | slice = slice(None), base: np.uint64 = _BASE, bytes_: np.ndarray = _BYTE) -> np.ndarray:
    """Polynomial hashes of the strings of ``size`` bytes at the given positions, by sums from the beginning on.

    data: at most STEP bytes and a string. The base is odd, so a sum is moved to its place by a power of its inverse.
    """
    room = -(-max(len(data), 1) // STEP) * STEP
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(bytes_[data] * _powers(pow(int(base), -1, 1 << 64), room)[: len(data)], out=sums[1:])
    n = max(len(data) - size + 1, 0)
    return (sums[size:][at] - sums[:n][at]) * _powers(int(base), room)[size - 1 : size - 1 + n][at] if n else sums[:0]


def strings_at(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of the strings of ``length`` bytes at the positions, which ascend."""
    out = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    begins = np.arange(0, len(data), STEP)
    for begin, i, j in zip(begins.tolist(), np.searchsorted(at, begins).tolist(), np.searchsorted(at, begins + STEP).tolist(), strict=True):
        if i < j:
            piece, own = data[begin : begin + STEP + length - 1], at[i:j] - begin
            out[0].append(rolling(piece, length, own))
            out[1].append(rolling(piece, length, own, _BASE2, _BYTE2))
    return np.concatenate(out[0]), np.concatenate(out[1])


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The position of the smallest value, the last on a tie, of each window of ``width`` values."""
    n = len(values)
    packed = (values & np.uint64(0xFFFFFFFF00000000)) | np.arange(n - 1, -1, -1, dtype=np.uint64)
    size, low = 1, packed
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: n - width + 1], low[width - size : width - size + n - width + 1])
    return n - 1 - (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _winnowed(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last suffix of each group of texts laid end to end, over STEP suffixes at a time."""
    valid = np.ones(len(data) + 1, bool)
    for end, size in zip(ends.tolist(), np.diff(ends, prepend=0).tolist(), strict=True):
        valid[end - min(size, length - 1) : end] = False
    valid[-1] = False
    names, firsts, lasts, last = [], [], [], -1
    for begin in range(0, len(data) - length + 1, STEP):
        order = mix(rolling(data[begin : begin + STEP + length - 1], gram))
        at = smallest(order, length - gram + 1)
        own = valid[begin : begin + len(at)]
        new = np.concatenate([[at[0] + begin != last or not begin or not valid[begin - 1]], (at[1:] != at[:-1]) | ~own[:-1]])
        lo = np.flatnonzero(new & own)
        names.append(order[at[lo]])
        firsts.append(lo + begin)
        last = at[-1] + begin
    lo = np.concatenate(firsts)
    # a group ends before the next one or before the suffixes that are too short
    gaps = np.flatnonzero(valid[:-1] & ~valid[1:])
    hi = np.minimum(np.concatenate([lo[1:] - 1, gaps[-1:]]), gaps[np.searchsorted(gaps, lo)]) if len(lo) else lo
    return np.concatenate(names).view(np.int64), lo, hi


def groups(texts: list[bytes], length: int = LENGTH, gram: int = GRAM, only_anchors: bool = False, kept: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """Of the texts laid end to end: anchor, text number, first suffix, number of suffixes, head and two hashes of each group.

    kept: which anchors' groups are wanted; nothing but the anchor is computed of the others.
    """
    ends = np.cumsum(np.array([len(t) for t in texts], np.int64))
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return (np.empty(0, np.int64),) * (1 if only_anchors else 7)
    name, lo, hi = _winnowed(data, ends, length, gram)
    if only_anchors:
        return (name,)
    if kept:
        name, lo, hi = (x[k] for k in [kept(name)] for x in (name, lo, hi))
    n = hi - lo + 1
    whole = lambda a, b: mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b + n.astype(np.uint64))).view(np.int64)
    (full, second), (full_hi, second_hi) = strings_at(data, lo, length), strings_at(data, hi, length)
    head = np.lib.stride_tricks.sliding_window_view(data, 8)[lo].view(">u8").ravel().astype(np.uint64)
    head = (head ^ np.uint64(1 << 63)).view(np.int64)  # keeps the byte order in a signed number
    text = np.searchsorted(ends, lo, "right")
    return name, text, lo - np.concatenate([[0], ends])[text], n, head, whole(full, full_hi), whole(second, second_hi)


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """The texts in lists of about ``CHUNK`` bytes: number of the text and offset of each piece, and the pieces.

    Every string of ``length`` bytes begins in one piece and lies whole in it.
    """
    rows, offsets, parts, size = [], [], [], 0
    for i, t in enumerate(texts):
        for start in range(0, max(len(t) - length + 1, 1), CHUNK):
            part = t if len(t) < CHUNK + length else t[start : start + CHUNK + length - 1]
            if size and size + len(part) > CHUNK:
                yield np.array(rows), np.array(offsets), parts
                rows, offsets, parts, size = [], [], [], 0
            rows.append(i)
            offsets.append(start)
            parts.append(part)
            size += len(part)
    if parts:
        yield np.array(rows), np.array(offsets), parts


def later(keys: tuple[np.ndarray, ...], ids: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Which rows have an equal one at an earlier place, by id and ``lo``, in the same list."""
    out = np.zeros(len(ids), bool)
    by = np.argsort(keys[0])
    tied = keys[0][by[1:]] == keys[0][by[:-1]]
    if tied.any():
        some = by[np.append(tied, False) | np.append(False, tied)]
        some = some[np.lexsort((lo[some], ids[some], *(k[some] for k in reversed(keys))))]
        new = np.append(True, np.any([k[some[1:]] != k[some[:-1]] for k in keys], axis=0))
        first = some[np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))]
        out[some] = (ids[some] != ids[first]) | (lo[some] != lo[first])
    return out


def _slices(batch: pa.RecordBatch, text_at: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``ROWS`` rows, and ``BYTES`` bytes of text unless one text has more."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = min(start + ROWS, max(start + 1, int(np.searchsorted(sizes, before + BYTES, "right"))))
        yield batch.slice(start, end - start)
        start = end


def _anchors(length: int, gram: int):
    """Anchors and how many groups have them, over a piece of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 0):
                for _, _, texts in _pieces([t.encode() for t in part.column(0).to_pylist()], length):
                    found, n = np.unique(groups(texts, length, gram, True)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int32))], ["anchor", "n"])

    return run


def _bits(size: int):
    """Blocks of the bitmap that have the given slots set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for slots in batch.column(1).to_pylist():
                bits = np.zeros(BLOCK * 8, bool)
                bits[np.array(slots) % (BLOCK * 8)] = True
                out.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["block", "bits"])

    return run


def _bitmap(shared: DataFrame, size: int) -> bytes:
    """``size`` bits, a power of two, with the low bits of each anchor set; the driver gets size / 8 bytes."""
    slots = shared.select((F.col("anchor").bitwiseAND(size - 1)).cast("int").alias("slot"))
    blocks = slots.groupBy(F.expr(f"cast(slot / {BLOCK * 8} as int)").alias("block")).agg(F.collect_set("slot").alias("slots"))
    out = bytearray(size // 8)
    for row in blocks.mapInArrow(_bits(size), "block int, bits binary").toLocalIterator():
        out[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = row["bits"]
    return bytes(out)


#: An entry's columns: where its group is, and what makes it equal to another.
ENTRY = "id long, lo int, n short, head long, whole long, more long, anchor long"
ORDER = ("head", "whole", "more")
#: What tasks make: the batch, the entry, and whether it is the first of its group in the list that was read with it.
MADE = f"batch int, {ENTRY}, leads boolean"


def _grouped(cuts: list[float], length: int, gram: int, bitmap, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bitmap.value, np.uint8) if bitmap else None

        def kept(anchor: np.ndarray) -> np.ndarray:
            slot = anchor & (size - 1)
            return table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 > 0

        for batch in batches:
            for part in _slices(batch, 1):
                ids = part.column(0).to_numpy(zero_copy_only=False)
                for rows, offsets, texts in _pieces([t.encode() for t in part.column(1).to_pylist()], length):
                    anchor, text, lo, n, head, whole, more = groups(texts, length, gram, kept=kept if bitmap else None)
                    own = ids[rows[text]].astype(np.int64)
                    turn = np.searchsorted(cuts, own, "right").astype(np.int32)
                    lo = (lo + offsets[text]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (turn, own, lo, n.astype(np.int16), head, whole, more, anchor, ~later((whole, more, head), own, lo))], ["batch", "id", "lo", "n", "head", "whole", "more", "anchor", "leads"]
                    )

    return run


def candidate_groups(texts: DataFrame, cuts: list[float], scratch: Scratch, length: int, gram: int, most: int = BITMAP) -> DataFrame:
    """All groups of texts (id, text) whose anchor another group has too, with the batch of their id."""
    counted = texts.select("text").mapInArrow(_anchors(length, gram), "anchor long, n int").groupBy("anchor").agg(F.sum("n").alias("n"))
    shared = scratch.write(counted.where("n > 1").select("anchor"), "anchors")
    size = 1 << max(18, (shared.count() * BITS_EACH).bit_length())
    fits = size <= most * 8
    bitmap = texts.sparkSession.sparkContext.broadcast(_bitmap(shared, size)) if fits else None
    found = texts.mapInArrow(_grouped(cuts, length, gram, bitmap, size), MADE)
    found = scratch.write(found if fits else found.join(shared, "anchor", "left_semi"), "groups")
    scratch.drop(shared)
    return found


def _unmatched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows in suffix order, those of levels first among equals, then by place: the first new entry of each group that no level has."""
    last = None
    for batch in batches:
        keys = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ORDER])
        if not keys.shape[1]:
            continue
        same = np.concatenate([[last is not None and bool((keys[:, 0] == last).all())], (keys[:, 1:] == keys[:, :-1]).all(axis=0)])
        last = keys[:, -1].copy()
        new = batch.column(0).to_numpy() > 0
        yield batch.filter(pa.array(new & ~same)).select(list(range(1, batch.num_columns)))


def merge_scan(batch: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """The entries of ``batch`` that no level has, in ranges of the suffix order and sorted.

    batch: entries; of those of one group the first is taken. Batch and levels are dealt to the same ranges, and
    each task reads its range of all of them in one sorted pass.
    """
    place = [c for c in batch.columns if c not in ORDER]
    rows = batch.select(F.lit(1).cast("byte").alias("new"), *batch.columns)
    for level in levels:
        known = [F.lit(None).cast(batch.schema[c].dataType).alias(c) if c in place else F.col(c) for c in batch.columns]
        rows = rows.unionByName(level.select(F.lit(0).cast("byte").alias("new"), *known))
    ranged = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER, "new", "id", "lo")
    return ranged.mapInArrow(_unmatched, batch.schema)


class IndexFamily:
    """Levels of sorted entries in a folder, each with the first occurrence of its groups.

    A level's name says which batches it holds. A merged level replaces the two that it was made of; if a
    session ends in between, the larger one counts. A family is opened again by its folder.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.levels: list[tuple[int, int, DataFrame]] = []  # (first batch, batches, table), oldest first
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        done = [n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]
        held = sorted((tuple(map(int, n.split("-")[1:])) for n in done), key=lambda x: (x[0], -x[1]))
        for first, n in held:
            if not self.levels or first >= sum(self.levels[-1][:2]):
                self.levels.append((first, n, self._read(first, n)))

    @property
    def batches(self) -> int:
        return sum(self.levels[-1][:2]) if self.levels else 0

    def _name(self, first: int, n: int) -> str:
        return f"{self.root}/level-{first:06d}-{n:06d}"

    def _read(self, first: int, n: int) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(self._name(first, n))

    def _write(self, first: int, n: int, entries: DataFrame) -> tuple[int, int, DataFrame]:
        entries.write.mode("overwrite").parquet(self._name(first, n))
        return first, n, self._read(first, n)

    def add(self, batch: DataFrame) -> DataFrame:
        """batch: entries (``MADE``) of ids after all that the family has. Returns those of new groups, which the family now has."""
        own = batch.where("leads").select("id", "lo", "n", *ORDER, "anchor")
        self.levels.append(self._write(self.batches, 1, merge_scan(own, [level for *_, level in self.levels])))
        while len(self.levels) > 1 and self.levels[-1][1] == self.levels[-2][1]:
            (_, n, b), (first, _, a) = self.levels.pop(), self.levels.pop()
            merged = a.unionByName(b).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
            self.levels.append(self._write(first, 2 * n, merged))
            delete(self.spark, self._name(first, n))
            delete(self.spark, self._name(first + n, n))
        return self.levels[-1][2]

    def entries(self) -> DataFrame:
        out = self.levels[0][2]
        for *_, level in self.levels[1:]:
            out = out.union(level)
        return out


#: A span is one number: its first start times SPAN, plus the number of starts.
SPAN = 256


def _spans(column: pa.ListArray) -> list[np.ndarray | None]:
    """The numbers of each row; none for a null."""
    values, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b] if ok else None for a, b, ok in zip(ends, ends[1:], column.is_valid().to_pylist(), strict=False)]


def _strings(length: int):
    """Strings with their place; one that stands earlier in the same list is known, and has a key of its own instead of its hashes."""

    def listed(*columns: list[np.ndarray]) -> pa.RecordBatch:
        key, more, ids, lo = (np.concatenate(x) for x in columns)
        known = later((key, more), ids, lo)
        key[known], more[known] = mix(ids[known].view(np.uint64) * _BASE + lo[known].astype(np.uint64)).view(np.int64), 0
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, more, ids, lo, known)], ["key", "more", "id", "lo", "known"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 1):
                keys, more, ids, places, held = [], [], [], [], 0
                for own, text, spans in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), _spans(part.column(2)), strict=True):
                    data = np.frombuffer(text.encode(), np.uint8)
                    spans = np.sort(spans)
                    for start in range(0, max(len(data) - length + 1, 0), CHUNK):
                        few = spans[np.searchsorted(spans, (start - SPAN) * SPAN) : np.searchsorted(spans, (start + CHUNK) * SPAN)]
                        lo, n = few // SPAN, few % SPAN
                        at = np.unique(np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())) - start
                        piece = data[start : start + CHUNK + length - 1]
                        at = at[(at >= 0) & (at < CHUNK) & (at + length <= len(piece))]
                        if len(at):
                            full, second = strings_at(piece, at, length)
                            keys.append(mix(full).view(np.int64))
                            more.append(mix(second).view(np.int64))
                            ids.append(np.full(len(at), own, np.int64))
                            places.append((at + start).astype(np.int32))
                            held += len(at)
                        if held > CHUNK:
                            yield listed(keys, more, ids, places)
                            keys, more, ids, places, held = [], [], [], [], 0
                if held:
                    yield listed(keys, more, ids, places)

    return run


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over strings sorted by hashes and place: places of those that are known to stand earlier, or whose equals do."""
    last, place = None, (0, 0)
    for batch in batches:
        if not batch.num_rows:
            continue
        known = batch.column("known").to_numpy(zero_copy_only=False)
        keys = np.stack([known.astype(np.int64), *(batch.column(c).to_numpy() for c in ("key", "more"))])
        new = np.append(last is None or bool((keys[:, 0] != last).any()), (keys[:, 1:] != keys[:, :-1]).any(axis=0))
        ids, lo = (np.append(x, batch.column(c).to_numpy()) for x, c in zip(place, ("id", "lo"), strict=True))
        first = np.maximum.accumulate(np.where(new, np.arange(1, len(ids)), 0))
        again = known | (ids[1:] != ids[first]) | (lo[1:] != lo[first])
        last, place = keys[:, -1].copy(), (ids[first[-1]], lo[first[-1]])
        yield batch.filter(pa.array(again)).select(["id", "lo"])


def removed_runs(spans: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs of bytes that the strings of the spans cover."""
    spans = np.sort(spans)
    lo = spans // SPAN
    hi = np.maximum.accumulate(lo + spans % SPAN - 1 + length)
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    return lo[new], hi[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(lo) - 1]])]


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 1):
                sizes, removed, runs, kept = [], [], [], []
                for text, spans in zip(batch.column(1).to_pylist(), _spans(batch.column(2)), strict=True):
                    data = text.encode()
                    begins, ends = removed_runs(spans, length) if spans is not None and len(spans) else (np.empty(0, np.int64),) * 2
                    ends = np.minimum(ends, len(data))
                    sizes.append(len(data))
                    removed.append(int((ends - begins).sum()))
                    runs.append(len(begins))
                    stays = zip([0, *ends.tolist()], [*begins.tolist(), len(data)], strict=True)
                    kept.append(b"".join(data[a:b] for a, b in stays) if len(begins) else data)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
                )

    return run


def _as_spans(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(F.collect_list(F.col("lo").cast("long") * SPAN + F.col("n")).alias("spans"))


def _repeats(found: DataFrame, texts: DataFrame, family: IndexFamily, scratch: Scratch, length: int, drop: bool) -> DataFrame:
    """(id, spans) of the repeated strings of the groups ``found``, which the family has taken in.

    texts: (id, text) of all documents that the family knows. ``drop`` deletes the family when it isn't needed any more.
    """
    entries = family.entries()
    repeats = scratch.write(_as_spans(found.select("id", "lo", "n").join(entries.select("id", "lo"), ["id", "lo"], "left_anti")), "repeats")
    shared = entries.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
    if not drop:  # only where the new documents have a part
        shared = shared.join(found.select("anchor").distinct(), "anchor", "left_semi")
    edges = scratch.write(_as_spans(entries.join(shared, "anchor", "left_semi")), "edges")
    if drop:
        scratch.drop(found)
        delete(scratch.spark, family.root)
    strings = texts.join(edges, "id").select("id", "text", "spans").mapInArrow(_strings(length), "key long, more long, id long, lo int, known boolean")
    sorted_ = strings.repartition("key", "more").sortWithinPartitions("known", "key", "more", "id", "lo")
    again = scratch.write(_as_spans(sorted_.mapInArrow(_again, "id long, lo int").withColumn("n", F.lit(1))), "ends")
    scratch.drop(edges)
    return repeats.union(again).groupBy("id").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES, most: int = BITMAP) -> DataFrame:
    """texts: (id, text), no nulls, to (id, spans): the starts of repeated strings, as numbers of ``SPAN``."""
    scratch = Scratch(texts.sparkSession, "suffixes")
    cuts = sorted(set(texts.approxQuantile("id", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    found = candidate_groups(texts, cuts, scratch, length, gram, most)
    family = IndexFamily(texts.sparkSession, f"{scratch.root}/levels")
    for b in range(len(cuts) + 1):
        family.add(found.where(F.col("batch") == b).drop("batch"))
    return _repeats(found, texts, family, scratch, length, True)


def _picked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(col(id_col).cast("long").alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))


def _cut_texts(texts: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    return texts.join(spans, "id", "left").select("id", "text", "spans").mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES, most: int = BITMAP) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row; kept are the remaining bytes."""
    texts = _picked(docs, id_col, text_col)
    return _cut_texts(texts, repeated_spans(texts.where(f"id is not null and octet_length(text) >= {length}"), length, gram, batches, most), length)


class SuffixIndex:
    """A family of levels in a folder that further batches of documents are added to and cut against."""

    def __init__(self, spark: SparkSession, root: str, length: int = LENGTH, gram: int = GRAM):
        self.family, self.length, self.gram = IndexFamily(spark, root), length, gram

    def add(self, docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``dedup_substrings`` of ``docs`` after all that was added before; ids follow the earlier ones.

        known: the documents added before. Of them only those are read again that an end of a match lies in.
        """
        spark, length = docs.sparkSession, self.length
        texts, older = _picked(docs, id_col, text_col), _picked(known, id_col, text_col)
        long_enough = f"id is not null and octet_length(text) >= {length}"
        scratch = Scratch(spark, "suffixes")
        found = scratch.write(texts.where(long_enough).mapInArrow(_grouped([], length, self.gram, None, 0), MADE).drop("batch"), "groups")
        self.family.add(found)
        spans = _repeats(found, older.union(texts).where(long_enough), self.family, scratch, length, False)
        return _cut_texts(texts, spans, length)


ORACLE = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, x, unnest(range(0, length(x) // 2)) AS i FROM h),
k AS (SELECT doc_id, i, substr(x, 2 * i + 1, 2) AS byte, CASE WHEN 2 * i + 200 <= length(x) THEN substr(x, 2 * i + 1, 200) END AS s FROM p),
r AS (SELECT doc_id, i, byte, s IS NOT NULL AND row_number() OVER (PARTITION BY md5(s) ORDER BY doc_id, i) > 1 AS again FROM k),
g AS (SELECT doc_id, i, byte, coalesce(max(again::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 0) AS gone FROM r),
b AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS begins FROM g),
t AS (SELECT doc_id, count(*) AS n_bytes, sum(gone) AS n_removed, sum(begins::INT) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM b GROUP BY doc_id)
SELECT doc_id, coalesce(n_bytes, 0)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM documents LEFT JOIN t USING (doc_id)
"""
