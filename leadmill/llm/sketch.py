"""Document fingerprints: an invertible Bloom lookup sketch of paragraph digests.

A paragraph's digest is added to three cells of a sketch (count, xor of digests, xor of checks). Two
sketches subtract cell by cell; peeling cells that hold one digest recovers the paragraphs that differ, and
likeness is the Jaccard similarity of the paragraph multisets. If peeling gets stuck, both sketches are
made again four times larger, until it succeeds; beyond ``LARGEST`` cells, which only a difference of millions of
paragraphs needs, the two lists are compared directly, with the same result. A paragraph is a sentence or a
line, cut after every twelfth word; marks without words are one too, white space alone is none.

``compare_with_next`` pairs each document with the next one by descending id. Documents are dealt to
ranges of ids; the first of each range is also sent to the range before it, so each text moves once and no
task sees more than its range.

Nulls: a null text is empty; equal texts have equal fingerprints; two texts without paragraphs (empty or
blank) have likeness 1, one against any other 0. Rows with a null id come last in the order, rows with one id
in the order of a hash of their text; where one id or the null holds more than its share of the rows, they are dealt
to several ranges by that hash. Only rows equal in id and text stay in one task, which keeps 256 of them at a time. A
table of one row is its own neighbour. Other columns are ignored. A very long text is held by one task, with
40 bytes a paragraph.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.llm.words import mix

CELLS, GROWTH, HASHES = 24, 4, 3
#: Cells of a sketch at most; a difference of a million paragraphs fits.
LARGEST = 1 << 21
#: Words of a paragraph at most; longer ones are cut.
LONGEST = 12
PARAGRAPH = re.compile(r"[^\n.!?]+[.!?]*|[.!?]+")


def paragraph_digests(text: str) -> np.ndarray:
    """One 64-bit digest for each paragraph; the n-th occurrence of a paragraph has its own."""
    seen: dict[str, int] = {}
    out, nth = [], []
    for sentence in PARAGRAPH.findall(text):
        words = sentence.split()
        for i in range(0, len(words), LONGEST):
            piece = " ".join(words[i : i + LONGEST])
            n = seen[piece] = seen.get(piece, -1) + 1
            out.append(xxhash.xxh3_64_intdigest(piece.encode()))
            nth.append(n)
    return mix(np.array(out, np.uint64) + mix(np.array(nth, np.uint64)))  # a seed would make short paragraphs collide


def cells_of(keys: np.ndarray, m: int) -> np.ndarray:
    """(n, 3) cells of digests in a sketch of m cells, one in each third."""
    third = m // HASHES
    salted = mix(keys[:, None] + np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(m))
    return (salted % np.uint64(third)).astype(np.int64) + np.arange(HASHES) * third


def check_of(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype(np.uint32)


class Sketches:
    """Sketches of m cells for several documents at once."""

    def __init__(self, n: int, m: int):
        self.n, self.m = n, m
        self.count, self.key, self.check = np.zeros(n * m, np.int32), np.zeros(n * m, np.uint64), np.zeros(n * m, np.uint32)

    def add(self, keys: np.ndarray, docs: np.ndarray, sign: np.ndarray | int = 1) -> None:
        at = (docs[:, None] * self.m + cells_of(keys, self.m)).ravel()
        np.add.at(self.count, at, np.repeat(np.broadcast_to(np.int32(sign), keys.shape), HASHES).astype(np.int32))
        np.bitwise_xor.at(self.key, at, np.repeat(keys, HASHES))
        np.bitwise_xor.at(self.check, at, np.repeat(check_of(keys), HASHES))

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.n, self.m)
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, digests and signs recovered; the sketches end empty where that succeeds."""
        docs, keys, signs = [], [], []
        while True:
            pure = np.flatnonzero(np.abs(self.count) == 1)
            pure = pure[self.check[pure] == check_of(self.key[pure])]
            if not len(pure):
                break
            found, first = np.unique(np.stack([(pure // self.m).astype(np.uint64), self.key[pure]]), axis=1, return_index=True)
            sign = self.count[pure[first]]
            docs.append(found[0].astype(np.int64))
            keys.append(found[1])
            signs.append(sign)
            self.add(keys[-1], docs[-1], -sign)
        whole = [np.concatenate(x) if x else np.empty(0, t) for x, t in ((docs, np.int64), (keys, np.uint64), (signs, np.int32))]
        return whole[0], whole[1], whole[2]

    def empty(self) -> np.ndarray:
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        return ~left.reshape(self.n, self.m).any(axis=1)

    def texts(self) -> list[str]:
        cell = np.empty(self.n * self.m, np.dtype([("count", "<i4"), ("key", "<u8"), ("check", "<u4")]))
        cell["count"], cell["key"], cell["check"] = self.count, self.key, self.check
        return [base64.b64encode(row.tobytes()).decode() for row in cell.reshape(self.n, self.m)]


def _sketch(lists: list[np.ndarray], m: int) -> Sketches:
    out = Sketches(len(lists), m)
    if lists:
        out.add(np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
    return out


def likeness(a: list[np.ndarray], b: list[np.ndarray], cells: int = CELLS) -> np.ndarray:
    """Jaccard similarity of each pair of digest lists, by sketches that grow until they can be peeled."""
    sizes = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.float64)
    differ = np.zeros(len(a))
    open_ = np.arange(len(a))
    while len(open_):
        diff = _sketch([a[i] for i in open_], cells).minus(_sketch([b[i] for i in open_], cells))
        docs, _, _ = diff.peel()
        done = diff.empty()
        differ[open_] = np.bincount(docs, minlength=len(open_))
        open_, cells = open_[~done], cells * GROWTH
        if cells > LARGEST:  # digests that meet in every cell can't be peeled apart: compare them one by one
            differ[open_] = [len(np.setxor1d(a[i], b[i])) for i in open_]
            break
    return np.where(sizes == 0, 1.0, (sizes - differ) / np.maximum(sizes + differ, 1))


def edited_text(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the start of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _compared(cells: int):
    def flush(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (range, copied, id, text), each but the last followed by its neighbour."""
        texts = [r[3] or "" for r in rows]
        own = [paragraph_digests(t) for t in texts]
        use = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
        edited = [edited_text(texts[i], texts[i + 1]) for i in use]
        changed = [paragraph_digests(t) for t in edited]
        mine = [own[i] for i in use]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][2] for i in use], pa.int64()),
                pa.array([len(texts[i]) for i in use], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array(_sketch(mine, cells).texts(), pa.string()),
                pa.array(_sketch(changed, cells).texts(), pa.string()),
                pa.array(likeness(mine, changed, cells)),
                pa.array(likeness(mine, [own[i + 1] for i in use], cells)),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows.extend(zip(*(part.column(i).to_pylist() for i in range(4)), strict=True))
                if len(rows) > 1:
                    yield flush(rows)
                    rows = rows[-1:]

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """(doc_id, fingerprint) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                keys = [paragraph_digests(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_sketch(keys, cells).texts(), pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness; see the module's text."""
    spark = docs.sparkSession
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = 4 * parts
    marks = picked.select("id").approxQuantile("id", [i / ranges for i in range(1, ranges)], 0.25 / ranges) or [0.0]
    cuts = np.unique([*marks, *(v + 1 for v, w in zip(marks, marks[1:], strict=False) if v == w)])  # an id met twice gets a range of its own

    def place(ids: pd.Series) -> pd.Series:
        """Range of an id, descending; null ids come last."""
        at = len(cuts) - np.searchsorted(cuts, ids.to_numpy(np.float64, na_value=0), "right")
        return pd.Series(np.where(ids.isna(), len(cuts) + 1, at).astype("int32"))

    dealt = picked.withColumn("place", F.pandas_udf(place, "int")("id"))
    counted = dealt.groupBy("place").agg(F.max("id").alias("head"), F.min("id").alias("least"), F.count("*").alias("n")).collect()  # a row per range
    share = max(1, sum(r["n"] for r in counted) // ranges)
    pieces = np.ones(len(cuts) + 2, np.int64)
    for r in counted:
        if r["head"] == r["least"] and r["n"] > 2 * share:
            pieces[r["place"]] = -(-r["n"] // share)
    base = np.cumsum(pieces) - pieces

    def number(places: pd.Series, hashes: pd.Series) -> pd.Series:
        """Ranges of one id are cut by the hashes of texts."""
        at = places.to_numpy(np.int64)
        return pd.Series((base[at] + (((hashes.to_numpy(np.int64) >> 32) + (1 << 31)) * pieces[at] >> 32)).astype("int32"))

    told = dealt.withColumn("hash", F.xxhash64("text")).withColumn("number", F.pandas_udf(number, "int")("place", "hash"))
    heads = {int(base[r["place"]]): (r["head"], None) for r in counted if pieces[r["place"]] == 1}
    if split := np.flatnonzero(pieces > 1).tolist():
        own = told.where(F.col("place").isin(split)).groupBy("number").agg(F.max("id").alias("head"), F.min("hash").alias("hash"))
        heads |= {r["number"]: (r["head"], r["hash"]) for r in own.collect()}  # twice as many as ranges at most
    order = sorted(heads)
    before = {p: order[i - 1] for i, p in enumerate(order)}

    def goals(numbers: pd.Series, ids: pd.Series, hashes: pd.Series) -> pd.Series:
        """The ranges that a document goes to: its own, and for the first of a range the one before."""
        first = numbers.map({p: head for p, (head, _) in heads.items()})
        is_first = (ids == first) | (ids.isna() & first.isna())
        least = {p: h for p, (_, h) in heads.items() if h is not None}
        is_first &= [least.get(p, h) == h for p, h in zip(numbers, hashes, strict=True)]
        return pd.Series([[p, before[p]] if f else [p] for p, f in zip(numbers, is_first, strict=True)], dtype=object)

    sent = told.select("id", "text", F.posexplode(F.pandas_udf(goals, "array<int>")("number", "id", "hash")).alias("copied", "range"))
    ordered = sent.repartition(parts, "range").sortWithinPartitions("range", "copied", F.col("id").desc_nulls_last(), F.xxhash64("text"))
    return ordered.select("range", "copied", "id", "text").mapInArrow(
        _compared(cells), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
