"""LM scoring by cross-entropy difference.

A target model (documents labelled as good) and a background model (all documents) are matched: word
bigrams over one vocabulary and the same smoothing. A document's score is the mean over
its tokens of target loss minus background loss; lower is more like the target.

``score_whole`` keeps every word and every bigram of the corpus that it scores. Documents are gathered into
blocks of about ``BLOCK`` tokens; a block counts its words and bigrams and sends each distinct one once, in
slices of the key space, to be added up. What comes back are the corpus' counts where they differ from the
block's own, and the block scores its documents with them. A key has a row per block at most, however common
it is; nothing is broadcast and nothing but four sums reaches the driver. Keys are hashes of 63 bits.

A block sends ``WIDE`` slices at most, so that a slice is worth its row. Where the corpus needs more, sums are made
in two levels, both with about the root of the number: groups of blocks add up wide ranges of keys, each is cut into slices, and
these are added up over the groups. Counts go back the same way; results are the same.

Nulls: a null text, or one without words, has no tokens and score 0. Rows map one to one, with null and
repeated ids. Without target documents both models are equal up to smoothing. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.llm.columns import col, free
from leadmill.llm.words import mix, word_hashes, words_of

WEIGHT, SMOOTHING = 0.6, 0.5
START = 1
#: Ids that are broadcast at most.
BROADCAST = 4_000_000
#: Tokens of a block; bytes of text that a slice of the key space stands for, and slices at least.
BLOCK, SLICE, SLICES = 1_000_000, 16 << 20, 512
#: Slices that a block sends at most before groups of blocks are added up first.
WIDE = 4096


def with_flag(docs: DataFrame, chosen: DataFrame, name: str, id_col: str = "doc_id", most: int = BROADCAST) -> DataFrame:
    """``docs`` with a boolean column, in place of one of that name: whether the id is among ``chosen`` (id_col).

    The ids are broadcast while there are at most ``most``; beyond, documents and ids are shuffled.
    """
    (own,) = free([*docs.columns, name], "chosen")
    ids = chosen.select(col(id_col).alias(own)).where(col(own).isNotNull()).distinct()
    side = F.broadcast(ids) if ids.count() <= most else ids
    return docs.join(side, col(id_col) == col(own), "left").withColumn(name, col(own).isNotNull()).drop(own)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers from 0 on: one byte of all numbers after the other, as far as bytes are in use, compressed."""
    codec, out = pa.Codec("zstd", 1), []
    for column in columns:
        c = np.ascontiguousarray(column, np.uint64)
        width = (int(c.max()).bit_length() + 7) // 8 if len(c) else 0
        planes = [codec.compress(c.view(np.uint8)[k::8].tobytes(), asbytes=True) for k in range(width)]
        out += [np.array([len(c), width, *map(len, planes)], np.int64).tobytes(), *planes]
    return b"".join(out)


def _unpack(data: bytes) -> list[np.ndarray]:
    codec, out, at = pa.Codec("zstd"), [], 0
    while at < len(data):
        n, width = np.frombuffer(data, np.int64, 2, at).tolist()
        sizes = np.frombuffer(data, np.int64, width, at + 16).tolist()
        at += 16 + 8 * width
        c = np.zeros(n, np.uint64)
        for k, size in enumerate(sizes):
            c.view(np.uint8)[k::8] = np.frombuffer(codec.decompress(data[at : at + size], n, asbytes=True), np.uint8)
            at += size
        out.append(c)
    return out


def _steps(ordered: np.ndarray) -> np.ndarray:
    return np.diff(ordered.astype(np.uint64), prepend=np.uint64(0))


def _tally(words: np.ndarray, at: np.ndarray, lengths: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a block in order, their counts, and the keys of each token's word and bigram.

    words: distinct hashes, at: the word of each token. Counts are target and background, and of these the ends
    of documents. Keys of words are odd, those of bigrams even.
    """
    full = lengths > 0
    ends = np.cumsum(lengths[full])
    good = np.repeat(flags, lengths).astype(np.float64)
    own = words[at]
    before = np.concatenate([own[:1], own[:-1]])
    before[ends - lengths[full]] = START
    pairs, pair = np.unique(mix(mix(before) * np.uint64(0x9E3779B97F4A7C15) + own) & ~np.uint64(1), return_inverse=True)
    keys = np.concatenate([pairs, mix(words) | np.uint64(1)])
    order = np.argsort(keys, kind="stable")
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.arange(len(keys))
    counts = np.zeros((4, len(keys)), np.int64)
    n, m = len(pairs), len(words)
    counts[0] = np.concatenate([np.bincount(pair, good, n), np.bincount(at, good, m)])
    counts[1] = np.concatenate([np.bincount(pair, minlength=n), np.bincount(at, minlength=m)])
    counts[2, n:] = np.bincount(at[ends - 1], good[ends - 1], m)
    counts[3, n:] = np.bincount(at[ends - 1], minlength=m)
    return keys[order], counts[:, order], rank[n + at], rank[pair]


def _slices(keys: np.ndarray, slices: int, first: int = 0, n: int | None = None) -> np.ndarray:
    """Where each slice of the key space (n of them, from the first) begins among ordered keys, and where the last ends."""
    return np.searchsorted((keys >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32), np.arange(first, first + (slices if n is None else n) + 1, dtype=np.uint64))


def _sent(slices: int):
    """(id, text, target) to a row per block (at -1 - block) and a row per block and slice of keys (at the slice)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        ids, flags, lengths, hashes = [], [], [], []

        def out() -> pa.RecordBatch:
            size, flag = np.concatenate(lengths), np.concatenate(flags)
            words, at = np.unique(np.concatenate(hashes), return_inverse=True)
            known = np.array([i is not None for i in ids])
            whole = _pack(np.array([i or 0 for i in ids], np.int64).view(np.uint64), known, flag, size, _steps(words), at)
            keys, counts, _, _ = _tally(words, at, size, flag)
            begin = _slices(keys, slices)
            met = np.flatnonzero(np.diff(begin))
            blobs = [_pack(_steps(keys[a:b]), *counts[:, a:b]) for a, b in zip(begin[met], begin[met + 1], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([-1 - block, *met.tolist()], pa.int64()), pa.array([block] * (1 + len(met)), pa.int64()), pa.array([whole, *blobs], pa.binary())], ["at", "block", "data"])

        held = 0
        for batch in (whole.slice(i, 512) for whole in batches for i in range(0, whole.num_rows, 512)):
            texts = [words_of(text) for text in batch.column(1).to_pylist()]
            met = pa.array(chain.from_iterable(texts), pa.binary()).dictionary_encode()
            hashes.append(word_hashes(met.dictionary.to_pylist())[met.indices.to_numpy()])
            ids += batch.column(0).to_pylist()
            flags.append(np.array(batch.column(2).to_pylist(), bool))
            lengths.append(np.array([len(t) for t in texts], np.int64))
            held += len(hashes[-1])
            if held >= BLOCK:
                yield out()
                block, held = block + 1, 0
                for x in (ids, flags, lengths, hashes):
                    x.clear()
        if ids:
            yield out()

    return run


_SENT = "at long, block long, data binary"
_ADDED = "block long, part long, data binary, words long, target long, background long"


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.binary() if n == "data" else pa.int64() for n in names]
    return pa.table({n: pa.array([r[i] for r in rows], kind) for i, (n, kind) in enumerate(zip(names, kinds, strict=True))})


def _summed(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of unpacked rows in order, their sums, and the place among them of each row's keys, one row after the other."""
    keys = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    own = np.stack([np.concatenate([p[k] for p in parts]) for k in range(1, 5)]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(first) - 1
    return ranked[first], np.add.reduceat(own[:, order], np.flatnonzero(first), axis=1), which


def _returned(blocks: list[int], parts: list[list[np.ndarray]], sums: np.ndarray, which: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """For each block that sent less than all of it: where, and the sums."""
    begin = 0
    for block, p in zip(blocks, parts, strict=True):
        all_of = sums[:, which[begin : begin + len(p[0])]]
        more = np.flatnonzero(all_of[1] != p[2].astype(np.int64))
        begin += len(p[0])
        if len(more):
            yield block, _pack(_steps(more), *all_of[:, more])


def _added(table: pa.Table) -> pa.Table:
    """The sums of a slice for each block that sent less than all of it (part: the slice), and a row of totals.

    Blocks pass as part -1, with their number of texts under target and background.
    """
    at, blocks, data = table.column("at")[0].as_py(), table.column("block").to_pylist(), table.column("data").to_pylist()
    if at < 0:
        rows = []
        for block, x in zip(blocks, data, strict=True):
            _, _, flags, lengths, _, _ = _unpack(x)
            rows.append((block, -1, x, 0, int(((flags > 0) & (lengths > 0)).sum()), int((lengths > 0).sum())))
    else:
        parts = [_unpack(x) for x in data]
        keys, sums, which = _summed(parts)
        words = (keys & np.uint64(1)) > 0
        rows = [(-1, -2, None, int(words.sum()), int(sums[0, words].sum()), int(sums[1, words].sum()))]
        rows += [(block, at, x, 0, 0, 0) for block, x in _returned(blocks, parts, sums, which)]
    return _table(_ADDED, rows)


def _merged(ranges: int, fine: int):
    """The rows of a group of blocks in one range of keys to one row a slice of that range, from the unit of both."""

    def run(table: pa.Table) -> pa.Table:
        unit, at = table.column("unit")[0].as_py(), table.column("at")[0].as_py()
        keys, sums, _ = _summed([_unpack(x) for x in table.column("data").to_pylist()])
        begin = _slices(keys, ranges * fine, at * fine, fine)
        met = np.flatnonzero(np.diff(begin))
        return _table(_SENT, [(at * fine + int(k), unit, _pack(_steps(keys[begin[k] : begin[k + 1]]), *sums[:, begin[k] : begin[k + 1]])) for k in met])

    return run


def _handed(ranges: int, fine: int):
    """What a unit's blocks sent, and the sums that came back to the unit, to the sums that each block lacks."""

    def run(sent: pa.Table, back: pa.Table) -> pa.Table:
        if not sent.num_rows:
            return _table("block long, part long, data binary", [])
        at, parts = sent.column("at")[0].as_py(), [_unpack(x) for x in sent.column("data").to_pylist()]
        keys, sums, which = _summed(parts)
        begin = _slices(keys, ranges * fine, at * fine, fine)
        for part, data in zip(back.column("part").to_pylist(), back.column("data").to_pylist(), strict=True):
            places, *whole = _unpack(data)
            sums[:, begin[part - at * fine] + np.cumsum(places, dtype=np.uint64).astype(np.int64)] = np.stack(whole)
        return _table("block long, part long, data binary", [(block, at, x) for block, x in _returned(sent.column("block").to_pylist(), parts, sums, which)])

    return run


def _block_scores(slices: int, words: int, totals: list[int], texts: list[int]):
    """The documents of a block from what it kept and the sums that came back."""

    def run(table: pa.Table) -> pa.Table:
        parts = dict(zip(table.column("part").to_pylist(), table.column("data").to_pylist(), strict=True))
        ids, known, flags, lengths, steps, at = _unpack(parts.pop(-1))
        lengths = lengths.astype(np.int64)
        n, out = len(lengths), np.zeros((2, len(lengths)))
        if len(at):
            keys, counts, word, pair = _tally(np.cumsum(steps, dtype=np.uint64), at.astype(np.int64), lengths, flags > 0)
            begin = _slices(keys, slices)
            for part, data in parts.items():
                places, *sums = _unpack(data)
                counts[:, begin[part] + np.cumsum(places, dtype=np.uint64).astype(np.int64)] = np.stack(sums)
            full = lengths > 0
            starts = (np.cumsum(lengths) - lengths)[full]
            doc = np.repeat(np.arange(n), lengths)
            for m in (0, 1):
                followed = (counts[m] - counts[2 + m])[word]  # how often the word has a next one
                seen = np.concatenate([followed[:1], followed[:-1]])
                seen[starts] = texts[m]
                single = (counts[m][word] + SMOOTHING) / (totals[m] + SMOOTHING * (words + 1))
                p = np.where(seen > 0, 1 - WEIGHT, 1.0) * single + WEIGHT * counts[m][pair] / np.maximum(seen, 1)
                out[m] = np.bincount(doc, -np.log(p), n) / np.maximum(lengths, 1)
        return pa.table({"doc_id": pa.array(ids.view(np.int64), mask=known == 0), "n_tokens": lengths, "target_loss": out[0], "background_loss": out[1], "score": out[0] - out[1]})

    return run


def score_whole(docs: DataFrame, is_target: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of every row, by models of all words and bigrams of ``docs``."""
    from leadmill.llm.scratch import Scratch

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(is_target, F.lit(False)).alias("target"))
    slices = max(SLICES, (docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0) // SLICE)
    fine = 1 if slices <= WIDE else math.isqrt(slices - 1) + 1
    ranges = -(-slices // fine)
    scratch = Scratch(docs.sparkSession, "lm")
    sent = rows.mapInArrow(_sent(ranges), _SENT)
    if fine > 1:  # as many groups of blocks as slices in a range, so that a unit adds up as much as a slice
        sent = scratch.write(sent, "sent").withColumn("unit", F.pmod(F.xxhash64("block"), F.lit(fine)) * ranges + F.col("at"))
        units = sent.where("at >= 0")
        last = units.groupBy("unit").applyInArrow(_merged(ranges, fine), _SENT).unionByName(sent.where("at < 0").drop("unit"))
    else:
        last = sent
    added = scratch.write(last.groupBy("at").applyInArrow(_added, _ADDED), "sums")
    of = {r["texts"]: r for r in added.groupBy((F.col("part") == -1).alias("texts")).agg(*[F.sum(c).alias(c) for c in ("words", "target", "background")]).collect()}  # two rows
    scratch.reclaim()  # what was sent goes before the sums travel
    if not of:
        of = dict.fromkeys((True, False), {"words": 0, "target": 0, "background": 0})
    both = lambda texts: [of[texts][c] if texts in of else 0 for c in ("target", "background")]
    scores = _block_scores(ranges, of[False]["words"] if False in of else 0, both(False), both(True))
    back = added.where("block >= 0").select("block", "part", "data")
    if fine > 1:
        down = units.groupBy("unit").cogroup(back.where("part >= 0").groupBy("block")).applyInArrow(_handed(ranges, fine), "block long, part long, data binary")
        back = back.where("part = -1").unionByName(down)
    return back.groupBy("block").applyInArrow(scores, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
