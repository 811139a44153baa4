"""Packing documents into training sequences by lexical retrieval.

Every document is tokenised and ends with an end id. Its full windows are sequences of their own; what is left,
its rest, is packed with the rests of similar documents. Rests are dealt to shards by their most characteristic
token, so similar ones meet, with boundaries from counts per token: a common one is cut over as many shards as it
needs. A shard is a BM25 inverted index over the ids of its rests. The first unused rest is the seed of a window; the
index returns its unused neighbours by score, which fill the window greedily; the last one is cut to fit, and
what remains of it stays unused. Without neighbours the next rest in order is taken. So every window is full.
What is left of a shard at the end is cut into sequences whose lengths are powers of two, which need no padding.

Ids are those of the ``tokenizers`` library, special strings in the text included. Plain text goes through
``tiktoken`` with the same vocabulary, which is some five times faster: ``same_merges`` proves for a vocabulary that
both give the same ids. Where it doesn't, and for texts with special strings and words with characters on which
versions of Unicode may differ, ``tokenizers`` itself encodes.

Nulls: a null text is empty and has the end id alone. Rows with null or repeated ids are documents of their own.
Other columns are ignored. A very long text is encoded whole; it holds some ten times its size in one task.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.llm.columns import col
from leadmill.llm.scratch import Scratch

WINDOW, END = 2048, 1
#: Tokens of a shard and of a task; documents encoded at a time.
SHARD, TASK, BATCH = 1 << 20, 1 << 23, 256
#: BM25: saturation of frequencies, share of the length.
K1, B = 1.2, 0.75

#: Before a space that something visible follows, where the byte-level pattern always ends a piece.
_cut = re.compile(r" (?=\S)").split
#: Before the last of several spaces in a row that something visible follows, where it ends one, too.
_spaced, _inside = re.compile(r"\s\s\S").search, re.compile(r"(?<=\s)(?=\s\S)").split
#: Letters, marks and spaces that every version of Unicode has alike, without the separators that only Python counts as spaces.
_known = re.compile("[\x00-\x1b\x20-\u024f\u2010-\u2027\u20ac]*").fullmatch


def _byte_chars() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: visible Latin ones for themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def same_merges(path: str) -> bool:
    """Whether merging by rank gives the library's ids for every text.

    A merge by rank differs only where two neighbours make a token otherwise than by its own merge. Then that token's
    text alone doesn't encode to it. So it is enough that each token's text encodes to itself.
    """
    from tokenizers import Tokenizer

    model = json.load(open(path, encoding="utf-8"))
    kind = model.get("pre_tokenizer") or {}
    if model.get("normalizer") or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True) or model["model"].get("type") != "BPE":
        return False
    special = {t["content"] for t in model.get("added_tokens", ())}
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in model.get("added_tokens", ())):
        return False
    tokens, known = Tokenizer.from_file(path).model, _byte_chars()
    vocabulary = {t: i for t, i in model["model"]["vocab"].items() if t not in special}
    return all(c in known for t in vocabulary for c in t) and all([x.id for x in tokens.tokenize(t)] == [i] for t, i in vocabulary.items())


class Encoder:
    """Ids of texts as the ``tokenizers`` library gives them, as 32-bit numbers in bytes.

    Plain stretches go through a pattern without the rule for several spaces in a row, which is what makes it fast;
    they are cut where that rule would.
    """

    def __init__(self, path: str, fast: bool):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library, self.fast = Tokenizer.from_file(path), None
        if fast:
            model, byte = json.load(open(path, encoding="utf-8")), _byte_chars()
            self.special = {t["content"] for t in model.get("added_tokens", ())}
            ranks = {bytes(byte[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in self.special}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN.replace(r"|\s+(?!\S)", ""), mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> list[int]:
        encode = self.fast.encode_ordinary
        return encode(text) if _spaced(text) is None else [i for part in _inside(text) for i in encode(part)]

    def _ids(self, text: str) -> list[int]:
        whole = lambda x: self.library.encode(x, add_special_tokens=False).ids
        if self.fast is None or any(x in text for x in self.special):
            return whole(text)
        if _known(text):
            return self._plain(text)
        first, *rest = _cut(text)
        return [i for plain, parts in groupby([first, *(" " + x for x in rest)], lambda x: _known(x) is not None) for i in (self._plain if plain else whole)("".join(parts))]

    def encode(self, text: str) -> bytes:
        return array("I", self._ids(text)).tobytes()


@lru_cache(maxsize=1)
def encoder(path: str, fast: bool) -> Encoder:
    """One per worker."""
    return Encoder(path, fast)


_TOKENS = "row long, doc_id long, n long, heads array<long>, first long, rest binary, topic int"


def _topics(rests: list[np.ndarray]) -> np.ndarray:
    """The most characteristic id of each: frequency times its rarity among these."""
    sizes = np.array([len(r) for r in rests])
    keys, tf = np.unique(np.repeat(np.arange(len(rests)), sizes) << 32 | np.concatenate(rests).astype(np.int64), return_counts=True)
    owner, token = keys >> 32, keys & 0xFFFFFFFF
    _, place, df = np.unique(token, return_inverse=True, return_counts=True)
    weight = (1 + np.log(tf)) * np.log((len(rests) + 1) / df[place])
    order = np.lexsort((-token, weight, owner))
    return token[order[np.searchsorted(owner[order], np.arange(len(rests)), "right") - 1]]


def _tokenised(path: str, fast: bool, window: int, end: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, place = encoder(path, fast).encode, TaskContext.get().partitionId() << 32
        row = windows = place
        last = np.array([end], np.uint32).tobytes()
        for batch in (whole.slice(i, BATCH) for whole in batches for i in range(0, whole.num_rows, BATCH)):
            n, heads, firsts, rests = [], [], [], []
            for text in batch.column(1).to_pylist():
                data = encode(text or "") + last
                size = len(data) // 4
                full = size // window
                n.append(size)
                heads.append([zlib.crc32(data[4 * window * i : 4 * window * (i + 1)]) for i in range(full)])
                firsts.append(windows)
                windows += full
                rests.append(np.frombuffer(data, np.uint32, offset=4 * window * full).astype(kind))
            some = np.flatnonzero([len(r) for r in rests])
            topic = np.zeros(len(rests), np.int64)
            if len(some):
                topic[some] = _topics([rests[i] for i in some])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(n))), batch.column(0), pa.array(n, pa.int64()), pa.array(heads, pa.list_(pa.int64())), pa.array(firsts, pa.int64()), pa.array([r.tobytes() for r in rests], pa.binary()), pa.array(topic, pa.int32())],
                [x.split()[0] for x in _TOKENS.split(", ")],
            )
            row += len(n)

    return run


class _Shard:
    """The rests of a shard, in order, with an inverted index of their ids."""

    def __init__(self, rests: list[np.ndarray]):
        self.rests, n = rests, len(rests)
        sizes = np.array([len(r) for r in rests])
        keys, tf = np.unique(np.concatenate(rests).astype(np.int64) << 32 | np.repeat(np.arange(n), sizes), return_counts=True)
        token, self.doc = keys >> 32, keys & 0xFFFFFFFF
        self.tokens, begin, df = np.unique(token, return_index=True, return_counts=True)
        rarity = np.log((n - df + 0.5) / (df + 0.5))  # not positive for what half of them have
        self.begin, self.count = begin, np.where(rarity > 0, df, 0)
        self.impact = np.repeat(rarity, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[self.doc] / sizes.mean()))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every rest for the distinct ids of one."""
        at = np.searchsorted(self.tokens, np.unique(self.rests[seed]))
        count = self.count[at]
        total = int(count.sum())
        if not total:
            return np.zeros(len(self.rests))
        places = np.repeat(self.begin[at] - (np.cumsum(count) - count), count) + np.arange(total)
        return np.bincount(self.doc[places], self.impact[places], len(self.rests))


def fill(rests: list[np.ndarray], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of pieces (rest, start, length) that hold every id of the rests once."""
    shard = _Shard(rests)
    used, size = np.zeros(len(rests), np.int64), np.array([len(r) for r in rests])
    first, pieces, room = 0, [], window

    def take(i: int) -> None:
        nonlocal room
        n = int(min(room, size[i] - used[i]))
        pieces.append((i, int(used[i]), n))
        used[i] += n
        room -= n

    while True:
        while first < len(rests) and used[first] == size[first]:
            first += 1
        if first == len(rests):
            break
        take(first)
        if room:
            found = shard.scores(first)
            found[used == size] = 0
            for _ in range(len(rests)):
                best = int(found.argmax())
                if found[best] <= 0 or not room:
                    break
                found[best] = 0
                take(best)
        following = first
        while room and following < len(rests):  # no neighbour is left
            if used[following] < size[following]:
                take(following)
            following += 1
        if not room:
            yield pieces
            pieces, room = [], window
    while pieces:  # the last window: powers of two, largest first
        length = 1 << (sum(n for _, _, n in pieces).bit_length() - 1)
        out, rest = [], []
        for i, start, n in pieces:
            k = min(n, length)
            if k:
                out.append((i, start, k))
            if n > k:
                rest.append((i, start + k, n - k))
            length -= k
        yield out
        pieces = rest


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _filled(window: int, kind: str):
    """(shard, row, doc_id, n, rest) in the order of shards to pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        shard, docs = None, []

        def out() -> pa.RecordBatch:
            nonlocal number
            rests = [np.frombuffer(r, kind) for _, _, r in docs]
            found = []
            for pieces in fill(rests, window):
                offset = 0
                for i, start, length in pieces:
                    doc, n, _ = docs[i]
                    found.append((doc, n - len(rests[i]) + start, length, zlib.crc32(rests[i][start : start + length].astype(np.uint32).tobytes()), n, 2 * number + 1, offset))
                    offset += length
                number += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], [x.split()[0] for x in _PIECES.split(", ")])

        for batch in batches:
            for s, doc, n, rest in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "n", "rest")), strict=True):
                if docs and s != shard:
                    yield out()
                    docs = []
                shard = s
                docs.append((doc, n, rest))
        if docs:
            yield out()

    return run


def pack(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD, task: int = TASK) -> DataFrame:
    """A row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset); path: a tokenizer's JSON file."""
    from tokenizers import Tokenizer

    scratch = Scratch(docs.sparkSession, "packing")
    kind = "<u2" if max(Tokenizer.from_file(path).get_vocab_size(), end + 1) <= 1 << 16 else "<u4"
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    tokens = scratch.write(rows.mapInArrow(_tokenised(path, same_merges(path), window, end, kind), _TOKENS), "tokens")
    windows = tokens.select("doc_id", "n", "first", F.posexplode("heads").alias("i", "crc")).select(
        "doc_id", (F.col("i") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"),
        (2 * (F.col("first") + F.col("i"))).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    size = F.col("n") % window
    counts = tokens.groupBy("topic").agg(F.sum(size).alias("tokens")).where("tokens > 0").orderBy("topic").collect()  # a row per id of the vocabulary at most
    total, upto = sum(r["tokens"] for r in counts), 0
    places = []
    for r in counts:
        places.append((r["topic"], upto, r["tokens"]))
        upto += r["tokens"]
    places = docs.sparkSession.createDataFrame(places, "topic int, upto long, tokens long")
    share = F.pmod(F.xxhash64("row"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    dealt = tokens.where(size > 0).join(F.broadcast(places), "topic").select(F.floor((F.col("upto") + share * F.col("tokens")) / shard).alias("shard"), "topic", "row", "doc_id", "n", "rest")
    dealt = dealt.repartition(max(1, -(-total // task)), F.floor(F.col("shard") / (task // shard or 1))).sortWithinPartitions("shard", "topic", "row")
    return windows.union(dealt.select("shard", "doc_id", "n", "rest").mapInArrow(_filled(window, kind), _PIECES))
