"""Ranked lexical search: BM25 over a sharded inverted index, read by Block-Max MaxScore.

``build_index`` cuts the documents into shards of about ``SHARD`` words and gives a row per shard and term: its
postings in blocks of ``BLOCK`` documents, each block compressed on its own, with the block's last document,
greatest term frequency and least document length. A shard also has a row of its documents' ids and lengths.

``search`` ranks all documents for each item. Of a term's lists in all shards come its weight and its bounds.
In a shard, an item's lists are put in the order of their bounds. Those whose bounds together can't reach the
item's worst kept result are not essential: they make no candidates. The others are read whole. A candidate
then meets the other lists from the largest bound down, and leaves as soon as its score so far, the maximum of
its block in the next list and the bounds of the rest together stay below the worst kept result; only blocks
that still have a candidate are decompressed. Shards of a part are searched one after the other with the same
heaps, and the heaps of all parts are merged. Rejection is exact, ties included, so the result is the one of
scoring everything.

Index and items meet by equal numbers of parts and blocks of items: nothing grows on the driver, and no task
holds more than a shard's lists and a block of items. The terms asked for are broadcast up to ``BROADCAST``.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case. Nulls: a null
text has no terms; such documents don't count and are never found. A null id is a document with that id and is
the last among equals. Rows that repeat an id are documents of their own. Rows that repeat an item (id and
text) are one item; an item of the same id and another text is ranked on its own. Items without known terms
have no rows. Other columns are ignored. Long texts are read in slices, whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadmill.llm.columns import col
from leadmill.llm.scratch import Scratch

#: Words of a shard, postings of a block, results of an item.
SHARD, BLOCK, TOP = 2_000_000, 64, 10
#: Terms asked for that are broadcast at most; items of a block; shards of a part of the search, at least.
BROADCAST, ITEMS, PART = 1_000_000, 1024, 8
#: Bytes of a text that are split into words at a time.
PIECE = 1 << 22

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_INDEX = "shard long, term binary, docs long, words long, top long, least long, heads binary, data binary"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def _pieces(text: str | None) -> Iterator[list[bytes]]:
    data, at = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _binary(ends: np.ndarray, data: bytes) -> pa.Array:
    """Binary values that lie one after the other; ends: where each ends."""
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes()), pa.py_buffer(data)])


def _bytes_of(x: np.ndarray) -> np.ndarray:
    """How many bytes each number needs, one at least."""
    return 1 + (x >= 1 << 8).astype(np.int64) + (x >= 1 << 16) + (x >= 1 << 24)


class _Shard:
    """Words of documents until there are enough of them; ``rows`` is their index."""

    def __init__(self, number: int):
        self.number, self.terms, self.ids, self.lengths, self.held = number, {}, [], [], 0
        self.term_parts: list[np.ndarray] = []
        self.doc_parts: list[np.ndarray] = []

    def add(self, ids: list[int | None], texts: list[str | None]) -> None:
        first = len(self.ids)
        words, owners = [], []
        for i, text in enumerate(texts):
            n = 0
            for piece in _pieces(text):
                words.append(piece)
                owners.append((first + i, len(piece)))
                n += len(piece)
            self.lengths.append(n)
        self.ids += ids
        met = pa.array(chain.from_iterable(words), pa.binary()).dictionary_encode()
        number = self.terms
        known = np.array([number.setdefault(t, len(number)) for t in met.dictionary.to_pylist()], np.int64)
        if len(met):
            self.term_parts.append(known[met.indices.to_numpy()].astype(np.int32))
            self.doc_parts.append(np.repeat(np.array([o for o, _ in owners], np.int32), [n for _, n in owners]))
            self.held += len(met)

    def rows(self) -> pa.RecordBatch:
        names = [x.split()[0] for x in _INDEX.split(", ")]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        lengths = np.array(self.lengths, np.int64)
        ids = np.array([i or 0 for i in self.ids], np.int64)
        known = np.array([i is not None for i in self.ids], np.uint8)
        own = [[self.number], [None], [int((lengths > 0).sum())], [int(lengths.sum())], [0], [0], [ids.tobytes()], [lengths.tobytes() + known.tobytes()]]
        own_rows = [pa.array(v, k) for v, k in zip(own, kinds, strict=True)]
        if not self.held:
            return pa.RecordBatch.from_arrays(own_rows, names)
        pairs, tf = np.unique(np.concatenate(self.term_parts).astype(np.int64) << 32 | np.concatenate(self.doc_parts), return_counts=True)
        term, doc = pairs >> 32, pairs & 0xFFFFFFFF
        n = lengths[doc]
        first = np.flatnonzero(np.diff(term, prepend=-1))
        size = np.diff(np.append(first, len(term)))
        within = np.arange(len(term)) - np.repeat(first, size)
        begin = np.flatnonzero(within % BLOCK == 0)
        count = np.diff(np.append(begin, len(term)))
        gap = np.diff(doc, prepend=0)
        gap[begin] = doc[begin]
        wide, deep = _bytes_of(np.maximum.reduceat(gap, begin)), _bytes_of(np.maximum.reduceat(tf, begin))
        room = 1 + count * (wide + deep)
        start = np.cumsum(room) - room
        data = np.zeros(int(room.sum()), np.uint8)
        data[start] = wide | deep << 4
        nth = np.arange(len(term)) - np.repeat(begin, count)
        for values, width, base in ((gap, wide, start + 1), (tf, deep, start + 1 + count * wide)):
            w = np.repeat(width, count)
            at = np.repeat(base, count) + nth * w
            for k in range(int(width.max())):
                some = w > k
                data[at[some] + k] = values[some] >> 8 * k & 255
        blocks = (size + BLOCK - 1) // BLOCK
        list_end = np.cumsum(blocks)
        begins = np.repeat(start[list_end - blocks], blocks)
        heads = np.stack([doc[begin + count - 1], np.maximum.reduceat(tf, begin), np.minimum.reduceat(n, begin), start + room - begins], axis=1).astype(np.int32)
        many = blocks > 1
        head_ends = np.cumsum(np.where(many, blocks * 16, 0))
        lists = [
            pa.array(np.full(len(first), self.number)),
            pa.array(list(self.terms), pa.binary()),  # numbered as first met, which is the order of ``term``
            pa.array(size),
            pa.array(np.add.reduceat(tf, first)),
            pa.array(np.maximum.reduceat(tf, first)),
            pa.array(np.minimum.reduceat(n, first)),
            _binary(head_ends, heads[np.repeat(many, blocks)].tobytes()),
            _binary((start + room)[list_end - 1], data.tobytes()),
        ]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([a, b.cast(k)]) for a, b, k in zip(own_rows, lists, kinds, strict=True)], names)


def _indexed(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(TaskContext.get().partitionId() << 32)
        for batch in (whole.slice(i, 256) for whole in batches for i in range(0, whole.num_rows, 256)):
            shard.add(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            if shard.held >= words:
                yield from _cut(shard.rows())
                shard = _Shard(shard.number + 1)
        if shard.ids:
            yield from _cut(shard.rows())

    return run


def _cut(rows: pa.RecordBatch, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, rows.num_rows, size):
        yield rows.slice(i, size)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHARD) -> DataFrame:
    """The index of every row of ``docs``, to be written before it is searched."""
    return docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text")).mapInArrow(_indexed(words), _INDEX)


def _decode(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and term frequencies of one block."""
    wide, deep = int(data[0]) & 15, int(data[0]) >> 4
    n = (len(data) - 1) // (wide + deep)

    def numbers(part: np.ndarray, width: int) -> np.ndarray:
        if width == 1:
            return part.astype(np.int64)
        out = np.zeros(n, np.int64)
        for k in range(width):
            out |= part[k::width].astype(np.int64) << 8 * k
        return out

    return np.cumsum(numbers(data[1 : 1 + n * wide], wide)), numbers(data[1 + n * wide :], deep)


class _List:
    """The postings of a term in a shard; ``part`` is the score of a frequency and a length for weight 1."""

    __slots__ = ("bound", "data", "done", "ends", "last", "lengths", "most", "part", "weight")

    def __init__(self, weight: int, top: int, least: int, heads: bytes, data: bytes, lengths: np.ndarray, part):
        self.weight, self.data, self.lengths, self.part, self.done = weight, np.frombuffer(data, np.uint8), lengths, part, {}
        if heads:
            head = np.frombuffer(heads, np.int32).reshape(-1, 4).astype(np.int64)
            self.last, self.ends = head[:, 0], head[:, 3]
            self.most = part(head[:, 1], head[:, 2])
            self.bound = int(self.most.max())
        else:
            self.last = None
            self.bound = int(part(np.array([top]), np.array([least]))[0])

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and score parts of a block, decompressed when first asked for."""
        if i not in self.done:
            data = self.data if self.last is None else self.data[self.ends[i - 1] if i else 0 : self.ends[i]]
            docs, tf = _decode(data)
            self.done[i] = docs, self.part(tf, self.lengths[docs])
        return self.done[i]

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        if self.last is None:
            return self.block(0)
        if -1 not in self.done:
            blocks = [self.block(i) for i in range(len(self.last))]
            self.done[-1] = np.concatenate([d for d, _ in blocks]), np.concatenate([p for _, p in blocks])
        return self.done[-1]

    def at(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block that each document would be in, and that block's maximum; 0 beyond the last."""
        if self.last is None:
            return np.zeros(len(docs), np.int64), np.full(len(docs), self.bound)
        i = np.searchsorted(self.last, docs)
        return i, np.append(self.most, 0)[i]


class _Best:
    """The best results of an item so far: highest score first, then the smallest id, null ids last."""

    def __init__(self, k: int):
        self.k, self.score, self.id, self.known = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def worst(self) -> int:
        """What a score has to reach at least."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        s, d, k = np.concatenate([self.score, score]), np.concatenate([self.id, doc]), np.concatenate([self.known, known])
        order = np.lexsort((d, ~k, -s))[: self.k]
        self.score, self.id, self.known = s[order], d[order], k[order]


def best_in_shard(best: _Best, lists: list[tuple[int, _List]], ids: np.ndarray, known: np.ndarray) -> None:
    """Adds a shard's documents to the best of an item; lists: (times the item has the term, list)."""
    weighed = sorted(((q * x.weight * x.bound, q * x.weight, x) for q, x in lists if x.weight > 0), key=lambda y: y[0])
    upto = np.cumsum([b for b, _, _ in weighed])  # the bound of a list and all before it
    least = best.worst()
    essential = int(np.searchsorted(upto, least))  # all before can't reach it even together
    if essential == len(weighed):
        return
    score = np.zeros(len(ids), np.int64)
    for _, weight, x in weighed[essential:]:
        docs, part = x.whole()
        score[docs] += weight * part
    found = np.flatnonzero(score)
    score = score[found]
    for i in range(essential - 1, -1, -1):
        kept = score + upto[i] >= least
        found, score = found[kept], score[kept]
        _, weight, x = weighed[i]
        at, most = x.at(found)
        kept = score + weight * most + (upto[i - 1] if i else 0) >= least
        found, score, at = found[kept], score[kept], at[kept]
        if not len(found):
            return
        for b in np.unique(at[most[kept] > 0]).tolist():
            docs, part = x.block(b)
            place = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
            score = score + np.where(docs[place] == found, weight * part[place], 0)
    kept = score >= least
    found, score = found[kept], score[kept]
    if len(found):
        best.add(score, ids[found], known[found])


_TASK = "block long, part long, shard long, kind int, key long, num long, top long, least long, term binary, heads binary, data binary"
_FOUND = "key long, item_id long, doc_id long, score long"


def _searched(n: int, words: int, k: int):
    """Rows in the order of block, part, shard and kind: a block's items, then each shard's documents and lists."""

    def part(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * tf // (1000 * tf + 8 * (100 - 75 + 75 * length * n // words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, shard = None, None
        items: list[tuple[int, int | None, dict[bytes, int], _Best]] = []
        lists: dict[bytes, _List] = {}
        ids = known = lengths = None

        def close() -> None:
            for _, _, terms, best in items if lists else ():
                if met := [(q, lists[t]) for t, q in terms.items() if t in lists]:
                    best_in_shard(best, met, ids, known)
            lists.clear()

        def told() -> pa.RecordBatch:
            rows = [(key, item, int(d) if ok else None, int(s)) for key, item, _, b in items for s, d, ok in zip(b.score, b.id, b.known, strict=True)]
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in _FOUND.split(", ")])

        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                columns = [c.to_pylist() for c in whole.slice(start, 4096).columns]
                for b, p, s, kind, key, num, top, least, term, heads, data in zip(*columns, strict=True):
                    if (b, p) != place:
                        close()
                        if items:
                            yield told()
                            items.clear()
                        place, shard = (b, p), None
                    if kind == 0:
                        items.append((key, num, dict(Counter(data.split())), _Best(k)))
                    elif kind == 1:
                        close()
                        shard, ids = s, np.frombuffer(heads, np.int64)
                        lengths, known = np.frombuffer(data, np.int64, len(ids)), np.frombuffer(data, np.uint8, len(ids), 8 * len(ids)) > 0
                    elif s == shard:
                        lists[term] = _List(num, top, least, heads, data, lengths, part)
        close()
        if items:
            yield told()

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([b" ".join(terms_of(t)) for t in batch.column(2).to_pylist()], pa.binary())], ["key", "num", "data"])


def search(index: DataFrame, items: DataFrame, k: int = TOP, item_col: str = "item_id", text_col: str = "text", block: int = ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item; index: what ``build_index`` gave, stored."""
    spark = index.sparkSession
    own = items.select(col(item_col).cast("long").alias("num"), col(text_col).alias("text")).distinct()
    asked = own.select(F.xxhash64("num", "text").alias("key"), "num", "text").mapInArrow(_asked, "key long, num long, data binary").where("length(data) > 0")
    told = index.where("term is null").agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.count("*").alias("shards")).first()
    n, words = told["n"], told["words"]
    blocks = max(1, -(-asked.count() // block))
    parts = max(min(told["shards"], spark.sparkContext.defaultParallelism), told["shards"] // PART, 1)
    asked = asked.withColumn("block", F.pmod("key", F.lit(blocks)))
    per_block = asked.select("block", F.explode(F.split(F.col("data").cast("string"), " ")).alias("word")).select("block", F.col("word").cast("binary").alias("term")).distinct()
    terms = per_block.select("term").distinct()
    few = terms.limit(BROADCAST + 1).count() <= BROADCAST
    near = index.where("term is not null").join(F.broadcast(terms) if few else terms, "term", "left_semi")
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weights = near.groupBy("term").agg(F.sum("docs").alias("df")).select("term", weight.alias("num"))
    wanted = per_block.join(weights, "term")
    wanted = F.broadcast(wanted) if few and blocks == 1 else wanted
    part = F.pmod(F.xxhash64("shard"), F.lit(parts)).alias("part")
    nothing = {"long": F.lit(0).cast("long"), "binary": F.lit(None).cast("binary"), "int": F.lit(0)}

    def rows(df: DataFrame, kind: int, *given: str) -> DataFrame:
        kinds = dict(x.split() for x in _TASK.split(", "))
        return df.select(*[F.lit(kind).alias(c) if c == "kind" else F.col(c) if c in given else nothing[t].alias(c) for c, t in kinds.items()])

    all_blocks = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1).cast("long"))).alias("block")
    questions = asked.withColumn("shard", F.lit(-1).cast("long")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    lengths = index.where("term is null").select("shard", "heads", "data", part, all_blocks)
    postings = near.join(wanted, "term").select("*", part)
    task = rows(questions, 0, "block", "part", "shard", "key", "num", "data").union(rows(lengths, 1, "block", "part", "shard", "heads", "data")).union(rows(postings, 2, "block", "part", "shard", "num", "top", "least", "term", "heads", "data"))
    task = task.repartition(blocks * parts, "block", "part").sortWithinPartitions("block", "part", "shard", "kind")
    found = task.mapInArrow(_searched(n, max(words, 1), k), _FOUND)
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP, words: int = SHARD) -> DataFrame:
    """Index the documents, store the index in the shared folder and rank them for each item."""
    return search(Scratch(docs.sparkSession, "lexical").write(build_index(docs, words=words), "index"), items, k)


ORACLE = r"""
with docs as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
t as (select r, doc_id, len(terms) as n, unnest(terms) as term from docs),
tf as (select r, doc_id, n, term, count(*) as tf from t group by all),
total as (select cast(count(distinct r) as bigint) as n_docs, cast(count(*) as bigint) as n_terms from t),
w as (select term, cast(floor(1000 * ln(cast(2 * n_docs + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as w from tf, total group by term, n_docs),
items as (select distinct item_id, text from benchmark),
asked as (select item_id, text, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from items),
q as (select item_id, text, term, count(*) as times from asked group by all),
scored as (
  select q.item_id, q.text, tf.r, tf.doc_id, cast(sum(q.times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 75 + ((75 * tf.n * total.n_docs) // total.n_terms))))) as bigint) as score
  from q join w using (term) join tf using (term), total group by all),
ranked as (select item_id, doc_id, score, row_number() over (partition by item_id, text order by score desc, doc_id asc nulls last) as rank from scored where score > 0)
select item_id, cast(rank as int) as rank, doc_id, score from ranked where rank <= 10
"""
