"""MinHash near-duplicate detection.

Many universal hash minima with banding propose candidates, signatures verify them roughly, full shingle
sets confirm them, and alternating large-star and small-star turn links into components.

* Equal word sequences form a class first; only the smallest doc_id of a class goes on, so groups of exact
  copies cost one row each.
* A band bucket is never expanded into all its pairs at once. Its smallest member is compared with every
  other member; members that are then in one component need no comparison with each other. Buckets that
  still hold several components get a second hub. What remains goes through an exact prefix filter: two
  sets with that similarity share a shingle among the rarest quarter of each, so documents that only have
  a common passage in common never meet. Only pairs across components are compared; nothing is capped.
* Comparison streams the members of a hub past the hub's set, in salted slices, so memory is one batch.
* A link at exactly 0.75 is missed by all bands with probability 5e-6, and its signature's estimate lies five
  deviations under the threshold, so that it isn't compared, with probability 3e-7. All else is exact.

Nulls: a null or empty text, or one without words, has no shingles and no links. Rows with a null id are
returned with a null component and kept. Rows that repeat an id are one document. An empty table gives an
empty result. Columns other than the id and the text are ignored, and ``keep_one_each`` keeps them, whatever
their names. A very long text is one set of shingles in one task: 8 bytes a distinct shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.llm.columns import col, free
from leadmill.llm.components import connected_components
from leadmill.llm.scratch import Scratch
from leadmill.llm.words import mix, shingle_hashes, words_of

BANDS, ROWS, WIDTH = 32, 4, 5
#: Slots of one block of counts.
BLOCK = 4096
#: Pairs of a hub that one slice compares; a larger hub is split over slices.
SLICE = 128
#: Bits of the largest array of shingle counts, a byte each.
MOST_BITS = 25


def universal(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and addends of n multiply-add-shift hash functions on 64 bits."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over the set, high 32 bits."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 256):
        np.minimum(low, (shingles[i : i + 256, None] * a + b).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def _signed(bands: int, rows: int, width: int):
    a, b = universal(bands * rows)
    powers = (np.uint64(0x9E3779B97F4A7C15) * (np.arange(rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)))[None, :]
    salt = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, keys, marks = [], [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                s = shingle_hashes(words, width)
                digests.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                sizes.append(len(s))
                if len(s):
                    m = minima(s, a, b)
                    k = mix((m.astype(np.uint64).reshape(bands, rows) + np.uint64(1)) * powers)
                    keys.append((mix(k.sum(axis=1, dtype=np.uint64)) ^ salt).view(np.int64))
                    marks.append(m.astype(np.uint8).tobytes())
                else:
                    keys.append(None)
                    marks.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                ["id", "digest", "n", "keys", "marks"],
            )

    return run


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """(id, digest of the word sequence, n shingles, band keys, low bytes of the minima) of every document."""
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(_signed(bands, rows, width), "id long, digest binary, n long, keys array<long>, marks binary")


def _agreeing(x: pd.Series, y: pd.Series) -> pd.Series:
    """How many of the minima of two signatures agree in their low byte."""
    if not len(x):
        return pd.Series([], dtype="int32")
    p, q = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (x, y))
    return pd.Series((p == q).sum(axis=1).astype("int32"))


def _compare(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, own = None, np.empty(0, np.uint64)
        for batch in batches:
            us, vs = [], []
            hubs, slices, flags, ids = (batch.column(i).to_pylist() for i in range(4))
            for hub, part, flag, doc, text in zip(hubs, slices, flags, ids, batch.column(4).to_pylist(), strict=True):
                other = shingle_hashes(words_of(text), width)
                if flag == 0:
                    place, own = (hub, part), other
                elif place == (hub, part):
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if both and 100 * both >= percent * (len(own) + len(other) - both):
                        us.append(hub)
                        vs.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def _slots(width: int, bits: int):
    """Counts of shingles by hash slot over some documents; Spark adds them up before and after the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                found = [shingle_hashes(words_of(text), width) >> np.uint64(64 - bits) for text in batch.column(1).slice(start, 256).to_pylist()]
                full, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(n)], ["slot", "n"])

    return run


def level_of(n: np.ndarray) -> np.ndarray:
    """Counts on a log scale of eight steps a doubling, which orders them up to 2 ** 31 in one byte; 1 is for a count of one."""
    return np.minimum(1 + 8 * np.log2(np.maximum(n, 1)), 255).astype(np.uint8)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of slots as one byte per slot, on a log scale, since only the order of counts matters."""
    for batch in batches:
        out = []
        for entries in batch.column(1).to_pylist():
            block = np.zeros(BLOCK, np.uint8)
            block[[e["slot"] % BLOCK for e in entries]] = level_of(np.array([e["n"] for e in entries]))
            out.append(block.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["block", "counts"])


def _prefixes(width: int, percent: int, bits: int, counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(counts.value, np.uint8)
        for batch in batches:
            ids, sizes, places, keys = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingle_hashes(words_of(text), width)
                seen = table[s >> np.uint64(64 - bits)]
                rare = np.lexsort((s, seen))[: len(s) - (percent * len(s) + 99) // 100 + 1]
                place = np.flatnonzero(seen[rare] > 1)  # a slot counted once has no other document
                ids.append(np.full(len(place), doc, np.int64))
                sizes.append(np.full(len(place), len(s), np.int32))
                places.append(place.astype(np.int32))
                keys.append(s[rare[place]].view(np.int64))
            whole = [np.concatenate(x) if x else np.empty(0, t) for x, t in ((keys, np.int64), (ids, np.int64), (sizes, np.int32), (places, np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in whole], ["key", "id", "n", "at"])

    return run


def prefix_pairs(texts: DataFrame, comps: DataFrame, scratch: Scratch, percent: int = 75, width: int = WIDTH, most: int = MOST_BITS) -> DataFrame:
    """All pairs of ``texts`` (id, text) in different components (id, comp) that can reach the similarity.

    Shingles are ordered by how often their slot occurs, rare ones first. Two sets that reach it share one
    in their prefixes, and at the first that they share enough of both sets must be left. That is exact for
    any order; the counts are an array with about two slots a shingle, up to 2 ** ``most``, and slots shared
    by several shingles cost candidates, never links.
    """
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(most, max(16, (size // 3).bit_length()))  # a shingle takes six bytes of text or so
    slots = texts.mapInArrow(_slots(width, bits), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    blocks = slots.groupBy(F.expr(f"cast(slot / {BLOCK} as int)").alias("block")).agg(F.collect_list(F.struct("slot", "n")).alias("entries"))
    counts = bytearray(1 << bits)
    for row in blocks.mapInArrow(_packed, "block int, counts binary").toLocalIterator():  # 2 ** bits bytes
        counts[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = row["counts"]
    found = texts.mapInArrow(_prefixes(width, percent, bits, spark.sparkContext.broadcast(bytes(counts))), "key long, id long, n int, at int").join(comps, "id")
    found = scratch.write(found, "prefixes")
    several = found.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    found = scratch.write(found.join(scratch.write(several, "several"), "key"), "meeting")
    left, right = (found.select("key", *(F.col(c).alias(c + side) for c in ("id", "comp", "n", "at"))) for side in ("u", "v"))
    enough = f"(100 + {percent}) * least(nu - atu, nv - atv) >= {percent} * (nu + nv)"
    near = f"idu < idv and compu <> compv and 100 * nu >= {percent} * nv and 100 * nv >= {percent} * nu and {enough}"
    return left.join(right, "key").where(near).select(F.col("idu").alias("u"), F.col("idv").alias("v")).distinct()


class _Linker:
    """Tests candidate pairs of class representatives and remembers which were tested."""

    def __init__(self, texts: DataFrame, marks: DataFrame, scratch: Scratch, n_hashes: int, percent: int, width: int):
        self.texts, self.marks, self.scratch, self.percent, self.width = texts, marks, scratch, percent, width
        p = percent / 100
        #: Five standard deviations of the estimate below the threshold.
        self.least = max(1, int(n_hashes * (p - 5 * (p * (1 - p) / n_hashes) ** 0.5)))
        self.tested: list[DataFrame] = []
        self.links: list[DataFrame] = []

    def test(self, pairs: DataFrame) -> None:
        """pairs: (u, v), u < v, distinct."""
        m, agreeing = self.marks, F.pandas_udf(_agreeing, "int")
        est = (
            pairs.join(m.select(F.col("id").alias("u"), F.col("marks").alias("mu")), "u")
            .join(m.select(F.col("id").alias("v"), F.col("marks").alias("mv")), "v")
            .select("u", "v", (agreeing("mu", "mv") >= self.least).alias("near"))
        )
        tested = self.scratch.write(est, "pairs")
        self.tested.append(tested)
        near = tested.where("near").select("u", "v")
        fan = near.groupBy("u").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
        members = near.join(fan, "u").select(F.col("u").alias("hub"), F.expr("cast(pmod(xxhash64(v), slices) as int)").alias("part"), F.lit(1).alias("flag"), F.col("v").alias("id"))
        heads = fan.select(F.col("u").alias("hub"), F.explode(F.expr("sequence(0, slices - 1)")).alias("part"), F.lit(0).alias("flag"), F.col("u").alias("id"))
        placed = members.union(heads).hint("merge").join(self.texts, "id").select("hub", "part", "flag", "id", "text")
        confirmed = (
            placed.repartition("hub", "part").sortWithinPartitions("hub", "part", "flag").mapInArrow(_compare(self.width, self.percent), "u long, v long")
        )
        self.links.append(self.scratch.write(confirmed, "links"))

    def all_links(self) -> DataFrame:
        out = self.links[0]
        for x in self.links[1:]:
            out = out.union(x)
        return out

    def untested(self, pairs: DataFrame) -> DataFrame:
        for t in self.tested:
            pairs = pairs.join(t.select("u", "v"), ["u", "v"], "left_anti")
        return pairs


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH, hub_rounds: int = 1
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, class_id) of every row.

    Links join documents with 100 * intersection >= percent * union of their shingle sets. class_id is the
    smallest doc_id with the same word sequence, component_id the smallest that links reach.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    signed = scratch.write(signatures(docs, id_col, text_col, bands, rows, width), "signatures")
    known = signed.where("id is not null and n > 0")
    # sums by key are tables of their own, so that the joins with them can split a hot key
    classes = scratch.write(known.groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    reps = scratch.write(known.join(classes.select(F.col("rep").alias("id"), "digest"), ["id", "digest"], "left_semi").select("id", "keys", "marks"), "reps")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    keyed = reps.select("id", F.explode("keys").alias("key"))
    full = scratch.write(keyed.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("hub")).where("c > 1"), "buckets")
    members = scratch.write(keyed.join(full.select("key", "hub"), "key"), "members")
    # texts are shuffled whole once, at any size; later rounds read those with a shared band key
    pool = scratch.write(texts.join(members.select("id").distinct().hint("merge"), "id", "left_semi"), "pool")
    linker = _Linker(pool, reps.select("id", "marks"), scratch, bands * rows, percent, width)
    linker.test(members.where("id > hub").select(F.col("hub").alias("u"), F.col("id").alias("v")).distinct())
    comps = scratch.write(connected_components(linker.all_links(), scratch), "components")

    for step in range(hub_rounds + 1):
        labelled = members.select("key", "id").join(comps.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
        split = labelled.groupBy("key").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi and c > 2")
        open_ = labelled.join(scratch.write(split, "open"), "key")
        if step < hub_rounds:  # one more hub of each bucket, from a component that the last ones did not reach
            hubs = open_.where("comp <> lo").groupBy("key").agg(F.min(F.struct(F.xxhash64("id", F.lit(step)).alias("r"), "id", "comp")).alias("h"))
            pairs = open_.join(scratch.write(hubs, "hubs"), "key").where("comp <> h.comp").select(F.least("id", "h.id").alias("u"), F.greatest("id", "h.id").alias("v")).distinct()
        else:
            left = open_.select("id", "comp").distinct()
            pairs = prefix_pairs(scratch.write(pool.join(left.select("id").hint("merge"), "id", "left_semi"), "rest"), left, scratch, percent, width)
        todo = scratch.write(linker.untested(pairs), "todo")
        if todo.limit(1).count():
            linker.test(todo)
            newer = scratch.write(connected_components(linker.all_links(), scratch), "components")
            scratch.drop(comps)
            comps = newer

    of_class = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("digest", "rep", F.coalesce("component", "rep").alias("component"))
    out = signed.select("id", "digest", "n").join(of_class, "digest", "left")
    alone = F.col("n") == 0
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNull(), F.lit(None)).when(alone, F.col("id")).otherwise(F.col("component")).cast("long").alias("component_id"),
        F.when(F.col("id").isNull() | alone, True).otherwise(F.col("id") == F.col("component")).alias("kept"),
        F.when(F.col("id").isNull(), F.lit(None)).when(alone, F.col("id")).otherwise(F.col("rep")).cast("long").alias("class_id"),
    )


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group of near copies is kept."""
    (lost,) = free(docs.columns, "__lost")
    gone = near_duplicates(docs, id_col, text_col, **kw).where("not kept").select(F.col("doc_id").alias(lost))
    return docs.join(gone, col(id_col) == F.col(lost), "left_anti")


#: All pairs that share a shingle, exactly; equal to the query up to the probability that banding misses a link.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM pairs JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
edges AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT doc_id AS node, doc_id AS root FROM w UNION SELECT e.v, r.root FROM reach r JOIN edges e ON e.u = r.node),
comp AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node),
class AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY array_to_string(ws, ' ')) END AS class_id FROM w)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept, class_id FROM comp JOIN class ON doc_id = node LEFT JOIN n USING (doc_id)
"""
