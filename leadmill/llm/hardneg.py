"""Hard negatives for labelled vectors, by coordinate pruning in length buckets.

For each anchor, its positives are the best rows of its own label, and the negatives of a positive are the best
rows of other labels whose score lies in a band given by the positive's score. The score is the integer inner
product of the quantised vectors.

All rows are sorted by label and length and cut into buckets of about ``BUCKET`` distinct vectors. Anchors are
a query set: groups of them meet slices of the buckets, so a row travels once per group of ``GROUP`` anchors
and not to each of them. In a bucket, an anchor whose threshold is over its length times the greatest length
has no candidates. For the others, every coordinate of a normalised candidate lies in a range about the
anchor's own one, narrower the higher the threshold; where the ranges of the anchor's focus coordinates (its
largest) are narrow, they are looked up in the bucket's sorted coordinate lists, the lists intersected, and
only what is left is scored. An anchor without a narrow range is scored with the whole bucket by one matrix
product. Both are exact, so results don't depend on which way was taken. Thresholds rise from bucket to bucket,
longest first; each slice returns a few rows per anchor, which are ranked over all slices.

Rows of one label with equal vectors are one vector with its smallest ids, as many as a result can hold, so
large groups of copies cost one comparison.

Nulls: rows with a null id, label or vector, or with a null or non-finite component, take no part. Vectors only
meet vectors of their own dimension. Rows that repeat an id are rows of their own; a repeated anchor gives its
rows as often, and another row with an anchor's id may be its positive, but never the anchor itself. An
anchor without positives, or whose positive's band is empty, has no rows. Scores beyond 64 bits stop at the
ends of the range; all others are exact. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadmill.llm.columns import col
from leadmill.llm.scratch import Scratch

#: Distinct vectors of a bucket, buckets of a slice, anchors of a packed row and of a group.
BUCKET, SLICE, PACK, GROUP = 4096, 64, 1024, 65_536
#: Coordinates that prune; a range is narrow under this share of the bucket's own; anchors scored at a time.
FOCUS, NARROW, STRIP = 4, 0.5, 256
EMPTY = np.iinfo(np.int64).min
_LOW, _HIGH = -(1 << 63) + 1, (1 << 63) - 1


def quantised(vectors: list[list[float]]) -> list[np.ndarray]:
    """floor(256 x) of each component; Python integers where they are too large for 64 bits."""
    out = []
    for v in vectors:
        x = np.floor(256 * np.array(v, np.float64))
        out.append(x.astype(np.int64) if not len(x) or np.abs(x).max() < 1 << 52 else np.array([int(c) for c in x], object))
    return out


def _pack(x: np.ndarray) -> bytes:
    """Two bytes a component where they fit, eight, or decimal text."""
    if x.dtype == object:
        return b"t" + b",".join(str(c).encode() for c in x)
    return b"s" + x.astype(np.int16).tobytes() if not len(x) or np.abs(x).max() < 1 << 15 else b"l" + x.tobytes()


def _unpack(data: list[bytes], dim: int) -> np.ndarray:
    """A matrix of the vectors, of objects if any needs it."""
    if all(d[:1] == b"s" for d in data):
        return np.frombuffer(b"".join(d[1:] for d in data), np.int16).reshape(len(data), dim).astype(np.int64)
    rows = [np.frombuffer(d[1:], np.int16).astype(np.int64) if d[:1] == b"s" else np.frombuffer(d[1:], np.int64) if d[:1] == b"l" else np.array([int(c) for c in d[1:].split(b",")], object) for d in data]
    kind = object if any(r.dtype == object for r in rows) else np.int64
    return np.stack([r.astype(kind) for r in rows]).reshape(len(data), dim)


_ROWS = "id long, label long, anchor boolean, dim int, q binary, norm double"


def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(i, 4096) for whole in batches for i in range(0, whole.num_rows, 4096)):
        q = quantised(batch.column(3).to_pylist())
        norm = [float(np.sqrt(np.dot(x.astype(np.float64), x.astype(np.float64)))) for x in q]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array([len(x) for x in q], pa.int32()), pa.array([_pack(x) for x in q], pa.binary()), pa.array(norm, pa.float64())],
            [x.split()[0] for x in _ROWS.split(", ")],
        )


def _frame(arrays: dict[str, np.ndarray | list]) -> bytes:
    """Columns of a packed row: an Arrow stream, compressed."""
    table = pa.table(arrays)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _packed(size: int, columns: tuple[str, ...]):
    """Consecutive rows of one dimension, ``size`` at most, to one: (block, n, dim, norm, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []

        def out(table: pa.Table) -> pa.RecordBatch:
            dims, norms = table.column("dim"), table.column("norm").to_numpy()
            row = [[number], [table.num_rows], [dims[0].as_py()], [float(norms.max())], [_frame({c: table.column(c) for c in columns})]]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.binary()), strict=True)], ["block", "n", "dim", "norm", "data"])

        for batch in batches:
            dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
            at = 0
            while at < len(dims):
                if held and held[0].column("dim")[0].as_py() != dims[at]:
                    yield out(pa.concat_tables(held))
                    number, held = number + 1, []
                other = np.flatnonzero(dims[at:] != dims[at])
                end = min(len(dims), at + size - sum(t.num_rows for t in held), at + int(other[0]) if len(other) else len(dims))
                held.append(pa.Table.from_batches([batch.slice(at, end - at)]))
                at = end
                if sum(t.num_rows for t in held) == size:
                    yield out(pa.concat_tables(held))
                    number, held = number + 1, []
        if held:
            yield out(pa.concat_tables(held))

    return run


_PACKED = "block long, n long, dim int, norm double, data binary"


class Anchors:
    """The anchors of one group and dimension, in the order of their labels, and their best so far per band."""

    def __init__(self, frames: list[pa.Table], dim: int, k: int, bands: int, share: tuple[int, int] | None):
        table = pa.concat_tables(frames)
        label = table.column("label").to_numpy()
        order = np.argsort(label, kind="stable")
        self.label, self.no, self.id = label[order], table.column("no").to_numpy()[order], table.column("id").to_numpy()[order]
        q = table.column("q").to_pylist()
        self.q = _unpack([q[i] for i in order.tolist()], dim)
        plain = self.q.astype(np.float64)
        self.norm = np.sqrt((plain * plain).sum(axis=1))
        self.unit = plain / np.maximum(self.norm, 1e-300)[:, None]
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :FOCUS]
        n = len(label)
        if share is None:  # positives: any score
            self.low, self.high, self.open = np.full((n, 1), _LOW), np.full((n, 1), _HIGH), np.ones((n, 1), bool)
        else:
            scores = table.column("scores").to_pylist()
            s = np.zeros((n, bands), np.int64)
            self.open = np.zeros((n, bands), bool)
            for r, i in enumerate(order.tolist()):
                s[r, : len(scores[i])] = scores[i]
                self.open[r, : len(scores[i])] = True
            self.low = -((-s // 100) * share[0] + (-s % 100) * share[0] // 100)  # the ceiling of a share of the score
            self.high = s // 100 * share[1] + s % 100 * share[1] // 100
            self.open &= self.low <= self.high
        self.k = k
        self.score = np.full((n, self.low.shape[1], k), EMPTY)
        self.row = np.zeros((n, self.low.shape[1], k), np.int64)

    def least(self) -> np.ndarray:
        """What a score has to reach in each band to count; equal ones may have a smaller id."""
        return np.maximum(self.low, self.score[:, :, -1])

    def add(self, anchor: np.ndarray, band: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        bands = self.low.shape[1]
        v = anchor * bands + band
        touched = np.unique(v)
        flat_s, flat_r = self.score.reshape(-1, self.k), self.row.reshape(-1, self.k)
        all_v = np.concatenate([np.repeat(touched, self.k), v])
        all_s, all_r = np.concatenate([flat_s[touched].ravel(), score]), np.concatenate([flat_r[touched].ravel(), row])
        real = all_s > EMPTY
        all_v, all_s, all_r = all_v[real], all_s[real], all_r[real]
        order = np.lexsort((all_r, -all_s, all_v))
        all_v, all_s, all_r = all_v[order], all_s[order], all_r[order]
        begin = np.flatnonzero(np.diff(all_v, prepend=-1))
        nth = np.arange(len(all_v)) - np.repeat(begin, np.diff(np.append(begin, len(all_v))))
        kept = nth < self.k
        flat_s[touched] = EMPTY
        flat_s[all_v[kept], nth[kept]] = all_s[kept]
        flat_r[all_v[kept], nth[kept]] = all_r[kept]


class Bucket:
    """Distinct vectors with their smallest ids; coordinates are sorted when first asked for."""

    def __init__(self, data: bytes, dim: int):
        table = pa.ipc.open_stream(data).read_all()
        self.label = table.column("label").to_numpy()
        self.q = _unpack(table.column("q").to_pylist(), dim)
        ids = table.column("ids").combine_chunks()
        self.offsets, self.ids = ids.offsets.to_numpy(), ids.values.to_numpy()
        plain = self.q.astype(np.float64)
        self.norm = np.sqrt((plain * plain).sum(axis=1))
        self.unit = plain / np.maximum(self.norm, 1e-300)[:, None]
        self.longest = float(self.norm.max())
        self.ends = self.unit.min(axis=0, initial=np.inf), self.unit.max(axis=0, initial=-np.inf)
        self.peak = int(np.abs(self.q).max()) if self.q.size else 0
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.cast: dict[type, np.ndarray] = {}

    def coordinates(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.sorted:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.sorted[f] = self.unit[order, f], order
        return self.sorted[f]

    def products(self, q: np.ndarray, rows: slice | np.ndarray, peak: int) -> np.ndarray:
        """Exact inner products of the vectors q with some rows of the bucket."""
        most = peak * self.peak * max(1, q.shape[1])
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object
        if kind not in self.cast:
            self.cast[kind] = self.q.astype(kind)
        found = q.astype(kind) @ self.cast[kind][rows].T
        return np.clip(found, _LOW, _HIGH) if kind is object else found


def candidates(unit: np.ndarray, focus: np.ndarray, least: float, bucket: Bucket) -> np.ndarray | None:
    """Rows of the bucket that an anchor's focus coordinates leave for a cosine of ``least``; None where no range is narrow."""
    ranges = []
    for f in focus.tolist():
        own = float(unit[f])
        half = np.sqrt(max(0.0, 1 - least * least) * max(0.0, 1 - own * own))
        left, right = -1.0 if own <= -least else own * least - half, 1.0 if own >= least else own * least + half  # of all cosines from least to 1
        low, high = bucket.ends[0][f], bucket.ends[1][f]
        if min(high, right) - max(low, left) < NARROW * (high - low):
            ranges.append((f, left - 1e-9, right + 1e-9))
    if not ranges:
        return None
    looked = []
    for f, low, high in ranges:
        values, order = bucket.coordinates(f)
        looked.append((np.searchsorted(values, low), np.searchsorted(values, high, "right"), f, low, high, order))
    looked.sort(key=lambda x: x[1] - x[0])
    left, right, _, _, _, order = looked[0]
    rows = order[left:right]
    for _, _, f, low, high, _ in looked[1:]:
        at = bucket.unit[rows, f]
        rows = rows[(at >= low) & (at <= high)]
    return rows


def meet(anchors: Anchors, bucket: Bucket, same: bool) -> None:
    """Adds what a bucket has of the anchors' own label (same), or of the others, to their best."""
    if not len(bucket.label):
        return
    least = anchors.least()
    wanted = np.where(anchors.open, least, _HIGH).min(axis=1)  # of all bands of an anchor
    reach = anchors.norm * bucket.longest
    alive = anchors.open.any(axis=1) & (wanted <= reach * (1 + 1e-9) + 1)
    if same:
        alive &= np.isin(anchors.label, bucket.label)
    sharp = np.where(reach > 0, wanted / np.maximum(reach, 1.0), 0.0)  # the cosine that counts at least
    peak = int(np.abs(anchors.q).max()) if anchors.q.size else 0
    dense = alive.copy()
    for i in np.flatnonzero(alive & (sharp > 0.5)).tolist():
        rows = candidates(anchors.unit[i], anchors.focus[i], min(1.0, float(sharp[i]) * (1 - 1e-9)), bucket)
        if rows is None:
            continue
        dense[i] = False
        rows = rows[(bucket.label[rows] == anchors.label[i]) == same]
        if len(rows):
            rows = np.sort(rows)
            _taken(anchors, bucket, np.array([i]), rows, bucket.products(anchors.q[i : i + 1], rows, peak), same)
    if same:  # a label's anchors and rows both lie together
        begin = np.flatnonzero(np.concatenate([[True], bucket.label[1:] != bucket.label[:-1]]))
        for a, b in zip(begin, np.append(begin[1:], len(bucket.label)), strict=True):
            left, right = np.searchsorted(anchors.label, bucket.label[a]), np.searchsorted(anchors.label, bucket.label[a], "right")
            i = np.flatnonzero(dense[left:right]) + left
            for part in (i[s : s + STRIP] for s in range(0, len(i), STRIP)):
                _taken(anchors, bucket, part, np.arange(a, b), bucket.products(anchors.q[part], slice(a, b), peak), same)
    else:
        i = np.flatnonzero(dense)
        for part in (i[s : s + STRIP] for s in range(0, len(i), STRIP)):
            found = bucket.products(anchors.q[part], slice(None), peak)
            found[anchors.label[part][:, None] == bucket.label[None, :]] = -np.inf
            _taken(anchors, bucket, part, np.arange(len(bucket.label)), found, same)


def _taken(anchors: Anchors, bucket: Bucket, part: np.ndarray, rows: np.ndarray, found: np.ndarray, same: bool) -> None:
    """Adds the products (part, rows) that reach the anchors' bands."""
    least, k = anchors.least()[part], anchors.k
    for band in range(anchors.low.shape[1]):
        use = anchors.open[part, band]
        if not use.any():
            continue
        high = anchors.high[part, band]
        limit = least[:, band].copy()
        hit = found if same else np.where(_under(found, high), found, -np.inf)
        fresh = np.flatnonzero(use & (anchors.score[part, band, -1] == EMPTY))
        if len(fresh) and len(rows) > 4 * k and found.dtype != object:  # nothing to hold against yet: the k-th best of this bucket
            nth = len(rows) - k - same  # one of them may be the anchor itself
            kth = np.partition(hit[fresh], nth, axis=1)[:, nth]
            limit[fresh] = np.maximum(limit[fresh], np.where(np.isfinite(kth), kth, _LOW).astype(np.int64))
        i, j = np.nonzero(_over(hit, limit) & use[:, None])
        if not len(i):
            continue
        score = found[i, j].astype(np.int64)
        fits = (score >= least[i, band]) & (score <= high[i])
        i, j, score = i[fits], j[fits], score[fits]
        at = rows[j]
        count = bucket.offsets[at + 1] - bucket.offsets[at]
        begin = np.cumsum(count) - count
        ids = bucket.ids[np.repeat(bucket.offsets[at], count) + np.arange(int(count.sum())) - np.repeat(begin, count)]
        pair = np.repeat(np.arange(len(at)), count)
        if same:  # not the anchor itself: one row of its id among those with its vector
            own = np.flatnonzero((anchors.q[part[i]] == bucket.q[at]).all(axis=1))
            itself = np.isin(pair, own) & (ids == anchors.id[part[i]][pair])
            first = np.flatnonzero(itself)[np.unique(pair[itself], return_index=True)[1]]
            stays = np.ones(len(ids), bool)
            stays[first] = False
            ids, pair = ids[stays], pair[stays]
        if len(ids):
            anchors.add(part[i][pair], np.full(len(ids), band), score[pair], ids)


def _over(found: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Whether products may reach limits; rounded down where numbers are short, exact ones follow."""
    if found.dtype == object:
        return found >= limit[:, None].astype(object)
    short = limit.astype(found.dtype)
    return found >= np.where(short.astype(np.float64) > limit, np.nextafter(short, found.dtype.type(-np.inf)), short)[:, None]


def _under(found: np.ndarray, limit: np.ndarray) -> np.ndarray:
    if found.dtype == object:
        return found <= limit[:, None].astype(object)
    short = limit.astype(found.dtype)
    return found <= np.where(short.astype(np.float64) < limit, np.nextafter(short, found.dtype.type(np.inf)), short)[:, None]


_FOUND = "no long, band int, row long, score long"


def _mined(k: int, bands: int, share: tuple[int, int] | None):
    """Rows by (group, slice, flag): a group's anchors (0), then the slice's buckets (1), longest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, frames, anchors = None, {}, None

        def told() -> Iterator[pa.RecordBatch]:
            for a in (anchors or {}).values():
                at, band, nth = np.nonzero(a.score > EMPTY)
                for s in range(0, len(at), 50_000):
                    x = at[s : s + 50_000], band[s : s + 50_000], nth[s : s + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(a.no[x[0]]), pa.array(x[1], pa.int32()), pa.array(a.row[x]), pa.array(a.score[x])], ["no", "band", "row", "score"])

        for batch in batches:
            for n in range(batch.num_rows):
                group, part, flag, dim = (batch.column(c)[n].as_py() for c in range(4))
                if (group, part) != place:
                    yield from told()
                    place, frames, anchors = (group, part), {}, None
                data = batch.column(4)[n].as_py()
                if flag == 0:
                    frames.setdefault(dim, []).append(pa.ipc.open_stream(data).read_all())
                    continue
                if anchors is None:
                    anchors = {d: Anchors(f, d, k, bands, share) for d, f in frames.items()}
                    frames = {}
                if dim in anchors:
                    meet(anchors[dim], Bucket(data, dim), share is None)
        yield from told()

    return run


def _pass(packs: DataFrame, buckets: DataFrame, groups: int, slices: int, k: int, bands: int, share: tuple[int, int] | None) -> DataFrame:
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    left = packs.select(own(groups).alias("group"), "dim", "data", every(slices).alias("slice")).select("group", "slice", F.lit(0).alias("flag"), "dim", "data", F.lit(0.0).alias("at"))
    right = buckets.select(own(slices).alias("slice"), "dim", "data", "norm", every(groups).alias("group")).select("group", "slice", F.lit(1).alias("flag"), "dim", "data", (-F.col("norm")).alias("at"))
    dealt = left.union(right).repartition(groups * slices, "group", "slice").sortWithinPartitions("group", "slice", "flag", "at")
    return dealt.select("group", "slice", "flag", "dim", "data").mapInArrow(_mined(k, bands, share), _FOUND)


def mine(
    df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 3, share: tuple[int, int] = (50, 95),
    bucket: int = BUCKET, group: int = GROUP,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), as the head of this module says.

    ``share``: the band of a negative's score, in percent of the positive's.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "hardneg")
    rows = df.select(col(id_col).cast("long").alias("id"), col(label_col).cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), col(vec_col).cast("array<double>").alias("v"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & whole).mapInArrow(_quantise, _ROWS)
    rows = scratch.write(rows, "rows")
    cores = spark.sparkContext.defaultParallelism
    nth = F.row_number().over(Window.partitionBy("label", "dim", "q").orderBy("id"))
    most = max(positives + 1, negatives)
    distinct = rows.withColumn("nth", nth).where(F.col("nth") <= most).groupBy("label", "dim", "q").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.first("norm").alias("norm"))
    distinct = scratch.write(distinct, "distinct")
    anchors = scratch.write(rows.where("anchor").select(F.monotonically_increasing_id().alias("no"), "id", "label", "dim", "q", "norm"), "anchors")
    n, asked = distinct.count(), anchors.count()
    scratch.drop(rows)
    parts = max(1, min(cores, -(-n // 512)), -(-n // (4 * bucket)))
    ordered = ["dim", "label", F.col("norm").desc(), "q"]
    buckets = distinct.repartitionByRange(parts, *ordered).sortWithinPartitions(*ordered).mapInArrow(_packed(bucket, ("label", "q", "ids")), _PACKED)
    buckets = scratch.write(buckets, "buckets")
    scratch.drop(distinct)
    many = buckets.count()
    groups, slices = max(1, -(-asked // group)), max(1, min(many, cores), -(-many // SLICE))

    def packed(found: DataFrame, *more: str) -> DataFrame:
        found = found.repartitionByRange(max(1, -(-asked // (4 * PACK))), "dim", "label", "no").sortWithinPartitions("dim", "label", "no")
        return found.mapInArrow(_packed(PACK, ("no", "id", "label", "q", *more)), _PACKED)

    best = lambda found, k, *keys: found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "row"))).where(F.col("rank") <= k)
    of_label = _pass(packed(anchors), buckets, groups, slices, positives, 1, None)
    of_label = scratch.write(best(of_label, positives, "no").select("no", (F.col("rank") - 1).alias("band"), F.col("row").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = of_label.groupBy("no").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    others = _pass(packed(anchors.join(scores, "no"), "scores"), buckets, groups, slices, negatives, positives, share)
    ranked = best(others, negatives, "no", "band").select("no", "band", "rank", F.col("row").alias("negative_id"), F.col("score").alias("negative_score"))
    return ranked.join(of_label, ["no", "band"]).join(anchors.select("no", F.col("id").alias("anchor_id")), "no").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
with q as (
  select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select a.r as a, b.r as b, a.vec_id as anchor_id, b.vec_id, a.label = b.label as same,
         cast(coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])), 0) as bigint) as score
  from q a join q b on a.r <> b.r and len(a.v) = len(b.v) where a.vec_id % 50 = 0),
pos as (select a, b, anchor_id, vec_id, score, row_number() over (partition by a order by score desc, vec_id) as p from pairs where same),
neg as (
  select pos.anchor_id, pos.vec_id as positive_id, pos.score as positive_score, n.vec_id as negative_id, n.score as negative_score,
         row_number() over (partition by pos.a, pos.p order by n.score desc, n.vec_id) as rank
  from pos join pairs n on n.a = pos.a and not n.same and 50 * pos.score <= 100 * n.score and 100 * n.score <= 95 * pos.score
  where pos.p <= 5)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from neg where rank <= 3
"""
