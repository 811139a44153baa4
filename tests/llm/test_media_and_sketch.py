import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadmill.llm import mpegts, sketch

# Transport streams


@pytest.mark.parametrize("n", [0, 1, 5, 161, 162, 163, 164, 346, 2921, 2922, 2923, 2930, 3084, 3105, 3106, 9000, 123_456])
def test_stream_round_trip(n):
    payload = random.Random(n).randbytes(n)
    media = mpegts.mux(payload)
    assert len(media) % 188 == 0 and media[::188] == b"G" * (len(media) // 188)
    back = mpegts.demux(media)
    assert back["payload"] == payload and back["lost"] == 0 and back["program"] == 1 and back["pid"] == 256
    units = max(1, -(-n // mpegts.BODY))
    assert back["pts"] == [(k + 1) * mpegts.TICKS for k in range(units)]
    assert len(back["access"]) == -(-units // mpegts.ACCESS)


def test_damage_is_noticed():
    media = bytearray(mpegts.mux(bytes(20_000)))
    lost = bytes(media[: 188 * 10] + media[188 * 11 :])
    assert mpegts.demux(lost)["lost"] == 1
    media[20] ^= 1  # inside the first table
    assert mpegts.demux(bytes(media))["program"] is None
    assert mpegts.demux(b"")["payload"] is None and mpegts.demux(b"x" * 376)["payload"] is None


def test_table_checksum_is_the_published_one():
    assert mpegts.crc_mpeg(b"123456789") == 0x0376E6E7


def test_media_columns(spark):
    texts = ["", None, "x" * 192, "é" * 5000, "a", "a"]
    df = spark.createDataFrame([(i, t, b"m") for i, t in enumerate(texts)] + [(None, "q", None)], "doc_id long, text string, media binary")
    rows = {r.doc_id: r for r in mpegts.digests(mpegts.parse(mpegts.store(df))).collect()}
    for i, t in enumerate(texts):
        p = mpegts.payload_of(t)
        assert len(p) % 192 == 0 and p
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert rows[4][2:] == rows[5][2:] and rows[0][1:] == rows[1][1:] and None in rows
    assert mpegts.parse(mpegts.store(df.limit(0))).count() == 0


# Sketches


def lists(rng, n):
    a = rng.integers(0, 2**63, n, dtype=np.uint64)
    return a, np.concatenate([a[: n // 2], rng.integers(0, 2**63, rng.integers(0, 40), dtype=np.uint64)])


def test_likeness_is_exact():
    rng = np.random.default_rng(1)
    pairs = [lists(rng, n) for n in (0, 1, 2, 30, 500, 4000)] + [(np.empty(0, np.uint64),) * 2]
    got = sketch.likeness([a for a, _ in pairs], [b for _, b in pairs])
    for x, (a, b) in zip(got, pairs):
        union = len(set(a.tolist()) | set(b.tolist()))
        assert abs(x - (len(set(a.tolist()) & set(b.tolist())) / union if union else 1.0)) < 1e-12


def test_peeling_recovers_the_difference():
    a, b = np.arange(100, 130, dtype=np.uint64), np.arange(110, 135, dtype=np.uint64)
    diff = sketch._sketch([a], 96).minus(sketch._sketch([b], 96))
    _, keys, signs = diff.peel()
    assert diff.empty().all()
    assert {(int(k), int(s)) for k, s in zip(keys, signs)} == {(k, 1) for k in range(100, 110)} | {(k, -1) for k in range(130, 135)}


def expected(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for j, (i, t) in enumerate(order):
        t, following = t or "", order[(j + 1) % len(order)][1] or ""
        k = len(t) // 3
        e = t[: len(t) - k] + following[:k]

        def near(x, y):
            x, y = set(sketch.paragraph_digests(x).tolist()), set(sketch.paragraph_digests(y).tolist())
            return len(x & y) / len(x | y) if x | y else 1.0

        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), round(near(t, e), 9), round(near(t, following), 9))
    return out


@pytest.mark.parametrize("n,parts", [(1, 1), (2, 3), (57, 4)])
def test_next_documents(spark, n, parts):
    rng = random.Random(n)
    texts = [None, "", "é. " * 40, "one line", "a. b.\nc! " * 300]
    rows = [(i * 13, texts[i] if i < 5 else ". ".join(str(rng.randint(0, 30)) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, range string, copied int").repartition(parts)
    out = sketch.compare_with_next(df).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in out} == expected(rows)
    by_text = {}
    for r in out:
        by_text.setdefault(dict(rows)[r.doc_id] or "", set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_marks_alone_are_paragraphs():
    lists = [sketch.paragraph_digests(t) for t in ("", "...", "!!!", " \n ", "... a.", "a. ...")]
    assert [len(x) for x in lists] == [0, 1, 1, 0, 2, 2]
    assert sketch.likeness([lists[0], lists[0], lists[1], lists[1]], [lists[1], lists[3], lists[2], lists[1]]).tolist() == [0.0, 1.0, 0.0, 1.0]


def test_direct_comparison_gives_the_same(monkeypatch):
    rng = np.random.default_rng(3)
    pairs = [lists(rng, n) for n in (10, 300, 2000)]
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    peeled = sketch.likeness(a, b)
    monkeypatch.setattr(sketch, "LARGEST", 8)
    assert (sketch.likeness(a, b) == peeled).all()


def test_very_long_texts_and_clashing_names(spark):
    text = "a line of words. " * 200_000
    df = spark.createDataFrame([(1, text, 0, "r", 0), (2, text[:-40] + "other end.", 0, "r", 0)], "doc_id long, text string, place int, range string, head int")
    rows = {r.doc_id: r for r in sketch.compare_with_next(df).collect()}
    assert rows[2].n_chars == len(text) - 30 and 0.99 < rows[2].near_next < 1


def test_ties_and_empty(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, None)], "doc_id long, text string")
    out = sketch.compare_with_next(df).collect()
    assert sorted((r.doc_id or 0) for r in out) == [0, 0, 1, 1, 1]
    assert sketch.compare_with_next(df.limit(0)).count() == 0
    assert sketch.fingerprints(df).count() == 5


def test_hot_ids_are_split_and_keep_their_order(spark):
    texts = [f"text {i}. of {i % 7} parts" for i in range(120)] + ["same"] * 30
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    line = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = [(i, len(t), sha(sketch.edited_text(t, line[(k + 1) % len(line)][1]))) for k, (i, t) in enumerate(line)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    out = sketch.compare_with_next(df)
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in out.collect()), key=key) == sorted(expected, key=key)
