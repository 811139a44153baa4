"""Ranked search against plain scoring of every document."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from leadmill.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(ASCII))


def brute(docs: list[tuple], items: list[tuple], k: int = 10) -> list[tuple]:
    said = [(i, Counter(words(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in said), sum(sum(c.values()) for _, c in said)
    df = Counter(t for _, c in said for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c in said:
            m = 25 + 75 * sum(c.values()) * n // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def ranked(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, SHARD int").repartition(3)
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, key string")
    return sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical.rank_documents(d, q, **more).collect()], key=repr)


@pytest.mark.parametrize(("shard", "k"), [(2_000_000, 10), (3000, 10), (500, 3)])
def test_equals_scoring_everything(spark, shard, k):
    rng = np.random.default_rng(11)
    common = 1 / np.arange(1, 401)
    vocabulary = [f"T{i}" if i % 3 else f"Ünï{i}" for i in range(400)]
    docs = [(i, " ".join(rng.choice(vocabulary, int(n), p=common / common.sum()))) for i, n in enumerate(rng.integers(1, 200, 400))]
    docs += [(1000 + i, "t0 t1 Ünï3 copy") for i in range(150)]  # copies with equal scores
    items = [(i, " ".join(rng.choice(vocabulary, 12))) for i in range(25)] + [(90, "T0, t0; T1?"), (91, "copy")]
    assert ranked(spark, docs, items, words=shard, k=k) == brute(docs, items, k)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "?! --"), (None, "alpha beta"), (None, "alpha"), (4, "alpha beta"), (4, "alpha beta"), (-5, "ALPHA\x00beta"), (6, "x" * 100_000 + " alpha " * 300), (7, "ärger _alpha_ 1e5")]
    items = [(1, "alpha"), (1, "alpha"), (1, "beta"), (2, None), (3, ""), (None, "beta ärger"), (4, "unknown"), (5, "1E5 alpha alpha")]
    assert ranked(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert ranked(spark, [], [(1, "a")]) == []
    assert ranked(spark, [(1, "a"), (2, "b")], []) == []
    assert ranked(spark, [(1, None)], [(1, "a")]) == []


def test_long_texts_are_read_in_slices(spark, monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000))
    monkeypatch.setattr(lexical, "PIECE", 100)
    assert [w for p in lexical._pieces(text) for w in p] == lexical.terms_of(text)


def test_blocks_stay_compressed_where_bounds_reject():
    """A list that can't change the result is not decompressed beyond the blocks of candidates."""
    shard = lexical._Shard(0)
    texts = [("rare " if i == 700 else "") + "common " * (1 + i % 3) + "filler " * (i % 7) for i in range(1000)]
    shard.add(list(range(1000)), texts)
    rows = shard.rows().to_pylist()
    lengths = np.frombuffer(rows[0]["data"], np.int64, 1000)
    part = lambda tf, n: 1_000_000_000 * tf // (1000 * tf + 8 * (25 + 75 * n * 1000 // int(lengths.sum())))
    lists = {r["term"]: lexical._List(w, r["top"], r["least"], r["heads"], r["data"], lengths, part) for r in rows[1:] for w in [5000 if r["term"] == b"rare" else 3]}
    best = lexical._Best(1)
    best.add(np.array([4000 * 10**6 // 10]), np.array([-1]), np.array([True]))
    lexical.best_in_shard(best, [(1, lists[b"rare"]), (1, lists[b"common"])], np.arange(1000), np.ones(1000, bool))
    assert best.id.tolist() == [700]
    assert len(lists[b"common"].done) <= 1 and len(lists[b"common"].last) == -(-1000 // lexical.BLOCK)
    docs, tf = lexical._decode(lists[b"common"].data[: lists[b"common"].ends[0]])
    assert docs.tolist() == list(range(64)) and tf.tolist() == [1 + i % 3 for i in range(64)]
