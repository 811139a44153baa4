"""Packing: ids against the library, every id in one piece, full windows, similar documents together."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from leadmill.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = st.sampled_from([" ", "  ", "\n", "\n\n", "\t", "\r\n", " a", "Word", "don't", "'ll", "é", "ß.", "12", "³", "½", "\x1c", "\x85", "\xa0", " ", "　", "日本", "🙂", "<|endoftext|>", "...", "€5", "\x00", "_", "​", "Å̊"])


SLOW, LIBRARY = packing.Encoder(PATH, False), Tokenizer.from_file(PATH)


def library_ids(text: str) -> list[int]:
    return LIBRARY.encode(text, add_special_tokens=False).ids


def test_merges_are_proven():
    assert packing.same_merges(PATH)
    assert not packing.same_merges(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.lists(PARTS, max_size=12).map("".join), st.text(max_size=40)))
def test_ids_equal_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    want = library_ids(text)
    assert np.frombuffer(packing.encoder(PATH, True).encode(text), np.uint32).tolist() == want
    assert np.frombuffer(SLOW.encode(text), np.uint32).tolist() == want


def check(rows: list, docs: list[tuple[int | None, str | None]], window: int) -> None:
    """Every id of every document in exactly one piece with the right checksum, gapless sequences, padding only up to the window."""
    ids = [(i, np.array([*library_ids(t or ""), packing.END], np.uint32)) for i, t in docs]
    whole: dict = {}
    for r in rows:
        whole.setdefault(r["sequence_id"], []).append(r)
    for pieces in whole.values():
        pieces.sort(key=lambda r: r["offset"])
        at = 0
        for r in pieces:
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at == window or at & (at - 1) == 0
    # pieces of an id, taken by rows with that id: checksums as a multiset per document, found greedily by start
    for doc in {i for i, _ in ids}:
        own = [x for i, x in ids if i == doc]
        got = sorted(((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows if r["doc_id"] == doc))
        assert sum(n for _, n, _, _ in got) == sum(map(len, own))
        for start, n, crc, size in got:
            assert any(len(x) == size and zlib.crc32(x[start : start + n].tobytes()) == crc for x in own)
        if len(own) == 1:
            at = 0
            for start, n, _, _ in got:
                assert start == at
                at += n


SCHEMA = "doc_id long, text string, rest int, TEXT2 string"


@pytest.mark.parametrize(("window", "shard"), [(64, 1 << 20), (64, 300), (16, 100)])
def test_every_id_once(spark, window, shard):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choice(words, int(n)))) for i, n in enumerate(rng.integers(0, 90, 120))]
    docs += [(200, None), (201, ""), (None, "no id here"), (None, None), (202, "x" * 3000), (203, "twice"), (203, "twice"), (204, "a <|endoftext|> b  c\n\n d")]
    docs += [(300 + i, "the same copy of a text") for i in range(80)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], SCHEMA).repartition(3)
    rows = packing.pack(df, PATH, window, shard=shard, task=2 * shard).collect()
    check(rows, docs, window)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_neighbours_fill_the_window():
    a, b = [np.array(x, "<u2") for x in ([1, 2, 3, 4, 5, 6], [11, 12, 13, 14, 15, 16])]
    rests = [a, b, np.append(a, 7), np.append(b, 17), *(np.array([20 + i, 30 + i], "<u2") for i in range(6))]
    first = next(packing.fill(rests, 13))
    assert [i for i, _, _ in first] == [0, 2]
    pieces = [p for s in packing.fill(rests, 13) for p in s]
    assert sum(n for _, _, n in pieces) == sum(map(len, rests))


def test_scores_are_bm25():
    rng = np.random.default_rng(1)
    rests = [rng.integers(0, 40, n).astype("<u2") for n in (5, 9, 30, 12, 7, 3)]
    shard, n = packing._Shard(rests), len(rests)
    mean = np.mean([len(r) for r in rests])
    for seed in range(n):
        want = np.zeros(n)
        for t in set(rests[seed].tolist()):
            df = sum(t in r for r in rests)
            weight = max(0, np.log((n - df + 0.5) / (df + 0.5)))
            for i, r in enumerate(rests):
                tf = int((r == t).sum())
                want[i] += weight * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(r) / mean)) if tf else 0
        np.testing.assert_allclose(shard.scores(seed), want)


def test_query_packs_all_documents(spark):
    from leadmill.llm.queries import op12_retrieval_packing

    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = op12_retrieval_packing(spark, sf).collect()
    check(rows, docs, 2048)
    lengths: dict[int, int] = {}
    for r in rows:
        lengths[r["sequence_id"]] = lengths.get(r["sequence_id"], 0) + r["length"]
    assert sum(n != 2048 for n in lengths.values()) <= 11
