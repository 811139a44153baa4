import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadmill.llm import components, minhash
from leadmill.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, component_id string, key string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """Components by comparing all pairs."""
    sets = {}
    for i, t in rows:
        sets[i] = shingles(t)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(3, 60))]
        if i % 3 == 0:
            words = passage + words[: rng.randint(0, 14)]  # one passage, many documents around the threshold
        if i % 4 == 1 and rows:
            words = rows[rng.randrange(len(rows))][1].split()
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = "changed"
        rows.append((i * 7 % 1009, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("parts", [1, 7])
def test_components_equal_brute_force(spark, seed, parts):
    rows = corpus(seed) + [(2000, "A b\tC d e f"), (2001, "a B c\nd E f"), (2002, None), (2003, ""), (2004, " \t "), (2005, "one"), (2006, "ONE")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(parts)
    found = {r.doc_id: r for r in minhash.near_duplicates(df).collect()}
    expected = brute(rows)
    assert {i: (r.n_shingles, r.component_id) for i, r in found.items()} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.values())
    assert found[2002].component_id == 2002 and found[2006].component_id == 2005


def test_odd_rows(spark):
    long_text = " ".join(f"t{i}" for i in range(30_000))
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (None, None), (5, long_text), (6, long_text + " end")]
    df = spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)
    out = sorted(((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()))
    assert out == [(False, 1, 1, True), (False, 1, 1, True), (False, 5, 5, True), (False, 6, 5, False), (True, 0, None, True), (True, 0, None, True)]


def test_clashing_names(spark):
    names = ["__lost", "__LOST_", "id", "digest", "a.b"]
    df = spark.createDataFrame([(i, "a b c d e f g", *range(len(names))) for i in (1, 2)], ["doc_id", "text", *names])
    assert [tuple(r) for r in minhash.keep_one_each(df).collect()] == [(1, "a b c d e f g", *range(len(names)))]


def test_levels_keep_the_order_of_counts():
    n = np.array([1, 2, 3, 254, 300, 5000, 10**6, 10**9])
    assert (np.diff(minhash.level_of(n).astype(int)) > 0).all() and minhash.level_of(np.array([1]))[0] == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert minhash.near_duplicates(df).count() == 0
    assert minhash.keep_one_each(df).columns == df.columns


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    found = {r.node: r.component for r in components.connected_components(links, Scratch(spark, "chain")).collect()}
    assert {found[i] for i in range(41)} == {0} and found[101] == 100 and found[100] == 100


def test_prefix_pairs_lose_none(spark):
    rows = corpus(3, 50)
    texts = spark.createDataFrame(rows, "id long, text string")
    comps = texts.select("id", F.col("id").alias("comp"))
    pairs = {(r.u, r.v) for r in minhash.prefix_pairs(texts, comps, Scratch(spark, "pairs")).collect()}
    sets = {i: shingles(t) for i, t in rows}
    near = {(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert near and near <= pairs
