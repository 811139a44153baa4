import math
from collections import Counter

from pyspark.sql import functions as F

from leadmill.llm import lmscore, queries
from tests.llm.test_lmscore import frame

DIR = "/root/testdata/sf0.001"
ALL = 1 << 62


def brute(rows, words, pairs):
    docs = [((t or "").lower().split(), g) for _, t, g in rows]
    count = [Counter(), Counter()]
    for own, good in docs:
        count[1].update(own)
        if good:
            count[0].update(own)
    total = [sum(c.values()) for c in count]
    vocabulary = {w for w, n in count[1].items() if n * words >= total[1]}
    fold = lambda own: [w if w in vocabulary else "<unk>" for w in own]
    two, context, one = [Counter(), Counter()], [Counter(), Counter()], [Counter(), Counter()]
    for own, good in docs:
        own = fold(own)
        for m in (0, 1):
            if m or good:
                for a, b in zip(["<s>", *own], own):
                    two[m][a, b] += 1
                    context[m][a] += 1
                    one[m][b] += 1
    kept = {p for p, n in two[1].items() if n * pairs >= total[1]} | {p for p, n in two[0].items() if n * pairs >= total[0]}
    size = len(vocabulary) + 1

    def loss(m, a, b):
        seen = max(context[m][a], 1)
        rest = 1 - lmscore.WEIGHT * sum(n for p, n in two[m].items() if p in kept and p[0] == a) / seen
        single = (one[m][b] + lmscore.SMOOTHING) / (total[m] + lmscore.SMOOTHING * size)
        return -math.log(rest * single + (lmscore.WEIGHT * two[m][a, b] / seen if (a, b) in kept else 0))

    out = {}
    for (i, _, _), (own, _) in zip(rows, docs):
        own = fold(own)
        losses = [[loss(m, a, b) for a, b in zip(["<s>", *own], own)] for m in (0, 1)]
        out[i] = (len(own), *(sum(x) / len(x) if x else 0.0 for x in losses))
    return out


def plain(rows):
    """As ``brute`` without a threshold, where a context's bigrams are the context's count."""
    docs = {i: ((t or "").encode().lower().split(), g) for i, t, g in rows}
    one, two, context = [Counter(), Counter()], [Counter(), Counter()], [Counter(), Counter()]
    for own, good in docs.values():
        for m in (0, 1) if good else (1,):
            one[m].update(own)
            two[m].update(zip([None, *own], own))
            context[m].update([None, *own][: len(own)])
    size, total = len(one[1]) + 1, [sum(c.values()) for c in one]

    def loss(m, a, b):
        single = (one[m][b] + lmscore.SMOOTHING) / (total[m] + lmscore.SMOOTHING * size)
        return -math.log((1 - lmscore.WEIGHT * (context[m][a] > 0)) * single + lmscore.WEIGHT * two[m][a, b] / max(context[m][a], 1))

    return {i: (len(own), *(sum(loss(m, a, b) for a, b in zip([None, *own], own)) / max(len(own), 1) for m in (0, 1))) for i, (own, _) in docs.items()}


def close(found, expected):
    for i, (n, a, b) in expected.items():
        r = found[i]
        assert r.n_tokens == n and abs(r.target_loss - a) < 1e-9 and abs(r.background_loss - b) < 1e-9 and abs(r.score - (a - b)) < 1e-9


def test_whole_models_equal_brute_force(spark, monkeypatch):
    rows = [(i, " ".join(("The", "cat", "sat", f"x{i % 5}", "on", f"once{i}")[(i * k) % 6] for k in range(1, 3 + i % 17)), i % 3 == 0) for i in range(80)]
    rows += [(200, None, True), (201, "", None), (202, "never seen words here", False), (203, "cat " * 20_000, None)]
    for block in (lmscore.BLOCK, 10):
        monkeypatch.setattr(lmscore, "BLOCK", block)
        found = {r.doc_id: r for r in lmscore.score_whole(frame(spark, rows), F.col("good")).collect()}
        close(found, brute(rows, ALL, ALL))
        close(found, plain(rows))


def test_two_levels_equal_one(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * k) % 37}" for k in range(1, 3 + i % 17)) + f" once{i}", i % 3 == 0) for i in range(80)]
    rows += [(200, None, True), (201, "", None), (203, "cat " * 5_000, None), (None, "cat w1", True)]
    monkeypatch.setattr(lmscore, "BLOCK", 10)
    expected = plain(rows)
    for slices, wide in ((64, 8), (70, 8), (5, 4)):
        monkeypatch.setattr(lmscore, "SLICES", slices)
        monkeypatch.setattr(lmscore, "WIDE", wide)
        found = lmscore.score_whole(frame(spark, rows), F.col("good")).collect()
        assert len(found) == len(rows)
        close({r.doc_id: r for r in found}, expected)
    assert lmscore.score_whole(frame(spark, rows).limit(0), F.col("good")).count() == 0


def test_query_keeps_rare_words_and_bigrams(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DIR}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    good = {r.doc_id for r in labels.where("quality = 1 and coalesce(toxic, 0) = 0").collect()}
    rows = [(r.doc_id, r.text, r.doc_id in good) for r in docs.collect()]
    close({r.doc_id: r for r in queries.op10_lm_scoring(spark, DIR).collect()}, plain(rows))


def test_whole_models_of_odd_tables(spark):
    df = frame(spark, [(1, "a b", False), (1, "a b", False), (None, "a", False), (None, None, True)])
    assert sorted((r.doc_id or 0, r.n_tokens) for r in lmscore.score_whole(df, F.col("good")).collect()) == [(0, 0), (0, 1), (1, 2), (1, 2)]
    assert lmscore.score_whole(df.limit(0), F.col("good")).count() == 0
    assert [r.score for r in lmscore.score_whole(df.where("text is null"), F.col("good")).collect()] == [0.0]
