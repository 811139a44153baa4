import hashlib
import re

from leadmill.llm import mixing

SCHEMA = "doc_id long, text string, source string, h string, size int, s string"


def brute(rows):
    """Targets by resharing the excess until none is above, thresholds by sorting hashes."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({s for _, _, s in rows if s is not None}) + ([None] if any(s is None for _, _, s in rows) else [])
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    capped = set()
    while True:
        free = [s for s in sources if s not in capped]
        left = sum(total.values()) - sum(3 * total[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 3 * total[s]}
        if not above:
            break
        capped |= above
    target = {s: 3.0 * total[s] if s in capped else share[s] for s in sources}
    taken = {}
    for s in sources:
        passes = int(target[s] // total[s]) if total[s] else 0
        rest, upto = target[s] - passes * total[s], 0
        for i, t, _ in sorted((r for r in rows if r[2] == s), key=lambda r: int(hashlib.md5(str(r[0]).encode()).hexdigest()[:15], 16)):
            taken[i] = size(t) * min(3, passes + (upto + size(t) / 2 <= rest))
            upto += size(t)
    return {i: (size(t), total[s], target[s], taken[i]) for i, t, s in rows}


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1, None) for r in rows], SCHEMA).repartition(parts)


def test_equals_sorting(spark):
    rows = [(i, "w " * (i * 37 % 50), f"s{i % 2}" if i % 7 else f"t{i % 3}") for i in range(300)] + [(900, None, "s0"), (901, "a b", None), (902, "x", "é"), (903, "", "zero")]
    found = {r.doc_id: r for r in mixing.mix(frame(spark, rows)).collect()}
    expected = brute(rows)
    assert set(found) == set(expected)
    for i, (size, total, target, taken) in expected.items():
        r = found[i]
        assert (r.size, r.source_size, r.taken) == (size, total, taken) and abs(r.target - target) < 1e-6
    again = {(r.doc_id, r.taken) for r in mixing.mix(frame(spark, rows, 11)).collect()}
    assert again == {(i, r.taken) for i, r in found.items()}


def test_sums_are_near_targets(spark):
    rows = [(i, "w " * (i % 23 + 1), "big" if i % 3 else f"s{i % 5}") for i in range(2000)]
    out = mixing.mix(frame(spark, rows)).toPandas()
    sums = out.groupby("source_size").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((sums.taken - sums.target).abs() <= 23).all()
    assert (out.taken <= 3 * out["size"]).all()


def test_odd_tables(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(frame(spark, [(1, None, None)])).collect()] == [0]
    ties = mixing.mix(frame(spark, [(1, "a b", "s"), (1, "a b", "s"), (None, "c", "s")])).collect()
    assert sorted(r.taken for r in ties) == [1, 2, 2]


def test_resample_repeats_rows(spark):
    rows = [(i, "w w", "a" if i < 10 else "b") for i in range(40)]
    df = frame(spark, rows)
    out = mixing.resample(df)
    assert out.columns == df.columns
    times = {r.doc_id: r.taken // r.size for r in mixing.mix(df).collect()}
    assert out.count() == sum(times.values())


def test_clashing_names(spark):
    names = ["__source", "__s", "__PASSES", "__below", "__times", "__copy", "__copy_", "h", "size", "a.b"]
    df = spark.createDataFrame([(i, "w w", "a", *range(len(names))) for i in range(6)], ["doc_id", "text", "source", *names])
    out = mixing.resample(df)
    assert out.columns == df.columns and {tuple(r) for r in out.collect()} == {(i, "w w", "a", *range(len(names))) for i in range(6)}


def test_resample_of_odd_rows(spark):
    df = frame(spark, [(None, "a b", None), (1, "a", None), (1, "b c", None), (2, None, None), (3, "", None)])
    out = mixing.resample(df).collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == [(0, "a b"), (1, "a"), (1, "b c")]
    assert mixing.resample(df.limit(0)).count() == 0
