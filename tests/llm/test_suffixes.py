import random

import numpy as np
import pyarrow as pa
import pytest

from leadmill.llm import suffixes

SCHEMA = "doc_id long, text string, lo int, spans string"


def brute(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(b[p : p + length])
        runs = sum(1 for j, g in enumerate(gone) if g and (not j or not gone[j - 1]))
        out[i] = (len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 6)))
    rows = []
    for i in range(60):
        text = " ".join(word() for _ in range(rng.randint(0, 60)))
        if rows and i % 2:
            other = rows[rng.randrange(len(rows))][1]
            a = rng.randint(0, len(other))
            text = text[: len(text) // 2] + other[a : a + rng.randint(0, 200)] + text[len(text) // 2 :]
        if i % 9 == 0:
            text = "a" * rng.randint(0, 300) + text
        rows.append((i * 31 % 997, text))
    return rows


def found(df, **kw):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.dedup_substrings(df, **kw).collect()}


@pytest.mark.parametrize("most", [suffixes.BITMAP, 0])
@pytest.mark.parametrize("seed,batches", [(1, 1), (2, 3), (3, 5)])
def test_equals_brute_force(spark, seed, batches, most):
    rows = corpus(seed) + [(2000, None), (2001, ""), (2002, "é"), (2003, "ab" * 400), (2004, "ab" * 400)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(4)
    assert found(df, batches=batches, most=most) == brute(rows, 100)


def test_short_strings(spark):
    rows = corpus(4)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert found(df, length=24, gram=9) == brute(rows, 24)


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, "x" * 500, 1, "x"), (None, "x" * 500, 1, "x"), (1, "y" * 150, None, None)], SCHEMA)
    out = suffixes.dedup_substrings(df).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in out) == [(0, 0), (0, 0), (1, 149)]
    assert suffixes.dedup_substrings(df.limit(0)).count() == 0


def test_levels_merge_geometrically(spark):
    rows = [(i, " ".join(f"{i}w{j}" for j in range(120))) for i in range(16)]
    made = []
    add = suffixes.IndexFamily.add

    def watched(self, batch):
        out = add(self, batch)
        made.append([n for _, n, _ in self.levels])
        return out

    suffixes.IndexFamily.add = watched
    try:
        df = spark.createDataFrame([(i, t + rows[0][1], 1, "x") for i, t in rows], SCHEMA)
        found(df, batches=4)
    finally:
        suffixes.IndexFamily.add = add
    assert made == [[1], [2], [2, 1], [4]]


def test_batches_are_added_to_stored_levels(spark, tmp_path):
    """Three batches, each by an index opened anew, give what one run over all gives."""
    rows = sorted(corpus(5) + [(2000, "ab" * 200), (2001, "ab" * 300), (2002, None)])
    frame = lambda part: spark.createDataFrame([(*r, 1, "x") for r in part], SCHEMA)
    parts, got = [rows[:20], rows[20:41], rows[41:]], {}
    for k, part in enumerate(parts):
        index = suffixes.SuffixIndex(spark, str(tmp_path / "index"))
        assert index.family.batches == k
        out = index.add(frame(part), frame([r for p in parts[:k] for r in p]))
        got |= {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out.collect()}
    assert got == brute(rows, 100)
    assert sorted(p.name for p in (tmp_path / "index").iterdir()) == ["level-000000-000002", "level-000002-000001"]


def test_an_interrupted_merge_counts_once(spark, tmp_path):
    entries = spark.createDataFrame([(1, 0, 3, 5, 6, 7, 8), (2, 0, 3, 9, 6, 7, 8)], "id long, lo int, n short, head long, whole long, more long, anchor long")
    for name in ("level-000000-000001", "level-000001-000001", "level-000000-000002"):
        entries.write.parquet(str(tmp_path / name))
    (tmp_path / "level-000002-000001").mkdir()  # not complete
    assert [x[:2] for x in suffixes.IndexFamily(spark, str(tmp_path)).levels] == [(0, 2)]


def test_levels_are_in_suffix_order(spark, tmp_path):
    df = spark.createDataFrame([(*r, 1, "x") for r in corpus(6)], SCHEMA)
    index = suffixes.SuffixIndex(spark, str(tmp_path / "index"))
    index.add(df, df.limit(0))
    level = index.family.levels[0][2]
    ranges = level.selectExpr("input_file_name() as f", "head", "whole", "more", "id", "lo").collect()
    texts = {i: t.encode() for i, t in corpus(6)}
    by = {}
    for r in ranges:
        by.setdefault(r.f, []).append(r)
    for rs in by.values():
        assert [tuple(r)[1:4] for r in rs] == sorted(tuple(r)[1:4] for r in rs)
        heads = [texts[r.id][r.lo : r.lo + 8] for r in rs]
        assert heads == sorted(heads)
    spans = sorted((min(r.head for r in rs), max(r.head for r in rs)) for rs in by.values())
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 150)
    rows = corpus(7) + [(3000, "".join(t for _, t in corpus(7)[:30])), (3001, "".join(t for _, t in corpus(8)))]
    texts = [(t or "").encode() for _, t in rows]
    rebuilt = {}
    for numbers, offsets, parts in suffixes._pieces(texts, 100):
        for k, at, part in zip(numbers.tolist(), offsets.tolist(), parts):
            assert texts[k][at : at + len(part)] == part
            rebuilt.setdefault(k, set()).update(range(at, at + len(part) - 99))
    assert all(rebuilt.get(k, set()) == set(range(len(t) - 99)) for k, t in enumerate(texts) if len(t) >= 100)
    run = lambda maker, table: [b.to_pylist() for b in maker(iter([table]))]
    table = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t or "" for _, t in rows])], ["id", "text"])
    got = {(r["id"], r["lo"] + k) for b in run(suffixes._grouped([], 100, 64, None, 0), table) for r in b for k in range(r["n"])}
    assert got == {(i, p) for (i, _), t in zip(rows, texts) for p in range(len(t) - 99)}
    spans = pa.array([[p * suffixes.SPAN + 1 for p in range(max(len(t) - 99, 0))] for t in texts], pa.list_(pa.int64()))
    cut = pa.RecordBatch.from_arrays([*table.columns, spans], ["id", "text", "spans"])
    strings = [r for b in run(suffixes._strings(100), cut) for r in b]
    seen = {}
    for r in strings:
        seen.setdefault((r["key"], r["more"]), set()).add(dict(zip([i for i, _ in rows], texts))[r["id"]][r["lo"] : r["lo"] + 100])
    assert len(strings) == sum(max(len(t) - 99, 0) for t in texts) and all(len(x) == 1 for x in seen.values())


def test_a_text_of_a_hundred_megabytes_takes_bounded_memory():
    import tracemalloc

    text = np.random.default_rng(1).integers(97, 123, 100_000_000, dtype=np.uint8).tobytes().decode()
    table = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["id", "text"])
    tracemalloc.start()
    n, spans = 0, []
    for b in suffixes._grouped([], 100, 64, None, 0)(iter([table])):
        n += b.num_rows
        spans.append((b.column(2).to_numpy().astype(np.int64) * suffixes.SPAN + b.column(3).to_numpy())[::50])
    whole = np.concatenate(spans)
    cut = pa.RecordBatch.from_arrays([*table.columns, pa.array([whole], pa.list_(pa.int64()))], ["id", "text", "spans"])
    assert sum(b.num_rows for b in suffixes._strings(100)(iter([cut]))) == int((whole % suffixes.SPAN).sum())
    (out,) = suffixes._cut(100)(iter([cut]))
    assert out.column(1)[0].as_py() == len(text) and 0 < out.column(2)[0].as_py() < len(text)
    assert tracemalloc.get_traced_memory()[1] < 1_000_000_000 and n > 4_000_000
    tracemalloc.stop()


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "y" * 150, 0, 0, 0, 0)], ["doc_id", "text", "id", "spans", "a.b", "n_bytes"])
    assert [(r.doc_id, r.n_removed) for r in suffixes.dedup_substrings(df).collect()] == [(1, 149)]


def test_hashes_are_the_polynomials(monkeypatch):
    monkeypatch.setattr(suffixes, "STEP", 64)
    data = np.random.default_rng(3).integers(0, 256, 500, dtype=np.uint8)
    at = np.array([0, 1, 63, 64, 65, 200, 400])
    for found, base, bytes_ in zip(suffixes.strings_at(data, at, 100), (suffixes._BASE, suffixes._BASE2), (suffixes._BYTE, suffixes._BYTE2), strict=True):
        assert found.tolist() == [sum(int(bytes_[b]) * pow(int(base), 99 - j, 1 << 64) for j, b in enumerate(data[p : p + 100])) % (1 << 64) for p in at]


def test_only_the_wanted_groups_are_hashed(monkeypatch):
    texts, hashed, strings_at = [t.encode() for _, t in corpus(9)], [], suffixes.strings_at
    monkeypatch.setattr(suffixes, "strings_at", lambda data, at, length: hashed.append(len(at)) or strings_at(data, at, length))
    every = suffixes.groups(texts)
    some = suffixes.groups(texts, kept=lambda name: name % 4 == 0)
    assert all((a == b[every[0] % 4 == 0]).all() for a, b in zip(some, every, strict=True))
    assert 0 < len(some[0]) < len(every[0]) and hashed == [len(every[0])] * 2 + [len(some[0])] * 2


def test_small_steps_make_the_same_groups(monkeypatch):
    texts = [t.encode() for _, t in corpus(10)] + [b"", b"a" * 99, b"a" * 100, b""]
    whole = suffixes.groups(texts)
    monkeypatch.setattr(suffixes, "STEP", 32)
    assert all((a == b).all() for a, b in zip(suffixes.groups(texts), whole, strict=True))


def test_a_batch_is_dealt_once(spark, monkeypatch):
    """Between the groups' table and the ranges no row is aggregated, and a common passage is one row for each list."""
    dealt, merge_scan = [], suffixes.merge_scan
    monkeypatch.setattr(suffixes, "merge_scan", lambda batch, levels: dealt.append((batch._jdf.queryExecution().toString(), batch.collect())) or merge_scan(batch, levels))
    same = " ".join(f"w{j}" for j in range(60))
    rows = [(i, same) for i in range(300)]
    assert found(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3), batches=1) == brute(rows, 100)
    ((plan, batch),) = dealt
    assert "Aggregate" not in plan and len(batch) == 3 * len({(r.head, r.whole, r.more) for r in batch})


def test_strings_known_in_their_list_and_found_later():
    """Strings of lists of two texts, in batches of seven rows; a place of its own is no repeat."""
    texts = [(5, "ab" * 60), (2, "ab" * 70), (9, "ab" * 60 + "x"), (9, "ab" * 60 + "x"), (1, "a" * 105), (7, "b" + "a" * 104)]
    table = lambda part: pa.RecordBatch.from_arrays([pa.array([i for i, _ in part]), pa.array([t for _, t in part]), pa.array([[p * suffixes.SPAN + 1 for p in range(len(t) - 99)] for _, t in part], pa.list_(pa.int64()))], ["id", "text", "spans"])
    made = pa.Table.from_batches([b for k in (0, 2, 4) for b in suffixes._strings(100)(iter([table(texts[k : k + 2])]))])
    assert made.column("known").to_pylist().count(True) > 50
    ordered = made.sort_by([(c, "ascending") for c in ("known", "key", "more", "id", "lo")]).combine_chunks()
    got = {(r["id"], r["lo"]) for b in suffixes._again(iter(ordered.to_batches(max_chunksize=7))) for r in b.to_pylist()}
    places = {}
    for i, t in texts:
        for p in range(len(t) - 99):
            places.setdefault(t[p : p + 100], set()).add((i, p))
    assert got == {x for s in places.values() for x in s - {min(s)}}
