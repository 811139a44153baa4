import random
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leadmill.llm import langid

WORDS = {"aa": ["banana", "ananas", "kanada", "alabama"], "bb": ["strength", "rhythm", "schmuck", "twelfth"], "ru": ["привет", "мир", "слово"]}
SCHEMA = "doc_id long, text string, lang string, score string, label int"


def corpus(n=240):
    rng = random.Random(3)
    langs = sorted(WORDS)
    return [(i, " ".join(rng.choice(WORDS[langs[i % 3]]) for _ in range(12)), langs[i % 3]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def test_held_out_accuracy_and_odd_texts(spark):
    rows = corpus() + [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 ... !", "bb"), (1003, "banana " * 30_000, None), (None, "rhythm strength", None), (3, "мир", None)]
    df = frame(spark, rows)
    model = langid.fit(df)
    assert model.langs == ["aa", "bb", "ru"]
    out = langid.predict(df, model).collect()
    assert len(out) == len(rows)
    truth = {i: x for i, _, x in corpus()}
    held = [(r.lang_pred, truth[r.doc_id]) for r in out if r.doc_id in truth and r.doc_id != 3 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 50 and all(a == b for a, b in held)
    by = {r.doc_id: r for r in out}
    assert [(by[i].lang_pred, by[i].score, by[i].spans) for i in (1000, 1001, 1002)] == [("und", 0.0, [])] * 3
    assert by[1003].lang_pred == "aa" and by[None].lang_pred == "bb" and all(0 <= r.score <= 1 for r in out)


def test_held_out_rows_are_not_learnt(spark):
    rows = [(i, "zzz qqq", "secret") for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert langid.fit(frame(spark, corpus() + rows)).langs == ["aa", "bb", "ru"]


def test_mixed_text_gives_spans(spark):
    df = frame(spark, corpus())
    text = "banana ananas kanada alabama banana. strength rhythm schmuck twelfth rhythm! привет мир слово"
    r = langid.predict(frame(spark, [(1, text, None)]), langid.fit(df)).first()
    assert [s.lang for s in r.spans] == ["aa", "bb", "ru"]
    assert text[r.spans[1].begin : r.spans[1].end].startswith("strength") and r.spans[0].begin == 0 and r.spans[-1].end == len(text)


def test_letters_are_of_category_l(spark):
    texts = ["½ ² ①", "Ⅻ ⅔", "٣٤", "", "´`", "x²", "一二三"]
    out = langid.predict(frame(spark, [(i, t, None) for i, t in enumerate(texts)]), langid.fit(frame(spark, corpus()))).collect()
    und = {r.doc_id for r in out if r.lang_pred == "und"}
    assert und == {i for i, t in enumerate(texts) if not any(unicodedata.category(c)[0] == "L" for c in t)} == {0, 1, 2, 3, 4}


def test_places_hold_where_lower_case_is_longer(spark):
    text = "İİİ banana İnanas kanada alabama banana. strength rhythm schmuck twelfth rhythm! привет мир слово"
    r = langid.predict(frame(spark, [(1, text, None)]), langid.fit(frame(spark, corpus()))).first()
    parts = {s.lang: text[s.begin : s.end] for s in r.spans}
    assert "".join(text[s.begin : s.end] for s in r.spans) == text and parts["bb"].startswith("strength") and parts["ru"].startswith("привет")


def test_three_hundred_languages():
    rng = random.Random(1)
    langs = [f"l{i:03}" for i in range(300)]
    words = {x: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(4)] for x in langs}
    counts = np.zeros((300, (1 << 17) + len(langid.NAMES)), np.int64)
    for i, x in enumerate(langs):
        slots, _, _ = langid.grams(words[x])
        np.add.at(counts[i], slots, 5)
        counts[i, (1 << 17) + langid.NAMES.index("latin")] = 9
    model = langid.Model(langs, counts, 17)
    found, _, familiar, spans = langid.label([" ".join(words[x]) for x in langs], model)
    assert found == langs and (familiar > 0.99).all() and {s[0]["lang"] for s in spans} == set(langs)


def test_tie_goes_to_the_first_by_name():
    counts = np.ones((2, (1 << 17) + len(langid.NAMES)), np.int64)
    assert langid.label(["some words"], langid.Model(["aa", "bb"], counts, 17))[0] == ["aa"]


def test_unknown_languages_and_junk_go(spark):
    rows = corpus() + [(600, "щи да каша пища наша едим ложкой", None), (601, "xqzj wkvv qqpz jjkx zzvq wxkj", None), (602, "ελληνικά γράμματα εδώ", None)]
    kept = {r.doc_id for r in langid.keep_known(frame(spark, rows), langid.fit(frame(spark, corpus()))).collect()}
    assert kept == set(range(240))


def test_clashing_names(spark):
    names = ["__lang", "__SCORE", "__spans", "__familiar", "__lang_", "a.b"]
    df = spark.createDataFrame([(1, "banana kanada", *range(len(names))), (2, "...", *range(len(names)))], ["doc_id", "text", *names])
    model = langid.fit(frame(spark, corpus()))
    assert langid.with_language(df, model).columns == [*df.columns, *langid.added(df.columns)]
    assert [tuple(r) for r in langid.keep_known(df, model).collect()] == [(1, "banana kanada", *range(len(names)))]


def test_no_labels_and_empty(spark):
    df = frame(spark, [(1, "banana", None)])
    assert [r.lang_pred for r in langid.predict(df, langid.fit(df)).collect()] == ["und"]
    none = df.limit(0)
    assert langid.predict(none, langid.fit(none)).count() == 0


def test_filter_keeps_rows_and_columns(spark):
    df = frame(spark, corpus() + [(500, "...", "aa"), (7, "banana kanada", None), (7, "banana kanada", None)])
    out = langid.keep_known(df, langid.fit(df))
    assert out.columns == df.columns and out.count() == 242 and out.where(F.col("doc_id") == 500).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_viterbi_equals_one_text_at_a_time(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 12, 9)
    scores = rng.normal(size=(lengths.sum(), 3)).astype(np.float32) * 4
    starts = np.cumsum(lengths) - lengths
    got = langid.viterbi(scores, starts, lengths, 3.0)
    for a, n in zip(starts, lengths):
        best, paths = None, [([k], float(scores[a, k])) for k in range(3)]
        for t in range(1, n):
            paths = [max(((p + [k], s - 3.0 * (p[-1] != k) + float(scores[a + t, k])) for p, s in paths), key=lambda x: x[1]) for k in range(3)]
        best = max(paths, key=lambda x: x[1])
        value = lambda p: sum(float(scores[a + t, k]) for t, k in enumerate(p)) - 3.0 * sum(x != y for x, y in zip(p, p[1:]))
        assert abs(value(list(got[a : a + n])) - best[1]) < 1e-4


def test_parts_bound_texts_and_bytes(monkeypatch):
    """Slices keep all rows in order; a text over the bound is a slice of its own."""
    texts = [None, "", "ä" * 40, "a" * 200, "b", None, "c" * 99, "d"] + ["e"] * 5
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]).slice(0, len(texts))
    monkeypatch.setattr(langid, "BATCH", 3)
    monkeypatch.setattr(langid, "BATCH_BYTES", 100)
    got = [part.column(0).to_pylist() for part in langid.parts(batch, 0)]
    assert [t for part in got for t in part] == texts
    assert all(len(part) <= 3 and (len(part) == 1 or sum(len((t or "").encode()) for t in part) <= 100) for part in got)
    assert list(langid.parts(batch.slice(2, 0), 0)) == []


def test_words_learned_in_pieces(monkeypatch):
    """How many words are scored at a time doesn't change a score."""
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 50, (3, (1 << 10) + len(langid.NAMES)))
    words = ["".join(rng.choice(list("abcdefgäжя"), rng.integers(1, 9))) for _ in range(200)]
    whole, pieces = langid.Model(["x", "y", "z"], counts, 10), langid.Model(["x", "y", "z"], counts, 10)
    whole.learn(words)
    monkeypatch.setattr(langid, "AT_ONCE", 7)
    pieces.learn(words)
    assert whole.memo == pieces.memo and (whole.table == pieces.table).all() and (whole.known == pieces.known).all()
