import sys
from collections import Counter

import public_tokenizers
import sentencepiece
from leadmill.llm import langid, queries

import corpus_pipeline
from tests.llm.test_linededup import brute as lines_left
from tests.llm.test_minhash import brute as groups
from tests.llm.test_mixing import brute as mixed

DIR = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark, tmp_path):
    """Each stage is held against a plain version on its own input."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        stage(spark, docs, DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "sentencepiece":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    known = {r.doc_id for r in langid.predict(inputs["language_id"], langid.fit(inputs["language_id"])).where("lang_pred <> 'und' and score >= 0.3 and familiar >= 0.5").collect()}
    rows = lambda df: [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert {r[0] for r in rows(inputs["line_dedup"])} == known
    left = lines_left(rows(inputs["line_dedup"]))
    got = dict(rows(inputs["near_dedup"]))
    assert all(left[i] == t for i, t in got.items()) and all(not left[i].strip() for i in set(left) - set(got))
    kept = {i for i, (_, root) in groups(rows(inputs["near_dedup"])).items() if i == root}
    assert {r[0] for r in rows(inputs["source_mix"])} == kept
    times = mixed([tuple(r) for r in inputs["source_mix"].select("doc_id", "text", "source").collect()])
    assert inputs["sentencepiece"].count() == sum(taken // size for size, _, _, taken in times.values() if size)
    assert docs.count() == inputs["sentencepiece"].count()
    texts = dict(rows(inputs["source_mix"]))
    assert Counter(rows(inputs["sentencepiece"])) == Counter({(i, texts[i]): taken // size for i, (size, _, _, taken) in times.items() if size and taken})
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.TOKENIZER))
    coded = {i: tuple(library.encode(t)) for i, t in set(rows(inputs["sentencepiece"]))}
    assert Counter((r.doc_id, tuple(r.ids)) for r in docs.collect()) == Counter((i, coded[i]) for i, _ in rows(inputs["sentencepiece"]))


def test_first_stage_drops_what_no_language_fits(spark):
    """Consonant heaps in letters of known languages, text of unlearned scripts, and no text go; clean documents stay."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    junk = ["xqzv kjwq zzxv qpqk vxzj wqqz " * 30, "\u0531\u0532\u0533 \u0534\u0535\u0536 " * 40, "1234 5678 !!", "", None]
    own = spark.createDataFrame([(10**9 + i, t, None, "s", 0) for i, t in enumerate(junk)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.known_languages(spark, docs.unionByName(own), DIR).select("doc_id").collect()}
    assert not {i for i in kept if i >= 10**9}
    clean = {r.doc_id for r in langid.predict(docs, langid.fit(docs)).where("lang_pred <> 'und' and score >= 0.9 and familiar >= 0.9").collect()}
    assert clean <= kept and len(clean) > docs.count() // 2


def test_run_is_registered(spark):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(queries.QUERIES) <= names and "pipeline" in names and "pipeline" not in __spark_entry__.oracle_sql()
    assert corpus_pipeline.run(spark, DIR).count() > 0
