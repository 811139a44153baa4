"""Flags and the direction of the score; ``test_lmscore_whole`` has the brute force."""

from pyspark.sql import functions as F

from leadmill.llm import lmscore

SCHEMA = "doc_id long, text string, word string, pair int, good boolean"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, g) for i, t, g in rows], SCHEMA).repartition(3)


def test_target_like_texts_score_lower(spark):
    rows = [(i, "good clean words again " * 5, True) for i in range(10)] + [(i + 100, "junk spam noise " * 5, False) for i in range(10)]
    by = {r.doc_id: r.score for r in lmscore.score_whole(frame(spark, rows), F.col("good")).collect()}
    assert max(by[i] for i in range(10)) < min(by[i + 100] for i in range(10))


def test_flag_with_and_without_broadcast(spark):
    df = frame(spark, [(1, "a", None), (2, "b", None), (None, "c", None)]).withColumn("CHOSEN", F.lit("x")).withColumn("chosen_", F.lit("y"))
    ids = spark.createDataFrame([(2,), (2,), (None,)], "doc_id long")
    for most in (100, 0):
        out = lmscore.with_flag(df, ids, "mark", most=most)
        assert out.columns == [*df.columns, "mark"] and {r.text: r.mark for r in out.collect()} == {"a": False, "b": True, "c": False}
        assert {r.text: r.good for r in lmscore.with_flag(df, ids, "good", most=most).collect()} == {"a": False, "b": True, "c": False}
