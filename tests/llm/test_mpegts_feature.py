from leadmill.llm import mpegts


def test_feature_lists_all_points(spark):
    df = spark.createDataFrame([(1, "x" * 2_000_000), (2, None)], "doc_id long, text string")
    parsed = mpegts.parse(mpegts.store(df)).cache()
    features = {r.doc_id: dict(x.split("=", 1) for x in r.feature.split(";")) for r in mpegts.digests(parsed).collect()}
    for r in parsed.collect():
        assert features[r.doc_id]["access"] == ",".join(map(str, r.access)) and features[r.doc_id]["pts"] == ",".join(map(str, r.pts))
    assert len(features[1]["access"].split(",")) > 8
