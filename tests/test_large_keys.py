"""Operators whose keys may hold most of the rows, and files that outlive broken batches."""

from __future__ import annotations

import datetime as dt
import os
import random
import types

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from leadmill.functions import html as H
from leadmill.functions import lookups, tries
from leadmill.operators import criteria as C
from leadmill.operators import enrich as E
from leadmill.operators import judge as J
from leadmill.operators import listing as L
from leadmill.operators import ranks
from leadmill.operators import recall as R
from leadmill.sources import io, snapshots
from leadmill.streaming import jobs
from tests.test_operators import records


def test_numbers_of_large_keys_equal_a_window(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a"] * 8 + ["b", "c", None]), rng.choice([1, 2, None]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, v int, id int").withColumn("part", F.lit("x")).withColumn("n", F.lit(1))
    order = [F.col("v").desc(), "id"]
    want = {r.id: r.place for r in df.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy(*order))).collect()}
    got = ranks.numbered(df, ["k"], order, "place", most=50, size=40)
    assert got.columns == [*df.columns, "place"]
    assert {r.id: r.place for r in got.collect()} == want
    tasks = got.where("k = 'a'").groupBy(F.spark_partition_id()).count().count()
    assert tasks > 1 and ranks.numbered(df.limit(0), ["k"], order, "place").count() == 0


def test_lists_of_any_size(spark):
    rng = random.Random(8)
    rows = [("big" if i % 10 else f"l{i % 3}", i, rng.choice(["a goods", "b", "c goods"]), rng.choice(["完全符合", "部分符合", "?"]), rng.randint(0, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "list_id string, pos int, name string, match_level string, score int").select("*", *[F.lit("").alias(c) for c in ("domain", "summary", "location", "row_key")], F.array().cast("array<string>").alias("industries"))
    seen = df.groupBy("list_id").agg((F.max("pos") - 5).alias("discovered_count"))
    page = lambda most: sorted(tuple(r) for r in L.page_rows(df, seen, 2, 7, keyword="GOODS", most=most).select("list_id", "place", "pos", "total").collect())
    assert page(20) == page(1000) and len(page(20)) > 7


def joined_rows(df) -> dict[str, int]:
    """Rows that each kind of join of the executed plan gave out."""
    df.collect()
    out: dict[str, int] = {}

    def walk(node) -> None:
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        if "Join" in name and node.metrics().contains("numOutputRows"):
            out[name] = out.get(name, 0) + node.metrics().apply("numOutputRows").value()
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return out


def test_a_query_meets_as_many_rows_as_it_returns(spark):
    counts = []
    for n in (200, 20_000):
        corpus = spark.range(n).select(F.col("id").cast("int").alias("pos"), F.lit("x").alias("location"), F.array(F.lit("none")).alias("industries"))
        queries = spark.createDataFrame([(f"q{i}", "", ["zz"], 17 * i, 5) for i in range(10)], "query_id string, city string, hints array<string>, seed int, limit int")
        counts.append(sum(joined_rows(R.rank_companies(queries, corpus)).values()))
    assert counts[0] == counts[1] < 1000


def test_merged_recalls_equal_the_fold(spark):
    rng = random.Random(12)
    row = lambda i: (f"q{rng.randint(0, 3)}", i, rng.choice(["A", "b ", "C", "d", "E", "", None]), rng.choice(["", "a.com", "x.b.com", "c.com", "d.org", None]))
    first, extra = [row(i) for i in range(12)], [row(i) for i in range(80)]
    schema = "query_id string, pos int, name string, domain string"
    keyed = spark.createDataFrame(first + extra, schema).select("query_id", "pos", "name", "domain", F.when(F.col("domain") != "", R.T.registrable_domain(F.col("domain"))).otherwise(F.lower(R.T.strip(F.coalesce("name", F.lit(""))))).alias("key"), F.lower(R.T.strip(F.coalesce("name", F.lit("")))).alias("fold")).collect()
    want = []
    for q in sorted({r[0] for r in first + extra}):
        keys, names, place = set(), set(), 0
        for i, r in enumerate(keyed):
            if r.query_id != q:
                continue
            if i < len(first) or not (r.key in keys or (r.fold and r.fold in names)):
                keys.add(r.key)
                names.add(r.fold)
                want.append((q, place, int(i >= len(first)), r.name, r.domain))
                place += 1
    got = [tuple(r) for r in R.merge_recalls(spark.createDataFrame(first, schema), spark.createDataFrame(extra, schema), most=5).orderBy("query_id", "place").collect()]
    assert got == want


def test_three_sources_fill_one_record(spark):
    base = records(spark, "company", {"name": "A", "domain": "a.com"})
    of = lambda source, **given: {"name": "A", "domain": "a.com", "source_id": source, **given}
    new = records(spark, "company", of("z", summary="z", location="z", attributes={"k": "z", "y": "z"}), of("m", location="m", employees="m"), of("b", employees="b", funding_stage="b", attributes={"k": "b"}), of("b", employees="bb"))
    (r,) = E.merge_enrichment(base, new, ("m", "b")).collect()
    assert (r.summary, r.location, r.employees) == ("z", "m", "m") and r.attributes["enriched_by"] == "m+b+z"
    assert r.attributes["y"] == "z" and (r.funding_stage, r.attributes["k"]) in (("b", "b"), ("", "z"))  # of the two of b the first as text


def test_rows_stay_one_to_one(spark):
    rows = spark.createDataFrame([("k", "", [], ""), ("k", "x", [], ""), ("n", "", [], "")], "row_key string, name string, industries array<string>, official_contact_state string").select("*", *[F.lit("").alias(c) for c in E.ROW_FIELDS])
    d = spark.createDataFrame([("k", "B", "s"), ("k", "A", "s"), (None, "C", "s")], "row_key string, name string, summary string")
    out = E.apply_dossier(rows, d).collect()
    assert sorted((r.row_key, r.name, r.summary) for r in out) == [("k", "A", "s"), ("k", "A", "s"), ("n", "", "")]
    from leadmill.schemas import CRITERION

    old = spark.createDataFrame([("l", "k", 1, "?", "r"), ("l", "k", 2, "?", "r"), ("l", "n", 3, "?", "r")], "list_id string, row_key string, score int, match_level string, match_reason string").withColumn("criteria", F.array().cast(f"array<{CRITERION}>"))
    found = records(spark, "company", {"name": "A"}, {"name": "B"}).withColumn("row_key", F.lit("k"))
    again = J.rejudge(old, found).collect()
    assert len(again) == 3 and [r.score for r in again if r.row_key == "n"] == [3] and len({r.score for r in again if r.row_key == "k"}) == 1


def test_sightings_without_a_time(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    rows = [("k", "n", "", "s", at(2)), ("k", "m", "", "t", None), ("j", "j", "", "u", None)]
    m = {r.dedupe_key: r for r in E.company_master(spark.createDataFrame(rows, "dedupe_key string, name string, domain string, source_id string, seen_at timestamp")).collect()}
    assert (m["k"].first_source, m["k"].first_seen_at, m["k"].seen_count) == ("s", at(2), 2) and m["j"].first_source == "u"


def test_names_in_the_order_of_their_clues(spark):
    assert spark.range(1).select(C.detect_person_names(F.lit("「李雷」、韩梅老师、王强先生"))).first()[0] == ["李雷", "王强"]


def test_tags_of_any_length():
    many = "<a " + " ".join(f'x{i}="{i}>"' for i in range(10_000)) + ' href="/y">z</a>'
    assert H.read(many)[0] == "z" and H.read(many)[2] == ["/y"]
    assert H.read('<p title="x>hello')[0] == "hello" and H.read("<a href=x'y>u</a>")[2] == ["x'y"]
    assert H.read('<a href="/q" title="a>b">t</a>')[0] == "t" and H.read('ok<a href="x')[0] == "ok"
    assert H.read('<p title="' * 20_000)[0] == ""  # linear, or this never ends


@pytest.mark.parametrize("most", [100, 0])
def test_requests_are_answered_once(spark, most):
    asked = spark.createDataFrame([(i, "hot") for i in range(1000)] + [(1000, "known"), (1001, "rare"), (1002, None)], "asker int, key string")
    seen = []

    def generate(new):
        seen.extend(r.key for r in new.collect())
        return new.select("key", F.concat(F.lit("made "), "key").alias("answer"))

    told, known = C.answered_once(asked, spark.createDataFrame([("known", "old"), ("known", "older")], "key string, answer string"), generate, most)
    rows = told.collect()
    assert sorted(seen) == ["hot", "rare"] and len(rows) == 1003
    assert {(r.key, r.answer) for r in rows} == {("hot", "made hot"), ("known", "old"), ("rare", "made rare"), (None, None)} and known.count() == 3


SIGHTINGS = "dedupe_key string, name string, domain string, source_id string, seen_at timestamp"


def test_master_files_grow_geometrically(spark, tmp_path):
    path, rng, rows = str(tmp_path / "m"), random.Random(2), []
    for batch in range(24):
        part = [(f"k{rng.randint(0, 60)}", f"n{batch}", "", rng.choice("st"), dt.datetime(2024, 1, 1 + rng.randint(0, 20))) for _ in range(5)]
        rows += part
        files = jobs.MasterFiles(spark, path)
        files.add(E.company_master(spark.createDataFrame(part, SIGHTINGS)).coalesce(1), batch)
        files.add(E.company_master(spark.createDataFrame(part, SIGHTINGS)), batch)  # a batch that runs again
        assert len(files.manifest()["runs"]) <= 4
        assert sum(n.startswith("run-") for n in os.listdir(path)) <= 12
    assert sorted(map(tuple, jobs.read_master(spark, path).collect())) == sorted(map(tuple, E.company_master(spark.createDataFrame(rows, SIGHTINGS)).collect()))


def test_master_survives_a_kill_before_the_manifest(spark, tmp_path):
    path, at = str(tmp_path / "m"), dt.datetime(2024, 1, 2)
    one = lambda key: E.company_master(spark.createDataFrame([(key, key, "", "s", at)], SIGHTINGS))
    files = jobs.MasterFiles(spark, path)
    files.add(one("a"), 0)
    broken = jobs.MasterFiles(spark, path)
    broken.put = types.MethodType(lambda self, manifest: (_ for _ in ()).throw(RuntimeError("killed")), broken)
    with pytest.raises(RuntimeError):
        broken.add(one("b"), 1)
    assert [r.dedupe_key for r in jobs.read_master(spark, path).collect()] == ["a"]
    files.sweep()
    files.add(one("b"), 1)
    assert sorted((r.dedupe_key, r.seen_count) for r in jobs.read_master(spark, path).collect()) == [("a", 1), ("b", 1)]
    live = {r["name"] for r in files.manifest()["runs"]} | set(files.manifest()["gone"])
    assert {n for n in os.listdir(path) if n.startswith("run-")} == live


def test_a_stream_never_forgets_a_name(spark, tmp_path):
    schema = "run_id string, name string, found_at timestamp"
    for i, (name, day) in enumerate([("a", 1), ("b", 5), ("a", 20), ("c", 28), ("a", 29)]):
        spark.createDataFrame([("r", name, dt.datetime(2024, 1, day))], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = jobs.stream_dedupe(stream).writeStream.format("memory").queryName("never").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.name for r in spark.table("never").collect()) == ["a", "b", "c"]


def test_a_list_is_a_file(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 8).select(F.concat(F.lit("l"), F.col("id") % 50).alias("list_id"), F.col("id").alias("row_id"))
    io.write_list(rows, str(tmp_path / "lists"))
    assert sum(n.endswith(".parquet") for _, _, names in os.walk(tmp_path / "lists") for n in names) == 50
    io.write_list(rows.where("list_id = 'l3'").limit(7), str(tmp_path / "lists"))  # another list stays
    assert spark.read.parquet(str(tmp_path / "lists")).groupBy("list_id").count().where("count <> 80").collect()[0]["count"] == 7


def test_many_words_are_one_pass(spark):
    """A pattern in the shape of a trie against looking for every word by itself."""
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("ab金属 (.\\[") for _ in range(n))
    words = sorted({some(rng.randint(1, 4)) for _ in range(60)})
    texts = [some(rng.randint(0, 40)) for _ in range(300)] + ["", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    longer = tries.extensions(words, words)
    got = {r.i: {w for w in words if set(longer[w]) & set(r.f)} for r in rows.select("i", tries.found(F.col("t"), words).alias("f")).collect()}
    assert got == {i: {w for w in words if t and w in t} for i, t in enumerate(texts)}
    families = tuple((f"f{i}", tuple(rng.sample(words, 3))) for i in range(20))
    named = {r.i: [x.name for x in r.f] for r in rows.select("i", C.match_families(F.col("t"), families).alias("f")).collect()}
    assert named == {i: [n for n, tokens in families if t and any(w in t for w in tokens)] for i, t in enumerate(texts)}
    signals = {r.i: r.f for r in rows.select("i", C.detect_signals(F.col("t"), tuple(words)).alias("f")).collect()}
    for i, t in enumerate(texts):
        hits = [w for w in words if t and w in t]
        assert signals[i] == [w for w in hits if not any(w != o and w in o for o in hits)]


def test_ten_thousand_words(spark):
    """Both ways of ``match_vocabulary`` agree, on words that nest too deep for a pattern too."""
    rng = random.Random(6)
    words = list({"".join(rng.choice("abcdefgh的了") for _ in range(rng.randint(2, 7))) for _ in range(10_000)})
    table = spark.createDataFrame([(i, f"v{i}", words[i * 50 : i * 50 + 50]) for i in range(len(words) // 50)], "pos int, family string, tokens array<string>")
    texts = spark.createDataFrame([(i, "".join(rng.choice("abcdefgh的了") for _ in range(60))) for i in range(40)], "list_id int, text string")
    one, other = ({r.list_id: r.families for r in C.match_vocabulary(texts, table, most).collect()} for most in (100_000, 0))
    assert one == other and len(one) == 40
    with pytest.raises(tries.TooDeep):
        tries.pattern(["a" * n for n in range(1, 400)])
    deep = spark.createDataFrame([(0, "deep", ["a" * n for n in range(1, 400)])], "pos int, family string, tokens array<string>")
    assert C.match_vocabulary(spark.createDataFrame([(1, "xaa"), (2, "b"), (3, None)], "list_id int, text string"), deep).collect() == [(1, ["deep"])]
    assert C.match_vocabulary(texts, deep.limit(0)).collect() == []


def test_a_hundred_thousand_words_meet_no_text_in_a_join(spark):
    """Texts are read for all words at once: no text is joined with words that it may not hold."""
    table = spark.range(1001).select(F.col("id").alias("pos"), F.concat(F.lit("v"), "id").alias("family"), F.transform(F.sequence(F.lit(0), F.lit(100)), lambda i: F.concat(F.lit("th"), F.substring(F.md5(F.concat_ws("-", "id", i)), 1, 12))).alias("tokens"))
    rows = {r.pos: r for r in table.where("pos % 100 = 7").collect()}
    texts = spark.createDataFrame([(p, f"x{r.tokens[3]}th{r.tokens[100]} {rows[7].tokens[0]}") for p, r in rows.items()] + [(-1, "th" * 50), (-2, None)], "list_id long, text string")
    found = C.match_vocabulary(texts, table)
    assert {r.list_id: r.families for r in found.collect()} == {p: list(dict.fromkeys(["v7", f"v{p}"])) for p in rows}
    assert joined_rows(found) == {}


def test_ways_of_a_vocabulary_equal_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    text = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    monkeypatch.setattr(lookups, "PIECE", 64)
    for of in ("ab", "abc的了😀\0", "abcdefgh"):
        words = [text(rng.randint(1, rng.choice([3, 9, 30])), of) for _ in range(300)]
        rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y", f"f{i}"]), [*words[i * 6 : i * 6 + 6], ""]) for i in range(50)]
        texts = [(rng.choice([None, *range(30)]), rng.choice([None, "", text(rng.randint(1, 90), of)])) for _ in range(60)]
        want: dict = {}
        for ident, said in texts:
            want.setdefault(ident, set()).update((p, f) for p, f, tokens in rows if any(t and t in (said or "") for t in tokens))
        order = lambda x: tuple((v is not None, v or "") if i else (v is not None, v or 0) for i, v in enumerate(x))
        want = {k: [f for _, f in sorted(v, key=order)] for k, v in want.items() if v}
        table = spark.createDataFrame(rows, "pos int, family string, tokens array<string>")
        profiles = spark.createDataFrame(texts, "list_id int, text string")
        for given in ({}, {"held": 0}, {"held_chars": 0, "most": 0}):
            assert {r.list_id: r.families for r in C.match_vocabulary(profiles, table, **given).collect()} == want, (of, given)


def _store(spark, path, n=200):
    store = snapshots.ListStore(spark, str(path), 4)
    rows = spark.range(0, n * 5, 1, 8).select(F.concat(F.lit("l"), F.col("id") % n).alias("list_id"), F.col("id").alias("bucket"))
    store.replace(rows.unionByName(spark.createDataFrame([(None, -1)], rows.schema)))
    return store


def _counts(df):
    return {r.list_id: r["count"] for r in df.groupBy("list_id").count().collect()}


def test_a_store_of_lists(spark, tmp_path):
    store = _store(spark, tmp_path / "s")
    files = sum(n.endswith(".parquet") for _, _, names in os.walk(tmp_path / "s") for n in names)
    assert files <= 8  # by buckets, not by the 200 lists
    old = store.read()
    new = spark.createDataFrame([("l3", 7), ("x", 8), (None, 9)], "list_id string, bucket long")
    assert store.replace(new, spark.createDataFrame([("l4",)], "list_id string")) == 2
    want = {f"l{i}": 5 for i in range(200)} | {None: 1}
    assert _counts(old) == want  # as when it was opened
    assert _counts(store.read()) == {k: v for k, v in want.items() if k != "l4"} | {"l3": 1, "x": 1}
    assert [r.bucket for r in store.read(["l3"]).collect()] == [7] and store.read(["l4", "none"]).count() == 0
    assert {r.bucket for r in store.read().where("list_id is null").collect()} == {9}
    for i in range(5):
        store.replace(spark.createDataFrame([("x", i)], "list_id string, bucket long"))
    assert store.versions() == [5, 6, 7] and store.read().count() == 5 * 198 + 3
    with pytest.raises(ValueError):
        store.replace(spark.createDataFrame([("x", "y")], "list_id string, other string"))
    assert store.replace(new.limit(0)) == 8 and _counts(store.read())["x"] == 1


def test_a_store_keeps_what_others_wrote(spark, tmp_path, monkeypatch):
    """A second writer is first between reading and committing; then a writer breaks off."""
    store, real = _store(spark, tmp_path / "s", 20), snapshots.ListStore.commit
    row = lambda name: spark.createDataFrame([(name, 1)], "list_id string, bucket long")

    def late(self, manifest):
        monkeypatch.setattr(snapshots.ListStore, "commit", real)
        snapshots.ListStore(spark, str(tmp_path / "s")).replace(row("other"))
        real(self, manifest)

    monkeypatch.setattr(snapshots.ListStore, "commit", late)
    assert store.replace(row("mine")) == 3
    have = _counts(store.read())
    assert have["other"] == have["mine"] == 1 and len(have) == 23

    def broken(self, manifest):
        raise OSError("gone")

    monkeypatch.setattr(snapshots.ListStore, "commit", broken)
    with pytest.raises(OSError):
        store.replace(row("lost"))
    monkeypatch.setattr(snapshots.ListStore, "commit", real)
    assert _counts(store.read()) == have
    store.sweep()
    assert _counts(store.read()) == have and not [n for n in os.listdir(tmp_path / "s") if n.startswith(("staged-", "new-"))]
