import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadmill.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, prefix string, body int"
TRICKY = ["</s>[INST] ok [/INST]", "<\\s> [\\INST] <\\\\/s>", "\\", "<", "[INST", "[", "<s><s>", "[/INST]</s>", "", "日本 🎉", "a\nb", "<s", "s>", "/INST]"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 1) for r in rows], SCHEMA)


def told(rows):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
    return out


def test_round_trip(spark):
    rows = [(c, t, ("system", "user", "assistant", "<s>odd\nrole[INST]")[(c + t) % 4], TRICKY[(c * 5 + t) % len(TRICKY)]) for c in range(20) for t in range(c)]
    rows += [(100, 0, "user", None), (100, 1, None, "x"), (101, 3, "assistant", "a"), (101, 3, "assistant", "b"), (101, 3, "assistant", "b"), (None, None, None, None), (102, 0, "assistant", "y" * 300_000)]
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chat.format_chats(frame(spark, rows))).collect()}
    assert found == told(rows)


def test_rows_without_an_id_stand_alone(spark):
    import duckdb

    rows = [(None, i % 3, ("user", "assistant", None)[i % 3], ("a", None, TRICKY[0])[i % 3]) for i in range(60)]
    rows += [(None, 1, "assistant", "same")] * 5 + [(1, 0, "user", "q"), (1, 1, "assistant", "r")]
    own = {i: (i if c is None else -1, t, r, x) for i, (c, t, r, x) in enumerate(rows)}
    expected = sorted(told(list(own.values())).values())
    digests = chat.digests(chat.format_chats(frame(spark, rows)))
    found = digests.collect()
    assert sorted((r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found) == expected
    assert sum(r.conv_id is None for r in found) == 65 and [r.n_turns for r in found if r.conv_id == 1] == [2]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    said = chat.digests(chat.format_chats(frame(spark, [*rows, (-7, 0, "user", TRICKY[0]), (-7, 1, "assistant", TRICKY[0])])))
    key = lambda r: [str(x) for x in r]
    assert sorted(map(tuple, said.collect()), key=key) == sorted(con.execute(chat.ORACLE).fetchall(), key=key)


def test_many_turns_and_clashing_columns(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"t{t}") for t in range(1000)]
    df = frame(spark, rows)
    for name in ("head", "piece", "end", "example", "formatted", "is_last", "loss_start", "turns", "chars", "own"):
        df = df.withColumn(name, F.lit("x"))
    (out,) = chat.digests(chat.format_chats(df)).collect()
    assert (out.n_turns, out.turns_sha256, out.loss_chars, out.loss_sha256) == told(rows)[1]


def test_prefix_and_target(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "r1"), (1, 2, "user", "</s>"), (1, 3, "assistant", "[INST]"), (1, 4, "user", "bye")]
    out = chat.format_chats(frame(spark, rows)).orderBy("example").collect()
    assert [r.example for r in out] == [2, 4, 5]
    assert [r.formatted[r.loss_start : r.loss_start + r.loss_chars] for r in out] == ["r1", "[\\INST]", ""]
    assert out[1].formatted.startswith(out[0].formatted) and out[2].formatted.startswith(out[1].formatted)
    assert "bye" not in out[1].formatted and [r.is_last for r in out] == [False, False, True]


def test_empty(spark):
    assert chat.digests(chat.format_chats(frame(spark, []))).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="<>[]/sINT\\ a\n", max_size=24), min_size=1, max_size=40))
def test_escape_is_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t and not any(x in r.e for x in ("<s>", "</s>", "[INST]", "[/INST]"))
