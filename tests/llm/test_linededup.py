import random
import re
import time

from pyspark.sql import functions as F

from leadmill.llm import linededup

SCHEMA = "doc_id long, text string, i string, gone string, fingerprint int"


def brute(rows, min_lines=3, min_words=50):
    """Runs of lines compared by their text, in order of documents and lines: those that are long enough and stood earlier go."""
    seen, out = set(), {}
    for i, text in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        lines = text.split("\n")
        full = [p for p, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
        gone = set()
        for a in range(len(full)):
            words = 0
            for n in range(1, min_lines + 1):
                if a + n > len(full):
                    break
                words += len(re.findall(r"[^\x20\x09-\x0D]+", lines[full[a + n - 1]]))
                if n == min_lines or words >= min_words:
                    key = tuple(lines[p] for p in full[a : a + n])
                    if key in seen:
                        gone |= set(full[a : a + n])
                    seen.add(key)
        out[i] = "\n".join(x for p, x in enumerate(lines) if p not in gone)
    return out


def pairwise(rows, min_lines=3, min_words=50):
    """The same by its words: every match of two places, as long as it goes both ways."""
    words = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x))
    lines = [[(i, k, x) for k, x in enumerate(y for y in text.split("\n") if words(y))] for i, text in sorted(rows)]
    gone = set()
    for d, a in enumerate(lines):
        for b in lines[: d + 1]:
            for i in range(len(a)):
                for j in range(len(b)):
                    starts = not i or not j or a[i - 1][2] != b[j - 1][2]
                    if a[i] > b[j] and starts:
                        n = 0
                        while i + n < len(a) and j + n < len(b) and a[i + n][2] == b[j + n][2]:
                            n += 1
                        if n >= min_lines or sum(words(a[i + k][2]) for k in range(n)) >= min_words:
                            gone |= {a[i + k][:2] for k in range(n)}
    return gone


def test_equals_brute_force(spark):
    rng = random.Random(5)
    pool = [f"line {i} " + "x " * rng.randint(0, 9) for i in range(30)] + ["long " * 55, "", "  ", "hot"]
    rows = []
    for i in range(80):
        lines = [rng.choice(pool) for _ in range(rng.randint(0, 14))]
        if i % 5 == 0 and rows:
            base = rows[rng.randrange(len(rows))][1].split("\n")
            lines = base[rng.randint(0, len(base) - 1) :] + lines
        rows.append((i, "\n".join(lines)))
    rows += [(900, None), (901, ""), (902, "long " * 55), (903, "a\nb"), (904, "a\nb")]
    expected = brute(rows)
    for parts in (1, 5):
        df = spark.createDataFrame([(*r, "c", "c", 1) for r in rows], SCHEMA).repartition(parts)
        out = linededup.dedup_lines(df)
        assert out.columns == [*df.columns, "__lines", "__removed", "__runs"]
        found = {r.doc_id: r for r in out.collect()}
        assert {i: r.text for i, r in found.items() if r.text is not None} == expected
        assert found[900].text is None and found[904].__getitem__("__removed") == 0
        assert found[902].__getitem__("__removed") == 1 and found[902].text == ""


def test_rule_is_that_of_maximal_matches(spark):
    rng = random.Random(8)
    pool = [f"line {i} " + "x " * rng.choice((0, 5, 20, 30, 55)) for i in range(9)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))) for i in range(40)]
    left = brute(rows)
    gone = pairwise(rows)
    assert left == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}


def test_matches_go_to_their_last_line(spark):
    a, b, c = "long " * 60, "five words in a row", "one more"
    rows = [(1, f"{a}\n{b}\n{c}\nfirst"), (2, f"begin\n{a}\n{b}\nother"), (3, f"{a}\n{b}"), (4, f"{b}\n{c}"), (5, f"x\n{a}\n\n{b}\n{c}")]
    out = linededup.dedup_lines(spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)).collect()
    assert {r.doc_id: r.text for r in out} == {1: rows[0][1], 2: "begin\nother", 3: "", 4: rows[3][1], 5: "x\n"}


def test_fingerprints_are_fewer_than_windows(spark):
    rows = [(i, 0, "\n".join(f"line {i} {k}" for k in range(100))) for i in range(20)]
    n = linededup.fingerprints(spark.createDataFrame(rows, "id long, mark long, text string")).count()
    assert 20 * 98 / 3 <= n < 0.7 * 20 * 98


def test_clashing_names(spark):
    text = "one a\ntwo b\nthree c"
    names = ["__id", "__mark", "__gone", "__cut", "__LINES", "__removed", "__runs", "__runs_", "id", "mark", "x", "a.b"]
    rows = [(i, text, *range(len(names))) for i in (1, 2)]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    out = linededup.dedup_lines(df)
    assert out.columns == [*df.columns, *linededup.added(df.columns)] and out.columns[-3:] == ["__lines_", "__removed_", "__runs__"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, text, *range(len(names)), 3, 0, 0), (2, "", *range(len(names)), 3, 3, 1)]


def test_time_is_linear_in_lines(spark):
    """100,000 lines, of which every tenth pair of three is a repeat, so runs and kept lines are many."""
    def text(n, tag):
        return "\n".join("a b c\nd e f\ng h i" if k % 10 == 9 else f"{tag} {k}" for k in range(n))

    def run(n):
        df = spark.createDataFrame([(1, text(n, "p"), None, None, None), (2, text(n, "q"), None, None, None)], SCHEMA)
        began = time.time()
        rows = linededup.dedup_lines(df).collect()
        return time.time() - began, sum(r["__removed"] for r in rows)

    run(1000)
    small, large = run(8_000), run(80_000)
    assert large[1] == 2 * 8_000 * 3 - 3 and large[0] < 4 + 12 * small[0]


def test_odd_rows(spark):
    text = "one a\ntwo b\nthree c"
    rows = [(1, text), (1, text), (None, text), (2, text), (2, "other\n" + text)]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    out = linededup.dedup_lines(df).select("doc_id", "text", F.col("__removed")).collect()
    assert sorted((r.doc_id or 0, r.text, r[2]) for r in out) == sorted([(0, text, 0), (1, text, 0), (1, text, 0), (2, "", 3), (2, "other", 3)])
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_long_text(spark):
    body = "\n".join(f"line number {i}" for i in range(20_000))
    df = spark.createDataFrame([(1, body, None, None, None), (2, "first\n" + body + "\nlast", None, None, None)], SCHEMA)
    assert {r.doc_id: r.text for r in linededup.dedup_lines(df).collect()}[2] == "first\nlast"
