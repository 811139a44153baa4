"""Line de-duplication by winnowing over line hashes.

A run of consecutive lines (blank ones left out) with ``min_lines`` lines or ``min_words`` words is a repeat
when the same lines also stand earlier: in a document with a smaller id, or further up in the same one. All
lines of repeats are deleted, so of a long passage that occurs twice the later one goes whole, to its last line.

* The window at a line is the shortest such run that begins there. It selects its smallest line hash, the last
  on a tie; equal windows anywhere select the same line. The selected lines are the fingerprints, a row each
  with the lines around it; most are selected by several windows, and the other lines have no row.
* Positions of one fingerprint meet by a join; a fingerprint with one position, as most are, ends there.
* Each match is extended to both sides, line by line, as far as the lines around agree with an earlier position
  of the same fingerprint. Every further line of a longer match lies around the next fingerprint of the same
  match, so ``min_lines - 1`` lines each way are enough, and what was extended is a key that can be
  aggregated: a line that repeats in thousands of documents is never paired with all its copies.
* Runs are equal if two hashes of 64 bits are, each made of its lines' hashes with a seed of its own.
* Lines under repeats are merged into maximal runs, which are cut from the text.

Nulls: a null text stays null and an empty one empty. Rows with a null id are left as they are. Rows with
one id and one text are the same document; rows with one id and different texts are told apart by a hash.
Documents without a window are left alone. All other columns are kept, whatever their names. Work is linear
in the lines of a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.llm.columns import col, free
from leadmill.llm.mixing import TOKEN
from leadmill.llm.scratch import Scratch

MIN_LINES, MIN_WORDS = 3, 50
ADDED = ("__lines", "__removed", "__runs")


def _enough(n: int, words: list[str], min_lines: int, min_words: int) -> str:
    return "true" if n == min_lines else f"{' + '.join(words)} >= {min_words}"


def fingerprints(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs: (id, mark, text) to (id, mark, at, fingerprint, around), a row per selected line.

    ``at`` counts the lines that aren't blank; ``around`` has hashes h and g and words w of the lines from
    ``min_lines - 1`` before it to as many after it, null beyond the ends of the text.
    """
    lines = F.expr(f"filter(transform(split(text, '\\n'), l -> struct(xxhash64(l) as h, xxhash64(1, l) as g, regexp_count(l, r'{TOKEN}') as w)), x -> x.w > 0)")
    # the smallest hash of the window, the last on a tie: its place is kept negative
    least = lambda n: "array_min(array(" + ", ".join(f"struct(lines[i + {k}].h as h, -(i + {k}) as j)" for k in range(n)) + ")).j"
    window = " ".join(f"WHEN i + {n} <= size(lines) AND {_enough(n, [f'lines[i + {k}].w' for k in range(n)], min_lines, min_words)} THEN -{least(n)}" for n in range(1, min_lines + 1))
    listed = docs.where("id is not null and text is not null").select("id", "mark", lines.alias("lines")).where("size(lines) > 0")
    picked = listed.select("id", "mark", "lines", F.expr(f"array_distinct(filter(transform(sequence(0, size(lines) - 1), i -> CASE {window} END), p -> p is not null))").alias("picked"))
    far = min_lines - 1
    around = ", ".join(f"get(lines, p + {k})" for k in range(-far, far + 1))
    each = picked.select("id", "mark", F.explode(F.expr(f"transform(picked, p -> struct(p as at, lines[p].h as fingerprint, array({around}) as around))")).alias("x"))
    return each.select("id", "mark", "x.*")


def _extended(min_lines: int, min_words: int) -> str:
    """Of a position: before, after and two hashes of every run around it that is long enough, up to ``min_lines`` lines."""
    far, runs = min_lines - 1, []
    for before in range(min_lines):
        for after in range(min_lines - before):
            at = range(far - before, far + after + 1)
            there = " AND ".join(f"around[{k}] is not null" for k in at)
            key, check = (f"xxhash64({', '.join(f'around[{k}].{x}' for k in at)})" for x in "hg")
            run = f"struct({before} as before, {after} as after, {key} as key, {check} as check)"
            runs.append(f"CASE WHEN {there} AND {_enough(len(at), [f'around[{k}].w' for k in at], min_lines, min_words)} THEN {run} END")
    return f"array_compact(array({', '.join(runs)}))"


def repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs: (id, mark, text) to (id, mark, gone): the numbers of the lines in repeated runs, ascending."""
    scratch = Scratch(docs.sparkSession, "lines")
    selected = scratch.write(fingerprints(docs, min_lines, min_words), "fingerprints")
    # sums by key are tables of their own, so that the joins with them can split a hot key
    shared = scratch.write(selected.groupBy("fingerprint").agg(F.count("*").alias("c")).where("c > 1").select("fingerprint"), "shared")
    met = selected.join(shared, "fingerprint").select("id", "mark", "at", "fingerprint", F.explode(F.expr(_extended(min_lines, min_words))).alias("x"))
    met = scratch.write(met.select("id", "mark", (F.col("at") - F.col("x.before")).alias("i"), (F.col("x.before") + F.col("x.after") + 1).alias("n"), "fingerprint", "x.before", "x.key", "x.check"), "extended")
    start, same = F.struct("id", "mark", "i"), ["key", "check", "fingerprint", "before"]
    first = met.groupBy(*same).agg(F.min(start).alias("first"), F.max(start).alias("last")).where("first < last").select(*same, "first")
    again = met.join(scratch.write(first, "first"), same).where(start > F.col("first"))
    under = again.select("id", "mark", F.explode(F.expr("sequence(i, i + n - 1)")).alias("line"))
    return under.groupBy("id", "mark").agg(F.array_sort(F.collect_set("line")).alias("gone"))


def added(columns: list[str]) -> list[str]:
    """The names of the three columns that ``dedup_lines`` adds to these: ``ADDED``, with underscores added where one is taken."""
    return free(columns, *ADDED)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the repeated runs cut from its text, and three longs added (``added``): lines, removed lines, runs."""
    columns = docs.columns
    names = added(columns)
    ident, mark, gone, cut = free([*columns, *names], "__id", "__mark", "__gone", "__cut")
    picked = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    found = repeated_lines(picked, min_lines, min_words).toDF(ident, mark, gone)
    joined = docs.join(found, (col(id_col) == F.col(ident)) & (F.xxhash64(col(text_col)) == F.col(mark)), "left")

    # each lambda binds its argument, so a text is split once; all lookups are by place or by hash
    def kept(parts, full):
        lost = F.transform(F.col(gone), lambda g: full[g])  # the k-th line that isn't blank has number k
        places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), lost)
        return F.when(F.col(gone).isNotNull(), F.array_join(F.transform(places, lambda p: parts[p]), "\n")).otherwise(col(text_col))

    def read(parts):
        full = F.filter(F.transform(parts, lambda x, p: F.when(F.regexp_like(x, F.lit(TOKEN)), p)), lambda p: p.isNotNull())
        return F.transform(F.array(full), lambda f: F.struct(F.size(f).cast("long").alias("lines"), kept(parts, f).alias("text")))[0]

    ends = F.size(F.array_except(F.col(gone), F.transform(F.col(gone), lambda g: g + 1)))
    joined = joined.withColumn(cut, F.transform(F.array(F.split(col(text_col), "\n")), read)[0])
    counts = (F.coalesce(F.col(cut)["lines"], F.lit(0)), F.coalesce(F.size(gone), F.lit(0)), F.coalesce(ends, F.lit(0)))
    kept_columns = [F.col(cut)["text"].alias(c) if c == text_col else col(c) for c in columns]
    return joined.select(*kept_columns, *(n.cast("long").alias(name) for n, name in zip(counts, names, strict=True)))


ORACLE = r"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
counted AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM raw),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM counted WHERE w > 0),
near AS (SELECT *, lead(line) OVER d AS l1, lead(line, 2) OVER d AS l2, lead(w) OVER d AS w1 FROM numbered WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
run AS (SELECT doc_id, i, 1 AS n, line AS k FROM near WHERE w >= 50
  UNION ALL SELECT doc_id, i, 2, line || chr(10) || l1 FROM near WHERE w + w1 >= 50
  UNION ALL SELECT doc_id, i, 3, line || chr(10) || l1 || chr(10) || l2 FROM near WHERE l2 IS NOT NULL),
again AS (SELECT doc_id, i, n FROM (SELECT *, row_number() OVER (PARTITION BY n, k ORDER BY doc_id, i) AS nth FROM run) WHERE nth > 1),
lost AS (SELECT DISTINCT doc_id, i + o AS i FROM again, range(3) t(o) WHERE o < n),
marked AS (SELECT m.*, l.i IS NOT NULL AS gone FROM numbered m LEFT JOIN lost l ON l.doc_id = m.doc_id AND l.i = m.i),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM marked),
kept AS (SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.pos) AS text FROM raw r LEFT JOIN runs m ON m.doc_id = r.doc_id AND m.pos = r.pos WHERE NOT coalesce(m.gone, false) GROUP BY r.doc_id),
sums AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE begins) AS n_runs FROM runs GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n_lines, 0)::BIGINT AS n_lines, coalesce(s.n_removed, 0)::BIGINT AS n_removed, coalesce(s.n_runs, 0)::BIGINT AS n_runs,
       CASE WHEN d.text IS NULL THEN 0 ELSE coalesce(length(k.text), 0) END::BIGINT AS n_chars, CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(k.text, '')) END AS kept_sha256
FROM documents d LEFT JOIN sums s USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
