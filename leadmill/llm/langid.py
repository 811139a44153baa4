"""Language identification of spans by Viterbi over words.

Character n-grams of labelled texts give each word a score per language. The scripts of a word's letters
narrow its candidates to languages that were seen in that script. Viterbi over the words of a text, with a
penalty for each switch, labels spans; the language with most letters is the document's (of several with as
many, the first by name), and the score is the mean posterior of that language over the letters. A document's
familiarity is the share of its n-grams that the language's training documents have; it falls for languages
that were never learned and for junk, whatever the number of languages.

A letter is a character of Unicode category L; digits, other numbers and marks end a word.

The model is fitted on at most about ``per_lang`` documents of each language, drawn by a hash of the id
(a documented bound); every document is predicted. Nulls: a text that is null or has no letter is ``und``
with score 0 and no spans. A table without labelled rows predicts ``und`` throughout. Rows map one to one;
repeated and null ids are kept; other columns never reach the prediction. Whole texts are labelled, and a
very long one takes some 50 bytes a word in its task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leadmill.llm.columns import col, free
from leadmill.llm.tasks import tidy

PER_LANG, SLOT_BITS, PENALTY, SMOOTHING = 2000, 17, 6.0, 0.5
#: Texts and bytes of them at a time (one text at least), and distinct words that a task remembers before it starts afresh.
BATCH, BATCH_BYTES, REMEMBERED = 1024, 1 << 21, 250_000
#: Distinct words whose n-grams are in memory at once.
AT_ONCE = 1 << 14
#: First and last code points of scripts (Unicode blocks).
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)
NAMES = sorted({s for s, _, _ in SCRIPTS}) + ["other"]
_EDGES = sorted((a, b, NAMES.index(s)) for s, a, b in SCRIPTS)
_STARTS, _ENDS, _KINDS = (np.array(x) for x in zip(*_EDGES, strict=True))
WORD = re.compile(r"[^\W\d_]+")


def _runs(word: str) -> Iterator[tuple[int, str]]:
    """The runs of letters in a word that also has other characters, such as fractions and letter numbers."""
    at = 0
    for letters, run in groupby(word, str.isalpha):
        part = "".join(run)
        if letters:
            yield at, part
        at += len(part)


def words_of(text: str) -> list[str]:
    """The words of a lowered text, runs of letters."""
    found = WORD.findall(text)
    return found if "".join(found).isalpha() or not found else [part for w in found for _, part in _runs(w)]


def places_of(text: str) -> list[int]:
    """Where the words of a lowered text begin."""
    return [m.start() + at for m in WORD.finditer(text) for at, _ in _runs(m[0])]


def lowered(text: str) -> str:
    """In lower case, with every character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower()[0] for c in text)


def scripts_of(points: np.ndarray) -> np.ndarray:
    """The script number of each code point."""
    at = np.searchsorted(_STARTS, points, "right") - 1
    inside = (at >= 0) & (points <= _ENDS[at])
    return np.where(inside, _KINDS[at], len(NAMES) - 1)


def grams(words: list[str], bits: int = SLOT_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the 2-, 3- and 4-grams of words between two marks, the word of each, and each word's scripts as bits."""
    marked = "".join(f"\x02{w}\x03" for w in words)
    p = np.frombuffer(marked.encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array(list(map(len, words)), np.int64) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    slots, owners = [], []
    for n in (2, 3, 4):
        if len(p) >= n:
            inside = owner[: len(p) - n + 1] == owner[n - 1 :]
            h = np.full(len(p) - n + 1, np.uint64(n))
            for i in range(n):
                h = (h ^ p[i : len(p) - n + 1 + i]) * np.uint64(0x100000001B3) + (h >> np.uint64(29))
            slots.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits))[inside].astype(np.int64))
            owners.append(owner[: len(p) - n + 1][inside])
    ends = np.cumsum(sizes)
    kinds = np.int64(1) << scripts_of(p.astype(np.int64)).astype(np.int64)
    kinds[ends - 1] = kinds[ends - sizes] = 0  # the marks have no script
    return np.concatenate(slots), np.concatenate(owners), np.bitwise_or.reduceat(kinds, ends - sizes)


def parts(batch: pa.RecordBatch, text_at: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of so few texts and bytes that their words fit in memory."""
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy().astype(np.int64))])
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, ends[start] + BATCH_BYTES, "right")) - 1
        stop = min(max(stop, start + 1), start + BATCH, batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def held_out(ident: Column) -> Column:
    return F.crc32(ident.cast("string").cast("binary")) % 3 == 1


def _counted(langs: list[str], bits: int):
    """Counts by language of n-gram slots, and of words by script in slots from 2 ** bits on, over one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(langs), (1 << bits) + len(NAMES)))
        for batch in (part for whole in batches for part in parts(whole, 0)):
            seen: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(words_of(lowered(text)))
            for lang, words in seen.items():
                row, found = counts[langs.index(lang)], list(words)
                for i in range(0, len(found), AT_ONCE):
                    some = found[i : i + AT_ONCE]
                    times = np.array([words[w] for w in some], np.float64)
                    slots, owner, kinds = grams(some, bits)
                    row[: 1 << bits] += np.bincount(slots, times[owner], 1 << bits)
                    row[1 << bits :] += [times[kinds >> k & 1 > 0].sum() for k in range(len(NAMES))]
        for i, row in enumerate(counts):
            full = np.flatnonzero(row)
            if len(full):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), i, np.int32)), pa.array(full.astype(np.int32)), pa.array(row[full].astype(np.int64))], ["lang", "slot", "n"])

    return tidy(run)


class Model:
    """Log probabilities of n-gram slots by language and the scripts that each language uses."""

    def __init__(self, langs: list[str], counts: np.ndarray, bits: int, penalty: float = PENALTY):
        self.langs, self.bits, self.penalty = langs, bits, penalty
        own, scripts = counts[:, : 1 << bits], counts[:, 1 << bits :]
        self.logp = np.log((own + SMOOTHING) / (own.sum(axis=1, keepdims=True) + SMOOTHING * own.shape[1])).astype(np.float32).T.copy()
        self.seen = (own > 0).T.copy()
        self.uses = scripts > 0.001 * scripts.sum(axis=1, keepdims=True)
        self.memo: dict[str, int] = {}
        self.table = np.empty((0, len(langs)), np.float32)
        self.known = np.empty((0, len(langs) + 1), np.int32)

    def learn(self, words: list[str]) -> None:
        """Give words that are new rows of ``table``, their scores, and ``known``, their n-grams seen by language and in all.

        A full memory starts afresh.
        """
        if len(self.memo) > REMEMBERED:
            self.forget()
        new = [w for w in dict.fromkeys(words) if w not in self.memo]
        if not new:
            return
        tables, knowns = [self.table], [self.known]
        for i in range(0, len(new), AT_ONCE):
            score, known = self.scored(new[i : i + AT_ONCE])
            tables.append(score)
            knowns.append(known)
        self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new)), strict=True))
        self.table, self.known = np.concatenate(tables), np.concatenate(knowns)

    def scored(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of words by language, and their n-grams seen by language and in all."""
        slots, owner, kinds = grams(words, self.bits)
        score = np.stack([np.bincount(owner, self.logp[slots, k], len(words)) for k in range(len(self.langs))], axis=1) / 3
        masks, at = np.unique(kinds, return_inverse=True)
        fits = np.array([[all(self.uses[k, b] for b in range(len(NAMES)) if m >> b & 1) for k in range(len(self.langs))] for m in masks])
        fits[~fits.any(axis=1)] = True
        score = np.where(fits[at], score, score.min(axis=1, keepdims=True) - 50)
        seen = self.seen[slots]
        known = [np.bincount(owner[seen[:, k]], minlength=len(words)) for k in range(len(self.langs))] + [np.bincount(owner, minlength=len(words))]
        return score.astype(np.float32), np.stack(known, axis=1).astype(np.int32)

    def forget(self) -> None:
        self.memo, self.table, self.known = {}, self.table[:0].copy(), self.known[:0].copy()

    def __getstate__(self):
        return {**self.__dict__, "memo": {}, "table": self.table[:0], "known": self.known[:0]}


def viterbi(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word; document d has the rows starts[d] to starts[d] + lengths[d].

    All documents advance together, longest first, so step t works on those with more than t words.
    """
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    n, k = scores.shape
    kind = np.min_scalar_type(max(k - 1, 0))
    back = np.empty((n, k), kind)
    label = np.empty(n, kind)
    own = np.arange(k, dtype=kind)
    best = scores[starts].astype(np.float64)
    active = len(starts)
    final = np.zeros(len(starts), kind)
    longest = int(lengths[0]) if len(lengths) else 0
    ends = np.searchsorted(-lengths, -np.arange(longest + 1), "left")  # documents with more than t words
    for t in range(1, longest + 1):
        now = int(ends[t])
        if now < active:
            final[now:active] = best[now:active].argmax(axis=1)
            best, active = best[:now], now
        if not active:
            break
        rows = starts[:active] + t
        top = best.argmax(axis=1).astype(kind)
        moved = best[np.arange(active), top][:, None] - penalty
        switch = moved > best
        back[rows] = np.where(switch, top[:, None], own)
        best = np.where(switch, moved, best) + scores[rows]
    current = final
    for t in range(longest - 1, -1, -1):
        now = int(ends[t])
        rows = starts[:now] + t
        label[rows] = current[:now]
        if t:
            current[:now] = back[rows, current[:now]]
    return label


SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))


def label(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray, list[list[dict]]]:
    """Language, score, familiarity and spans of each text."""
    k, langs = len(model.langs), [*model.langs, "und"]
    if not k:
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), [[] for _ in texts]
    words: list[str] = []
    lengths = np.zeros(len(texts), np.int64)
    for d, text in enumerate(texts):
        own = words_of(lowered(text)) if text else []
        lengths[d] = len(own)
        words.extend(own)
    model.learn(words)
    rows = np.array([model.memo[w] for w in words], np.int64)
    scores = model.table[rows]
    letters = np.array(list(map(len, words)), np.int64)
    starts = np.cumsum(lengths) - lengths
    full = np.flatnonzero(lengths)
    labels = viterbi(scores, starts[full], lengths[full], model.penalty)
    doc = np.repeat(np.arange(len(texts)), lengths)
    by = np.bincount(doc * k + labels.astype(np.int64), letters, len(texts) * k).reshape(-1, k)
    best = np.where(lengths > 0, by.argmax(axis=1), k)
    score, familiar = np.zeros(len(texts)), np.zeros(len(texts))
    if len(doc):
        known = model.known[rows]
        familiar = np.bincount(doc, known[np.arange(len(doc)), best[doc]], len(texts)) / np.maximum(np.bincount(doc, known[:, k], len(texts)), 1)
        e = np.exp(scores - scores.max(axis=1, keepdims=True))
        post = e[np.arange(len(doc)), best[doc]] / e.sum(axis=1)
        score = np.bincount(doc, post * letters, len(texts)) / np.maximum(np.bincount(doc, letters, len(texts)), 1)
    spans = []
    for d, text in enumerate(texts):
        own = labels[starts[d] : starts[d] + lengths[d]]
        cuts = np.flatnonzero(own[1:] != own[:-1]) + 1 if len(own) else []
        if not len(own):
            spans.append([])
        elif not len(cuts):
            spans.append([{"begin": 0, "end": len(text), "lang": model.langs[own[0]]}])
        else:  # a span ends where the next one's first word begins
            begins = places_of(lowered(text))
            at = [0, *(begins[c] for c in cuts), len(text)]
            spans.append([{"begin": a, "end": b, "lang": model.langs[own[c]]} for a, b, c in zip(at, at[1:], [0, *cuts], strict=False)])
    return [langs[b] for b in best], np.clip(score, 0, 1), familiar, spans


#: What labelling adds to the columns of a frame.
ADDED = ("__lang", "__score", "__familiar", "__spans")
_KINDS_ADDED = ("string", "double", "double", "array<struct<begin: int, end: int, lang: string>>")


def _labelled(shared, text_at: int, kept: list[int], added: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, text_at):
                langs, score, familiar, spans = label(batch.column(text_at).to_pylist(), shared.value)
                names = [batch.schema.names[i] for i in kept]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(langs, pa.string()), pa.array(score), pa.array(familiar), pa.array(spans, SPANS)], [*names, *added])

    return tidy(run, lambda: shared.value.forget())


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, bits: int = SLOT_BITS, penalty: float = PENALTY) -> Model:
    """A model of the labelled rows whose id isn't held out, from about ``per_lang`` documents of each language at most."""
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text"), col(lang_col).alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~F.coalesce(held_out(F.col("id")), F.lit(False)))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    langs = sorted(sizes)
    counts = np.zeros((len(langs), (1 << bits) + len(NAMES)), np.int64)
    if langs:
        share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, per_lang / sizes[lang]))])
        drawn = rows.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).select("text", "lang")
        summed = drawn.mapInArrow(_counted(langs, bits), "lang int, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()  # languages x slots at most
        counts[summed["lang"].to_numpy(), summed["slot"].to_numpy()] = summed["n"].to_numpy()
    return Model(langs, counts, bits, penalty)


def added(columns: list[str]) -> list[str]:
    """The names of the columns that ``with_language`` adds to these: ``ADDED``, with underscores added where one is taken."""
    return free(columns, *ADDED)


def with_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with language, score, familiarity and spans of (begin, end, lang) in characters added (``added``); rows stay where they are."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model), added(docs.columns)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names with dots don't reach Python workers
    new = [f"n{i}" for i in range(len(names))]
    kind = StructType([*plain.schema.fields, *StructType.fromDDL(", ".join(f"{n} {k}" for n, k in zip(new, _KINDS_ADDED, strict=True))).fields])
    return plain.mapInArrow(_labelled(shared, docs.columns.index(text_col), list(range(len(docs.columns))), new), kind).toDF(*docs.columns, *names)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, familiar, spans of (begin, end, lang) in characters)."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model), ["lang_pred", "score", "familiar", "spans"]
    picked = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    return picked.mapInArrow(_labelled(shared, 1, [0], names), "doc_id long, " + ", ".join(f"{n} {k}" for n, k in zip(names, _KINDS_ADDED, strict=True)))


#: Least score and familiarity of a recognised language. The least familiar clean document of 50,000 had 0.79.
LEAST_SCORE, LEAST_FAMILIAR = 0.3, 0.5


def keep_known(docs: DataFrame, model: Model, text_col: str = "text", least: float = LEAST_SCORE, familiar: float = LEAST_FAMILIAR) -> DataFrame:
    """The rows of ``docs`` with a recognised language; ``und``, low scores and texts of unfamiliar n-grams go."""
    lang, score, share, _ = map(col, added(docs.columns))
    known = with_language(docs, model, text_col).where((lang != "und") & (score >= least) & (share >= familiar))
    return known.select(*map(col, docs.columns))
