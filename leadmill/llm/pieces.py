"""SentencePiece encoding and decoding that keeps byte offsets.

The model's own normaliser is applied by longest-prefix matches through its compiled character map, and
every normalised byte remembers the source bytes it came from; the pieces tile the normalised text, so each
one projects to a span of original bytes. The ids are the library's. Texts repeat their words, and no piece
of such a vocabulary reaches over a word or line start, so a word is encoded once per task and looked up
afterwards; a model with pieces across words is given whole texts.

Nulls: a null text counts as empty and has no pieces. Rows are kept one to one, with null and repeated ids;
other columns are dropped. Whole texts are encoded, however long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.llm.tasks import tidy

SPACE = "▁"
#: Distinct words, and characters of them, that a task remembers before it starts afresh.
REMEMBERED, REMEMBERED_CHARS = 200_000, 8_000_000


class CharMap:
    """The compiled character map of a model: a double-array trie of source strings and their replacements."""

    def __init__(self, blob: bytes):
        self.units, self.texts = np.empty(0, np.uint32).tolist(), b""
        if blob:
            size = int.from_bytes(blob[:4], "little")
            self.units, self.texts = np.frombuffer(blob[4 : 4 + size], "<u4").tolist(), blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest source string that ``data`` has at ``at``."""
        if not self.units:
            return None
        found, units = None, self.units
        node = self._child(units[0], 0)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node = self._child(unit, node)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        return found and (found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])])

    @staticmethod
    def _child(unit: int, node: int) -> int:
        return node ^ (unit >> 10 << ((unit & 512) >> 6))


class Normalizer:
    def __init__(self, spec):
        self.map = CharMap(spec.precompiled_charsmap)
        self.dummy, self.strip, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces

    def __call__(self, text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Normalised bytes, and for each one where its source bytes begin and end."""
        data = text.encode()
        if not data:
            return b"", np.empty(0, np.int64), np.empty(0, np.int64)
        if self.map.units or self.strip or not self.escape:
            return self._walk(data)
        space = SPACE.encode()
        out = (space if self.dummy else b"") + data.replace(b" ", space)
        widths = np.where(np.frombuffer(data, np.uint8) == 32, 3, 1)
        begin = np.repeat(np.arange(len(data)), widths)
        lead = np.zeros(3 if self.dummy else 0, np.int64)
        return out, np.concatenate([lead, begin]), np.concatenate([lead, begin + 1])

    def _walk(self, data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        space = SPACE.encode() if self.escape else b" "
        out, begin, end = bytearray(), [], []

        def put(piece: bytes, a: int, b: int) -> None:
            for c in piece:
                unit = space if c == 32 else bytes([c])
                out.extend(unit)
                begin.extend([a] * len(unit))
                end.extend([b] * len(unit))

        at, after_space = 0, self.strip
        steps = []
        while at < len(data):
            width, new = self.map.longest(data, at) or self._character(data, at)
            steps.append((at, at + width, new))
            at += width
        started = False
        for a, b, new in steps:
            while after_space and new.startswith(b" "):
                new = new[1:]
            if new:
                if not started and self.dummy:
                    put(b" ", a, a)
                started = True
                put(new, a, b)
                after_space = self.strip and new.endswith(b" ")
        while self.strip and out.endswith(space):
            del out[-len(space) :], begin[-len(space) :], end[-len(space) :]
        return bytes(out), np.array(begin, np.int64), np.array(end, np.int64)

    @staticmethod
    def _character(data: bytes, at: int) -> tuple[int, bytes]:
        width = next((n for lead, n in ((0xF0, 4), (0xE0, 3), (0xC0, 2)) if data[at] >= lead), 1)
        return width, data[at : at + width]


class Codec:
    """A model's encoder and decoder inside a worker."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.normalize = Normalizer(proto.normalizer_spec)
        byte = sentencepiece_model_pb2.ModelProto.SentencePiece.BYTE
        self.widths = np.array([1 if p.type == byte else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.fallback = proto.trainer_spec.byte_fallback
        across = any(SPACE in p.piece.lstrip(SPACE) or "\n" in p.piece for p in proto.pieces)
        spec = proto.normalizer_spec
        self.by_word = spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces and not spec.precompiled_charsmap and not across and self.fallback
        self.alone = self.library.piece_to_id(SPACE)
        self.memo: dict[str, list[int]] = {}
        self.held = 0

    def _word(self, word: str) -> list[int]:
        if word == SPACE:
            ids = [self.alone]
        elif word[0] == "\n":  # after a line end no prefix: drop the one that the library adds
            ids = self.library.encode(word)[1:]
        else:
            ids = self.library.encode(word[1:].replace(SPACE, " "))
        if len(self.memo) >= REMEMBERED or self.held >= REMEMBERED_CHARS:
            self.memo.clear()
            self.held = 0
        self.memo[word] = ids
        self.held += len(word)
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if not self.by_word:
            return self.library.encode(text)
        memo, word = self.memo, self._word
        parts = re.findall(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*", SPACE + text.replace(" ", SPACE))
        return list(chain.from_iterable([memo.get(p) or word(p) for p in parts]))

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Original bytes [begin, end) of every piece; empty for models that drop unknown characters."""
        if not self.fallback or not ids:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        normalized, begin, end = self.normalize(text)
        stop = np.cumsum(self.widths[np.array(ids)])
        if stop[-1] != len(normalized):
            raise ValueError("the pieces do not tile the normalised text")
        return begin[np.concatenate([[0], stop[:-1]])], end[stop - 1]


def _encoded(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Codec(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids, begins, ends, decoded = [], [], [], []
                for text in part.column(1).to_pylist():
                    own = c.encode(text or "")
                    a, b = c.spans(text or "", own)
                    ids.append(np.array(own, np.int32))
                    begins.append(a.astype(np.int32))
                    ends.append(b.astype(np.int32))
                    decoded.append(c.library.decode(own) if own else "")
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(x, pa.list_(pa.int32())) for x in (ids, begins, ends)), pa.array(decoded, pa.string())], ["id", "ids", "begins", "ends", "decoded"]
                )

    return tidy(run)


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, begins, ends, decoded): piece ids, their spans in the UTF-8 bytes of the text, and the text decoded from the ids."""
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = picked.mapInArrow(_encoded(model), "id long, ids array<int>, begins array<int>, ends array<int>, decoded string")
    return out.withColumnRenamed("id", "doc_id")


def read_model(path: str) -> bytes:
    """A model file of the driver; tasks get its bytes."""
    with open(path, "rb") as f:
        return f.read()


def digests(encoded: DataFrame) -> DataFrame:
    """Counts and digests of ids and decoded text, and the bytes that the spans cover."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.coalesce(F.get("ends", F.size("ends") - 1), F.lit(0)).cast("long").alias("n_bytes"),
    )
