import random

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from leadmill.llm import pieces

MODEL = pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
TEXTS = ["", " ", "a", "a ", "  a  b ", "\n\n x\n", "▁a▁ b", "x▁\n ▁y", "日本語 テスト 🎉🎉", "\t\ttab\r\nz", "é́ ñ", "a\n", "\n", " \n ", "<s> </s> <unk> [INST]", "word " * 9000, "x" * 20_000, "\x00   ", "ａｂｃ ﬁ"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def test_equals_the_library(spark, library):
    df = spark.createDataFrame([(i, t, "ids") for i, t in enumerate(TEXTS)] + [(100, None, None), (None, "a b", None), (1, "again", None)], "doc_id long, text string, ids string")
    rows = pieces.encode(df, MODEL).collect()
    assert len(rows) == len(TEXTS) + 3
    for r in rows:
        if r.doc_id is not None and r.doc_id < len(TEXTS) and not (r.doc_id == 1 and r.decoded == "again"):
            text = TEXTS[r.doc_id]
            assert r.ids == library.encode(text) and r.decoded == (library.decode(r.ids) if r.ids else "")
            data = text.encode()
            assert not r.ids or (r.begins[0] == 0 and r.ends[-1] == len(data))
            surfaces = [data[a:b].decode("utf-8", "replace") for a, b in zip(r.begins, r.ends)]
            for piece, surface in zip(library.id_to_piece(r.ids), surfaces):
                if not piece.startswith("<0x"):
                    assert piece.replace("▁", " ").strip() == surface.replace("▁", " ").strip()
    assert {r.doc_id: r.ids for r in rows}[100] == []


def test_empty(spark):
    assert pieces.encode(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0


def charmap(pairs):
    """A double array for one-byte-branching sources, built by hand, and the replacements."""
    texts, where = b"", {}
    for source, new in pairs.items():
        where[source] = len(texts)
        texts += new + b"\0"
    size = 1 << 16
    units = [0] * size
    states, bases = {b"": 0}, set()  # every state needs a base of its own, or it has another one's children
    prefixes = sorted({s[:i] for s in pairs for i in range(len(s) + 1)}, key=len)

    def children(p):
        return sorted({s[len(p)] for s in pairs if len(s) > len(p) and s.startswith(p)})

    used = {0}
    for p in prefixes:
        node, labels = states[p], children(p) + ([0] if p in pairs else [])
        base = 1
        while base in bases or any((base ^ c) in used for c in labels) or base ^ node >= 1 << 21:
            base += 1
        bases.add(base)
        units[node] |= (base ^ node) << 10 | (1 << 8 if p in pairs else 0)
        for c in labels:
            used.add(base ^ c)
            if c:
                units[base ^ c] = c
                states[p + bytes([c])] = base ^ c
            else:
                units[base] = 1 << 31 | where[p]
    blob = b"".join(u.to_bytes(4, "little") for u in units)
    return len(blob).to_bytes(4, "little") + blob + texts


class Spec:
    add_dummy_prefix = True
    escape_whitespaces = True
    remove_extra_whitespaces = True

    def __init__(self, pairs):
        self.precompiled_charsmap = charmap(pairs)


def test_longest_prefix_wins_and_keeps_offsets():
    n = pieces.Normalizer(Spec({b"a": b"x", b"ab": b"YZ", "é".encode(): b"e", b"\t": b" "}))
    out, begin, end = n("  abaé\t c ")
    assert out.decode() == "▁YZxe▁c"
    spans = [(b, e) for b, e in zip(begin.tolist(), end.tolist())]
    assert spans[3:5] == [(2, 4), (2, 4)]  # both letters come from "ab"
    assert spans[5] == (4, 5) and spans[6] == (5, 7)


def test_walk_equals_the_library_on_its_own_map():
    """The library's built-in NFKC map: texts and offsets, over all its sources and random mixtures."""
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    assert len(proto.normalizer_spec.precompiled_charsmap) > 100_000
    own = pieces.Normalizer(proto.normalizer_spec)
    rng = random.Random(2)
    sources = [chr(c) for c in range(1, 0x30000, 7) if not 0xD800 <= c < 0xE000] + ["ﬁ", "①", "ｱﾞ", "が", "e\u0301", "각", "  ", "\u3000", "\u00a0", "①②"]
    texts = [*sources, *("".join(rng.choice(sources) for _ in range(rng.randint(1, 30))) for _ in range(500))]
    for text in texts:
        normal, offsets = library.normalize(text, with_offsets=True)
        out, begin, _ = own(text)
        assert out.decode() == normal, text
        # the library's offsets are of characters: where the source of each normalised character begins
        starts = [k for k, b in enumerate(out) if b & 0xC0 != 0x80]
        assert [len(text.encode()[: begin[k]].decode()) for k in starts] == list(offsets[: len(starts)]), text


def test_memory_is_bounded_by_characters(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED_CHARS", 5000)
    codec = pieces.Codec(MODEL)
    for i in range(100):
        codec.encode(f"{i:04}" + "x" * 400)
    assert codec.held <= 5500 and len(codec.memo) <= 14


def test_identity_walk_equals_fast_path():
    class Plain(Spec):
        remove_extra_whitespaces = False

        def __init__(self):
            self.precompiled_charsmap = b""

    fast = pieces.Normalizer(Plain())
    for text in ("a b", "  é 日", "\n x "):
        a, b = fast(text), fast._walk(text.encode())
        assert a[0] == b[0]
