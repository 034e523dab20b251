import itertools

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import sentencepiece_fst as fst
from llm_docs import docs_of  # noqa: F401

PATH = "/opt/tokenizers/piece_bpe_32k.model"
MODEL = fst.compile_model(PATH)
ENCODER = fst.Encoder(MODEL)
PUBLIC = sentencepiece.SentencePieceProcessor(model_file=PATH)

ODD = ["", " ", "  a", "a  b ", "a\nb\t\x00", "Ａｂｃ ﬁ é", "日本語😀", "<s> </s> <unk>", "x y", "12345", "a" * 999, "▁▁", "\r\n  \r\n", "é" * 50, "’“”…—", "Привет, мир", "ab" * 300,
       "&&& %%% $$$", "https://a.b/c?d=e&f=g", "​‍", "ﷺ"]


@pytest.mark.parametrize("text", ODD)
def test_equals_the_public_encoder(text):
    assert ENCODER.encode(text) == PUBLIC.encode(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("abeinrst  .,'\n")), max_size=60))
def test_equals_and_round_trip(text):
    ids = ENCODER.encode(text)
    assert ids == PUBLIC.encode(text)
    assert fst.decode_ids(MODEL, ids) == text.replace("▁", " ")


def test_documents(spark, docs_of):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    docs = docs_of([(r.doc_id, r.text) for r in rows] + [(None, "null id"), (1, None), (1, ""), (2, "word " * 60_000)] * 2)
    out = fst.encode(docs, MODEL, decoded=True)
    texts = [r.text or "" for r in docs.collect()]
    got = out.collect()
    assert [list(r.ids) for r in got] == [PUBLIC.encode(t) for t in texts]
    assert [r.decoded for r in got] == texts
    assert [r.text for r in fst.decode(out, MODEL).collect()] == texts
    assert fst.encode(docs.where("false"), MODEL).count() == 0


def model_bytes(pieces, kind, fallback=True, prefix=True):
    """A small model file: <unk>, the bytes, and the given (piece, score) pairs."""
    import struct

    def field(number, wire, value):
        return bytes([number << 3 | wire]) + (bytes([len(value)]) + value if wire == 2 else value)

    def piece(text, score, t):
        return field(1, 2, field(1, 2, text.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([t])))

    out = piece("<unk>", 0.0, fst.UNKNOWN) + b"".join(piece(f"<0x{i:02X}>", 0.0, fst.BYTE) for i in range(256) if fallback)
    out += b"".join(piece(p, s, fst.NORMAL) for p, s in pieces)
    trainer = field(3, 0, bytes([kind])) + bytes([35 << 3 & 0x7F | 0x80, 35 >> 4, int(fallback)])
    return out + field(2, 2, trainer) + field(3, 2, field(3, 0, bytes([int(prefix)])) + field(4, 0, b"\0"))


def test_unigram_takes_the_least_weight():
    pieces = [("▁a", -1.0), ("b", -2.0), ("ab", -2.5), ("▁ab", -4.0), ("ba", -1.5), ("a", -3.0), ("▁", -2.0), ("bab", -3.2)]
    model = fst.Compiled(model_bytes(pieces, fst.UNIGRAM))
    weight = dict(pieces)

    def least(text):
        best = None
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            parts, at = [], 0
            for i, c in enumerate((*cuts, 1), 1):
                if c:
                    parts.append(text[at:i])
                    at = i
            if all(p in weight for p in parts):
                cost = -sum(weight[p] for p in parts)
                best = cost if best is None else min(best, cost)
        return best

    for n in range(1, 8):
        for letters in itertools.product("ab", repeat=n):
            ids = fst.Encoder(model).encode("".join(letters))
            assert abs(fst.path_weight(model, ids) - least("▁" + "".join(letters))) < 1e-5


def test_bpe_by_greedy_merging():
    pieces = [(c, -100.0) for c in "▁abc"] + [(p, -float(i)) for i, p in enumerate(["ab", "bc", "aa", "abc", "▁a", "ca", "aab", "bcab", "aaaa", "▁abc"], 1)]
    model = fst.Compiled(model_bytes(pieces, fst.BPE))
    rank = {p: s for p, s in pieces if len(p) > 1}
    for n in range(1, 8):
        for letters in itertools.product("abc", repeat=n):
            symbols = list("▁" + "".join(letters))
            while True:
                pairs = [(-rank[a + b], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in rank]
                if not pairs:
                    break
                k = min(pairs)[1]
                symbols[k:k + 2] = [symbols[k] + symbols[k + 1]]
            assert [model.strings[i] for i in fst.Encoder(model).encode("".join(letters))] == symbols


def test_unsupported_models_are_refused():
    with pytest.raises(ValueError):
        fst.Compiled(model_bytes([("a", 0.0)], 3))
