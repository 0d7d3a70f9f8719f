import os
import random

import pytest

from massloom.llm import op04_pieces as o

needs_model = pytest.mark.skipif(not os.path.exists(o.MODEL), reason="no vocabulary file")
TEXTS = ["", " ", "a", " a", "  two  spaces ", "line\nline\n\n", "tab\tand\r\n", "naïve façade, größer", "漢字かな交じり文", "emoji 👩‍👩‍👧 \U0001f600", "▁marker ▁ in text▁", "\0nul", "x" * 3000, "the cat sat on the mat. " * 50, "﻿bom"]


def as_unigram(data: bytes) -> bytes:
    """The model file with its type set to unigram, for the library to segment by score."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(data)
    m.trainer_spec.model_type = 1
    for piece, (_, score, _) in zip(m.pieces, o.read_pieces(data), strict=True):
        piece.score = score
    return m.SerializeToString()


@needs_model
def test_same_ids_as_the_library():
    import sentencepiece

    data = open(o.MODEL, "rb").read()
    try:
        lib = sentencepiece.SentencePieceProcessor(model_proto=as_unigram(data))
    except ImportError:
        pytest.skip("no protocol buffer classes")
    ours, rng, same = o.Pieces(o.read_pieces(data)), random.Random(4), 0
    more = ["".join(rng.choice("theriondé ßñ \n.,!x漢") for _ in range(rng.randrange(1, 200))) for _ in range(300)]
    for text in [t for t in TEXTS if o.MARK not in t and "\0" not in t] + more:
        own, other = ours.encode(text).tolist(), lib.encode(text)
        total = lambda ids: sum(ours.scores[i] for i in ids)
        assert own == other or abs(total(own) - total(other)) <= 1e-6 * abs(total(own)), text[:80]  # ties may differ
        same += own == other
    assert same >= 0.97 * (len(TEXTS) + len(more) - 2)


@needs_model
def test_round_trip():
    ours, rng = o.Pieces(o.read_pieces(open(o.MODEL, "rb").read())), random.Random(5)
    more = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x3000), 0x2581, 10, 32])) for _ in range(80)) for _ in range(200)]
    for text in TEXTS + more:
        assert ours.decode(ours.encode(text)) == text


def test_viterbi_against_every_segmentation():
    rng = random.Random(6)
    words = ["a", "b", "c", "ab", "bc", "abc", "ca", "bb", o.MARK, o.MARK + "a", o.MARK + "ab"]
    pieces = [("<unk>", 0.0, o.UNKNOWN)] + [(w, -rng.random() * 9, o.NORMAL) for w in words] + [(f"<0x{b:02X}>", 0.0, o.BYTE) for b in range(256)]
    ours = o.Pieces(pieces)
    score = {w: s for w, s, k in pieces if k == o.NORMAL}

    def best(s):
        table = [0.0] + [-1e9] * len(s)
        for j in range(1, len(s) + 1):
            for i in range(j):
                w = score.get(s[i:j], ours.low if j == i + 1 else None)
                if w is not None:
                    table[j] = max(table[j], table[i] + w)
        return table[-1]

    for _ in range(300):
        text = "".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 14)))
        got = 0.0
        for i in ours.encode(text).tolist():
            got += score.get(pieces[i][0], ours.low)
        assert abs(got - best(o.MARK + text.replace(" ", o.MARK))) < 1e-9


def test_table_with_nulls_and_clashing_columns(spark):
    pieces = o.Pieces([("<unk>", 0.0, o.UNKNOWN), ("a", -1.0, o.NORMAL), (o.MARK, -2.0, o.NORMAL)] + [(f"<0x{b:02X}>", 0.0, o.BYTE) for b in range(256)])
    rows = [(1, "a a", "x", 5), (1, "a a", "x", 5), (None, "é", None, None), (2, None, None, None), (3, "", "y", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, exact int")
    got = sorted(map(tuple, o.encode_documents(df, pieces).collect()), key=repr)
    assert got == sorted([(1, [2, 1, 2, 1], True), (1, [2, 1, 2, 1], True), (None, [2, 3 + 0xC3, 3 + 0xA9], True), (2, None, False), (3, [], True)], key=repr)
    back = o.decode_documents(o.encode_documents(df, pieces), pieces).collect()
    assert sorted(map(repr, [(r.doc_id, r.text) for r in back])) == sorted(map(repr, [(d, t) for d, t, *_ in rows]))
    assert o.encode_documents(df.limit(0), pieces).count() == 0
