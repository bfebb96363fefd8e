import random
from itertools import pairwise

import pytest
from sentencepiece import SentencePieceProcessor
from sentencepiece import sentencepiece_model_pb2 as pb

from alertflow.llm import sentencepiece_scan as S

BLOB = open(S.MODEL_PATH, "rb").read()


def chunks(pieces, text, size):
    norm = pieces.normalised(text)
    cuts, m = [*range(0, len(norm), size), len(norm)], 2 * pieces.longest
    return [S.Chunk(pieces, norm[max(0, a - m):a], norm[a:b], norm[b:b + m], a - m <= 0, b == len(norm)) for a, b in pairwise(cuts)]


def scan(pieces, text, size):
    parts = chunks(pieces, text, size)
    states = S.states_at_cuts([c.matrix() for c in parts])
    return [i for c, (left, right) in zip(parts, states, strict=True) for i in c.trace(left, right)]


def samples(n):
    rng = random.Random(1)
    letters = "abcdefghie tion   \n.,'é漢字▁_=-/*0123☃"
    for k in range(n):
        if k % 3:
            text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 200)))
        else:
            text = "".join(rng.choice(["the", "ing", "ation", "a", "b", "____", "==", "--", "http", "://", "    "])
                           for _ in range(rng.randint(1, 60)))
        yield text.replace(" ", "") if k % 5 == 0 else text


def test_split_anywhere_equals_the_library():
    pieces, library = S.Pieces(BLOB), SentencePieceProcessor(model_proto=BLOB)
    for text in samples(150):
        for size in (5, 17, 64):
            assert scan(pieces, text, size) == library.encode(text)
        assert pieces.decode(library.encode(text)) == text.replace(S.MARK, " ")


def test_product_is_associative():
    pieces = S.Pieces(BLOB)
    a, b, c, *_ = (x.matrix() for x in chunks(pieces, "internationalisation" * 8, 23))
    assert S.combine(S.combine(a, b), c) == S.combine(a, S.combine(b, c))


def test_unigram_split_anywhere_keeps_the_best_weight():
    proto = pb.ModelProto()
    proto.ParseFromString(BLOB)
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:  # scores without ties
        if p.type == 1:
            p.score = -1.0 - (hash(p.piece.encode()) % 100_003) / 9_973 - 2 / len(p.piece)
    blob = proto.SerializeToString()
    pieces = S.Pieces(blob)
    for text in ["internationalisation" * 5, "the quick brown fox", "aaaaabbbbbab" * 6]:
        norm = pieces.normalised(text)
        best = [0.0] + [float("-inf")] * len(norm)
        for i in range(len(norm)):
            for piece in pieces.starting(norm, i):
                best[i + len(piece)] = max(best[i + len(piece)], best[i] + pieces.link("", piece))
        ids = scan(pieces, text, 13)
        assert pieces.decode(ids) == text
        weight = sum(proto.pieces[i].score for i in ids)
        assert weight == pytest.approx(best[-1], rel=1e-5)


def test_refuses_other_normalisations():
    proto = pb.ModelProto()
    proto.ParseFromString(BLOB)
    proto.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        S.Pieces(proto.SerializeToString())


def test_documents_equal_the_library(spark):
    library = SentencePieceProcessor(model_proto=BLOB)
    rng = random.Random(6)
    long = "".join(rng.choice(["the ", "quick", "brown ", "\n", "  ", "naïve", "☃"]) for _ in range(9000))
    texts = [None, "", " ", "a", "a b▁c", "\x00", long, "x" * 700, "ab" * 400 + " end", long[:500], "tie", "tie"]
    rows = [(i if t != "tie" else 77, t, "clash") for i, t in enumerate(texts)] + [(None, "no id", "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = S.decode(S.add_tokens(df, chunk=300))
    assert got.columns == ["doc_id", "text", "row", "token_ids", "decoded"]
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.token_ids == library.encode(r.text or "") and r.row == "clash"
        assert r.decoded == (r.text or "").replace(S.MARK, " ")
    assert S.encode(spark.createDataFrame([], df.schema)).collect() == []
