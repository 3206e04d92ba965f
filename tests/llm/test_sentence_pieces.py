import random
import zlib

import numpy as np
import sentencepiece as spm

from concordia.llm import sentence_pieces as sp
from concordia.llm.common import tokenizer_path
from tests.llm.corpus import SMALL, edge_documents, small

PATH = tokenizer_path("piece_bpe_32k.model")
LIB = spm.SentencePieceProcessor(model_file=PATH)


def mixed(n=1500):
    rng = random.Random(2)
    parts = ["a", "b1", " ", "  ", "\n", "\t", ".", "'s", "é", "<s>", "<0x0A>", " ", "9", "漢", "ﬁ", "▁", "🎉", "the", "tion"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(n)] + [" " * 3000, "x" * 2000, "日本語" * 50, ""]


def test_merges_equal_the_library():
    texts = mixed()
    for t, x in zip(texts, sp.encode_texts(PATH, texts)):
        assert list(x) == LIB.encode(t), t
        assert sp.loaded(PATH)[0].decode(x) == LIB.decode(list(x))


def test_unigram_models_equal_the_library(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *((p, s, 1) for p, s in [("▁", -3.0), ("a", -2.0), ("b", -2.5), ("▁a", -2.2), ("ab", -2.6), ("aba", -4.1), ("ba", -3.3), ("▁ab", -5.0), ("c", -6.0)])]:
        m.pieces.add(piece=piece, score=score, type=kind)
    m.trainer_spec.model_type = 1
    m.normalizer_spec.name = "identity"
    m.normalizer_spec.remove_extra_whitespaces = False
    path = str(tmp_path / "hand.model")
    with open(path, "wb") as f:
        f.write(m.SerializeToString())
    lib = spm.SentencePieceProcessor(model_file=path)
    rng = random.Random(3)
    texts = ["".join(rng.choice("aab bc") for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    model = sp.Pieces(path)
    got = model.segment([sp.MARK + t.replace(" ", sp.MARK) for t in texts])
    score = lambda x: sum(model.scores[i] for i in x)
    for t, x in zip(texts, got):
        assert abs(score(x) - score(lib.encode(t))) < 1e-5 and lib.decode(list(x)) == t


def test_query(spark):
    text = {r.doc_id: r.text for r in small(spark).collect()}
    for r in sp.op9_sentence_pieces(spark, SMALL).collect():
        x = LIB.encode(text[r.doc_id])
        assert (r.n_pieces, r.ids_crc32) == (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) and r.round_trip
    df = edge_documents(spark)
    out = sp.decode_documents(sp.encode_documents(df, PATH), PATH)
    assert out.count() == df.count() and sp.encode_documents(df.limit(0), PATH).count() == 0
