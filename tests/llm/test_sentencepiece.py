import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

import evalloom.llm.packing as packing
from evalloom.llm import sentencepiece as S
from evalloom.llm.common import flat

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  a   b\n\n  c ", "日本語 ½ ﬁ", "    ", "a    \n    b", " " * 50 + "x" + " " * 37, "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "The quick brown fox's 12,345.67!?", "\t\r\n x", "😀é ü"]


def ids_of(encoder, texts):
    ids, counts, _, _ = encoder.encode_rows(*flat(pa.array(texts)))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    return [ids[a:z].tolist() for a, z in zip(bounds[:-1], bounds[1:], strict=True)]


@pytest.mark.parametrize("remembered", [50, 1_000_000])
def test_ids_of_the_library(sample, remembered, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", remembered)
    texts = TEXTS + [r.text for r in sample.limit(80).collect()]
    library, encoder = sentencepiece.SentencePieceProcessor(model_file=PATH), S.PieceEncoder(PATH)
    for at in range(0, len(texts), 9):
        assert ids_of(encoder, texts[at : at + 9]) == library.encode(texts[at : at + 9])


def test_unigram_model(tmp_path):
    """A model made by hand: pieces with scores, no training."""
    model = pb.ModelProto()
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), ("▁", -4.1, 1), ("▁the", -1.3, 1), ("▁th", -2.7, 1), ("e", -3.2, 1), ("r", -3.3, 1), ("er", -2.9, 1), ("ere", -4.55, 1), ("t", -3.9, 1), ("h", -4.3, 1), ("he", -3.05, 1), ("re", -3.15, 1), ("a", -2.45, 1)]:
        p = model.pieces.add()
        p.piece, p.score, p.type = piece, score, kind
    model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    model.normalizer_spec.name, model.normalizer_spec.remove_extra_whitespaces = "identity", False
    path = str(tmp_path / "u.model")
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    texts = ["there the there", "three hears", "rather tea", "xthere", "  the"]
    assert ids_of(S.PieceEncoder(path), texts) == sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)


def test_operator(odd, none):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = {(r.doc_id, r.text or "") for r in odd.collect()}
    got = S.encoded(odd, PATH)
    assert {(r.doc_id, tuple(r.ids)) for r in got.collect()} == {(i, tuple(library.encode(t))) for i, t in rows}
    assert {(r.doc_id, r.text) for r in S.decoded(got, PATH).collect()} == rows
    digests = S.digested(odd, PATH).collect()
    assert len(digests) == odd.count() and all(r.round_trip for r in digests)
    assert S.encoded(none, PATH).collect() == [] and S.digested(none, PATH).collect() == []


def test_marks_in_texts(spark):
    rows = spark.createDataFrame([(1, "a▁b"), (2, "a b")], "doc_id long, text string")
    got = {r.doc_id: r for r in S.digested(rows, PATH).collect()}
    assert got[1].ids_sha256 == got[2].ids_sha256 and not got[1].round_trip and got[2].round_trip


def test_words_of_equal_polynomial_hashes():
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = ["".join((a, b)[k.bit_count() % 2] for k in range(n)) for n in (1024, 2048) for a, b in ("ab", "ba")]
    ids, counts, *_ = S.encoder_at(PATH).encode_rows(*flat(pa.array(texts)))
    want = library.encode(texts, num_threads=1)
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]
