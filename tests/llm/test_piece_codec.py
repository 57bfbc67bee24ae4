"""SentencePiece encoding and decoding (13) against the library, on random texts and on the edge cases."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tallyspark.llm import piece_codec

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts(rng, library, n):
    pieces = [library.id_to_piece(rng.randrange(3, 32000)).replace("▁", " ") for _ in range(4000)]
    kinds = (
        lambda: "".join(rng.choice(pieces) for _ in range(rng.randrange(30))),
        lambda: "".join(rng.choice("aabbttheionsr ") for _ in range(rng.randrange(60))),
        lambda: "".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(0x4E00, 0x5000), rng.randrange(0x1F300, 0x1F700), 0x2581, 32, 32, 10])) for _ in range(rng.randrange(60))),
        lambda: "".join(rng.choice(["The", "legal", "Foundation", "statement", "Sept", "anni", " ", "th", "e", "T", "h"]) for _ in range(rng.randrange(40))),
    )
    fixed = ["", " ", "  ", "\n", "▁", "<s>", "</s> a", "<unk>", "<0x0A>", "\x00a", " a ", "x" * 5000, "ab" * 3000, "The" * 2000, "1" * 999]
    return fixed + [rng.choice(kinds)() for _ in range(n)]


@pytest.mark.parametrize("symbols", [64, piece_codec.SYMBOLS])
def test_encoding_equals_the_library(library, monkeypatch, symbols):
    monkeypatch.setattr(piece_codec, "SYMBOLS", symbols)  # small: the flat array is cut many times
    data = texts(random.Random(symbols), library, 2000)
    pieces = piece_codec.codec(PATH)
    ids, n = pieces.encode(data)
    ends = np.cumsum(n)
    for text, a, b in zip(data, ends - n, ends, strict=True):
        assert ids[a:b].tolist() == library.encode(text)
        assert pieces.decode(ids[a:b]) == library.decode(ids[a:b].tolist())


def test_decoding_of_any_ids_equals_the_library(library):
    rng, pieces = random.Random(5), piece_codec.codec(PATH)
    for _ in range(5000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), 0, 1, 2, 29871]) for _ in range(rng.randrange(12))]
        assert pieces.decode(np.array(ids, np.int64)) == library.decode(ids)
    with pytest.raises(ValueError, match="outside"):
        pieces.decode(np.array([32000]))


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    for change in ("removes", "unigram", "over a blank"):
        other = sentencepiece_model_pb2.ModelProto()
        other.CopyFrom(model)
        if change == "removes":
            other.normalizer_spec.remove_extra_whitespaces = True
        elif change == "unigram":
            other.trainer_spec.model_type = 1
        else:
            other.pieces[300].piece = "a▁b"
        (tmp_path / "m").write_bytes(other.SerializeToString())
        with pytest.raises(ValueError, match="piece|BPE"):
            piece_codec.PieceCodec(str(tmp_path / "m"))


def test_rows_on_spark(spark, library, tmp_path):
    data = [(i, t, "ids2", i) for i, t in enumerate(texts(random.Random(9), library, 300))]
    data += [(None, None, None, None), (5, None, "x", 5), data[20], data[20]]
    docs = spark.createDataFrame(data, "doc_id long, text string, `Made` string, c0 int").repartition(3)
    rows = piece_codec.decoded(piece_codec.encoded(docs, PATH), PATH).collect()
    want = sorted((i, library.encode(t or ""), library.decode(library.encode(t or "")), m, c) for i, t, m, c in data if i is not None)
    assert sorted((r.doc_id, r.ids, r.decoded, r.Made, r.c0) for r in rows if r.doc_id is not None) == want
    assert [(r.ids, r.decoded) for r in rows if r.doc_id is None] == [([], "")]
    assert piece_codec.decoded(piece_codec.encoded(docs.limit(0), PATH), PATH).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [library.piece_to_id("▁")])], "doc_id long, ids array<int>")
    assert sorted((r.doc_id, r.decoded) for r in piece_codec.decoded(nulls, PATH).collect()) == [(1, ""), (2, "")]
    with pytest.raises(ValueError, match="a column already"):
        piece_codec.encoded(docs.withColumnRenamed("Made", "IDS"), PATH)

    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    out = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piece_codec.op13_sentencepiece(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert out == {(i, len(e), sha(",".join(map(str, e))), sha(library.decode(e))) for i, t, *_ in data for e in [library.encode(t or "")]}
