from __future__ import annotations

import os

import pytest

spm = pytest.importorskip("sentencepiece")

from tessel.llm import queries, sentencepieces  # noqa: E402

FILE = queries.VOCABULARY
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="no vocabulary file")
TEXTS = ["", " ", "Hello  world\n\tfoo", "  a   b", "▁x", "你好 😀\x00 z", "a" * 300, "   ", "\t\tif (x) {\n        return;\n            }", "The quick brown fox jumps over 12345 things’ “quoted” naïve façade", "  ", "ᚠᛇᚻ runes"]


@pytest.fixture(scope="module")
def model():
    return sentencepieces.load(FILE)


def split(encoder, texts):
    upto, ids = encoder.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(upto[:-1], upto[1:], strict=True)]


def test_ids_equal_the_library(model, spark, folder):
    lib = spm.SentencePieceProcessor(model_file=FILE)
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()]
    encoder = sentencepieces.Encoder(model)
    for k in range(0, len(texts), 200):
        for t, ids in zip(texts[k : k + 200], split(encoder, texts[k : k + 200]), strict=True):
            assert ids == lib.encode(t), t[:80]
            assert sentencepieces.decode_ids(model, ids) == lib.decode(ids)


def test_forgetting_words_changes_nothing(model, monkeypatch):
    monkeypatch.setattr(sentencepieces, "CACHE_WORDS", 3)
    encoder = sentencepieces.Encoder(model)
    assert [split(encoder, TEXTS) for _ in range(3)] == [split(sentencepieces.Encoder(model), TEXTS)] * 3


def test_unigram_scores_equal_the_library(prose):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(FILE, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    lib = spm.SentencePieceProcessor(model_proto=proto.SerializeToString())
    model = sentencepieces.load(FILE, "unigram")
    encoder = sentencepieces.Encoder(model)
    words = sorted({w for k in range(20) for w in prose(k, 30).split()})
    for w, ids in zip(words, split(encoder, words), strict=True):
        # several paths can share the best score
        assert sum(model.score[ids]) == sum(model.score[lib.encode(w)])
    for t in (prose(k, 30) for k in range(20)):
        (ids,) = split(encoder, [t])
        assert sum(model.score[ids]) >= sum(model.score[lib.encode(t)])
        assert sentencepieces.decode_ids(model, ids) == t


def test_query_round_trip(spark, folder, model):
    rows = queries.op6_sentencepieces(spark, folder).collect()
    assert len(rows) == 1000 and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)


def test_decode_gives_the_texts(spark, model):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS) if "▁" not in t], "doc_id bigint, text string")
    encoded = sentencepieces.encode(df, model).withColumnRenamed("__id", "doc_id")
    got = {r["__id"]: r.text for r in sentencepieces.decode(encoded, model).collect()}
    assert got == {r.doc_id: r.text for r in df.collect()}


def test_odd_rows(odd_documents, no_documents, model):
    rows = sentencepieces.encode(odd_documents, model).collect()
    assert len(rows) == odd_documents.count() and all(r.round_trip for r in rows)
    assert sentencepieces.encode(no_documents, model).collect() == []


def test_long_runs_and_long_words(model):
    import random
    import time

    rng = random.Random(5)
    lib = spm.SentencePieceProcessor(model_file=FILE)
    chars = "abcdefghijklmnopqrstuvwxyzABCDEFG0123+/"
    texts = [" " * n for n in (5, 63, 64, 65, 1000, 4097)] + ["x" * 5000, "ab" * 3000, "".join(rng.choice(chars) for _ in range(9000)), "a" + " " * 777 + "b", "".join(rng.choice("thereinon") for _ in range(300)), "".join(rng.choice("aetino") for _ in range(6000))]
    assert split(sentencepieces.Encoder(model), texts) == [lib.encode(t) for t in texts]
    began = time.time()
    for text in (" " * 100_000, "x" * 200_000, "".join(rng.choice(chars) for _ in range(500_000))):
        (ids,) = split(sentencepieces.Encoder(model), [text])
        assert sentencepieces.decode_ids(model, ids) == text
    assert time.time() - began < 60
