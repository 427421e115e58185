import random

import public_tokenizers
import pytest
import sentencepiece

from qacorpus.llm import sentencepiece_codec as S

MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
PARTS = ["a", "b", "the", " ", "  ", "abab", "\n", "é", "ﬁ", "▁", "日", "\x00", "🙂", "er", "in", "aaaa", "'s", "1", "=", " tion", " " * 15, "́"]


@pytest.fixture(scope="module")
def both():
    return S.Codec(MODEL), sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def test_encodes_and_decodes_as_the_library(both):
    codec, sp = both
    rnd = random.Random(1)
    for _ in range(1500):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 40)))
        ids = sp.encode(text)
        assert codec.encode(text) == ids
        assert codec.decode(ids) == sp.decode(ids)


def test_decodes_any_ids_as_the_library(both):
    codec, sp = both
    rnd = random.Random(2)
    for _ in range(1500):
        ids = [rnd.choice([0, 1, 2, rnd.randint(3, 258), rnd.randint(3, 258), rnd.randint(259, 31999)]) for _ in range(rnd.randint(0, 12))]
        assert codec.decode(ids) == sp.decode(ids)


def test_word_of_many_merges(both):
    codec, sp = both
    for text in ("x" * 5000, "ab" * 3000, " " * 700 + "a", "日本" * 900):
        assert codec.encode(text) == sp.encode(text)


def test_digests_nulls_empty_and_long(spark):
    import hashlib

    texts = [None, "", " ", "the " * 20000, "a\nb", "a\nb"]
    df = spark.createDataFrame([(i % 5, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids_sha256 string").repartition(2)
    sp = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    want = []
    for i, t in enumerate(texts):
        ids = sp.encode(t or "")
        want.append((i % 5, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert sorted(tuple(r) for r in S.digests(df, MODEL).collect()) == sorted(want)
    assert S.digests(df.filter("false"), MODEL).count() == 0


def test_columns(spark):
    df = spark.createDataFrame([(1, "Thé  end"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.decoded for r in S.decode(S.encode(df, MODEL), MODEL).collect()}
    assert got == {1: "Thé  end", 2: ""}
