import random

import pytest

from paddock.llm import token_counts as T

tokenizers = pytest.importorskip("public_tokenizers")
SIGNS = ["a", "the", " ", "  ", "   ", "\n", "\r", "\t", "▁", "<s>", "</s>", "<unk>", "<0x0A>", "é", "中文", "\0", "{", "}", "0", "123", "ing", ";", "\r\n", " ", "😀", "Straße", "THE!!"]


@pytest.fixture(scope="module")
def model():
    return tokenizers.path("piece_bpe_32k.model")


def test_equals_the_library(spark, model, sf_small):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model)
    rng = random.Random(5)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(0, 15))) for _ in range(3000)]
    texts += [None, "", " ", "\n", "\n\n", "a" * 50_000, "word and " * 60_000]
    rows = list(enumerate(texts)) + [(None, "a b"), (1, texts[1])]
    docs = spark.createDataFrame([(d, t, -1) for d, t in rows], "doc_id long, text string, n_tokens long").repartition(4)
    got = sorted((tuple(r) for r in T.token_counts(docs, model).collect()), key=str)
    count = lambda t: len(library.encode(t)) if t else 0
    want = [(d, len((t or "").encode()), count(t), count(t) > 4096) for d, t in rows]
    assert got == sorted(want, key=str)
    real = spark.read.parquet(f"{sf_small}/documents.parquet")
    want = {r["doc_id"]: count(r["text"]) for r in real.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in T.token_counts(real, model).collect()} == want
    assert T.token_counts(docs.where("false"), model).collect() == []


def test_the_table_stays_bounded(model, monkeypatch):
    with open(model, "rb") as f:
        counter = T.PieceCounter(f.read())
    monkeypatch.setattr(T, "KEPT_BYTES", 5000)
    rng = random.Random(6)
    for _ in range(500):
        text = " ".join("".join(rng.choice("abcxyz") for _ in range(9)) for _ in range(10))
        assert counter.count(text) == len(counter.library.encode(text))
    assert len(counter.known) < len(counter.whole) + 130 and max(map(len, counter.known)) <= T.KEPT_LENGTH


def test_whole_tokens_are_one_token(model):
    with open(model, "rb") as f:
        counter = T.PieceCounter(f.read())
    assert len(counter.whole) > 30_000
    spaced = [p for p in counter.whole if p[0] == "▁"]
    assert all(len(counter.library.encode(p[1:])) == 1 for p in spaced[::50])


def test_refuses_a_vocabulary_without_the_property(model):
    with open(model, "rb") as f:
        counter = T.PieceCounter(f.read())

    library = counter.library

    class Crossing:
        def __getattr__(self, name):
            return getattr(library, name)

        def id_to_piece(self, i):
            return "a▁b" if i == 500 else library.id_to_piece(i)

    counter.library = Crossing()
    with pytest.raises(ValueError, match="cross"):
        counter.prove()
