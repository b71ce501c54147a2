"""Encoding and decoding against the library, and the facts that the prefix table rests on."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from paddock.llm import piece_codec as C
from paddock.llm.queries import op12_pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def codec():
    return C.Codec(C.read_vocabulary(MODEL)[1])


def merged(vocabulary, text):
    """Plain merging: the best adjacent pair, the leftmost of equals, until none is left."""
    index = vocabulary.ids()
    symbols = list(C._MARK + text.replace(" ", C._MARK)) if text else []
    while True:
        pairs = [(vocabulary.scores[index[a + b]], -k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in index]
        if not pairs:
            break
        k = -max(pairs)[1]
        symbols[k:k + 2] = [symbols[k] + symbols[k + 1]]
    return [i for s in symbols for i in ([index[s]] if s in index else [vocabulary.byte[b] for b in s.encode()])]


def random_texts(seed, n, length):
    r = random.Random(seed)
    some = [" ", "  ", "\n", "a", "e", "in", "the", "é", "▁", "日本", "\U0001f44d", "\0", "\t", "ing", "�", "ﬁ", "1", "====", "----", "\r", "​", "<s>", "</s>", "<unk>", "<0x41>"]
    return ["".join(r.choice(some) for _ in range(r.randint(0, length))) for _ in range(n)]


def test_library_and_plain_merging(codec, library):
    for text in random_texts(1, 400, 25):
        ids = codec.encode(text).tolist()
        assert ids == library.encode(text) == merged(codec.vocabulary, text)
        assert codec.decode(ids) == library.decode(ids)


def test_many_random_texts(codec, library):
    texts = random_texts(2, 15_000, 40)
    pieces = [p.replace(C._MARK, " ") for p in codec.vocabulary.pieces if p]
    r = random.Random(3)
    texts += ["".join(r.choices(pieces, k=4)) for _ in range(30_000)]
    assert [ids.tolist() for ids in codec.encode_all(texts)] == library.encode(texts)


def test_every_prefix_has_one_last_piece(codec, library):
    for text in random_texts(4, 40, 12) + ["representations of internationalisation", " " * 40 + "x", "y" * 100]:
        for unit in C.re.findall(f"{C._MARK}*[^{C._MARK}\n]+", C._MARK + text.replace(" ", C._MARK)):
            code = codec.automaton.code[[ord(c) for c in unit]]
            if not code.all():
                continue
            last = codec.last_pieces(code, np.array([0]))
            assert last[0] == -1
            for end in range(1, len(unit) + 1):
                fitting = [i for p, i in codec.id_of.items() if unit[:end].endswith(p) and (
                    end == len(p) or codec.compatible(int(last[end - len(p)]), i))]
                assert fitting == [last[end]]


def test_compatible_pairs_are_those_the_library_keeps(codec, library):
    r = random.Random(5)
    inner = [i for p, i in codec.id_of.items() if not p.startswith(C._MARK)]
    start = library.encode("\n")
    for _ in range(20_000):
        a, b = r.choice(inner), r.choice(inner)
        text = codec.vocabulary.pieces[a] + codec.vocabulary.pieces[b]
        assert codec.compatible(a, b) == (library.encode("\n" + text) == [*start, a, b])


def test_decoding_of_any_ids(codec, library):
    r = random.Random(6)
    for _ in range(8_000):
        ids = [r.choice([0, 1, 2, 3, 16, 200, 259, 28705, r.randrange(32_000), r.randrange(3, 259), r.randrange(130, 259)]) for _ in range(r.randint(0, 9))]
        assert codec.decode(ids) == library.decode(ids)
    assert codec.decode(None) == ""
    for wrong in ([-1], [32_000]):
        with pytest.raises(ValueError, match="outside"):
            codec.decode(wrong)


def test_bounds_change_nothing(library, monkeypatch):
    texts = random_texts(7, 300, 60) + ["".join(random.Random(9).choices("abcdefgh", k=5000)), "é" * 300 + "日本\U0001f44d" * 40]
    want = library.encode(texts)
    for bounds in ({"PAIR_BITS": 4, "SEGMENT": 50, "WIDE": 8}, {"PAIR_BITS": 9, "WIDE": 1}, {"PAIR_BITS": 12, "SEGMENT": 1, "KEPT_PAIRS": 3}):
        with monkeypatch.context() as m:
            for name, value in bounds.items():
                m.setattr(C, name, value)
            small = C.Codec(C.read_vocabulary(MODEL)[1])
            assert [i.tolist() for i in small.encode_all(texts)] == want
            assert small.pairs.used <= len(small.pairs.keys) // 2


def test_parts_of_equal_hashes(codec, library, monkeypatch):
    monkeypatch.setattr(C, "_WEIGHT", np.zeros(C.WIDE + 1, dtype=np.uint64))
    texts = random_texts(8, 200, 30)
    assert [i.tolist() for i in codec.encode_all(texts)] == library.encode(texts)


def test_other_vocabularies_raise():
    good = C.read_vocabulary(MODEL)[1]
    assert C.vocabulary(open(MODEL, "rb").read()) is good
    with pytest.raises(Exception):      # noqa: B017  the library refuses what is no model
        C.vocabulary(b"no model")


def test_rows_and_columns(spark, library):
    texts = [None, "", " ", "naïve  text\n\n x", "x" * 30_000, "word " * 40_000, "same", "same", "\U0001f44d" * 3]
    docs = spark.createDataFrame([(i if i != 6 else None, t, "z", "y") for i, t in enumerate(texts)], "doc_id long, text string, ids string, decoded string").repartition(3)
    got = C.decoded(C.encoded(docs, MODEL), MODEL)
    assert got.columns == ["doc_id", "ids", "decoded"]
    rows = {r.doc_id: r for r in got.collect()}
    for i, t in enumerate(texts):
        r = rows[i if i != 6 else None]
        assert r.ids == library.encode(t or "")
        assert r.decoded == library.decode(r.ids)
    assert C.decoded(C.encoded(docs.limit(0), MODEL), MODEL).collect() == []


def test_query_equals_library(spark, sf_small, library):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()

    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    want = {d: (len(i), digest(",".join(map(str, i))), digest(library.decode(i))) for d, t in docs for i in [library.encode(t or "")]}
    got = op12_pieces(spark, sf_small)
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "string", "string"]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want
    assert not any(re.search("[A-F]", v[1]) for v in want.values())
