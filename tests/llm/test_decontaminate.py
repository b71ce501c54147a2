import random

import numpy as np
import pytest

from paddock.llm import decontaminate as D

SCHEMA = "doc_id long, text string, item_id long, hits string"


def fewest_edits(item, text):
    """Sellers: the whole item against any part of the text."""
    row = np.zeros(len(text) + 1, dtype=int)
    t = np.frombuffer(text, dtype=np.uint8)
    for i, c in enumerate(item):
        best = np.r_[i + 1, np.minimum(row[1:] + 1, row[:-1] + (t != c))]
        row = np.minimum.accumulate(best - np.arange(len(best))) + np.arange(len(best))
    return int(row.min())


def brute(docs, items):
    out = {}
    for d, text in docs:
        for i, item in items:
            a, b = D.item_bytes(item), D.item_bytes(text)
            if len(a) >= D.Q and len(b):
                e = fewest_edits(a, b)
                if e <= D.edit_budget(len(a)):
                    out[d, i] = e
    return out


def edited(rng, text, n):
    x = list(text)
    for _ in range(n):
        at = rng.randrange(len(x))
        what = rng.randrange(3)
        x[at:at + (what != 0)] = [] if what == 1 else [rng.choice("abcdefgh ")]
    return "".join(x)


def some(rng, n):
    return " ".join("".join(rng.choice("abcdeéö") for _ in range(rng.randrange(2, 7))) for _ in range(n))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_full_alignment(spark, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(D, "CHUNK", 3000)
    items = [(i, some(rng, rng.choice([3, 6, 15, 40]))) for i in range(25)]
    docs = []
    for d in range(120):
        text = some(rng, rng.randrange(0, 60))
        if d % 2:
            item = rng.choice(items)[1]
            text += " " + edited(rng, item, rng.randrange(0, len(item) // 6)) + " " + some(rng, rng.randrange(0, 30))
        docs.append((d, text.upper() if d % 5 == 0 else text))
    want = brute(docs, items)
    assert len(want) > 30
    table = spark.createDataFrame([(d, t, 7, "clash") for d, t in docs], SCHEMA).repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in D.contaminations(table, benchmark).collect():
        got[r["doc_id"], r["item_id"]] = min(r["edits"], got.get((r["doc_id"], r["item_id"]), 99))
    assert got == want
    kept = {r["doc_id"] for r in D.without_contaminated(table, benchmark).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}
    monkeypatch.setattr(D, "BLOCK_BYTES", 200)       # many passes give the same
    again = {(r["doc_id"], r["item_id"]) for r in D.contaminations(table, benchmark).collect()}
    assert again == set(want)


def test_defined_cases(spark):
    passage = "The quick brown fox jumps over the lazy dog near the river bank today."
    benchmark = spark.createDataFrame([(1, passage), (2, None), (3, ""), (None, "another passage that nobody has copied so far"), (5, "ab cd")], "item_id long, text string")
    rows = [(1, passage), (1, passage), (None, "x " + passage.upper().replace(" ", "\n\t")), (2, None), (3, ""), (4, "clean"), (5, "word " * 400_000 + passage), (6, "x AB, cd!"), (7, "xab cd")]
    docs = spark.createDataFrame([(d, t, 0, "") for d, t in rows], SCHEMA)
    got = sorted(((r["doc_id"], r["item_id"], r["edits"]) for r in D.contaminations(docs, benchmark).collect()), key=str)
    assert got == sorted([(1, 1, 0), (1, 1, 0), (None, 1, 0), (5, 1, 0), (6, 5, 0)], key=str)
    kept = D.without_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 7]
    assert D.contaminations(docs.where("false"), benchmark).collect() == []
    assert D.contaminations(docs, benchmark.where("false")).collect() == []
    assert D.without_contaminated(docs, benchmark.where("false")).count() == len(rows)


def test_twice_in_a_text(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, passage + " filler " * 50 + passage)], "doc_id long, text string")
    got = D.contaminations(docs, spark.createDataFrame([(9, passage)], "item_id long, text string")).collect()
    assert [(r["edits"], r["end"] - r["begin"]) for r in got] == [(0, len(passage))] * 2


def test_cut_copies_of_long_items(spark):
    rng = random.Random(5)
    items = [(i, " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n))) for i, n in enumerate([90, 300, 1500, 12])]
    window, stride = 320, 80
    size = window + stride
    docs, want = [], {}
    for d in range(60):
        i, item = items[d % 3]
        around = " ".join("".join(rng.choice("qrstuvwxyz") for _ in range(5)) for _ in range(rng.randrange(2, 400)))
        where = (0, rng.randrange(len(item) - size), len(item) - size)[d // 3 % 3]
        part = item[where:where + size] if d % 4 else item[:max(size, len(item) * 6 // 10)]
        if d % 2:
            part = edited(rng, part, window // 20)
        docs.append((d, [f"{around} {part} {around}", part, f"{around} {part}"][d % 3 - 1]))
        want[d] = i
    docs += [(100, items[1][1][:window // 2]), (101, items[3][1][:len(items[3][1]) * 6 // 10]), (102, "x " + items[2][1] + " y " + items[2][1][900:900 + size])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame([(d, t, 7, "clash") for d, t in docs], SCHEMA)
    rows = D.contaminations(table, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows if r["doc_id"] < 100} == set(want.items())
    assert sorted((r["doc_id"], r["edits"], r["end"] - r["begin"] >= size - 2 * stride) for r in rows if r["doc_id"] >= 100) == [(102, 0, True)] * 2
    exact = [r for r in rows if r["doc_id"] < 100 and r["doc_id"] % 2 == 0]
    assert all(r["edits"] == 0 for r in exact) and len(exact) == 30
    assert {r["doc_id"] for r in D.without_contaminated(table, benchmark).collect()} == {100, 101}


def letters(rng, n):
    """n bytes of random words, as bytes."""
    x = rng.integers(97, 123, n).astype(np.uint8)
    x[rng.integers(0, n, n // 7)] = 32
    return x.tobytes()


def test_normal_form_by_parts(monkeypatch):
    rng = random.Random(8)
    raws = ["".join(rng.choice("aÉß .,\0日—") for _ in range(rng.randrange(0, 60))).encode() for _ in range(300)]
    want = [D.normal_bytes(r).tolist() for r in raws]
    monkeypatch.setattr(D, "CHUNK", 3)
    assert [D.normal_bytes(r).tolist() for r in raws] == want


def test_pieces_find_what_whole_texts_find(monkeypatch):
    rng = np.random.default_rng(2)
    items = [(i, D.item_bytes(letters(rng, n).decode())) for i, n in enumerate([60, 200, 320, 900, 2500])]
    r = random.Random(3)
    text = b""
    for _ in range(20):
        item = items[r.randrange(len(items))][1]
        at = r.randrange(len(item) // 2)
        text += letters(rng, r.randrange(10, 3000)) + edited(r, (item if r.random() < 0.5 else item[at:]).decode(), len(item) // 30).encode()
    for longest in (1 << 14, 1000):
        monkeypatch.setattr(D, "LONGEST", longest)
        monkeypatch.setattr(D, "CHUNK", 1 << 20)
        whole = D.ItemIndex(items)
        monkeypatch.setattr(D, "CHUNK", 1 << 9)
        pieces = D.ItemIndex(items)
        normal = D.normal_bytes(text)
        assert whole.step >= len(normal) > 4 * pieces.step
        assert pieces.regions(normal) == whole.regions(normal)
        found = list(pieces.matches([text, text[:5000]]))
        assert found == list(whole.matches([text, text[:5000]])) and len(found) >= 12


def test_many_items_in_a_very_long_text():
    """More (item, band) pairs than 64 bits hold together with a place."""
    rng = np.random.default_rng(4)
    items = [(i, bytes(x)) for i, x in enumerate(rng.integers(97, 123, (350_000, 11)).astype(np.uint8))]
    text = bytearray(rng.integers(48, 58, 16 << 20).astype(np.uint8).tobytes())
    planted = {0: 15 << 20, 123_456: 7 << 20, 349_000: (16 << 20) - 200, 349_999: 5}
    for i, at in planted.items():
        text[at:at + 11] = items[i][1]
    found = {(i, begin, end, edits) for _, i, begin, end, edits in D.ItemIndex(items).matches([bytes(text)])}
    assert found == {(i, at, at + 11, 0) for i, at in planted.items()}


def test_items_of_more_than_sixteen_megabytes():
    rng = np.random.default_rng(6)
    item = rng.integers(97, 123, (17 << 20) + 5).astype(np.uint8).tobytes()
    index = D.ItemIndex([(1, item), (2, b"an item of usual length here")])
    around = rng.integers(48, 58, 3000).astype(np.uint8).tobytes()
    for at in (0, 17 << 20 - 4, len(item) - 900):
        found = list(index.matches([b"nothing", around + item[at:at + 900] + around]))
        assert [(n, i, edits) for n, i, _, _, edits in found] == [(1, 1, 0)]
        assert found[0][2] <= 3000 + 80 and found[0][3] >= 3900 - 80
