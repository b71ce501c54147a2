"""Benchmark decontamination by q-gram lemma filtering.

A passage of a benchmark item of m characters that was copied with at most e
edits shares at least ``m + 1 - q * (e + 1)`` of the item's q-grams with the
document, all on diagonals (document position minus item position) at most e
apart.  So, for a block of texts at a time:

1. every 8 bytes of the normalised texts are looked up in a bitmap of the
   items' q-grams, and the hits in the sorted q-gram table;
2. hits are counted by item and diagonal band; bands overlap by the edit
   budget, so one of them holds a whole copy;
3. bands that reach the lemma's bound are verified by an alignment of the item
   that is restricted to the band's diagonals.

Parts of long items count too: an item of more than ``WINDOW`` bytes of normal
form (about 50 English words) is also searched by its windows of that length,
one every ``STRIDE`` bytes and one at its end, by the same lemma and alignment
with a tenth of the window as budget.  So every copied part that holds a window
is found, whatever else of the item is missing: any run of ``WINDOW + STRIDE``
bytes, most exact ones of ``WINDOW``.  Items of at most ``WINDOW`` bytes count as a
whole only, items of more than ``LONGEST`` bytes by their windows only.

Texts are compared on a normal form: A-Z and Latin-1 capitals lower-cased,
every run of other ASCII characters than letters and digits one space.  The
result depends on no sample or prefix: whole texts, all items.

Memory in a task is bounded by one text (a few times its bytes), the item
block, and the q-gram hits of one piece: texts are searched about ``CHUNK`` bytes
at a time, in pieces that overlap by the longest item and its bands.

The items are a stated query set.  They are collected and sent to the tasks in
blocks of at most ``BLOCK_BYTES`` bytes; each block is one pass over the texts,
so a larger benchmark costs passes, not memory.

Defined cases: NULL or empty texts and items match nothing.  Items whose normal
form is shorter than q must occur exactly.  Repeated rows give repeated
matches; an item that occurs twice in a text gives its best occurrence (the
first of those) per overlapping band group.  Windows of an item that overlap in
a text give one row from the first begin to the last end with the edits of the
best window; beside a copy of the whole item they give none.  Other columns are ignored.  Empty
tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import kept_rows, with_computed

Q = 8
BUDGET = 0.10
WINDOW, STRIDE = 320, 80
LONGEST = 1 << 14
CHUNK = 1 << 20
BLOCK_BYTES = 4 << 20
_BITS = 22

_NORMAL = np.full(256, 32, dtype=np.uint8)
_NORMAL[128:] = np.arange(128, 256)
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _NORMAL[_a:_b] = np.arange(_a, _b)
_NORMAL[65:91] += 32
_NORMAL[0] = 0


def normal_bytes(raw: bytes) -> np.ndarray:
    """The normal form; zero bytes (separators of texts) stay."""
    out, at, spaced = [np.zeros(0, np.uint8)], 0, True
    while at < len(raw):
        cut = min(at + CHUNK, len(raw))
        while cut < len(raw) and 0x80 <= raw[cut] < 0xC0:      # within a character
            cut += 1
        part = _normal_part(np.frombuffer(raw, dtype=np.uint8, count=cut - at, offset=at), spaced)
        spaced = bool(part[-1] == 32) if len(part) else spaced
        out.append(part)
        at = cut
    return np.concatenate(out)


def _normal_part(a: np.ndarray, spaced: bool) -> np.ndarray:
    """``spaced``: a space stands before the part, or nothing."""
    x = _NORMAL[a]
    capital = np.flatnonzero(a[:-1] == 0xC3) + 1
    capital = capital[(a[capital] >= 0x80) & (a[capital] <= 0x9E) & (a[capital] != 0x97)]
    x[capital] += 0x20
    space = x == 32
    keep = ~space
    keep[0] |= not spaced
    keep[1:] |= ~space[:-1]
    return x[keep]


def item_bytes(text: str | None) -> bytes:
    return normal_bytes((text or "").replace("\0", " ").encode("utf-8", "surrogatepass")).tobytes().strip(b" ")


def grams(x: np.ndarray) -> np.ndarray:
    """All runs of 8 bytes, as numbers."""
    if len(x) < Q:
        return np.zeros(0, np.uint64)
    g = x.astype(np.uint64)
    for k in (1, 2, 4):
        g = g[:-k] | (g[k:] << np.uint64(8 * k))
    return g


def edit_budget(m: int) -> int:
    """Edits allowed for an item of m bytes: a tenth, less where the lemma would then ask for no shared q-gram."""
    return max(0, min(int(BUDGET * m), (m - Q) // Q))


def band_distance(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Fewest edits between the whole item and any part of ``text`` on diagonals
    low..high (text position minus item position); the part's begin and end."""
    d = np.arange(low, high + 1)
    inside = (d >= 0) & (d <= len(text))
    far = len(item) + len(text) + 1
    cost = np.where(inside, 0, far)
    begin = d.copy()
    step = np.arange(len(d))
    for i, c in enumerate(item):
        at = d + i
        ok = (at >= 0) & (at < len(text))
        same = text[np.clip(at, 0, max(0, len(text) - 1))] == c if len(text) else np.zeros(len(d), bool)
        take = np.where(ok, cost + ~same, far)                    # item byte against text byte
        skip = np.r_[cost[1:], far] + 1                           # item byte left out of the text
        began = np.where(skip < take, np.r_[begin[1:], 0], begin)
        now = np.minimum(take, skip)
        now = np.where((at + 1 >= 0) & (at + 1 <= len(text)), now, far)
        run = now - step                                          # text bytes that the item lacks
        best = np.minimum.accumulate(run)
        first = np.maximum.accumulate(np.where(np.r_[True, best[1:] < best[:-1]], step, 0))
        cost, begin = best + step, began[first]
    k = int(np.argmin(cost))
    return int(cost[k]), int(begin[k]), int(d[k] + len(item))


def grouped(hits: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """(edits, begin, end) by overlapping runs."""
    groups: list[list[tuple[int, int, int]]] = []
    last = 0
    for h in sorted(hits, key=lambda h: (h[1], h[0])):
        if groups and h[1] < last:
            groups[-1].append(h)
        else:
            groups.append([h])
            last = 0
        last = max(last, h[2])
    return groups


class ItemIndex:
    """q-gram table of a block of items."""

    def __init__(self, items: list[tuple[object, bytes]]):
        self.ids = [i for i, _ in items]
        self.items = [np.frombuffer(b, dtype=np.uint8) for _, b in items]
        self.length = np.array([len(x) for x in self.items], dtype=np.int64)
        by_windows = self.length > LONGEST
        self.budget = np.array([edit_budget(int(m)) if m <= LONGEST else 0 for m in self.length], dtype=np.int64)
        self.need = np.where(by_windows, np.iinfo(np.int64).max, self.length + 1 - Q * (self.budget + 1))
        g = [grams(x) for x in self.items]
        value = np.concatenate(g) if g else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(g)), [len(x) for x in g])
        place = np.concatenate([np.arange(len(x)) for x in g]) if g else np.zeros(0, np.int64)
        order = np.argsort(value, kind="stable")
        self.value, self.item, self.place = value[order], item[order], place[order]
        self.seen = np.zeros(1 << _BITS, dtype=bool)
        self.seen[self._slot(self.value)] = True
        self.short = [(k, x.tobytes()) for k, x in enumerate(self.items) if 0 < len(x) < Q]
        # Band width: at least the item's budget, so that a copy lies in two neighbours at most.
        self.shift = np.array([max(3, int(e).bit_length()) for e in self.budget], dtype=np.int64)
        # A multiple of every band's width, as are the begins of the pieces of a long block of texts.
        widest = max(9, int(self.shift.max(initial=3)))
        self.margin = (int(self.length.max(initial=1)) // 512 + 1) * 512 << (widest - 9)
        # A band's hits lie within the length of what it is a band of, an item or a window.
        longest = max(WINDOW, int(self.length[~by_windows].max(initial=1)))
        self.reach = -(-(longest + (2 << widest) + Q) >> widest) << widest
        self.step = max(CHUNK >> widest << widest, self.reach)
        # Windows of the long items: item and offset, the first window of each item.
        begins = [[*range(0, len(x) - WINDOW, STRIDE), len(x) - WINDOW] if len(x) > WINDOW else [] for x in self.items]
        self.first_window = np.cumsum([0, *(len(b) for b in begins)])
        self.window_item = np.repeat(np.arange(len(begins)), np.diff(self.first_window))
        self.window_at = np.array([o for b in begins for o in b], dtype=np.int64)
        new = np.flatnonzero(np.r_[True, self.value[1:] != self.value[:-1]]) if len(value) else np.zeros(0, np.int64)
        self.distinct, self.first = self.value[new], new
        self.count = np.diff(np.r_[new, len(self.value)])

    @staticmethod
    def _slot(value: np.ndarray) -> np.ndarray:
        return ((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)

    @staticmethod
    def _reaching(owner: np.ndarray, band: np.ndarray, place: np.ndarray, need: np.ndarray, bands: np.int64, distinct: bool) -> tuple:
        """Owners and bands that reach ``need`` (by owner) together with the next band, and the hits of both."""
        key = owner * bands + band
        if not len(key):
            return key, key, np.zeros(0, np.int64)
        if distinct:
            at = np.lexsort((place, key))
            key, place = key[at], place[at]
            key = key[np.r_[True, (key[1:] != key[:-1]) | (place[1:] != place[:-1])]]
        else:
            at = np.argsort(key, kind="stable")
            key = key[at]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        own, n = key[new], np.diff(np.r_[new, len(key)])
        follows = np.r_[own[1:] == own[:-1] + 1, False]
        good = n + np.where(follows, np.r_[n[1:], 0], 0) >= need[own // bands]
        if distinct:
            return own[good] // bands, own[good] % bands, np.zeros(0, np.int64)
        return own[good] // bands, own[good] % bands, at[np.repeat(good | np.r_[False, good[:-1] & follows[:-1]], n)]

    def regions(self, text: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """(item, begin and end in the item, budget, lowest and highest diagonal) of the bands of a block
        of texts that reach the lemma's bound; whole items first, then windows.

        A long block is searched piece by piece.  Pieces overlap by ``reach`` and begin at multiples of every
        band's width, so each band lies whole in a piece, and bands found twice are the same."""
        found = {(k, first, last, e, low + at, high + at)
                 for at in range(0, len(text), self.step)
                 for k, first, last, e, low, high in self._regions(text[at:at + self.step + self.reach])}
        return sorted(found, key=lambda r: (r[2] - r[1] < self.length[r[0]], r))

    def _regions(self, text: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        g = grams(text)
        at = np.flatnonzero(self.seen[self._slot(g)])
        if not len(at) or not len(self.distinct):
            return []
        value = g[at]
        row = np.minimum(np.searchsorted(self.distinct, value), len(self.distinct) - 1)
        hit = self.distinct[row] == value
        at, row = at[hit], row[hit]
        count = self.count[row]
        entry = np.repeat(self.first[row] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        item, place = self.item[entry], self.place[entry]
        diagonal = np.repeat(at, count) - place + self.margin
        bands = np.int64(((len(text) + self.margin) >> 3) + 2)
        # Two neighbouring bands together reach the bound: first by all hits, then by distinct places in the item.
        band = diagonal >> self.shift[item]
        _, _, kept = self._reaching(item, band, place, self.need, bands, False)
        owner, low, _ = self._reaching(item[kept], band[kept], place[kept], self.need, bands, True)
        out = []
        for k, b in zip(owner.tolist(), low.tolist(), strict=True):
            begin = (b << int(self.shift[k])) - self.margin
            out.append((k, 0, int(self.length[k]), int(self.budget[k]), begin, begin + (2 << int(self.shift[k])) - 1))
        if not len(self.window_at):
            return out
        # Windows: hits of the whole item on a window's bands, then dealt to the windows that hold their places.
        budget = edit_budget(WINDOW)
        need, shift = WINDOW + 1 - Q * (budget + 1), max(3, budget.bit_length())
        long = np.flatnonzero(self.length[item] > WINDOW)
        item, place, band = item[long], place[long], diagonal[long] >> shift
        _, _, kept = self._reaching(item, band, place, np.full(len(self.items), need), bands, False)
        item, place, band = item[kept], place[kept], band[kept]
        top = self.first_window[item + 1] - self.first_window[item] - 1
        # Offsets rise by STRIDE, the last by less: windows of places up to this one, back as far as they reach.
        newest = np.minimum(place // STRIDE, top)
        parts = []
        for back in range(-(-WINDOW // STRIDE) + 2):
            w = self.first_window[item] + newest + 1 - back
            ok = (newest + 1 - back >= 0) & (newest + 1 - back <= top)
            ok[ok] = (self.window_at[w[ok]] <= place[ok]) & (place[ok] <= self.window_at[w[ok]] + WINDOW - Q)
            parts.append((w[ok], band[ok], place[ok] - self.window_at[w[ok]]))
        w, band, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        owner, low, _ = self._reaching(w, band, place, np.full(len(self.window_at), need), bands, True)
        for w, b in zip(owner.tolist(), low.tolist(), strict=True):
            o = int(self.window_at[w])
            begin = (b << shift) - self.margin + o
            out.append((int(self.window_item[w]), o, o + WINDOW, budget, begin, begin + (2 << shift) - 1))
        return out

    def matches(self, raw: list[bytes]) -> Iterator[tuple[int, object, int, int, int]]:
        """(text number, item id, begin, end, edits) over a block of texts; places count in the text's normal form."""
        text = normal_bytes(b"\0" * Q + (b"\0" * Q).join(raw) + b"\0" * Q)
        zero = text == 0
        body = np.flatnonzero(np.diff(np.r_[True, zero, True].astype(np.int8)))
        starts, ends = body[::2], body[1::2]
        # Texts may be empty: count separators, not bodies.
        number = np.searchsorted(np.flatnonzero(zero), starts) // Q - 1
        whole = text.tobytes()
        found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        partly: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        copies: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for k, first, last, e, low, high in self.regions(text):
            item = self.items[k][first:last]
            into = found if len(item) == len(self.items[k]) else partly
            for s in range(int(np.searchsorted(ends, max(0, low), "right")), len(starts)):
                begin, end = int(starts[s]), int(ends[s])
                if begin > high + len(item):
                    break
                part_from, part_to = max(begin, low - e), min(end, high + len(item) + e + 1)
                if into is partly:
                    if (s, k) not in copies:            # whole items come first
                        copies[s, k] = [min(g)[1:] for g in grouped(found.get((s, k), []))]
                    if any(b + begin < low - e + len(item) and high + e < t + begin for b, t in copies[s, k]):
                        continue                        # any occurrence would overlap this copy
                at = whole.find(item.tobytes(), part_from, part_to)
                if at >= 0:
                    hit = (0, at, at + len(item))
                else:
                    part = text[part_from:part_to]
                    if len(part) < len(item) - e:
                        continue
                    cost, b, t = band_distance(item, part, low - e - part_from, high + e - part_from)
                    hit = (cost, b + part_from, t + part_from)
                if hit[0] <= e:
                    into.setdefault((s, k), []).append((hit[0], hit[1] - begin, hit[2] - begin))
        for s in range(len(starts)) if self.short else ():
            for k, x in self.short:
                at = (b" " + whole[starts[s]:ends[s]].strip(b" ") + b" ").find(b" " + x + b" ")
                if at >= 0:
                    found.setdefault((s, k), []).append((0, at, at + len(x)))
        for (s, k), hits in found.items():
            for g in grouped(hits):
                cost, b, t = min(g)
                yield int(number[s]), self.ids[k], b, t, cost
        for (s, k), hits in partly.items():
            for g in grouped([h for h in hits if not any(h[1] < t and b < h[2] for b, t in copies[s, k])]):
                yield int(number[s]), self.ids[k], g[0][1], max(h[2] for h in g), min(g)[0]


def _text_blocks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Blocks of about CHUNK bytes, each with the number of its first text."""
    block: list[bytes] = []
    first = held = 0
    for i, t in enumerate(texts):
        raw = (t or "").replace("\0", " ").encode("utf-8", "surrogatepass")
        if block and held + len(raw) > CHUNK:
            yield first, block
            block, first, held = [], i, 0
        block.append(raw)
        held += len(raw) + Q
    if block:
        yield first, block


def find_items(items: list[tuple[object, bytes]]):
    """From texts to lists of (item id, begin, end, edits); the index is built once a task."""
    index: list[ItemIndex] = []

    def search(texts: list[str | None]) -> list[list[tuple]]:
        if not index:
            index.append(ItemIndex(items))
        out: list[list[tuple]] = [[] for _ in texts]
        for first, block in _text_blocks(texts):
            for n, *rest in index[0].matches(block):
                out[first + n].append(tuple(rest))
        return out

    return search


def _item_blocks(benchmark: DataFrame) -> list[list[tuple[object, bytes]]]:
    """The items in blocks of bounded size."""
    blocks: list[list[tuple[object, bytes]]] = [[]]
    held = 0
    for row in benchmark.select("item_id", "text").orderBy("item_id").toLocalIterator():
        item = item_bytes(row["text"])
        if item:
            if held + len(item) > BLOCK_BYTES and blocks[-1]:
                blocks.append([])
                held = 0
            blocks[-1].append((row["item_id"], item))
            held += len(item)
    return blocks


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, begin, end, edits): a row for each benchmark passage in a document.

    ``begin`` and ``end`` count bytes of the text's normal form."""
    kind = benchmark.schema["item_id"].dataType.simpleString()
    found = None
    for block in _item_blocks(benchmark):
        search = find_items(block)
        hits = with_computed(docs, ["doc_id"], "text", lambda texts, search=search: [
            [[dict(zip(("item_id", "begin", "end", "edits"), h, strict=True)) for h in hits] for hits in search(texts)]],
            f"hits array<struct<item_id:{kind},begin:bigint,end:bigint,edits:bigint>>")
        part = hits.select("doc_id", F.inline("hits"))
        found = part if found is None else found.unionByName(part)
    return found


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark passage was found; rows with a NULL
    doc_id are judged like the others.  Narrow passes, no shuffle."""
    for block in _item_blocks(benchmark):
        search = find_items(block)
        docs = kept_rows(docs, "text", lambda texts, search=search: [not hits for hits in search(texts)])
    return docs
