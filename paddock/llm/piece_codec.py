"""Encoding and decoding with a merge-type piece vocabulary by a prefix table.

Merging starts from single characters and always joins the adjacent pair whose
joined string has the highest score (the leftmost of equals).  Two facts follow:

* a piece has one merge history of its own: within its borders merges happen in
  the order in which they happen when it stands alone;
* a sequence of pieces is the encoding of its text exactly if every two
  neighbours are *compatible*: running both histories side by side, no join over
  the border comes first.

So every prefix of a text has one last piece.  The table of last pieces is filled
from left to right: an automaton (the vocabulary's trie, run from every place at once) gives the
pieces that end at a place, and the one that is compatible with the last piece
of the prefix before it is stored.  The ids are then recovered backwards.
Compatibility is tested once for each pair of pieces that occurs and kept.  Many
texts' prefixes are tabulated together, those of one length at a time.  The
library is used on the driver only: to list the vocabulary and to compare
probes; encoding and decoding don't call it.

Characters outside the vocabulary become their UTF-8 bytes' ids; nothing joins
with them.  A text is encoded in parts that no piece crosses (a run of spaces
and the characters after it; a line feed), which ``vocabulary`` proves from the
pieces or raises; a group of texts encodes each distinct part once.

Defined cases: NULL and empty texts have no ids and decode to ''.  Special
strings inside texts are ordinary text.  Rows are handled one by one, so repeated
rows and NULL ids pass unchanged; texts of any length need memory in proportion
to one text.  Decoding takes any ids of the vocabulary: control ids give
nothing, the unknown id gives ' ⁇ ', bytes that are no UTF-8 give U+FFFD each,
NULL ids arrays give ''; ids outside the vocabulary raise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from paddock.llm.common import named, slices, small_batches, with_computed

KEPT_PAIRS = 200_000
PAIR_BITS = 20
WIDE = 64
SEGMENT = 1 << 20
_MARK = "▁"
_WEIGHT = np.random.Generator(np.random.PCG64(12)).integers(0, 2**63, WIDE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BORDER = re.compile(f"(?<=[^{_MARK}]){_MARK}|\n")
_NONE = float("-inf")


@dataclass(frozen=True)
class Vocabulary:
    """What encoding and decoding need of a model file."""

    pieces: list[str]                # text of every id; '' for control, unknown and byte ids
    scores: list[float]
    byte: list[int]                  # id of each byte
    unknown: int

    def ids(self) -> dict[str, int]:
        return {p: i for i, p in enumerate(self.pieces) if p}


@lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Vocabulary:
    """The vocabulary of a model file, listed by the library; raises where this method does not hold."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    every = range(lib.get_piece_size())
    names = [lib.id_to_piece(i) for i in every]
    pieces = ["" if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) else names[i] for i in every]
    byte = {int(names[i][3:-1], 16): i for i in every if lib.is_byte(i)}
    used = [p for p in pieces if p]
    characters = {p for p in used if len(p) == 1}
    if len(byte) != 256:
        raise ValueError("the vocabulary has no ids for single bytes")
    if any("\n" in p or re.search(f"[^{_MARK}]{_MARK}", p) for p in used):
        raise ValueError("pieces cross the borders of parts")
    if not all(set(p) <= characters for p in used):
        raise ValueError("a piece holds a character that is no piece")
    made = Vocabulary(pieces, [lib.get_score(i) for i in every], [byte[b] for b in range(256)], lib.unk_id())
    probes = ["", " ", "a", "  a  b ", "\r\n\ta b", "ﬁＡééΩ ​", "<s></s><unk><0x41>", "a\0b", "▁ ▁", "\U0001f44d\U0001f3fd日本",
              *(" " * n + "x" + " " * n for n in range(2, 80)), "\n".join(used), " ".join(used)]
    codec = Codec(made)
    for probe in probes:
        ids = lib.encode(probe)
        if codec.encode(probe).tolist() != ids or codec.decode(ids) != lib.decode(ids):
            raise ValueError(f"the model normalises or merges otherwise: {probe[:40]!r}")
    return made


class NumberTable:
    """Whole numbers (not negative) to small ones, looked up many at a time (open addressing)."""

    def __init__(self, bits: int):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.zeros(1 << self.bits, dtype=np.int32)
        self.used = 0

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or the free place where it would go."""
        mask = (1 << self.bits) - 1
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        while len(left):
            at[left] = (at[left] + 1) & mask
            there = self.keys[at[left]]
            left = left[(there != keys[left]) & (there >= 0)]
        return at

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, 0 where a key is missing."""
        at = self.places(keys)
        return np.where(self.keys[at] == keys, self.values[at], 0)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct new keys."""
        while len(keys):
            at = self.places(keys)
            self.keys[at] = keys                    # of keys for one free place the last one gets it
            won = self.keys[at] == keys
            self.values[at[won]] = values[won]
            self.used += int(won.sum())
            keys, values = keys[~won], values[~won]


class Automaton:
    """The vocabulary's trie: finds the pieces that begin at every place of a text."""

    def __init__(self, pieces: list[tuple[str, int]]):
        characters = sorted(set("".join(p for p, _ in pieces)))
        self.code = np.zeros(0x110000, dtype=np.int32)      # 0: a character outside the vocabulary
        self.code[[ord(c) for c in characters]] = np.arange(1, len(characters) + 1)
        self.width = len(characters) + 1
        child: dict[int, int] = {}
        ends = {}
        code = {c: k for k, c in enumerate(characters, 1)}
        for piece, i in pieces:
            node = 0
            for c in piece:
                node = child.setdefault(node * self.width + code[c], len(child) + 1)
            ends[node] = i
        self.piece = np.full(len(child) + 1, -1, dtype=np.int32)
        self.piece[list(ends)] = list(ends.values())
        self.child = NumberTable(max(4, (2 * len(child)).bit_length() + 1))
        self.child.put(np.fromiter(child, np.int64, len(child)), np.fromiter(child.values(), np.int32, len(child)))
        self.first = np.zeros(self.width, dtype=np.int32)
        for k in range(1, self.width):
            self.first[k] = child[k]

    def matches(self, code: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end, length, piece) of every piece found; ``room``: how many characters may follow a place's own."""
        at = np.arange(len(code))
        node = self.first[code]
        at, node = at[node > 0], node[node > 0]
        found, n = [], 1
        while len(at):
            piece = self.piece[node]
            hit = piece >= 0
            found.append((at[hit] + n, np.full(int(hit.sum()), n), piece[hit]))
            more = room[at] >= n
            at, node = at[more], node[more]
            node = self.child.get(node.astype(np.int64) * self.width + code[at + n])
            at, node = at[node > 0], node[node > 0]
            n += 1
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Codec:
    """Encodes and decodes by ``vocabulary``."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.id_of = vocabulary.ids()
        self.length = np.array([len(p) for p in vocabulary.pieces])
        self.score_of = {p: vocabulary.scores[i] for p, i in self.id_of.items()}
        self.history: dict[int, tuple] = {}
        self.pairs = NumberTable(PAIR_BITS)         # tested pairs: 1 fits, 2 does not
        # A piece that no merges lead to is never the result.
        self.automaton = Automaton([(p, i) for p, i in self.id_of.items() if self.merges(i) is not None])
        texts = [p.replace(_MARK, " ") for p in vocabulary.pieces]
        texts[vocabulary.unknown] = " ⁇ "
        self.texts = np.array(texts, dtype=object)
        for b, i in enumerate(vocabulary.byte[:0x80]):
            self.texts[i] = chr(b)
        # Bytes that are a character only together with others.
        self.byte_of = {i: b for b, i in enumerate(vocabulary.byte) if b >= 0x80}
        self.is_byte = np.zeros(len(texts), dtype=bool)
        self.is_byte[list(self.byte_of)] = True

    def merges(self, i: int) -> tuple | None:
        """The merge history of a piece: scores, and after 0, 1, ... merges the text of its
        first and of its last symbol.  None if it doesn't end in the piece."""
        if i not in self.history:
            piece = self.vocabulary.pieces[i]
            symbols = list(piece)
            scores, first, last = [], [symbols[0]], [symbols[-1]]
            while len(symbols) > 1:
                best, at = max((self.score_of.get(a + b, _NONE), -k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
                if best == _NONE:
                    break
                symbols[-at:2 - at] = [symbols[-at] + symbols[1 - at]]
                scores.append(best)
                first.append(symbols[0])
                last.append(symbols[-1])
            # The end of each history is one more merge that never comes.
            self.history[i] = ((*scores, _NONE), first, last) if len(symbols) == 1 else None
        return self.history[i]

    def compatible(self, a: int, b: int) -> bool:
        """Whether no join over the border comes before the merges inside ``a`` and ``b``."""
        score_a, _, last = self.merges(a)
        score_b, first, _ = self.merges(b)
        i = j = 0
        while True:
            join = self.score_of.get(last[i] + first[j], _NONE)
            if join > score_a[i] and join >= score_b[j]:
                return False
            if score_a[i] == score_b[j] == _NONE:
                return True
            if score_a[i] >= score_b[j]:        # equal scores: the left one first, as within a text
                i += 1
            else:
                j += 1

    def fitting(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Which pieces may follow those before them (-1: the begin); each pair is tested once."""
        key = (before.astype(np.int64) + 1) * len(self.length) + piece
        known = self.pairs.get(key)
        new = np.unique(key[(known == 0) & (before >= 0)])
        if len(new):
            room = len(self.pairs.keys) // 2
            if self.pairs.used + len(new) <= room:
                self.pairs.put(new, self.tested(new))
                known = self.pairs.get(key)
            else:
                # The table is full: it begins again with the pairs at hand.
                self.pairs.clear()
                new = np.unique(key[before >= 0])
                fits = self.tested(new)
                if len(new) <= room:
                    self.pairs.put(new, fits)
                known = fits[np.minimum(np.searchsorted(new, key), len(new) - 1)]
        return (known == 1) | (before < 0)

    def tested(self, keys: np.ndarray) -> np.ndarray:
        n = len(self.length)
        return np.array([1 if self.compatible(k // n - 1, k % n) else 2 for k in keys.tolist()], dtype=np.int32)

    def last_pieces(self, code: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """For every prefix of every unit its last piece: entry p + k for the prefix of
        unit k that ends before place p, -1 for empty prefixes.

        ``begin``: first place of each unit; units are runs of vocabulary characters."""
        size = np.diff(np.r_[begin, len(code)])
        unit = np.repeat(np.arange(len(begin)), size)
        place = np.arange(len(code)) - begin[unit]
        end, length, piece = self.automaton.matches(code, size[unit] - place - 1)
        last = np.full(len(code) + len(begin), -1, dtype=np.int32)
        owner = unit[end - 1]
        slot = end + owner
        step = np.minimum(end - begin[owner], WIDE + 1).astype(np.uint8)
        # Short units: all their prefixes of one length at a time.
        short = size[owner] <= WIDE
        order = np.flatnonzero(short)[np.argsort(step[short], kind="stable")]
        bounds = np.searchsorted(step[order], np.arange(1, WIDE + 2))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            now = order[a:b]
            if len(now):
                good = now[self.fitting(last[slot[now] - length[now]], piece[now])]
                last[slot[good]] = piece[good]
        # Long ones: place by place.
        if not short.all():
            rest = np.flatnonzero(~short)
            rest = rest[np.argsort(slot[rest], kind="stable")]
            tail, fits, n = last.tolist(), {}, len(self.length)
            for s, k, i in zip(slot[rest].tolist(), length[rest].tolist(), piece[rest].tolist(), strict=True):
                before = tail[s - k]
                if before >= 0:
                    fit = fits.get(before * n + i)
                    if fit is None:
                        if len(fits) >= KEPT_PAIRS:
                            fits.clear()
                        fit = fits[before * n + i] = self.compatible(before, i)
                    if not fit:
                        continue
                tail[s] = i
            last = np.array(tail, dtype=np.int32)
        return last

    def ids_of(self, point: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts between borders of a text (code points), and where each part's begin."""
        code = self.automaton.code[point]
        known = code > 0
        # Units: what parts and characters outside the vocabulary leave.
        starts = np.zeros(len(code), dtype=bool)
        starts[border[:-1]] = True
        starts[1:] |= ~known[:-1]
        place = np.flatnonzero(known)
        begin = np.flatnonzero(starts[place])
        last = self.last_pieces(code[place], begin)
        # Backwards: a piece for each unit that is not yet at its begin.
        unit = np.arange(len(begin))
        slot = np.r_[begin[1:], len(place)] + unit
        at, ids = [], []
        while len(unit):
            piece = last[slot]
            slot = slot - self.length[piece]
            at.append(place[slot - unit])
            ids.append(piece)
            left = slot > begin[unit] + unit
            unit, slot = unit[left], slot[left]
        for p in np.flatnonzero(~known).tolist():
            raw = [self.vocabulary.byte[b] for b in chr(point[p]).encode("utf-8", "surrogatepass")]
            at.append(np.full(len(raw), p))
            ids.append(np.array(raw, dtype=np.int32))
        where = np.concatenate(at)
        order = np.argsort(where, kind="stable")
        return np.concatenate(ids)[order].astype(np.int32, copy=False), np.searchsorted(where[order], border)

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, a group of texts or a segment of a long one at a time."""
        made: list[list[np.ndarray]] = [[] for _ in texts]
        group: list[tuple[int, str]] = []
        size = 0
        for k, text in enumerate(texts):
            marked = _MARK + text.replace(" ", _MARK) if text else ""
            at = 0
            while at < len(marked):
                border = _BORDER.search(marked, at + SEGMENT)
                cut = border.start() if border else len(marked)
                group.append((k, marked[at:cut]))
                size += cut - at
                at = cut
                if size >= SEGMENT:
                    self.encode_group(group, made)
                    group, size = [], 0
        self.encode_group(group, made)
        return [m[0] if len(m) == 1 else np.concatenate([np.zeros(0, np.int32), *m]) for m in made]

    def encode_group(self, group: list[tuple[int, str]], made: list[list[np.ndarray]]) -> None:
        """Every distinct part of a group of texts is encoded once."""
        if not group:
            return
        point = np.frombuffer("".join(t for _, t in group).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        segment = np.cumsum([0, *(len(t) for _, t in group)])
        mark, feed = point == ord(_MARK), point == 10
        starts = feed | (mark & ~np.r_[False, mark[:-1]])
        starts[1:] |= feed[:-1]
        starts[segment[:-1]] = True
        begin = np.flatnonzero(starts)
        size = np.diff(np.r_[begin, len(point)])
        offset = np.arange(len(point)) - np.repeat(begin, size)
        # Parts by hash; whether those of one hash are equal is looked at.
        value = (point.astype(np.uint64) + np.uint64(1)) * _WEIGHT[np.minimum(offset, WIDE)]
        name = np.add.reduceat(value, begin) * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64)
        _, first, part = np.unique(name, return_index=True, return_inverse=True)
        same = size[first[part]] == size
        like = np.repeat(np.where(same, begin[first[part]], begin), size) + offset
        same &= ~np.logical_or.reduceat(point[like] != point, begin)
        other = np.flatnonzero(~same)
        part[other] = len(first) + np.arange(len(other))
        first = np.r_[first, other]
        length = size[first]
        border = np.r_[0, np.cumsum(length)]
        ids, cut = self.ids_of(point[np.repeat(begin[first] - border[:-1], length) + np.arange(border[-1])], border)
        # Back to all parts.
        count = np.diff(cut)[part]
        total = np.r_[0, np.cumsum(count)]
        every = ids[np.repeat(cut[part] - total[:-1], count) + np.arange(total[-1])]
        bounds = total[np.searchsorted(begin, segment)]
        for (k, _), a, b in zip(group, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            made[k].append(every[a:b])

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        """The text of ids, without the space that stands before every text."""
        ids = np.asarray([] if ids is None else ids, dtype=np.int64)
        if not len(ids):
            return ""
        if ids.min() < 0 or ids.max() >= len(self.texts):
            raise ValueError("an id outside the vocabulary")
        raw = self.is_byte[ids]
        if not raw.any():
            out = "".join(self.texts[ids].tolist())
        else:
            # Runs of byte ids and runs of others in turn.
            cuts = np.flatnonzero(np.diff(raw)) + 1
            out = "".join(
                shown(bytes(map(self.byte_of.__getitem__, run.tolist()))) if self.is_byte[run[0]] else "".join(self.texts[run].tolist())
                for run in np.split(ids, cuts))
        start = next((i for i in map(int, ids) if self.texts[i] or i in self.byte_of), int(ids[0]))
        return out[1:] if self.vocabulary.pieces[start].startswith(_MARK) else out


def shown(raw: bytes) -> str:
    """UTF-8 text; each byte that is no part of a character gives U+FFFD."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError as wrong:
        return raw[:wrong.start].decode("utf-8") + "�" + shown(raw[wrong.start + 1:])


_CODECS: dict[int, tuple[Vocabulary, Codec]] = {}


def worker_codec(key: int, vocabulary: Vocabulary) -> Codec:
    """This worker's codec: its tables serve later tasks too."""
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(vocabulary)
    return _CODECS[key]


def read_vocabulary(model_path: str) -> tuple[int, Vocabulary]:
    """The vocabulary of a model file (read on the driver, some MB at most) and a name for it."""
    with open(model_path, "rb") as f:
        model = f.read()
    return hash(model), vocabulary(model)       # proved once for a model


def encoded(docs: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """The ``keep`` columns and the ids of every text, as an array column ``ids``."""
    key, pieces = read_vocabulary(model_path)

    def encode(texts: list[str | None]) -> list:
        from paddock.llm import piece_codec as worker

        return [worker.worker_codec(key, pieces).encode_all(texts)]

    return with_computed(docs, list(keep), "text", encode, f"{ids} array<int>")


def decoded(coded: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``coded`` with the text that each ids array stands for."""
    key, pieces = read_vocabulary(model_path)
    keep = [c for c in coded.columns if c != text]
    schema = StructType([StructField(f"c{i}", coded.schema[c].dataType) for i, c in enumerate(keep)]).add("text", "string")
    at = keep.index(ids)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from paddock.llm import piece_codec as worker

        codec = worker.worker_codec(key, pieces)
        for batch in slices(batches):
            bounds = batch.column(at).offsets.to_numpy().tolist()
            values = batch.column(at).values.to_numpy(zero_copy_only=False)
            texts = [codec.decode(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    small_batches(coded.sparkSession)
    return coded.select(*(named(c).alias(f"c{i}") for i, c in enumerate(keep))).mapInArrow(decode, schema).toDF(*keep, text)
