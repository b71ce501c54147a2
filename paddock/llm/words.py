"""Words, shingles and character hashes of whole texts as numpy arrays.

Helpers used inside tasks (one Arrow batch at a time).  Words are the
contract's ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; hashing works on
the UTF-8 bytes of many texts at once.  A polynomial hash modulo 2**64 over
random byte values gives each word a 64-bit value from two prefix sums; it
does not depend on the text's position, batch or machine.  Memory is bounded
by ``CHUNK`` bytes of text (or by one word, if a word is longer than that).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 20
SHINGLE = 5

_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = _rng.integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the largest n seen."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, CHUNK + 64), base, dtype=np.uint64)
        step[0] = 1
        have = _powers[base] = np.multiply.accumulate(step)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hash_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the block's words and the byte offset where each begins."""
    raw = np.frombuffer(block, dtype=np.uint8)
    word = np.zeros(len(raw) + 2, dtype=np.int8)
    word[1:-1] = ~_SPACE[raw]
    edge = np.diff(word)
    start = np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, np.uint64), start
    end = np.flatnonzero(edge == -1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_LOWER[raw] * _power(_BASE, len(raw)), out=total[1:])
    return mix((total[end] - total[start]) * _power(_INVERSE, len(raw))[start]), start


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text cut at white space into parts of about CHUNK bytes."""
    at = 0
    while len(text) - at > CHUNK:
        cut = max(text.rfind(b" ", at + 1, at + CHUNK), text.rfind(b"\n", at + 1, at + CHUNK))
        if cut <= at:
            ends = [x for x in (text.find(b" ", at + CHUNK), text.find(b"\n", at + CHUNK)) if x > 0]
            cut = min(ends, default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the 64-bit hashes of its words, in order (None: none)."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    group: list[bytes] = []
    first, held = 0, 0

    def flush() -> None:
        nonlocal group, held
        if group:
            hashes, start = _hash_block(b" ".join(group))
            bounds = np.cumsum([0] + [len(g) + 1 for g in group])
            for k, (a, b) in enumerate(zip(*(np.searchsorted(start, x) for x in (bounds[:-1], bounds[1:])), strict=True)):
                out[first + k] = hashes[a:b]
        group, held = [], 0

    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if held + len(raw) > CHUNK:
            flush()
            first = i
        if len(raw) > CHUNK:
            out[i] = np.concatenate([_hash_block(p)[0] for p in _pieces(raw)])
            first = i + 1
            continue
        group.append(raw)
        held += len(raw) + 1
    flush()
    return out


def each_words(texts: list[str | None], at_once: int = 512) -> Iterator[np.ndarray]:
    """``word_hashes`` of many texts, a few at a time."""
    for at in range(0, len(texts), at_once):
        yield from word_hashes(texts[at:at + at_once])


def shingles(words: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words.

    Fewer words than that: the whole sequence as one; no words: empty."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    total = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        total += words[k:k + n] * _MULT[k]
    return np.unique(mix(total + np.uint64(width)))


def packed(values: np.ndarray) -> bytes:
    """Little-endian bytes of an array, as kept in binary columns."""
    return np.ascontiguousarray(values).astype(values.dtype.newbyteorder("<"), copy=False).tobytes()


def unpacked(raw: bytes | None, dtype: str = "<u8") -> np.ndarray:
    return np.frombuffer(raw or b"", dtype=dtype)
