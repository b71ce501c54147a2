"""Token counts of whole texts by a whole-token shortcut.

The vocabulary is examined once, on the driver, with the library itself:

* no piece holds a line feed, and none holds the space mark after another
  character, so merges never cross from a character to a following space or
  over a line feed.  Pre-tokens (a run of spaces and the characters after it,
  within a line) can therefore be counted one by one, and a text's count is
  their sum plus the line feeds;
* ``whole``: the vocabulary strings that the library encodes alone as one
  token.  A pre-token among them counts 1 without any merging.

Only the rest is merged by the library, each distinct pre-token once per worker
while it stays in a table bounded by bytes (long ones don't enter it).  If a
vocabulary does not allow the proof, ``prove`` raises.

Defined cases: NULL and empty texts have 0 bytes and 0 tokens.  Special
strings inside texts are ordinary text (the library's default).  Rows are
counted one by one, so repeated rows and NULL ids change nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from paddock.llm.common import with_computed

OVER = 4096
KEPT_BYTES = 44 << 20
KEPT_LENGTH = 64
_MARK = "▁"
_PRE = re.compile(f"{_MARK}*[^{_MARK}\n]+|{_MARK}+")


class PieceCounter:
    """Counts by the library, given ``model`` (the model file's bytes)."""

    def __init__(self, model: bytes, whole: list[str] | None = None):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.whole = dict.fromkeys(self.prove() if whole is None else whole, 1)
        self.line_feed = len(self.library.encode("\n\n")) - len(self.library.encode("\n"))
        self.known = dict(self.whole)
        self.held = 0

    def prove(self) -> list[str]:
        """Vocabulary strings that are one token alone; raises if pre-tokens aren't independent."""
        lib = self.library
        pieces = [lib.id_to_piece(i) for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        if any("\n" in p or re.search(f"[^{_MARK}]{_MARK}", p) for p in pieces):
            raise ValueError("pieces cross pre-token borders: the shortcut does not hold for this vocabulary")
        if lib.encode(" ") == lib.encode("") or len(lib.encode("a \n  b")) != len(lib.encode("a \n")) + len(lib.encode("\n  b")) - len(lib.encode("\n")):
            raise ValueError("the normaliser changes white space: the shortcut does not hold for this vocabulary")
        found = [p for p in pieces if p.startswith(_MARK) and len(p) > 1]
        found = [p for p, ids in zip(found, lib.encode([p[1:] for p in found]), strict=True) if len(ids) == 1]
        inner = [p for p in pieces if not p.startswith(_MARK)]
        start = len(lib.encode("\n"))
        return found + [p for p, ids in zip(inner, lib.encode(["\n" + p for p in inner]), strict=True) if len(ids) == start + 1]

    def merge(self, parts: list[str]) -> None:
        """The library's counts of pre-tokens that aren't known yet."""
        spaced = [p for p in parts if p[0] == _MARK]
        inner = [p for p in parts if p[0] != _MARK]
        # The library puts a space mark before each text; a line feed shields the start of a line from it.
        self.known.update((p, len(ids)) for p, ids in zip(spaced, self.library.encode([p[1:] for p in spaced], num_threads=1), strict=True) if len(p) > 1)
        start = len(self.library.encode("\n"))
        self.known.update((p, len(ids) - start) for p, ids in zip(inner, self.library.encode(["\n" + p for p in inner], num_threads=1), strict=True))
        if _MARK in spaced:
            # A lone mark: what "\n " has more than "\n".
            self.known[_MARK] = len(self.library.encode("\n ")) - start

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = _PRE.findall(_MARK + text.replace(" ", _MARK))
        counts = list(map(self.known.get, parts))
        if None in counts:
            if self.held > KEPT_BYTES:
                self.known, self.held = dict(self.whole), 0
            new = list({p for p in parts if p not in self.known})
            self.merge(new)
            counts = list(map(self.known.__getitem__, parts))
            for p in new:
                if len(p) <= KEPT_LENGTH:
                    self.held += 100 + len(p)
                else:
                    del self.known[p]
        return sum(counts) + text.count("\n") * self.line_feed


_COUNTERS: dict[bytes, PieceCounter] = {}


def counter_of(model: bytes, whole: list[str]) -> PieceCounter:
    """This worker's counter: what it has merged serves its later tasks too."""
    if model not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[model] = PieceCounter(model, whole)
    return _COUNTERS[model]


def token_counts(docs: DataFrame, model_path: str, over: int = OVER) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``.

    The model file (at most some MB) is read on the driver and sent along."""
    with open(model_path, "rb") as f:
        model = f.read()
    whole = PieceCounter(model).prove()

    def count(texts: list[str | None]) -> list:
        from paddock.llm import token_counts as worker

        tokens = list(map(worker.counter_of(model, whole).count, texts))
        return [[len((t or "").encode("utf-8", "surrogatepass")) for t in texts], tokens, [n > over for n in tokens]]

    return with_computed(docs, ["doc_id"], "text", count, "n_bytes long, n_tokens long, over_limit boolean")
