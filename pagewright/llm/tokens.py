"""Token ids of whole texts by the ``tokenizers`` library and a public byte-level BPE vocabulary.

The library looks at one piece of text at a time: its split rule cuts a text
into words with the space before them, numbers, other marks and runs of white
space, and merges never cross a cut.  So a piece has the same ids wherever it
stands, and the library needs to see it only once: pieces are cut here by the
same rule and looked up; the library's model encodes those that are new.

The rule here is written with Python's character classes.  They agree with
the library's on the characters of Unicode 3.2 but for a few, which are found
by their properties; a text with any other character goes to the library whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

PIECE = 1 << 18  # characters encoded at a time
KEPT = 1_000_000  # pieces remembered; beyond it they are forgotten and encoded again
# The split rule starts a new token at a single space between two non-space
# characters, so a text may be cut there.
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
# Fixed value: the vocabulary's split rule, letters as [^\W\d_] and numbers as \d.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def _agrees(ch: str) -> bool:
    """Python's classes hold for a character as the library's do."""
    import unicodedata

    kind = unicodedata.ucd_3_2_0.category(ch)
    white = kind[0] == "Z" or ch in "\t\n\v\f\r\x85"
    return (kind != "Cn" and kind not in ("Nl", "No") and ch.isalpha() == (kind[0] == "L") and ch.isdecimal() == (kind == "Nd")
            and ch.isspace() == white and ch.isalnum() == (kind[0] == "L" or kind == "Nd"))


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: itself if it prints, else the next one from 256 on."""
    printing = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in printing else next(others)) for b in range(256)}


class Pieces(dict):
    """Ids of a piece as bytes, unsigned 32-bit; what is not known yet is asked of the library's model."""

    def __init__(self, library):
        self.model, self.letters = library.model, _byte_letters()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= KEPT:
            self.clear()
        spelled = piece.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Encoder:
    """``encode(text)`` gives the ids as unsigned 32-bit numbers, without special tokens."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.known = Pieces(self.library)
        self.plain: set[str] = set()
        self.odd: set[str] = set()

    def _simple(self, text: str) -> bool:
        new = set(text) - self.plain
        if new:
            for ch in new - self.odd:
                (self.plain if _agrees(ch) else self.odd).add(ch)
            return not new & self.odd
        return True

    def encode(self, text: str):
        import numpy as np

        parts = []
        for part in _parts(text):
            if self._simple(part):
                parts.append(b"".join(map(self.known.__getitem__, SPLIT.findall(part))))
            else:
                parts.append(np.array(self.library.encode(part, add_special_tokens=False).ids, "<u4").tobytes())
        return np.frombuffer(b"".join(parts), "<u4")


def shared_encoder(vocabulary: str) -> Encoder:
    """One encoder per worker process: what it remembers serves the next task too."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_pagewright_encoders", {})
    if vocabulary not in kept:
        kept[vocabulary] = Encoder(vocabulary)
    return kept[vocabulary]


def _parts(text: str) -> Iterator[str]:
    """``text`` in parts of about ``PIECE`` characters, cut where no token can span."""
    at = 0
    while at < len(text):
        cut = SAFE_CUT.search(text, at + PIECE) if len(text) - at > PIECE else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end
