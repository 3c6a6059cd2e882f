"""Token ids of whole texts with a byte-level BPE of the tokenizers library.

A text is cut before every single space or line break that follows a non-space. The
pre-tokenizer of a byte-level BPE never joins two sides of such a place, so the ids of
the text are the ids of the pieces, one after the other. Invented and rare words make the
merges the slow part; pieces repeat, so the ids of a piece are kept (up to a bound)
and only new ones go to the library.
"""

from __future__ import annotations

import re
from operator import itemgetter

#: Marks that make one pre-token when they follow a word.
_MARKS = ".,;:!?*$%&#|()"
#: White space to any of the libraries, and characters on which they may not agree.
_SPACE = re.compile("[\\s᠎​-‏⁠﻿]")
_CUT = re.compile("(?<![\\s᠎​-‏⁠﻿]) ")
_LOADED: dict[str, "Encoder"] = {}


class _Odd(Exception):
    """White space beside a cut: the pieces of such a text are not independent."""


def byte_letters() -> dict[int, str]:
    """The letter by which a byte-level BPE writes each byte: printable Latin-1 as it is, the rest from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class _Pieces(dict):
    """Piece of a text, without the space before it -> ids, by the library. A line break at its beginning has no space before it."""

    def __init__(self, encoder: "Encoder", space: str):
        super().__init__()
        self.encoder, self.space, self.written = encoder, space, "\u0120" * len(space)
        self.tokenize, self.ids, self.letters = encoder.model.tokenize, encoder.ids, encoder.letters

    def word(self, word: str) -> bytes:
        """Of one pre-token behind the space, by the library's model; letters of ASCII stand for themselves."""
        found = self.tokenize(self.written + (word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)))
        return self.ids[found[0].id] if len(found) == 1 else b"".join([self.ids[t.id] for t in found])

    def __missing__(self, piece: str) -> bytes:
        word = piece.rstrip(_MARKS)
        if word.isalpha() and (word.isascii() or max(word) <= "\u00ff"):
            out = self[word] + self.encoder.mark(piece[len(word):]) if len(word) < len(piece) else self.word(word)
        else:
            line = piece[:1] == "\n"
            rest = piece[1:] if line else piece
            if not rest or _SPACE.match(rest) or _SPACE.match(rest[-1]):
                raise _Odd
            out = self.encoder.line + self.encoder.first[rest] if line else self.encoder.library(self.space + rest)
        self[piece] = out
        return out


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str, max_kept: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.max_kept = Tokenizer.from_file(path), max_kept
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.ids = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.line, self.marks = self.library("\n"), {}
        self.first, self.later = _Pieces(self, ""), _Pieces(self, " ")

    def library(self, text: str) -> bytes:
        return b"".join([self.ids[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def mark(self, marks: str) -> bytes:
        found = self.marks.get(marks)
        if found is None:
            found = self.first.word(marks)
            if len(self.marks) < 10_000:
                self.marks[marks] = found
        return found

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(self.first) + len(self.later) > self.max_kept:
            self.first.clear()
            self.later.clear()
        pieces = text.replace("\n", " \n").split(" ")
        end = pieces.pop() if pieces[-1] == "\n" else ""  # a line break after the last word
        try:
            first = self.first[pieces[0]] if pieces[0] else b""
            rest = itemgetter(*pieces[1:])(self.later) if len(pieces) > 2 else map(self.later.__getitem__, pieces[1:])  # one call for all
            return b"".join([first, *rest, self.line if end else b""])
        except _Odd:
            pieces = _CUT.split(text)
            return b"".join([self.library(pieces[0]), *map(self.odd, pieces[1:])])

    def odd(self, piece: str) -> bytes:
        """Of a piece that follows a space and may hold or end in white space."""
        return self.library(" " + piece) if not piece or _SPACE.search(piece) else self.later[piece]


def encoder(path: str) -> Encoder:
    """The encoder of this worker process."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def release() -> None:
    """Frees what this worker process keeps of its encoders."""
    _LOADED.clear()
