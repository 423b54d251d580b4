"""Token ids of whole texts by a public tokenizer file, through the tokenizers library.

Both vocabularies in use cut a text before tokenization in such a way that a single blank between two characters
that aren't white space is a border no token crosses. The text is split there; the pieces, mostly words, recur, so
each worker remembers the ids of a bounded number of them. A new piece of plain letters and punctuation goes to the
library's model, any other to the library's whole pipeline.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: A blank that no token crosses: characters that no definition counts as white space stand on both sides.
_SOLID = "[^\\s\x1c-\x1f\x85​﻿]"
BORDER = re.compile(f"(?<={_SOLID}) (?={_SOLID})")
#: Letters that stay alone under NFC, then punctuation: cut by either vocabulary's pattern into these two at most.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įĲ-ɏ]*)([!-/:-@\[-`{-~]*)")


#: How byte-level vocabularies print a blank.
BLANK = "Ġ"


def _visible() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: other bytes take the code points from 256 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Memory(dict):
    """Ids by piece, in two generations: the older one goes when the newer one is full."""

    def __init__(self, compute, most: int) -> None:
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, piece: str) -> bytes | None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        ids = self.old[piece] if piece in self.old else self.compute(piece)
        if len(piece) < 100:
            self[piece] = ids
        return ids


class Encoder:
    """encode(texts) gives, for each text, its ids as little-endian unsigned 32-bit integers.

    They are those of the library's encode(text, add_special_tokens=False); texts in which the file's special tokens
    are spelled out go through it whole.
    """

    def __init__(self, path: str, remember: int = 500_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()) or r"(?!)")
        self.tokenize = self.library.model.tokenize
        self.visible = _visible()
        blank = self.library.encode("a b", add_special_tokens=False).tokens[-1]
        #: Whether the blank before a word is part of its token; else words are lower-cased and blanks dropped.
        self.keeps_blank = blank == f"{BLANK}b"
        if not self.keeps_blank and blank != "b</w>":
            raise ValueError("this kind of vocabulary isn't supported")
        #: A line feed between such characters is cut off likewise: a token of its own, or dropped.
        self.line_end = self.whole("\n") if self.keeps_blank else b""
        self.bytes_of = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]
        self.marks = _Memory(self.part, remember // 10)
        self.hidden = {k: v for k, v in self.visible.items() if k > 126}
        self.inner = _Memory(lambda p: self.piece(p, " "), remember)
        self.heads = _Memory(lambda p: self.piece(p, ""), remember // 10)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, piece: str, before: str) -> bytes | None:
        """None, where the piece is empty or has white space at an end, so that it can't be taken alone."""
        if piece.isascii() and piece.isalpha():
            return self.letters(piece, before)
        m = PLAIN.fullmatch(piece)
        if m is None or not piece:
            odd = not piece or BORDER.search(f"x {piece}") is None or BORDER.search(f"{piece} x") is None
            return None if odd else self.whole(before + piece)
        letters, marks = m.groups()
        if not letters:
            return self.marks[before + marks if self.keeps_blank else marks]
        return self.letters(letters, before) + self.marks[marks] if marks else self.letters(letters, before)

    def letters(self, letters: str, before: str) -> bytes:
        """The ids of letters alone, a blank before them where the vocabulary keeps it."""
        seen = letters if self.keeps_blank else letters.lower()
        if not seen.isascii():
            seen = seen.encode().decode("latin-1").translate(self.hidden)
        if before and self.keeps_blank:
            seen = BLANK + seen
        bytes_of = self.bytes_of
        return b"".join([bytes_of[t.id] for t in self.tokenize(seen)])

    def part(self, marks: str) -> bytes:
        return self.letters(marks.removeprefix(" "), " " if marks[:1] == " " else "")

    def encode(self, texts: list[str]) -> list[bytes]:
        out, inner, heads = [], self.inner.__getitem__, self.heads.__getitem__
        for text in texts:
            if self.special.search(text):
                out.append(self.whole(text))
                continue
            try:
                lines = []
                for line in text.split("\n") if text else ():
                    head, *pieces = line.split(" ")
                    lines.append(heads(head) + b"".join(map(inner, pieces)))
                out.append(self.line_end.join(lines))
            except TypeError:  # a piece that can't be taken alone
                first, *rest = BORDER.split(text)
                out.append(b"".join([self.whole(first), *(self.whole(f" {p}") for p in rest)]))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary(name: str) -> str:
    """The path of an installed public vocabulary, as the machine that asks sees it; a path stays as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
