"""Encoding of whole texts with a `tokenizers` file, through a cache of words.

A text is cut at single spaces. Before each of them the byte-level pre-tokenizer
starts a new word, so the pieces can be encoded one by one, and most of them were
met before. A word that wasn't is pre-split and its parts given to the library's BPE
model. Texts in which a space meets other white space, or which spell a special
token, go to the library whole, and so do words with characters of which two versions
of Unicode may differ. Either way the ids are the library's.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from .common import held
from .unicode_classes import PRE_SPLIT

#: From here on a letter of one version of Unicode may not be one of another.
UNSURE = "\u0530"


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, the
    other bytes, in order, for the characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}

#: Letters, then ASCII marks without the apostrophe (which may begin a contraction) and the brackets of special tokens.
letters_then_marks = re.compile(r"([^\W\d_]+)([!\"#$%&()*+,\-./:;=?@\[\]^`{}~]+)").fullmatch


class NotCut(Exception):
    """The text can't be cut at this space."""


class Words(dict):
    """ids of words after a space. Letters are kept, and what is short; other words are put together
    from their parts. When there are ``most`` words they become the old ones and those that were old are
    dropped, but a word that is met again moves on: this bounds memory, not what is encoded.
    ``whole`` encodes a text that isn't cut, ``part`` one part of the pre-split, ``none`` is no ids."""

    def __init__(self, whole, part, join, special, most: int, pre_split=None):
        super().__init__()
        self.whole, self.part, self.join, self.special, self.most = whole, part, join, special, most
        self.marks: dict = {}
        self.old: dict = {}
        self.pre_split = pre_split or re.compile(PRE_SPLIT).findall

    def trim(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        if len(self.marks) > self.most:
            self.marks.clear()

    def mark(self, run: str):
        """ids of a part of the pre-split; short ones are kept."""
        got = self.marks.get(run)
        if got is None:
            got = self.get(run[1:]) if run[0] == " " else None
            if got is None:
                got = self.part(run)
                if len(run) <= 32:
                    self.marks[run] = got
        return got

    def __missing__(self, w: str):
        if (got := self.old.get(w)) is not None:
            self[w] = got
            return got
        if w.isalpha() and max(w) < UNSURE:
            got = self.part(" " + w)
            if len(w) <= 32:
                self[w] = got
            return got
        if (cut := letters_then_marks(w)) and (letters := cut[1]).isalpha() and max(letters) < UNSURE:
            got = self.join((self[letters], self.mark(cut[2])))  # a run of marks is one part, whatever letters come before
        elif not w or w[0].isspace() or self.special(w):
            raise NotCut
        elif max(w) >= UNSURE:
            return self.whole(" " + w)
        else:
            parts = self.pre_split(" " + w)
            got = self.join([self[p[1:]] if len(parts) > 1 and p[0] == " " and p[1:].isalpha() else self.mark(p) for p in parts])
        if len(w) <= 10:
            self[w] = got
        return got


class CachedEncoder:
    """ids of texts as little-endian bytes of ``dtype``."""

    def __init__(self, path: str, most: int = 325_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.tokenize = self.tok.model.tokenize
        special = sorted(t.content for t in self.tok.get_added_tokens_decoder().values())
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)").search
        self.code = "H" if max(self.tok.get_vocab(with_added_tokens=True).values()) < 65536 else "I"
        self.dtype = np.dtype(self.code)
        self.to_alphabet = {b: c for c, b in byte_alphabet().items()}
        self.words = Words(self._whole, self._part, b"".join, self.special, most)

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        return array(self.code, [t.id for t in self.tokenize(part.encode().decode("latin-1").translate(self.to_alphabet))]).tobytes()

    def encode_one(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if first[:1].isspace() or self.special(first):
            return self._whole(text)
        self.words.trim()
        try:
            return (self._whole(first) if first else b"") + b"".join(map(self.words.__getitem__, rest))
        except NotCut:
            return self._whole(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        return list(map(self.encode_one, texts))


def encoder(path: str) -> CachedEncoder:
    """The worker's encoder of this file; it and its cache outlive the task."""
    return held(f"encoder {path}", lambda: CachedEncoder(path))
