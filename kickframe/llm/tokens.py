"""Token ids of whole texts by a tokenizers file, each distinct word encoded once.

Words between which a tokenizer can never merge are encoded apart and kept, so a
corpus costs one encoding per distinct word and worker. The ids equal those of
the whole text; what the rule doesn't cover is encoded whole.
"""

from __future__ import annotations

import re
import sys
from array import array
from unicodedata import is_normalized

import numpy as np
from tokenizers import Tokenizer

from kickframe.llm.batches import claim

#: Words of a generation and the longest word that is kept. Two generations take some 165 MB of a worker.
_KEPT, _LONG = 500_000, 100
#: Marks that follow a word; with a letter before them they begin a new piece in every supported rule.
_TAILS = frozenset(".,;:!?")
#: Between blanks, runs of these at a word's end are one piece that a letter before is never merged with, unless an added token holds them.
_RUNS = ".,;:!?#$%&*"
#: White space other than blank and line feed.
_ODD = re.compile(r"[^\S \n]")
#: White space beyond ASCII's; a tokenizer file may or may not see a border in it.
_OTHER = re.compile(r"[^\S \t\n\r\x0b\x0c]")
#: Begins the name of a byte-level word without a blank before it; white space, so no word begins with it.
_BARE = "\r"
#: Letters whose lower case depends on what stands beside them, or isn't one letter.
_CASES = re.compile("[\u0130\u03a3]")
#: The fixed rule of byte-level vocabularies: printable bytes stand for themselves, the others follow in order from 256.
_KEEP = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _KEEP)}
_loaded: dict[str, Encoder] = {}


class _Known(dict):
    """Ids by word; learns what it is asked for, unless it is very long."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, word: str) -> bytes:
        ids = self.learn(word)
        if len(word) <= _LONG:
            self[word] = ids
        return ids


class Encoder:
    """`ids(texts)` gives a byte string of little-endian ids per text.

    `words` says how the file treats blanks: "byte" keeps a blank as the first
    byte of the word after it (byte-level vocabularies with that rule), "blank" drops
    white space between words, "none" encodes texts whole.
    """

    def __init__(self, path: str, words: str, kept: int = _KEPT):
        self.kept = kept
        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = self.tokenizer.model.tokenize
        self.words = words
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.char = self.dtype.char
        added = {c for t in self.tokenizer.get_added_tokens_decoder().values() for c in t.content}
        self.runs = "".join(c for c in _RUNS if c not in added)
        self.known = _Known(self._learn)
        self.before: dict[str, bytes] = {}  # the previous generation, asked before the tokenizer

    def _one(self, word: str) -> bytes:
        """Ids of a word; one of letters only goes to the model at once, as it is a single piece."""
        if self.words == "none":
            return self._whole(word)
        blank, raw = "", word
        if self.words == "byte":
            if word[:1] == _BARE:
                word = word[1:]
            elif word[:1] != "\n":
                blank = " "
        elif not _CASES.search(word):
            word = word.lower()
        if not word.isalpha():
            return self._whole(blank + word if self.words == "byte" else raw)
        if word.isascii():
            return self._packed([t.id for t in self.pieces("\u0120" + word if blank else word)])
        if self.words == "byte" or (is_normalized("NFC", word) and not _CASES.search(word)):
            word = (blank + word).encode().decode("latin-1").translate(_BYTES)
            return self._packed([t.id for t in self.pieces(word)])
        return self._whole(raw)

    def _whole(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _packed(self, ids: list[int]) -> bytes:
        return array(self.char, ids).tobytes() if sys.byteorder == "little" else np.array(ids, self.dtype).tobytes()

    def _parts(self, text: str) -> list[str]:
        if self.words == "blank" and not _OTHER.search(text):
            return text.split()
        if self.words == "byte" and not _ODD.search(text):
            # A lone blank or line feed between words starts the next one; a word is named without its blank.
            out = text.replace("\n", " \n").split(" ")
            if "" not in out and "\n" not in out:
                out[0] = _BARE + out[0]
                return out
        return [_BARE + text] if self.words == "byte" else [text]

    def _learn(self, word: str) -> bytes:
        """Ids of an unknown word; a mark after a letter is never merged with it, so what stands before is looked up."""
        ids = self.before.get(word)
        if ids is None and self.words == "blank":
            if word.isalpha():
                return self._packed([t.id for t in self.pieces(word.lower())]) if word.isascii() else self._one(word)
            stem = word.rstrip(self.runs)
            if len(stem) < len(word) and stem[-1:].lower().isalpha():
                return self.known[stem] + self.known[word[len(stem):]]
            return self._one(word)
        if ids is None:
            if word[-1:] in _TAILS and self.words != "none" and word[-2:-1].lower().isalpha():
                return self.known[word[:-1]] + self.known[_BARE + word[-1] if self.words == "byte" else word[-1]]
            ids = self._one(word)
        return ids

    def ids(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.kept:
            self.before, self.known = self.known, _Known(self._learn)
        get, parts = self.known.__getitem__, self._parts
        return [b"".join(map(get, parts(t))) for t in texts]


def encoder(path: str, words: str, kept: int = _KEPT) -> Encoder:
    """One encoder per worker process."""
    claim("tokens", _loaded.clear)
    key = f"{words}:{kept}:{path}"
    if key not in _loaded:
        _loaded[key] = Encoder(path, words, kept)
    return _loaded[key]
