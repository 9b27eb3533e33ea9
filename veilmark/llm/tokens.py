"""Encoding whole texts with the tokenizers library, a chunk between spaces at a time.

The vocabulary used here drops white space between words and never merges across it, so a text's
ids are its space-separated chunks' ids in order. Chunks repeat heavily; each distinct one (a final
mark and most capitals apart) goes to the library once per worker and its ids are kept as little-endian 32-bit bytes, so a text is a
join of bytes.
Only U+0020 and U+000A split here; any other white space stays inside a chunk and is the library's
matter. ``tests/llm`` holds this against encoding the whole text at once.
"""

from __future__ import annotations

import os
import sys
import unicodedata
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism

import public_tokenizers
from tokenizers import Tokenizer

from veilmark.llm.common import CACHES, give_back, release_caches

assert sys.byteorder == "little" and array("I").itemsize == 4

#: Chunks in each of the two generations that a worker remembers, which bounds its memory.
MEMO_ENTRIES = 350_000
#: Longer chunks are encoded but not remembered.
MEMO_CHUNK = 64
_MARKS = frozenset(",.!?;:")


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level BPE writes for each byte: itself if it prints, else the next from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: b if b in prints else next(rest) for b in range(256)}


_LETTERS = _byte_letters()


class _Memo(dict):
    """Ids of chunks as little-endian unsigned 32-bit bytes; a missing one is encoded."""

    def __init__(self, path: str, entries: int):
        self._entries = entries
        self._tok = Tokenizer.from_file(path)
        self._model = self._tok.model
        self._old: dict[str, bytes] = {}
        self._long: list[str] = []

    def ids(self, text: str) -> list[int]:
        return self._tok.encode(text, add_special_tokens=False).ids

    def word(self, word: str) -> list[int]:
        """Ids of a word of lower-case letters in normal form: the model's alone."""
        return [t.id for t in self._model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS))]

    def renew(self) -> None:
        """Forgets long chunks and, when full, all that was not used since the last time."""
        for c in self._long:
            self.pop(c, None)
        self._long.clear()
        if len(self) > self._entries:
            self._old = dict(self)
            self.clear()

    def __missing__(self, chunk: str) -> bytes:
        got = self._old.get(chunk)
        if got is None:
            word = chunk[:-1] if chunk[-1:] in _MARKS else chunk
            low = word.lower()
            # Letters below U+0250 stay one word in the tokenizer's steps (normal form, lower case, split): checked, not assumed.
            if word.isalpha() and (word.isascii() or low.isalpha() and max(low) < "\u0250" and unicodedata.is_normalized("NFC", word)):
                if word is not chunk:
                    got = self[low] + self[chunk[-1]]
                elif low != word:
                    got = self[low]
                else:
                    got = array("I", self.word(word)).tobytes()
            else:
                got = array("I", self.ids(chunk)).tobytes()
        if len(chunk) > MEMO_CHUNK:
            self._long.append(chunk)
        self[chunk] = got
        return got


def _lowered(text: str) -> str:
    """A text of characters below U+0100 in lower case, so that a word is remembered once; others as they are.

    All of these are in normal form and have a lower case of one character, so the ids stay.
    """
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
    return text.lower()


class Encoder:
    """``ids_of(texts)``: the ids of each text as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, entries: int = MEMO_ENTRIES):
        self._memo = _Memo(path, entries)
        ids = self._memo.ids
        #: Whether chunks can be encoded apart; else whole texts are.
        self._apart = ids("Ab, c\nab") == [*ids("ab"), *ids(","), *ids("c"), *ids("ab")] and ids(" ") == [] and self._memo.word("abé") == ids("abé")

    def ids_of(self, texts: list[str]) -> list[bytes]:
        memo = self._memo
        if not self._apart:
            return [array("I", memo.ids(t)).tobytes() for t in texts]
        out = []
        for t in texts:
            out.append(b"".join(map(memo.__getitem__, _lowered(t).replace("\n", " ").split(" "))))
            memo.renew()
        return out


_ENCODERS: dict[tuple[str, int], Encoder] = {}
CACHES.append(_ENCODERS)


def encoder(path: str, entries: int = MEMO_ENTRIES) -> Encoder:
    """The worker's encoder of a vocabulary file, made once per process; ``entries`` bounds each generation of its memory."""
    if (path, entries) not in _ENCODERS:
        release_caches()
        give_back()
        _ENCODERS[path, entries] = Encoder(path, entries)
    return _ENCODERS[path, entries]


def default_vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")
