"""Token ids of whole texts with the tokenizers library, remembered by word.

Byte-level BPE never merges across the words that its pre-tokenizer makes. So each different word goes through the
library's BPE model once per worker and is looked up afterwards, which saves most of the work of a plain encode(). Texts that hold a
character on which the plain splitter below is not known to agree with the library's, or a special token's string, go whole
through Tokenizer.encode().
"""

from __future__ import annotations

import re
from array import array
from operator import attrgetter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

#: Fixed pattern: the library's splitter for byte-level BPE, in terms of the standard library's classes.
SPLIT = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")
#: Characters outside of these may be classed otherwise by the two libraries (superscripts, fractions, marks, separators, new letters).
ODD = re.compile("[^\\x00-\\x1b\\x20-\\x84\\x86-\\x9f\\xa1-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u017f\\u2010-\\u2027\\u20ac]")
END = 0
DEFAULT = "byte_bpe_50k.json"
#: A space at which any text may be cut without changing its words.
CUT = re.compile("(?<=[A-Za-z0-9.,]) (?=[A-Za-z0-9])")
#: Longer texts are cut there, so that working memory does not grow with them.
PART = 1_000_000
_REMEMBERED = 350_000
_LONG = 64


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a printable letter: printable ones as themselves, the rest from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_id = attrgetter("id")


class _Words(dict):
    """Ids of words as bytes (two to an id, or four for a large vocabulary), which join fast.

    Two generations are kept: when the younger is full it becomes the older, and words still in use come back from there.
    """

    def __init__(self, model, kind: str) -> None:
        self.model, self.kind, self.letters, self.older = model, kind, _byte_letters(), {}
        model._resize_cache(0)  # the library's own memory of words only costs time below this one

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            plain = word.isascii() and word.isprintable()
            letters = word.replace(" ", self.letters[0x20]) if plain else word.encode().decode("latin-1").translate(self.letters)
            found = array(self.kind, map(_id, self.model.tokenize(letters))).tobytes()
        if len(word) <= _LONG:
            if len(self) >= _REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


class Encoder:
    """Encodes texts as Tokenizer.from_file(path).encode(text, add_special_tokens=False) does."""

    def __init__(self, path: str | None = None) -> None:
        self.whole = Tokenizer.from_file(path or public_tokenizers.path(DEFAULT))
        self.kind = "H" if self.whole.get_vocab_size() <= 1 << 16 else "I"
        self.words = _Words(self.whole.model, self.kind)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]

    def ids(self, text: str) -> np.ndarray:
        if len(text) <= PART:
            return self._part(text)
        parts, at = [], 0
        while at < len(text):
            cut = CUT.search(text, min(at + PART, len(text)))
            end = cut.start() if cut else len(text)
            parts.append(self._part(text[at:end]))
            at = end
        return np.concatenate(parts)

    def _part(self, text: str) -> np.ndarray:
        if ODD.search(text) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.frombuffer(b"".join(map(self.words.__getitem__, SPLIT.findall(text))), dtype=self.kind).astype(np.uint32)

    def ended(self, text: str | None) -> np.ndarray:
        """The ids of a text (null: empty), and the id that ends a document."""
        return np.append(self.ids(text or ""), np.uint32(END))


_made: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """This worker's encoder for a vocabulary file, made once."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]


def forget() -> None:
    """Gives this worker's remembered words back, for operators that need the memory for other things."""
    for made in _made.values():
        made.words.clear()
        made.words.older = {}
