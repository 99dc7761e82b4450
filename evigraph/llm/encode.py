"""Token ids by a ``tokenizers`` file, remembering the ids of units that stand between spaces."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

from tokenizers import Tokenizer

SPACE_BEFORE_SPACE = re.compile(r" \s")
UNIT_START = re.compile(r"(?= \S)")
#: Neither letters, digits nor white space, and none begins a contraction: a run of them behind a word is a pre-token.
MARKS = "!.,?;:%$#&*"
LONGEST_UNIT = 64


def _visible_bytes() -> dict[int, str]:
    """The characters by which byte-level vocabularies write bytes: printable ones as they are, the others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


VISIBLE = _visible_bytes()
SPACE = VISIBLE[32]


class Units(dict):
    """Ids by unit, found on first use. A word with only marks behind it is put together from the word and the marks.

    A word of letters up to U+00FF is one pre-token that normal forms leave alone, so it goes straight to the BPE model.
    """

    def __init__(self, tokenizer: Tokenizer, spaced: bool):
        super().__init__()
        self.tokenizer, self.model, self.spaced, self.marks = tokenizer, tokenizer.model, spaced, {}

    def plain(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        if not self.spaced:
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(VISIBLE)
        return array("I", [t.id for t in self.model.tokenize(SPACE + word if self.spaced else word)]).tobytes()

    def __missing__(self, unit: str) -> bytes:
        word = unit.rstrip(MARKS)
        if word.isalpha() and (word.isascii() or max(word) <= "\xff"):
            if len(word) == len(unit):
                ids = self._word(unit)
            else:
                tail = unit[len(word) :]
                if tail not in self.marks:
                    self.marks[tail] = self.plain(tail)
                ids = self[word] + self.marks[tail]
        else:
            ids = self.plain(" " + unit if self.spaced else unit)
        if len(unit) <= LONGEST_UNIT:
            self[unit] = ids
        return ids


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, equal to ``Tokenizer.encode`` without special tokens.

    No pre-token of the supported files goes on past a space that is followed by a non-space, so text is cut there and
    each distinct unit is encoded once. ``spaced`` says that a unit owns the space in front of it (byte-level BPE);
    otherwise white space carries no ids. The memory is emptied at ``most_units``; long units are never kept.
    """

    def __init__(self, path: str, spaced: bool, most_units: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.spaced, self.most_units = spaced, most_units
        self.units = Units(self.tokenizer, spaced)

    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def encode(self, text: str) -> bytes:
        if self.spaced and SPACE_BEFORE_SPACE.search(text):
            first, *others = (u[i > 0 :] for i, u in enumerate(UNIT_START.split(text)))
        else:
            first, *others = text.split(" ")
        if len(self.units) + len(self.units.marks) > self.most_units:
            self.units.clear()
            self.units.marks.clear()
        return self.units.plain(first) + b"".join(map(self.units.__getitem__, others))


@lru_cache(maxsize=4)
def encoder(path: str, spaced: bool) -> Encoder:
    """One per Python worker."""
    return Encoder(path, spaced)
