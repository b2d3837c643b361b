"""Byte-level BPE ids of whole texts: one vocabulary file, two libraries that give the same ids."""

from __future__ import annotations

import json
import os
import re
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Fixed value: the published pattern by which byte-level BPE of 50,257 ids cuts texts before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The fast library's matcher overflows its stack on a million blanks in a row; such texts go to the other one.
BLANKS = 50_000
_BLANK_RUN = re.compile(rf"\s{{{BLANKS}}}")
_loaded: dict[tuple[int, bool], ByteBpe] = {}


def byte_level(char: str) -> int:
    """The byte a character of a byte-level vocabulary stands for: visible ones for themselves, others counted from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return hidden[ord(char) - 256] if ord(char) >= 256 else ord(char)


class ByteBpe:
    """Ids of a tokenizer file. Texts that need its special tokens, or hold very long blanks, go to the file's own
    library; all others to one that takes a quarter of the time (ids follow the order of merges in such a file)."""

    def __init__(self, model: str, special_is_text: bool):
        import tiktoken
        from tokenizers import Tokenizer

        table = {chr(c): bytes([byte_level(chr(c))]) for c in [*range(33, 127), *range(161, 173), *range(174, 256), *range(256, 324)]}
        self.own = Tokenizer.from_str(model)
        self.own.encode_special_tokens = special_is_text
        self.special = [] if special_is_text else [t.content for t in self.own.get_added_tokens_decoder().values()]
        self.ranks = {b"".join(map(table.__getitem__, token)): i for token, i in json.loads(model)["model"]["vocab"].items()}
        self.fast = tiktoken.Encoding("fast", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})

    @classmethod
    def of(cls, model: str, special_is_text: bool = False) -> ByteBpe:
        key = hash(model), special_is_text
        if key not in _loaded:
            _loaded[key] = cls(model, special_is_text)
        return _loaded[key]

    def ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special) or len(text) >= BLANKS and _BLANK_RUN.search(text):
            return self.own.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        return [array("I", self.ids(t)).tobytes() for t in texts]
