"""Token ids of the public byte-level BPE, quickly: words between single spaces are looked up in a bounded cache.

A cut before a lone space can't change the ids: no pre-token of this vocabulary holds a space after its first
character. Texts with neighbouring white space, control separators or special-token strings take the whole-text
path of the tokenizers library.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np

#: Fixed value: the pre-token pattern of this public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"
_CAREFUL = re.compile(r"\s\s|[\x1c-\x1f]|\A\s|<\|endoftext\|>")


class _Words(dict):
    """word -> ids of ' ' + word as little-endian uint32 bytes."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(" " + word), "<u4").tobytes()
        if len(self) < self.limit and len(word) < 40:
            self[word] = ids
        return ids


class ByteTokens:
    def __init__(self, json_path: str, ranks_path: str, ordinary_specials: bool = False, limit: int = 400_000):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ordinary = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.whole = Tokenizer.from_file(json_path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.whole.encode_special_tokens = ordinary_specials
        self.words = _Words(self.ordinary, limit)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian uint32 bytes, as tokenizers gives them with add_special_tokens=False."""
        if not text:
            return b""
        if _CAREFUL.search(text):
            if "<|" not in text and not re.search(r"[\x1c-\x1f]", text):
                return np.array(self.ordinary(text), "<u4").tobytes()
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        return np.array(self.ordinary(first), "<u4").tobytes() + b"".join(map(self.words.__getitem__, rest))


@functools.lru_cache(maxsize=4)
def byte_tokens(json_path: str, ranks_path: str, ordinary_specials: bool = False) -> ByteTokens:
    """One tokenizer for each Python worker."""
    return ByteTokens(json_path, ranks_path, ordinary_specials)
