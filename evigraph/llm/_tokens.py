"""Byte-level BPE ids, as the tokenizers library gives them for a file of its own.

Where the file's merges stand in the order of their ids, the same ids come several times faster from tiktoken with the ranks of
that file; texts that may hold a special token's string, texts whose long runs of white space overflow the stack of the fast one,
and other files go to the tokenizers library.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: How a byte-level tokenizer splits a text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, special = spec["model"], {t["content"] for t in spec.get("added_tokens", [])}
        self.special = sorted(special)
        self.fast = None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        made = [model["vocab"].get(a + b, -1) for a, b in merges]
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer") and made == sorted(made):
            of = _byte_of()
            ranks = {bytes(of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
            self.fast = tiktoken.Encoding("bytes", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    @lru_cache(maxsize=2)
    def at(path: str) -> Encoder:
        return Encoder(path)

    def plain(self, text: str) -> list[int]:
        """The ids, strings of special tokens taken for plain text."""
        if self.fast is not None:
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as e:  # a panic is no Exception
                if type(e).__name__ != "PanicException":
                    raise
        self.tokenizer.encode_special_tokens = True
        try:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        finally:
            self.tokenizer.encode_special_tokens = False

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()
            except BaseException as e:  # a panic is no Exception
                if type(e).__name__ != "PanicException":
                    raise
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
