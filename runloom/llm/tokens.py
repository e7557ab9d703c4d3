"""A byte-level BPE over a public vocabulary, with ids equal to those of the ``tokenizers`` library."""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken

# The split pattern and the special token that belong to the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_TEXT = "<|endoftext|>"
# The rank encoder's pattern backtracks over white space; longer runs go to the library.
LONG_RUN = 100_000
_LONG_SPACE = re.compile(r"\s{%d}" % LONG_RUN)


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves, the others for the characters from 256 on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encodes texts with a byte-level vocabulary given as the content of its JSON file.

    Texts within Latin-1 go to the rank encoder, which is four times as fast; texts beyond it, with the
    special token or with very long runs of white space go to the ``tokenizers`` library, whose
    Unicode tables decide there. Both give the same ids.
    """

    def __init__(self, spec: bytes):
        vocab = json.loads(spec)["model"]["vocab"]
        of = byte_symbols()
        self.ranks = {bytes(of[c] for c in token): i for token, i in vocab.items() if token != END_OF_TEXT}
        self.size = max(self.ranks.values()) + 2  # and the special token
        self.spec = spec
        self.rank_encoder = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.library = None
        self.lengths = np.ones(self.size, dtype=np.int64) * len(END_OF_TEXT)
        for token, i in self.ranks.items():
            self.lengths[i] = len(token)

    def _ranked(self, text: str) -> bytes:
        return self.rank_encoder.encode_to_numpy(text, disallowed_special=()).astype(self.dtype).tobytes()

    def _by_library(self, text: str) -> bytes:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.spec.decode())
            self.library.no_truncation()
            self.library.no_padding()
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian integers of ``dtype``; a null text counts as empty."""
        if not text:
            return b""
        if END_OF_TEXT in text or (len(text) >= LONG_RUN and _LONG_SPACE.search(text)):
            return self._by_library(text)
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self._by_library(text)
        return self._ranked(text)
