"""Exact BPE encoding by backtracking over longest token matches, and decoding from an offset table."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from runloom.llm.common import map_arrow, per_worker
from runloom.llm.tokens import byte_symbols

# The split pattern, word end and special tokens that belong to the word-end vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
SPECIAL = ("<|startoftext|>", "<|endoftext|>")

# The word end as one symbol that no byte stands for, so that a token is a string of symbols.
MARK = "\uffff"
HELD = 400_000  # words, and pairs, remembered by a worker before it starts anew
ENCODED = "n_tokens long, ids string, decoded string"


class WordBpe:
    """A byte-level BPE with word ends, from the content of its JSON file.

    ``encode`` gives the ids of the ``tokenizers`` library: special tokens are cut out first, the rest is
    normalised (NFC, white space, lower case), split into words, and each word encoded alone.

    A word is encoded in one pass. An Aho-Corasick automaton finds all tokens in it, and the encoder
    takes the longest at each place, provided that it is compatible with the token before: that the
    merges of the two side by side lead to the two themselves. A sequence whose neighbours are all
    compatible is what the merges give for the word, so the first that reaches the end is the answer.
    If no token fits, the encoder falls back to a shorter one before, and places that led nowhere are
    not tried again. Compatibilities are a table that fills as pairs are met.
    """

    def __init__(self, spec: bytes):
        content = json.loads(spec)
        model = content["model"]
        of = byte_symbols()
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        plain = {t: i for t, i in model["vocab"].items() if t not in self.special}

        def symbols(token: str) -> str:
            """One character per byte, then the mark at a word end."""
            ends = token.endswith(WORD_END) and token != WORD_END
            return "".join([chr(of[c]) for c in (token[: -len(WORD_END)] if ends else token)]) + MARK * ends

        self.ids = {symbols(t): i for t, i in plain.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(symbols(a), symbols(b)): k for k, (a, b) in enumerate(pairs)}
        self.token = {i: t for t, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            if self.merged(self.atoms(token)) == [token]:  # others never come of merges
                self.automaton.add_word(token, (i, len(token)))
        self.automaton.make_automaton()
        self.compatible: dict[int, bool] = {}
        self.words: dict[str, tuple[int, str, str]] = {}
        self.split = regex.compile(PATTERN)
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in self.special) + ")") if self.special else None
        # The offset table: where the text of each id begins and ends in one string.
        by_id = {i: t for t, i in plain.items()} | {i: t for t, i in self.special.items()}
        size = max(by_id) + 1
        texts = [by_id.get(i, "") for i in range(size)]
        self.blob = "".join(texts)
        self.offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).tolist()

    def merged(self, parts: list[str]) -> list[str]:
        """The definition: join the pair of the lowest rank, the leftmost first, until none is left."""
        parts = list(parts)
        while len(parts) > 1:
            ranks = [(self.merges.get(p, len(self.merges)), k) for k, p in enumerate(zip(parts, parts[1:], strict=False))]
            rank, k = min(ranks)
            if rank == len(self.merges):
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    @staticmethod
    def atoms(symbols: str) -> list[str]:
        """Single symbols; the mark belongs to the one before."""
        out = list(symbols)
        if len(out) > 1 and out[-1] == MARK:
            out[-2:] = [out[-2] + MARK]
        return out

    def _fit(self, a: int, b: int) -> bool:
        """The compatibility table: whether two tokens side by side are what their symbols merge to."""
        pair = a << 20 | b
        found = self.compatible.get(pair)
        if found is None:
            if len(self.compatible) >= HELD:
                self.compatible.clear()
            left, right = self.token[a], self.token[b]
            found = self.compatible[pair] = self.merged(self.atoms(left + right)) == [left, right]
        return found

    def encode_word(self, symbols: str) -> list[int]:
        """Ids of one word, given as a character per byte and the mark."""
        size, at, path = len(symbols), 0, []
        for last, (token, length) in self.automaton.iter_long(symbols):
            if last + 1 - length != at or path and not self._fit(path[-1], token):
                return self._search(symbols)
            path.append(token)
            at = last + 1
        return path if at == size else self._search(symbols)

    def _search(self, symbols: str) -> list[int]:
        """The same with shorter matches where the longest ones do not fit."""
        size = len(symbols)
        matches: list[list[tuple[int, int]]] = [[] for _ in range(size)]  # by first symbol, the longest last
        for last, (token, length) in self.automaton.iter(symbols):
            matches[last + 1 - length].append((token, length))
        path: list[tuple[int, int]] = []
        left = [len(matches[0])]  # matches not yet tried at each place of the path
        # A compatible way to a place is the encoding of what lies before it, so there is only one
        # such way: a place that was left once is never entered again.
        dead = [False] * (size + 1)
        at = 0
        while at < size:
            while left[-1]:
                left[-1] -= 1
                token, length = matches[at][left[-1]]
                if not dead[at + length] and (not path or self._fit(path[-1][0], token)):
                    path.append((token, length))
                    at += length
                    left.append(len(matches[at]) if at < size else 0)
                    break
            else:
                if not path:  # only with an incomplete alphabet
                    raise ValueError("the vocabulary cannot spell every byte")
                dead[at] = True
                at -= path.pop()[1]
                left.pop()
        return [token for token, _ in path]

    def word(self, text: str) -> tuple[int, str, str]:
        """(tokens, ids as text, decoded text) of a word; the texts begin with a space."""
        ids = self.encode_word(text.encode("utf-8", "surrogatepass").decode("latin-1") + MARK)
        return len(ids), "".join([f" {i}" for i in ids]), " " + self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        """Token texts joined by spaces, as the library does for a vocabulary without a decoder."""
        offsets, blob = self.offsets, self.blob
        return " ".join([blob[offsets[i] : offsets[i + 1]] for i in ids])

    def _normal(self, text: str) -> str:
        """NFC and lower case, letter by letter: no letter depends on its neighbours."""
        text = unicodedata.normalize("NFC", text)
        low = text.lower()
        return low if text.isascii() or "Σ" not in text else "".join([c.lower() for c in text])

    def _plain(self, text: str, out: list[tuple[int, str, str]]) -> None:
        low = self._normal(text)
        # str.split() also splits at four separators that the pattern does not take for white space.
        pieces = regex.split(r"\s+", low) if any(c in low for c in "\x1c\x1d\x1e\x1f") else low.split()
        known, split = self.words, self.split
        for piece in pieces:
            found = known.get(piece)
            if found is not None:
                out.append(found)
                continue
            for word in [piece] if piece.isalpha() else split.findall(piece):
                found = known.get(word)
                if found is None:
                    if len(known) >= HELD:
                        known.clear()
                    found = known[word] = self.word(word)
                out.append(found)

    def encode(self, text: str | None) -> tuple[int, str, str]:
        """(number of tokens, ids in decimal joined by a space, decoded text); a null text is empty."""
        out: list[tuple[int, str, str]] = []
        if text:
            for k, part in enumerate(self.cut.split(text) if self.cut and any(t in text for t in self.special) else [text]):
                if k % 2:
                    i = self.special[part]
                    out.append((1, f" {i}", " " + part))
                elif part:
                    self._plain(part, out)
        if not out:
            return 0, "", ""
        counts, ids, decoded = zip(*out, strict=True)
        return sum(counts), "".join(ids)[1:], "".join(decoded)[1:]


def encode(docs: DataFrame, spec: bytes, digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every document: its ids in decimal and the text they decode to.

    With ``digests`` the last two are their SHA-256 in hexadecimal, made where the texts are, so that
    neither leaves its task. Rows stay where they are; the vocabulary, a file of fixed size, is broadcast.

    Defined cases: null and empty texts have no ids and an empty decoded text; text of white space alone
    too; special tokens in a text are their ids; repeated rows and null ids are kept; other columns
    are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(spec)

    def process(batch: pa.RecordBatch) -> dict:
        bpe = per_worker(("word_bpe", hash(held.value)), lambda: WordBpe(held.value))
        rows = [bpe.encode(text) for text in batch.column(1).to_pylist()]
        if digests:
            rows = [(n, *(hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest() for s in more)) for n, *more in rows]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return dict(zip(("doc_id", "n_tokens", "ids", "decoded"), [batch.column(0), *columns], strict=True))

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), process, f"doc_id long, {ENCODED}", rows=64)
