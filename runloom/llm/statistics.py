"""Statistics of a text's words, lines and characters that quality operators share."""

from __future__ import annotations

import numpy as np

# The symbols that count as such, and the width of the windows that count as repeated.
SYMBOLS = "#*$%&|<>"
WINDOW = 8

_SPACE_BYTES = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]
_SYMBOL_BYTES = [ord(c) for c in SYMBOLS]

NAMES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct",
    "n_upper", "n_lower", "n_digits", "n_marks", "n_stops",
)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words in windows of ``width`` words that occur twice or more in the text, the first one included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    keys = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(width):  # a polynomial over the word keys, modulo 2**64
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + keys[k : k + n]
    ordered = np.sort(rolled)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return 0
    hit = np.isin(rolled, twice).astype(np.int64)
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    depth[:n] += hit
    depth[width : width + n] -= hit
    return int((np.cumsum(depth) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The statistics ``NAMES`` of a text; all zero for null.

    Words are runs of characters other than ASCII white space, characters are code points. Upper and
    lower case, digits, marks (!, ?, | and the symbols) and stops (. and ,) are counted in ASCII.
    """
    if not text:
        return (0,) * len(NAMES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    bytes_of = np.zeros(256, dtype=np.int64)
    for at in range(0, len(raw), 1 << 20):  # bounded memory for very long texts
        bytes_of += np.bincount(np.frombuffer(raw, dtype=np.uint8, count=min(1 << 20, len(raw) - at), offset=at), minlength=256)
    chars = len(raw) - int(bytes_of[0x80:0xC0].sum())
    lines = [line for line in raw.split(b"\n") if line.strip()]
    symbols = int(bytes_of[_SYMBOL_BYTES].sum())
    return (
        len(words),
        chars - int(bytes_of[_SPACE_BYTES].sum()),
        symbols,
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(set(words)),
        int(bytes_of[65:91].sum()),
        int(bytes_of[97:123].sum()),
        int(bytes_of[48:58].sum()),
        symbols + int(bytes_of[[33, 63]].sum()),
        int(bytes_of[[44, 46]].sum()),
    )
