"""Words of UTF-8 texts, taken in pieces of bounded size so that a very long text never becomes one long list."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Bytes split into words at once.
PIECE = 1 << 22


def word_pieces(data: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of `data`, divided by white space, in order; a piece ends at a space behind at least `piece` bytes."""
    if len(data) <= piece:
        yield data.split()
        return
    start = 0
    while start < len(data):
        end = data.find(b" ", start + piece)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


def map_words(data: bytes, number: Callable[[bytes], int], piece: int = PIECE) -> np.ndarray:
    """`number` of every word, as unsigned 64-bit numbers."""
    parts = [np.fromiter(map(number, words), dtype=np.uint64, count=len(words)) for words in word_pieces(data, piece)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
