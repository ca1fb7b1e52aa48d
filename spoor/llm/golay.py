"""The binary Golay code of length 23, as arrays: which codewords lie near a word.

The code is perfect: every 23-bit word is within distance 3 of exactly one codeword. A word at
distance 3 has five more codewords at distance 4, a nearer word has none. Two words that differ
in at most two bits have a word between them that is at most one bit from either; the codeword
within 3 of that word is within 4 of both. So words that differ in at most two bits share one of
their near codewords.
"""

from __future__ import annotations

from functools import cache

import numpy as np

BITS, DATA_BITS, CHECK_BITS = 23, 12, 11
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, a generator of the code.
GENERATOR = 0b110001110101
NEAR = 4
#: Codewords within distance 4: one, or six.
MOST_KEYS = 6


def _remainders(words: np.ndarray) -> np.ndarray:
    """The remainder of each word by the generator: equal for words of one coset."""
    out = words.astype(np.int64)
    for bit in range(BITS - 1, CHECK_BITS - 1, -1):
        out ^= ((out >> bit) & 1) * (GENERATOR << (bit - CHECK_BITS))
    return out


@cache
def _errors() -> tuple[np.ndarray, np.ndarray]:
    """For each remainder, the words of weight 4 or less in its coset, and how many."""
    words = np.arange(1 << BITS, dtype=np.uint32)
    light = words[np.bitwise_count(words) <= NEAR].astype(np.int64)
    rest = _remainders(light)
    order = np.lexsort((np.bitwise_count(light), rest))
    light, rest = light[order], rest[order]
    counts = np.bincount(rest, minlength=1 << CHECK_BITS)
    table = np.zeros((1 << CHECK_BITS, MOST_KEYS), np.int64)
    place = np.arange(len(rest)) - (np.cumsum(counts) - counts)[rest]
    table[rest, place] = light
    return table, counts


def near_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 23-bit word the indices (12 bits) of the codewords within distance 4.

    Gives an (n, 6) array, and a mask of the entries that count.
    """
    table, counts = _errors()
    rest = _remainders(words)
    codewords = words.astype(np.int64)[:, None] ^ table[rest]
    # The first 12 bits name a codeword, as the generator's top and bottom bits are ones.
    return codewords >> CHECK_BITS, np.arange(MOST_KEYS) < counts[rest][:, None]
