"""The perfect binary Golay code [23, 12, 7] as a fuzzy hash of 23-bit words.

A word's keys are the indices of all codewords within distance 4: one if its nearest codeword is at most 2
away, six if it is 3 away.  Two words at distance 2 or less always share a key: the codeword nearest to a
word between them is at most 3 from that word and so at most 4 from both.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
GENERATOR = 0b110001110101
LENGTH, DATA, CHECK = 23, 12, 11


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << bit - CHECK
    return word


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the data bits; the error of each syndrome; what leads from the nearest codeword to the next five."""
    high = np.array([_remainder(d << CHECK) for d in range(1 << DATA)], np.int64)
    codewords = (np.arange(1 << DATA, dtype=np.int64) << CHECK) | high
    sevens = codewords[np.bitwise_count(codewords) == 7]
    error, around = np.zeros(1 << CHECK, np.int64), np.zeros((1 << CHECK, 5), np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(LENGTH), weight):
            e = sum(1 << b for b in bits)
            s = int(high[e >> CHECK]) ^ (e & (1 << CHECK) - 1)
            error[s] = e
            if weight == 3:
                around[s] = sevens[(sevens & e) == e]
    return high, error, around


def keys(words: np.ndarray) -> np.ndarray:
    """n x 6 codeword indices (12 bits) of 23-bit words; -1 fills the rows of words with one key."""
    high, error, around = tables()
    words = words.astype(np.int64)
    syndrome = high[words >> CHECK] ^ (words & (1 << CHECK) - 1)
    nearest = words ^ error[syndrome]
    out = np.full((len(words), 6), -1, np.int64)
    out[:, 0] = nearest >> CHECK
    far = np.bitwise_count(error[syndrome]) == 3
    out[far, 1:] = (nearest[far, None] ^ around[syndrome[far]]) >> CHECK
    return out
