"""Sets of 64-bit hashes as bit sets of bounded size, built by the executors and read by every worker.

A set has 48 bits or more for each hash up to ``MAX_BITS``; beyond that it
fills up and holds more hashes by mistake, but never lacks one.  Each hash sets
three bits inside one piece, so a piece is packed by one task and the driver
receives whole pieces only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BITS = 1 << 29
BITS_PER_HASH = 48
PIECE = 1 << 20


def bits_for(n: int, max_bits: int | None = None) -> int:
    """Bits of a set of ``n`` hashes, a power of two."""
    return 1 << max(16, min((max_bits or MAX_BITS).bit_length() - 1, (BITS_PER_HASH * max(n, 1)).bit_length()))


def _places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The three bits of a hash, all in one piece of the set."""
    piece = min(PIECE, bits)
    base = h & np.uint64(bits - piece)
    low = np.uint64(piece - 1)
    return [base | (x & low) for x in (h, h >> np.uint64(29), h >> np.uint64(44))]


def _is_set(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    w = words.take((places >> np.uint64(6)).view(np.int64))
    w >>= places & np.uint64(63)
    w &= np.uint64(1)
    return w


def members(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Positions of the hashes (unsigned) that the set holds."""
    bits = len(words) * 64
    at = np.flatnonzero(_is_set(words, hashes & np.uint64(bits - 1)))
    for k in (1, 2):
        at = at[_is_set(words, _places(hashes[at], bits)[k]) > 0]
    return at


def holds(words: np.ndarray, h: int) -> bool:
    """Does the set hold one hash?"""
    bits = len(words) * 64
    piece = min(PIECE, bits)
    for shift in (0, 29, 44):
        at = (h & (bits - piece)) | ((h >> shift) & (piece - 1))
        if not int(words[at >> 6]) >> (at & 63) & 1:
            return False
    return True


def bit_set(hashes: DataFrame, n: int, max_bits: int | None = None) -> np.ndarray:
    """The set of the hashes in the only column of a table as 64-bit words; its length depends on ``n`` only."""
    bits = bits_for(n, max_bits)
    piece = min(PIECE, bits)
    name = hashes.columns[0]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        h = pdf[name].to_numpy(dtype=np.int64).view(np.uint64)
        words = np.zeros(piece // 64, np.uint64)
        for place in _places(h, bits):
            p = np.unique(place & np.uint64(piece - 1))
            np.bitwise_or.at(words, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))
        return pd.DataFrame({"piece": [int(h[0] & np.uint64(bits - 1)) // piece], "words": [words.tobytes()]})

    at = F.col(name).bitwiseAND(F.lit(bits - piece))
    got = hashes.groupBy(at.alias("p")).applyInPandas(pack, "piece long, words binary").toArrow()
    out = np.zeros(bits // 64, np.uint64)
    for k, words in zip(got["piece"].to_pylist(), got["words"].to_pylist()):
        out[k * piece // 64 : (k + 1) * piece // 64] = np.frombuffer(words, np.uint64)
    return out
