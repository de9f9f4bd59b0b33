"""Words of many texts at once, as hashes over their bytes."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from logwarden.llm import arrow

SPACE = 32
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Words(NamedTuple):
    text: bytes  # folded words, one space behind each
    places: np.ndarray  # where each word begins in it, and its end
    hashes: np.ndarray
    rows: np.ndarray  # offsets of the rows in the words


def words_of(column: pa.Array, fold: np.ndarray) -> Words:
    """``fold``: what each byte becomes; a space separates words."""
    data, ends = arrow.flat(column)
    n = len(ends) - 1
    spread = np.full(len(data) + n, SPACE, np.uint8)
    inside = np.ones(len(spread), bool)
    inside[ends[1:] + np.arange(n)] = False  # a space behind each row
    spread[inside] = fold[data]
    word = spread != SPACE
    before = np.zeros_like(word)
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & ~before)
    kept = spread[word | before]
    lengths = np.flatnonzero(before & ~word) - starts
    places = np.r_[0, np.cumsum(lengths + 1)]
    powers = np.cumprod(np.full(len(kept), BASE))
    sums = np.r_[np.uint64(0), np.cumsum((kept + np.uint64(1)) * powers)]  # a zero byte counts too
    back = np.cumprod(np.full(len(kept), _INVERSE))
    hashes = (sums[places[:-1] + lengths] - sums[places[:-1]]) * back[places[:-1]]
    hashes ^= hashes >> np.uint64(29)
    return Words(kept.tobytes(), places, hashes * MIX, np.searchsorted(starts, ends + np.arange(n + 1)))
