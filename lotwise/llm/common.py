"""What several operators share: reading the given tables, written intermediate tables (Scratch), byte-level word hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.operators.scratch import Scratch

__all__ = ["Scratch", "mix", "read_table", "shingle_hashes", "word_blocks", "word_edges", "word_hashes", "words_of"]

#: White space between words, as the query contracts give it: x20 and x09 to x0D.
SPACES = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read through Spark only, so that any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Words between ASCII white space as an array; null gives an empty array."""
    inside = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inside == "", F.array().cast("array<string>")).otherwise(F.split(inside, SPACES))


# ---- vectorised word hashing over one text's bytes -------------------------------------------------------------------

_MULT = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd multiplier modulo 2**64, and their inverses, up to n."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1 << 16)
        base = np.full(size, _MULT, np.uint64)
        base[0] = 1
        _powers = np.multiply.accumulate(base)
        base[1:] = np.uint64(pow(int(_MULT), -1, 1 << 64))
        _inverses = np.multiply.accumulate(base)
    return _powers, _inverses


def word_blocks(data: bytes, block: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Where a text's blocks start and end: of `block` bytes, and on to the next white space, so that no word is cut."""
    at = 0
    while at < len(data):
        end = min(len(data), at + block)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield at, end
        at = end


def word_edges(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a block's bytes start and stop."""
    inside = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def word_hashes(data: bytes, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word between ASCII white space, in order; equal words have equal hashes in any process.

    Polynomial hashes come from prefix sums modulo 2**64, then the finaliser and the word's length. Texts of any length
    are cut only where white space is, into blocks, so that memory stays bounded; the block size changes no hash.
    """
    out = []
    for at, end in word_blocks(data, block):
        raw = np.frombuffer(data, np.uint8, end - at, at)
        start, stop = word_edges(raw)
        if not len(start):
            continue
        power, inverse = _tables(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
        h = (sums[stop] - sums[start]) * inverse[start]
        out.append(mix(h + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words; a text of fewer words but at least one has one run, all its words."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = (out + words[k : k + len(out)]) * _MULT + np.uint64(0x2545F4914F6CDD1D)
    return mix(out)
