"""Word shingles as 64-bit hashes, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from demandflow.llm.common import binary_texts

#: Odd multipliers: the golden ratio's and two of its mixes, for combining and finishing hashes.
STEP, MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _finished(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each white-space separated word, A-Z lower-cased; place of each text's first word, one more at the end)."""
    texts = binary_texts(column).cast(pa.string() if not pa.types.is_large_string(column.type) else pa.large_string())
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = words.flatten()
    counts = np.asarray(pc.list_value_length(words).to_numpy(zero_copy_only=False), np.int64)
    real = np.asarray(pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False), bool)
    owner = np.repeat(np.arange(len(counts)), counts)[real]
    starts = np.searchsorted(owner, np.arange(len(counts) + 1))
    coded = flat.filter(pa.array(real)).dictionary_encode()
    if len(coded) == 0:
        return np.zeros(0, np.uint64), starts
    hashes = pd.util.hash_array(np.asarray(coded.dictionary.to_pylist(), dtype=object), categorize=False)
    return hashes[coded.indices.to_numpy(zero_copy_only=False)], starts


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles as sorted int64 hashes; fewer words than `width` make one shingle, none an empty set."""
    words, starts = word_hashes(column)
    with np.errstate(over="ignore"):
        if len(words) >= width:
            joined = np.zeros(len(words) - width + 1, np.uint64)
            for i in range(width):
                joined = joined * STEP + words[i : len(joined) + i]
            joined = _finished(joined).view(np.int64)
        for first, last in zip(starts[:-1], starts[1:]):
            if last - first >= width:
                yield np.unique(joined[first : last - width + 1])
            elif last > first:
                short = np.uint64(last - first)
                for w in words[first:last]:
                    short = short * STEP + w
                yield _finished(np.array([short], np.uint64)).view(np.int64)
            else:
                yield np.zeros(0, np.int64)
