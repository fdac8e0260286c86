"""Word shingles of whole texts as 64-bit hashes, vectorised over a batch.

Words are maximal runs outside ASCII white space after lower-casing A-Z. A
shingle is ``k`` successive words; a text with fewer words is one shingle, its
whole word sequence; a text without words has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

K = 5


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (xor-shift and odd multipliers)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


# Odd multipliers by word position, from a rule.
_PLACE = _mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    """The words of one text, exactly."""
    return (text or "").encode().lower().split()


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word in order, words per text)."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    bounds = lists.offsets.to_numpy()
    words = lists.flatten()
    real = (pc.binary_length(words).to_numpy(zero_copy_only=False) > 0)
    kept = np.concatenate([[0], np.cumsum(real)])
    coded = words.dictionary_encode()
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_numpy(zero_copy_only=False)),
                       np.uint64, len(coded.dictionary))
    return each[coded.indices.to_numpy(zero_copy_only=False)][real], np.diff(kept[bounds - bounds[0]])


def shingle_hashes(texts: pa.Array, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes in text order with repeats, shingles per text)."""
    hashes, n = word_hashes(texts)
    starts = np.cumsum(n) - n
    counts = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    row = np.repeat(np.arange(len(n)), counts)
    first = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(len(row))
    width = np.minimum(n, k)[row]
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    total = _PLACE[32 + width]  # sequences of different lengths never share a sum
    for j in range(k):
        total = total + np.where(j < width, padded[first + j] * _PLACE[j], np.uint64(0))
    return _mix(total), counts


def distinct_sets(texts: pa.Array, k: int = K) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, counts = shingle_hashes(texts, k)
    return [np.unique(s) for s in np.split(hashes, np.cumsum(counts)[:-1])] if len(counts) else []


def spelt_shingles(words: list[bytes], k: int = K) -> set[bytes]:
    """The distinct shingles of one text as bytes (a word holds no space)."""
    if len(words) < k:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)}
