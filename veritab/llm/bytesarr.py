"""Vectorised passes over the bytes of many texts: words, their hashes, lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes looked at in one vectorised step; bounds the temporary arrays, not the texts.
STEP = 1 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)

#: Byte tables. A-Z to a-z; bytes of words are digits, letters and all beyond ASCII.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:256] = True


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and each text's offset among them (nulls are empty)."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1 + texts.offset)[texts.offset :]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def powers(n: int) -> np.ndarray:
    out = np.ones(max(1, n), dtype=np.uint64)
    if n > 1:
        out[1:] = _PRIME
        with np.errstate(over="ignore"):
            np.multiply.accumulate(out, out=out)
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of a public integer hash)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(31))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(29))
        h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def word_hashes(buf: np.ndarray, cuts: np.ndarray, is_word: np.ndarray = IS_WORD, fold: np.ndarray = LOWER):
    """Start, length and hash of every word of buf; no word goes over a cut (sorted offsets).

    Works in steps of STEP bytes that end where a word ends, so one long text takes no more
    temporary memory than many short ones (a single word beyond STEP bytes is one step).
    """
    starts, lengths, hashes = [], [], []
    pow_table = powers(64)
    lo, size = 0, len(buf)
    while lo < size:
        hi = min(size, lo + STEP)
        while hi < size and is_word[buf[hi]] and is_word[buf[hi - 1]]:
            ahead = np.flatnonzero(~is_word[buf[hi : hi + STEP]])
            hi += int(ahead[0]) if len(ahead) else min(STEP, size - hi)
        part = buf[lo:hi]
        inside = is_word[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        own = cuts[np.searchsorted(cuts, lo) : np.searchsorted(cuts, hi)] - lo
        first[own] = inside[own]
        at = np.flatnonzero(inside)
        if len(at):
            begin = first[at]
            head = np.flatnonzero(begin)
            s = at[head]
            word = np.cumsum(begin) - 1
            pos = at - s[word]
            longest = int(pos.max()) + 1
            if longest > len(pow_table):
                pow_table = powers(longest)
            with np.errstate(over="ignore"):
                values = (fold[part[at]].astype(np.uint64) + np.uint64(1)) * pow_table[pos]
                hashes.append(mix(np.add.reduceat(values, head)))
            starts.append(s + lo)
            lengths.append(np.diff(np.append(head, len(at))))
        lo = hi
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(lengths), np.concatenate(hashes)


def per_text(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bounds of each text's words among all words."""
    return np.searchsorted(starts, offsets)


def groups_of_texts(offsets: np.ndarray, most: int):
    """Index ranges of texts of at most most bytes together (a longer text is alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j
