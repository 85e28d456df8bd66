"""Sequence primitives used inside pandas batches: bit-parallel longest common subsequence,
edit distance with transpositions, accent folding."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import numpy as np


def fold(text: str) -> str:
    """Lower case without accents; letters that do not decompose get a plain stand-in."""
    text = text.translate(_PLAIN)
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


# Letters without a canonical decomposition.
_PLAIN = str.maketrans({"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ı": "i", "’": "'", "‘": "'"})


#: Bits of the rows that one alignment keeps; longer texts are halved until theirs fit.
MOST_BITS = 1 << 28


def lcs_pairs(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Index pairs of one longest common subsequence of a and b, in memory of the texts' own size.

    Common ends are peeled off. The rest keeps one machine-word vector row per element of b (Crochemore
    et al. 2001); where those would take more than MOST_BITS, b is halved and a cut where the two halves
    have most in common (Hirschberg 1975)."""
    lo, n, m = 0, len(a), len(b)
    while lo < n and lo < m and a[lo] == b[lo]:
        lo += 1
    while n > lo and m > lo and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    pairs = [(i, i) for i in range(lo)]
    if n > lo and m > lo:
        pairs += [(i + lo, j + lo) for i, j in _between(a[lo:n], b[lo:m])]
    pairs += [(n + k, m + k) for k in range(len(a) - n)]
    return pairs


def _rows(a: Sequence, b: Sequence):
    """The bit row of a after each element of b: a zero where the subsequence grows."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for y in b:
        u = v & at.get(y, 0)
        v = (v + u | v - u) & full
        yield v


def _lengths(a: Sequence, b: Sequence) -> np.ndarray:
    """Lengths of the longest common subsequences of b with each beginning of a."""
    v = (1 << len(a)) - 1
    for v in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(a) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(a)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _between(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    if len(a) * len(b) > MOST_BITS and len(b) > 1:
        half = len(b) // 2
        both = _lengths(a, b[:half]) + _lengths(a[::-1], b[half:][::-1])[::-1]
        cut = int(both.argmax())
        return _between(a[:cut], b[:half]) + [(i + cut, j + half) for i, j in _between(a[cut:], b[half:])]
    rows, found, i, j = list(_rows(a, b)), [], len(a), len(b)
    while i and j:
        if rows[j - 1] >> i - 1 & 1:
            i -= 1
        elif j > 1 and not rows[j - 2] >> i - 1 & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.append((i, j))
    return found[::-1]


def edits(a: str, b: str, most: int | None = None) -> int:
    """Edit distance with adjacent transpositions; beyond `most` any larger number."""
    if a == b:
        return 0
    if most is not None and abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if most is not None and min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]
