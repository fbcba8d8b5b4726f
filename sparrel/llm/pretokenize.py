"""Where the pieces of the byte-level pretokenizer start, for whole arrays of code points at once.

The pieces are those of its pattern: contractions 's 't 're 've 'm 'll 'd; runs of letters, of numbers or of other characters, each with one space before
it; white space, of which the last character stands alone if a word follows (and belongs to the word if it is a space).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

from .bpe import _SPACE

#: Stand between texts: END after a text's last chunk, GAP after other chunks.
END, GAP = 0x110000, 0x110001
_LETTER, _NUMBER, _OTHER, _WHITE, _BORDER = range(5)
# What follows the apostrophe of a contraction.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_FACTOR, _SQUARE = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """Kind of every code point."""
    table = np.full(GAP + 1, _OTHER, np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_WHITE, f"[{_SPACE}]+")):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = kind
    table[[END, GAP]] = _BORDER
    return table


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_FACTOR, -1, 1 << 64)
    return tuple(np.concatenate(([np.uint64(1)], np.full(n - 1, f, np.uint64))).cumprod(dtype=np.uint64) for f in (_FACTOR, inverse))


def hashes(points: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every piece: sums of code points, and of a quadratic of them, times powers of an odd number."""
    n, out = len(points), []
    power, inverse = _powers(1 << max(12, n.bit_length()))
    wide, back = points.astype(np.uint64) + np.uint64(1), inverse[starts]
    for terms in (wide, wide * (wide * _SQUARE + np.uint64(0xA0761D64))):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(terms * power[:n], out=sums[1:])
        x = (sums[stops] - sums[starts]) * back
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xC2B2AE3D27D4EB4F)
        out.append(x ^ (x >> np.uint64(29)))
    return out[0], out[1]


def starts(points: np.ndarray) -> np.ndarray:
    """Places where pieces start.  The array ends with END or GAP; each of these is a piece."""
    kind = kinds()[points]
    before = np.concatenate(([_BORDER], kind[:-1]))
    white, prev_white = kind == _WHITE, before == _WHITE
    start = kind != before
    start[kind == _BORDER] = True
    # White space: a run's last character is apart if a word follows; a space there belongs to the word.
    last = np.flatnonzero(white[:-1] & ~white[1:] & (kind[1:] != _BORDER))
    start[last] = True
    start[last[points[last] == 32] + 1] = False
    for i in np.flatnonzero(points == 39).tolist():
        if before[i] in (_LETTER, _NUMBER, _BORDER) or (prev_white[i] and points[i - 1] != 32):
            after = "".join(chr(p) if p < END else "\n" for p in points[i + 1 : i + 3].tolist())
            for c in CONTRACTIONS:
                if after.startswith(c):
                    start[i + 1 : i + 1 + len(c)] = False
                    start[i + 1 + len(c)] = True
                    break
    return np.flatnonzero(start)
