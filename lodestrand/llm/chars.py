"""Code-point arrays of whole batches of texts, so that character work runs in NumPy rather than per character."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np

#: Characters that one vectorised step takes at once; a text is never split, so longer texts take a step of their own.
STEP_CHARS = 1 << 17


@cache
def bare_table() -> np.ndarray:
    """By code point: the lower-case letter or digit, or 0 for everything that bare text drops."""
    out = np.zeros(sys.maxunicode + 2, np.uint32)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if unicodedata.category(ch)[0] in "LN":
            low = ch.lower()
            out[c] = ord(low[0])
    return out


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts on end, and where each text starts (with the end as last entry)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def bare_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Like ``codes``, of the bare texts: lower-cased, only letters and digits (Unicode L and N)."""
    raw, starts = codes(texts)
    low = bare_table()[raw]
    kept = low != 0
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(kept, out=before[1:])
    return low[kept], before[starts]


def bare(text: str) -> str:
    """The bare text of one string."""
    return bare_codes([text])[0].tobytes().decode("utf-32-le", "surrogatepass")


def steps(lengths: list[int], limit: int = STEP_CHARS):
    """Ranges of consecutive texts of about ``limit`` characters each."""
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply, shift), elementwise."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def window_hashes(values: np.ndarray, log2: int) -> np.ndarray:
    """Hashes of all windows of ``2**log2`` consecutive values, by doubling; as many as there are such windows."""
    h = mix(values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for i in range(log2):
        step = 1 << i
        h = h[:-step] * np.uint64(0xD6E8FEB86659FD93 + 2 * i) + (h[step:] ^ (h[step:] >> np.uint64(32))) if len(h) > step else h[:0]
    return mix(h)
