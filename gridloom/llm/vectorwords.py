"""Words of many texts at once as 64-bit hashes, with array operations over their bytes.

A word's hash is a polynomial over random numbers of its bytes, modulo 2**64:
with prefix sums S of value * P**i, a word from s to e has
(S[e] - S[s]) * P**-s, as P is odd and so has an inverse.  A finaliser mixes
the bits.  Words are runs of bytes that are not white space (0x20, 0x09-0x0D).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

P = 0x9E3779B97F4A7C15
_INVERSE = pow(P, -1, 1 << 64)
_BYTE = np.random.default_rng(20_240_229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2**64 for i < n (kept, and doubled when more are needed)."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1 << max(16, (n - 1).bit_length()), np.uint64)
        have[1] = base
        done = 2
        while done < len(have):
            have[done : 2 * done] = have[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        _powers[base] = have
    return have[:n]


def forget_powers() -> None:
    _powers.clear()


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of all texts one after the other; null: empty."""
    texts = pc.cast(pc.fill_null(texts, ""), pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, of): the words' places, and the first word of each text (one more at the end)."""
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True  # a text begins
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | fresh[:-1]))
    after = np.empty(len(data), bool)
    if len(data):
        after[-1] = False
        after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | fresh[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(P, len(data)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from each start to its end."""
    inverse = powers(_INVERSE, len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, of): hashes of all words, and the first word of each text (one more at the end)."""
    data, offsets = text_bytes(texts)
    if lower:
        data = lower_ascii(data)
    starts, ends, of = word_bounds(data, offsets)
    return span_hashes(prefix_sums(data), starts, ends), of


def hash_of(word: str | bytes) -> int:
    """The hash that ``word_hashes`` gives one word."""
    data = np.frombuffer(word.encode() if isinstance(word, str) else word, np.uint8)
    return int(span_hashes(prefix_sums(data), np.array([0]), np.array([len(data)]))[0])


def shingle_hashes(words: np.ndarray, of: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words (all words of a text with fewer), and the first of each text."""
    n = np.diff(of)
    total = len(words)
    run = np.zeros(total, np.uint64)
    for k in range(width):  # a later word of the run gets another factor; runs past the end are not used
        run[: max(total - k, 0)] += words[k:] * np.uint64(pow(P, 2 * k + 1, 1 << 64))
    count = np.where(n >= width, n - width + 1, 0)
    short = np.flatnonzero((n > 0) & (n < width))
    counts = count.copy()
    counts[short] = 1
    first = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(of[:-1] - first[:-1], counts) + np.arange(first[-1])
    out = run[at]
    for t in short:  # texts of fewer words than a run: one hash of what they have
        value = 0
        for k, w in enumerate(words[of[t] : of[t + 1]].tolist()):
            value += w * pow(P, 2 * k + 1, 1 << 64)
        out[first[t]] = np.uint64((value + int(n[t]) * 0xD6E8FEB86659FD93) % (1 << 64))
    return mix(out), first
