"""Words of a text as 64-bit hashes, and hashes of word sequences, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of a text that are hashed together; a longer piece only where one word is longer.
PIECE = 1 << 18
_BLANK = b" \t\n\x0b\x0c\r"
_SPACE = np.isin(np.arange(256), list(_BLANK))
#: A random value for each byte, A-Z counting as a-z; white space has none.
_VALUE = np.random.default_rng(20240117).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: What a byte counts at the first places of a word, row by row, white space nothing; beyond them it is worked out.
_PLACES = 32
_PLACED = mix(_VALUE[None, :] + np.arange(_PLACES, dtype=np.uint64)[:, None] * _STEP)
_PLACED[:, _SPACE] = 0
_PLACED = _PLACED.ravel()
_WORD = ~_SPACE


def _pieces(raw: bytes) -> Iterator[bytes]:
    """``raw`` cut at white space."""
    at = 0
    while len(raw) - at > PIECE:
        ends = [e for c in _BLANK if (e := raw.find(c, at + PIECE)) >= 0]
        if not ends:
            break
        yield raw[at : min(ends)]
        at = min(ends)
    yield raw[at:]


def _hashed(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    word = _WORD.take(b)
    new = word.copy()
    np.greater(word[1:], word[:-1], out=new[1:])
    first = np.flatnonzero(new)  # where each word starts
    if not len(first):
        return np.zeros(0, np.uint64)
    b, word, first = b[first[0] :], word[first[0] :], (first - first[0]).astype(np.int32)
    # places run on over the white space after a word, which counts nothing
    place = np.arange(len(b), dtype=np.int32) - np.repeat(first, np.diff(first, append=np.int32(len(b))))
    # a value that depends on byte and place, summed over the word
    value = _PLACED.take((np.minimum(place, _PLACES - 1) << 8) + b)
    if place.max() >= _PLACES:
        far = np.flatnonzero((place >= _PLACES) & word)
        value[far] = mix(_VALUE[b[far]] + place[far].astype(np.uint64) * _STEP)
    return mix(np.add.reduceat(value, first))


def word_hashes(text: str | None) -> np.ndarray:
    """A-Z lowered, split at ASCII white space; one unsigned 64-bit hash a word."""
    found = [_hashed(p) for p in _pieces((text or "").encode("utf-8", "replace"))]
    return found[0] if len(found) == 1 else np.concatenate(found)


def sequences(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, in order (none where there are fewer)."""
    m = len(words) - n + 1
    if m <= 0:
        return words[:0]
    out = np.full(m, n, np.uint64)
    for j in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + m])
    return out
