"""64-bit hashes of words and word runs, by numpy over whole batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE_BYTES = 1 << 21
_PLACES = 4096
_SEEDS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
#: Odd weights of the first places of a word; further places take them times an odd number for each stretch of so many.
WEIGHTS = np.random.default_rng(5).integers(0, 1 << 63, _PLACES, np.uint64) * np.uint64(2) + np.uint64(1)
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _SEEDS[0]
        h = (h ^ (h >> np.uint64(27))) * _SEEDS[1]
        return h ^ (h >> np.uint64(31))


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of data."""
    b = np.frombuffer(data, np.uint8)
    blank = BLANK[b]
    first = ~blank
    first[1:] &= blank[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    at = np.arange(starts[0], len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))
    with np.errstate(over="ignore"):
        v = WEIGHTS[at & (_PLACES - 1)] * (b[starts[0] :].astype(np.uint64) + np.uint64(1))
        far = np.flatnonzero(at >= _PLACES)
        if len(far):
            v[far] *= mix((at[far] // _PLACES).astype(np.uint64)) | np.uint64(1)
        v[blank[starts[0] :]] = 0
        return starts, mix(np.add.reduceat(v, starts - starts[0]))


def _pieces(data: bytes) -> Iterator[bytes]:
    """data in pieces of about PIECE_BYTES that end at blanks; a longer word stays whole."""
    at = 0
    while len(data) - at > PIECE_BYTES:
        end = at + PIECE_BYTES
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def word_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The hashes of each text's words, in order; short texts go through numpy together."""
    group: list[bytes] = []
    size = 0

    def together() -> Iterator[np.ndarray]:
        if group:
            starts, hashes = _words(b"\n".join(group))
            ends = np.cumsum([len(t) + 1 for t in group])
            yield from np.split(hashes, np.searchsorted(starts, ends[:-1]))

    for text in texts:
        if len(text) > PIECE_BYTES:
            yield from together()
            group, size = [], 0
            yield np.concatenate([_words(p)[1] for p in _pieces(text)])
            continue
        group.append(text)
        size += len(text)
        if size > PIECE_BYTES // 2:
            yield from together()
            group, size = [], 0
    yield from together()


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of every run of k words; none if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    with np.errstate(over="ignore"):
        for j in range(1, k):
            h = (h ^ (h >> np.uint64(29))) * _SEEDS[j % 5] + words[j : j + n]
    return mix(h)


def runs_at(words: np.ndarray, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the runs of k words that start at these places."""
    out = []
    for own in (words, mix(words ^ _SEEDS[4])):
        h = own[at]
        with np.errstate(over="ignore"):
            for j in range(1, k):
                h = (h ^ (h >> np.uint64(29))) * _SEEDS[j % 5] + own[at + j]
        out.append(mix(h))
    return out[0], out[1]


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles; the whole sequence as one if there are fewer words."""
    return np.unique(runs(words, min(k, len(words)))) if len(words) else words


def lower_ascii(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()
