"""Word shingles of texts as multisets of hashes, for whole batches of texts at a time."""

from __future__ import annotations

from functools import cache

import numpy as np

WORDS = 5
BITS = 44  # of a shingle's hash; the rest of a 64-bit sort key numbers the text
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Each value's bits spread over the whole word, one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@cache
def _in_word() -> np.ndarray:
    return np.array([(c := chr(i)).isalnum() or c == "_" for i in range(0x110000)])


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    base = int(_MULTIPLIER)
    with np.errstate(over="ignore"):
        out = [np.cumprod(np.full(1 << bits, p, dtype=np.uint64)) for p in (base, pow(base, -1, 1 << 64))]
    return out[0], out[1]


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words per text). Words are runs of letters, digits and underscores in lower case.

    A word's hash is a polynomial in its characters, read off running sums over the whole batch.
    """
    lowered = [t.lower() + " " if t else " " for t in texts]
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    inside = _in_word()[code]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(max(16, int(len(code)).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(code.astype(np.uint64) + np.uint64(1)) * up[: len(code)])])
        value = mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    ends = np.cumsum([len(t) for t in lowered])
    per_text = np.diff(np.searchsorted(start, ends), prepend=0)
    return value, per_text


def multisets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, count), ordered by text number and shingle.

    A text of fewer than five words has one shingle, all its words; a text without words has none.
    """
    word, sizes = words(texts)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    n = len(word)
    total = np.zeros(n, dtype=np.uint64)
    left = np.repeat(ends, sizes) - np.arange(n)
    with np.errstate(over="ignore"):
        for k in range(WORDS):
            # Words past the end of a short text add nothing, so its one shingle holds all its words.
            here = np.zeros(n, dtype=np.uint64)
            here[: max(0, n - k)] = word[k:]
            total = (total + np.where(left > k, here + np.uint64(k + 1), np.uint64(0))) * _MULTIPLIER
            total ^= total >> np.uint64(29)
    whole = (left >= WORDS) | (np.arange(n) == np.repeat(ends - sizes, sizes))
    key = np.sort((owner[whole].astype(np.uint64) << np.uint64(BITS)) | (mixed(total[whole]) >> np.uint64(64 - BITS)))
    at = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0)
    first = key[at]
    mask = np.uint64((1 << BITS) - 1)
    return (first >> np.uint64(BITS)).astype(np.int64), first & mask, np.diff(np.append(at, len(key)))


def occurrences(owner: np.ndarray, shingle: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The multisets as plain sets: the k-th occurrence of a shingle is an element of its own."""
    who, what = np.repeat(owner, count), np.repeat(shingle, count)
    nth = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
    with np.errstate(over="ignore"):
        return who, mixed(what + nth.astype(np.uint64) * _MULTIPLIER)
