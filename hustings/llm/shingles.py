"""Words and word shingles of texts as 64-bit hashes, many texts at once, and what is exact about them.

A word's bytes are taken eight at a time as integers; each is mixed into the word's state, which starts from its length. Words of more than
LANES such integers go through XXH3. Nothing here is linear in the bytes, so no family of words collides by its shape; still, hashes only find
candidates. Equality of word sequences is decided by `spelling`, and what two sets share by `exact_shingles`.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Integers of eight bytes that a word may have before XXH3 takes it.
LANES = 4


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
BELOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def hashed_words(texts: Iterable[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    r"""Hashes of the words [^\x20\x09-\x0D]+ of all texts, end to end, and how many each has; lower: A-Z first become a-z."""
    raw = [(t or "").encode(errors="surrogatepass") for t in texts]
    joined = b" ".join([*raw, b""])
    joined = joined.translate(LOWER) if lower else joined
    space = SPACE[np.frombuffer(joined, np.uint8)]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    padded = joined + b"\0" * 8
    lanes = np.ndarray(len(joined) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    size = ends - starts
    out = mixed(size.astype(np.uint64) * ODD)
    for k in range(LANES):
        on = np.flatnonzero((size > 8 * k) & (size <= 8 * LANES)) if k else np.flatnonzero(size <= 8 * LANES)
        if len(on):
            out[on] = mixed(out[on] ^ (lanes[starts[on] + 8 * k] & BELOW[np.minimum(size[on] - 8 * k, 8)]))
    for i in np.flatnonzero(size > 8 * LANES):
        out[i] = xxhash.xxh3_64_intdigest(joined[starts[i] : ends[i]])
    bounds = np.cumsum([0, *(len(r) + 1 for r in raw)])
    return out, np.diff(np.searchsorted(starts, bounds))


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """The words themselves."""
    raw = (text or "").encode(errors="surrogatepass")
    return (raw.translate(LOWER) if lower else raw).split()


def spelling(spelt: bytes, seed: int = 0) -> tuple[int, int]:
    """128 bits of words in order, joined by spaces."""
    d = xxhash.xxh3_128_digest(spelt, seed)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def exact_shingles(words: list[bytes], k: int) -> set[tuple[bytes, ...]]:
    """The distinct shingles, spelt out; of fewer than k words the whole sequence is one."""
    return set(zip(*(words[j:] for j in range(k)), strict=False)) if len(words) >= k else {tuple(words)} if words else set()


def shingle_sets(texts: Iterable[str | None], k: int) -> list[np.ndarray]:
    """Of each text, lower-cased, the ascending distinct hashes of its k-word shingles; of fewer words the whole sequence is one; no words, none."""
    words, sizes = hashed_words(texts, lower=True)
    ends = np.cumsum(sizes)
    acc = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        acc = acc * ODD + words[j : len(acc) + j]
    acc = mixed(acc)
    out = []
    for n, b in zip(sizes.tolist(), ends.tolist(), strict=True):
        if n >= k:
            out.append(np.unique(acc[b - n : b - k + 1]))
        else:
            whole = np.full(min(n, 1), n, np.uint64)
            for w in words[b - n : b]:
                whole = mixed(whole * ODD + w)
            out.append(whole)
    return out
