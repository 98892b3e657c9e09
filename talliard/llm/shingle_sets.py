"""Sets of word shingles as sorted 64-bit hashes, their sketches, and keys of their parts."""

import hashlib

import numpy as np

from talliard.llm import chunks as C

#: Growth of a ring's sizes.
GROWTH = 1.4
#: Partitions that are tried for sets with many empty parts before each shingle is a key by itself.
TURNS = 3
#: Least bits of a sketch.
SKETCH = 512
#: Words whose hashes a task remembers before it starts over.
KNOWN = 250_000

_FACTORS = C.numbers(21, 256) | np.uint64(1)
_FIRST = np.array([True])
_STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hashes of words, each computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN:
            self.clear()
        self[word] = found = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return found


def shingle_set(text: bytes, known: WordHashes, shingle: int) -> np.ndarray:
    """Distinct shingles in order; a text of fewer words is one shingle, one without words has none."""
    words = text.lower().split()  # both go by ASCII alone
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    wide = min(shingle, len(h))
    if not wide:
        return h
    n = len(h) - wide + 1
    total = h[:n] * _FACTORS[wide]
    for k in range(1, wide):
        total += h[k : n + k] * _FACTORS[k + wide]
    found = C.mixed(total)
    found.sort()
    return found[np.concatenate((_FIRST, found[1:] != found[:-1]))]


def rings(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least size, parts, spare) of each ring. Linked sets, the smaller one of the ring, differ in fewer elements than parts - spare.

    So they agree in more than spare parts, and where one of them has no more than spare empty parts, in one that holds
    elements. Rings without parts have sets too small for that.
    """
    low = [1]
    while low[-1] < 1 << 40:
        low.append(max(low[-1] + 1, int(low[-1] * GROWTH)))
    low = np.array(low, np.int64)
    differ = (low[1:] - 1) * (100 - percent) // percent
    spare = np.zeros(len(differ), np.int64)
    for _ in range(40):
        parts = np.minimum(differ + 1 + spare, low[1:])
        empty = np.where(parts > 1, parts * np.exp(low[:-1] * np.log1p(-1 / np.maximum(parts, 2))), 0)
        spare = np.ceil(empty + 1.5 * np.sqrt(empty)).astype(np.int64)
    parts = differ + 1 + spare
    return low[:-1], np.where(parts >= low[:-1], np.where(differ > 0, 0, 1), parts), spare


def part_keys(hashes: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) of all parts with elements of sets of n elements, in each set's own ring and in those of smaller partners.

    Two linked sets have a key in common: both part their elements alike, and agree in a part with elements unless both
    have too many empty ones; such sets are parted once more by another hash, and in the end each element is a key.
    """
    low, parts, spare = rings(percent)
    of = np.repeat(np.arange(len(n)), n)
    own = np.searchsorted(low, n, side="right") - 1
    least = np.searchsorted(low, -(-n * percent // 100), side="right") - 1
    sets, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for back in range(int((own - least)[n > 0].max(initial=-1)) + 1):
        ring = np.maximum(own - back, 0)
        todo = (n > 0) & (own - back >= least)
        for turn in range(TURNS):
            whole = todo & (parts[ring] > 0)
            use = whole[of]
            if not use.any():
                break
            o, salt = of[use], C.numbers(31 + turn, 2)
            m = np.where(whole, parts[ring], 0)
            base = np.cumsum(m) - m
            slot = base[o] + ((C.mixed(hashes[use] ^ salt[1]) >> np.uint64(32)) * m[o].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            sums, held = np.zeros(int(m.sum()), np.uint64), np.bincount(slot, minlength=int(m.sum())) > 0
            np.add.at(sums, slot, C.mixed(hashes[use] ^ salt[0]))
            at = np.flatnonzero(held)
            one = np.repeat(np.arange(len(m)), m)[at]
            label = ring[one].astype(np.uint64) << np.uint64(40) | (at - base[one]).astype(np.uint64)
            sets.append(one)
            keys.append(C.mixed(C.mixed(label * _STEP ^ salt[0]) + sums[at]))
            todo = todo & (~whole | (m - np.bincount(one, minlength=len(m)) > spare[ring]))
        use = todo[of]
        sets.append(of[use])
        keys.append(C.mixed(hashes[use] ^ C.mixed(ring[of[use]].astype(np.uint64) + _STEP)))
    return np.concatenate(sets), np.concatenate(keys)


def width(n: int) -> int:
    """Bits of the sketch of n elements: twice as many, so that sketches of unrelated sets differ by much more than linked ones may."""
    return max(SKETCH, 1 << (2 * n - 1).bit_length())


def sketch(elements: np.ndarray, bits: int) -> np.ndarray:
    """Bits, set where an odd number of elements falls in: two sketches differ in no more bits than their sets in elements."""
    bucket = (C.mixed(elements ^ C.numbers(41, 1)[0]) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(bucket, minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def folded(s: np.ndarray, bits: int) -> np.ndarray:
    """A sketch of fewer bits of the same set."""
    return s if len(s) * 64 <= bits else np.bitwise_xor.reduce(s.reshape(-1, bits // 64), axis=0)


def apart(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Bits in which a sketch differs from each of others."""
    return np.bitwise_count(one ^ others).sum(axis=-1, dtype=np.int64)


def most_apart(n: np.ndarray, percent: int) -> np.ndarray:
    """The most elements in which a set of n elements differs from any that it links with."""
    return n * (100 - percent) // percent


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(both) - shared)


def tree(members: np.ndarray) -> list[tuple[int, int]]:
    """Links that hold members together, with three at most for each and short ways between all."""
    return [(int(members[(k - 1) // 2]), int(members[k])) for k in range(1, len(members))]
