"""Cross-polytope hashes of vectors after fast Hadamard rotations, with probes of the next best buckets."""

import itertools
import math

import numpy as np

from talliard.llm import chunks as C

#: Coordinates of a rotated vector that are tried as the largest.
NEXT = 3
#: Rotations of signs and Hadamard transforms that stand for a random one.
TURNS = 3
#: Pairs that measure how often a pair at the least cosine meets in a table.
MEASURED = 2000
SKETCH = 64


def unit(rows: list[bytes], kind: str, width: int) -> np.ndarray:
    """Vectors of length one in double precision; shorter ones end in zeros."""
    out = np.zeros((len(rows), width))
    for k, row in enumerate(rows):
        v = np.frombuffer(row, kind)
        out[k, : len(v)] = v
    if len(rows):
        out /= np.abs(out).max(axis=1, keepdims=True)  # else squares overflow or vanish
        out /= np.linalg.norm(out, axis=1, keepdims=True)
    return out


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """x times random signs and a Hadamard matrix, TURNS times; the width is a power of two."""
    n, width = x.shape
    for turn in range(TURNS):
        x = x * np.where(C.numbers(seed * TURNS + turn, width) >> np.uint64(63), -1.0, 1.0)
        half = 1
        while half < width:
            pairs = x.reshape(n, width // (2 * half), 2, half)
            x = np.concatenate((pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]), axis=2).reshape(n, width)
            half *= 2
    return x / width ** (TURNS / 2)


class Plan:
    """How many hashes make a key so that about as many keys as vectors exist, and how many tables reach a recall.

    The last hash takes fewer coordinates. The tables follow from a measurement on fixed random pairs at the least cosine.
    """

    def __init__(self, n: int, width: int, cosine: float, recall: float, probes: int):
        self.width = max(2, 1 << (width - 1).bit_length())
        self.probes = probes
        self.takes = [1]
        while math.prod(2 * k for k in self.takes) < n:
            if self.takes[-1] < self.width:
                self.takes[-1] *= 2
            else:
                self.takes.append(1)
        rng = np.random.default_rng(1)
        x, z = rng.normal(size=(2, MEASURED, self.width))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(1, keepdims=True) * x
        y = cosine * x + math.sqrt(1 - cosine**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
        a, b = self.keys(x, 0), self.keys(y, 0)
        met = np.mean((a[:, :1] == b).any(1) | (b[:, :1] == a).any(1))
        self.tables = 1 if met >= recall else math.ceil(math.log(1 - recall) / math.log(1 - min(max(met, 0.001), 0.999)))
        share = math.acos(cosine) / math.pi
        #: Sketches of linked vectors differ in no more bits, but for one pair in a hundred thousand.
        self.most_bits = math.ceil(SKETCH * share + 4.5 * math.sqrt(SKETCH * share * (1 - share)))

    def keys(self, x: np.ndarray, table: int) -> np.ndarray:
        """For each vector its key in a table, then those of the next best buckets."""
        cells, losses = [], []
        for k, take in enumerate(self.takes):
            y = rotated(x, 1 + table * 64 + k)[:, :take]
            both = np.concatenate((y, -y), axis=1)
            best = np.argsort(-both, axis=1, kind="stable")[:, :NEXT]
            score = np.take_along_axis(both, best, 1)
            cells.append(best)
            losses.append((score[:, :1] - score) ** 2)
        ways = [w for w in itertools.product(*(range(c.shape[1]) for c in cells))]
        loss = np.stack([sum(losses[k][:, w] for k, w in enumerate(way)) for way in ways], axis=1)
        chosen = np.array(ways)[np.argsort(loss, axis=1, kind="stable")[:, : self.probes]]
        key = np.full(chosen.shape[:2], table, np.uint64)
        for k, cell in enumerate(cells):
            key = C.mixed(key * np.uint64(2 * self.width + 1) + np.take_along_axis(cell, chosen[:, :, k], 1).astype(np.uint64))
        return key.view(np.int64)

    def sketches(self, x: np.ndarray) -> np.ndarray:
        """SKETCH signs of rotated coordinates."""
        turns = -(-SKETCH // self.width)
        y = np.concatenate([rotated(x, (1 << 20) + k) for k in range(turns)], axis=1)[:, :SKETCH]
        return np.packbits(y > 0, axis=1).view(np.int64).ravel()
