"""ProbMinHash signatures of weighted word shingles.

Every shingle is a Poisson process whose rate is its weight: its arrivals come in exponential gaps drawn from its hash, and each
arrival hits one register at random. A register keeps the shingle that hits it first. A shingle's process stops as soon as its
next arrival is later than every register's first one, so the work is that of filling the registers once. Two texts agree in a
register with the probability of their probability Jaccard similarity,

    J_P(x, y) = sum over d in both of 1 / sum_i max(x_i / x_d, y_i / y_d),

which is the plain Jaccard similarity where all weights are 1.
"""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word -> 64-bit hash; emptied between texts once it holds ``limit`` words."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(word_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and how often each stands. Fewer than SHINGLE words are one shingle; none, none."""
    n = len(word_hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    width = min(SHINGLE, n)
    h = np.full(n - width + 1, np.uint64(width))
    for k in range(width):
        h = mix((h + _A) ^ word_hashes[k : n - width + 1 + k])
    return np.unique(h, return_counts=True)


def signatures(elements: np.ndarray, weights: np.ndarray, sizes: np.ndarray, registers: int) -> np.ndarray:
    """The element that each register keeps, [texts, registers], for the texts whose shingles stand one after the other.

    ``sizes`` has the number of shingles of each text, one at least. All texts take their next arrivals at once.
    """
    texts = len(sizes)
    first = np.full(texts * registers, np.inf)
    kept = np.zeros(texts * registers, np.uint64)
    base = np.repeat(np.arange(texts, dtype=np.int64), sizes)
    own = state = elements
    rate, when = weights.astype(np.float64), np.zeros(len(elements))
    while len(own):
        state = mix(state + _A)
        when = when - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) / 9007199254740992.0) / rate
        place = base * registers + (mix(state ^ _C) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, place, when)
        won = when == first[place]
        kept[place[won]] = own[won]
        # a process whose arrival is later than every register's first has ended
        alive = when < first.reshape(texts, registers).max(axis=1)[base]
        base, own, state, rate, when = base[alive], own[alive], state[alive], rate[alive], when[alive]
    return kept.reshape(texts, registers)


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact J_P of two weighted sets given as ascending distinct elements and weights."""
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    wa, wb = wa.astype(float), wb.astype(float)
    only_a, only_b = wa.sum() - wa[i].sum(), wb.sum() - wb[j].sum()
    # for each shared d the sum of max(x_i / x_d, y_i / y_d): shared i split by the ratio x_i / y_i against x_d / y_d
    ratio = wa[i] / wb[j]
    order = np.argsort(ratio, kind="stable")
    x, y, r = wa[i][order], wb[j][order], ratio[order]
    x_after = np.concatenate([np.cumsum(x[::-1])[::-1], [0.0]])
    y_before = np.concatenate([[0.0], np.cumsum(y)])
    # x_i / x_d >= y_i / y_d exactly where ratio_i >= ratio_d
    at = np.searchsorted(r, r, side="left")
    total = (only_a + x_after[at]) / x + (only_b + y_before[at]) / y
    return float((1.0 / total).sum())
