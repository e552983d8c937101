"""Best two labels of a name, exactly, with few pairs scored: bounds from letter counts, then from common subsequences, then scores.

Names and labels meet in blocks. For each name the labels' letter counts (arrays of the whole block) bound every score from
above; the most promising labels are scored first, and what the second best of them reaches rules most others out. For those
left, the longest common subsequence with the name, computed for all of them at once by bits, gives a closer bound. Scores
themselves are taken in the order of these bounds, until no bound is left that could still change the best two.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np

from .fuzzy import composite

#: Letters that a block tells apart; further ones share columns, which only makes bounds wider.
COLUMNS = 96
#: Labels scored before bounds are compared, and the slack of comparing floating-point bounds with scores.
SEEDS, SLACK = 12, 1e-9
#: Longest names and labels whose common subsequences are taken by bits; of longer ones letter counts alone bound the score.
BITS, PLACES = 64, 256


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, a column of the table in two bit vectors."""
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, d = every, 0, len(a)
    for c in b:
        eq = where.get(c, 0)
        flat = ((eq & up) + up ^ up) | eq
        eq |= down
        rise, fall = down | (every & ~(flat | up)), up & flat
        d += bool(rise & last) - bool(fall & last)
        rise, fall = (rise << 1 | 1) & every, fall << 1 & every
        up, down = fall | (every & ~(eq | rise)), rise & eq
    return d


def edit(a: str, b: str) -> float:
    longest = max(len(a), len(b))
    return 100.0 * (longest - edit_distance(a, b)) / longest if longest else 0.0


@dataclass(frozen=True)
class Sizes:
    """A name against a block's labels: lengths, of raw texts and of distinct words, and shared words."""

    la: int
    lb: np.ndarray
    wa: int
    wb: np.ndarray
    shared: np.ndarray  # letters of shared words with the blanks between, 0 without any
    inside: np.ndarray  # all words of one are words of the other

    def at(self, i: np.ndarray) -> Sizes:
        return Sizes(self.la, self.lb[i], self.wa, self.wb[i], self.shared[i], self.inside[i])


def edit_bound(z: Sizes, common: np.ndarray, _: np.ndarray) -> np.ndarray:
    return 100.0 * common / np.maximum(z.la, np.maximum(z.lb, 1))


def composite_bound(z: Sizes, common: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Upper bound of fuzzy.composite; common and words bound the common subsequences of the texts and of their sorted words."""
    short, long = np.minimum(z.la, z.lb), np.maximum(z.la, z.lb)
    times = long / np.maximum(short, 1)
    plain = 200.0 * common / np.maximum(z.la + z.lb, 1)
    some = z.shared > 0
    sorted_words = np.minimum(200.0 * words / np.maximum(z.wa + z.wb, 1), 100)
    with_rest = np.where(some, 200.0 * z.shared / np.maximum(z.shared + np.minimum(z.wa, z.wb), 1), 0)
    token = np.where(z.inside & some, 100, np.maximum(sorted_words, with_rest))
    scale = np.where(times <= 8, 0.9, 0.6)
    part = 200.0 * common / np.maximum(short + common, 1)
    least = np.minimum(z.wa, z.wb)
    part_words = np.where(some, 100, np.minimum(200.0 * words / np.maximum(least + np.minimum(words, least), 1), 100))
    far = np.maximum(scale * part, 0.95 * scale * part_words)
    return np.where(short == 0, 0, np.maximum(plain, np.where(times < 1.5, 0.95 * token, far)))


@dataclass(frozen=True)
class Score:
    exact: Callable[[str, str], float]
    bound: Callable[[Sizes, np.ndarray, np.ndarray], np.ndarray]
    words: bool  # whether words and their order matter to the bound


SCORES = {"edit": Score(edit, edit_bound, False), "composite": Score(composite, composite_bound, True)}


def sorted_words(text: str) -> str:
    return " ".join(sorted(set(text.split())))


class Codes:
    """Texts of a block as arrays: letters by place, and counts by letter."""

    def __init__(self, texts: list[str]):
        self.lengths = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        letters, at = np.unique(points, return_inverse=True)
        self.letters = {chr(c): i for i, c in enumerate(letters)}
        row = np.repeat(np.arange(len(texts)), self.lengths)
        place = np.arange(len(points)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.counts = np.bincount(at % COLUMNS * len(texts) + row, minlength=COLUMNS * len(texts)).reshape(COLUMNS, -1).astype(np.int32)
        near = place < PLACES
        self.by_place = np.full((min(PLACES, int(self.lengths.max(initial=0))), len(texts)), -1, np.int32)
        self.by_place[place[near], row[near]] = at[near]

    def common_letters(self, text: str) -> np.ndarray:
        """How many letters each text shares with this one, an upper bound of their common subsequences."""
        out = np.zeros(len(self.lengths), np.int64)
        for k, n in Counter(self.letters[c] % COLUMNS for c in text if c in self.letters).items():
            out += np.minimum(self.counts[k], n)
        return out

    def subsequences(self, text: str, of: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences with the texts ``of``; the bound given, where one is too long for it."""
        if len(text) > BITS:
            return bound
        masks = np.zeros(len(self.letters) + 1, np.uint64)  # the last is that of places beyond a text's end
        for i, c in enumerate(text):
            if c in self.letters:
                masks[self.letters[c]] |= np.uint64(1 << i)
        free = np.full(len(of), (1 << BITS) - 1, np.uint64)
        for row in self.by_place[: int(self.lengths[of].max(initial=0))]:
            hit = free & masks[row[of]]
            free = free + hit | free - hit
        found = np.bitwise_count(~free & np.uint64((1 << len(text)) - 1)).astype(np.int64)
        return np.where(self.lengths[of] <= PLACES, found, bound)


class Block:
    """Labels against which names are searched, put in their order; norms are what is compared."""

    def __init__(self, labels: list, norms: list[str], score: str):
        self.order = sorted(range(len(labels)), key=lambda i: labels[i])
        self.norms, self.score = [norms[i] for i in self.order], SCORES[score]
        self.raw, self.scored = Codes(self.norms), 0
        if self.score.words:
            self.sorted = Codes([sorted_words(n) for n in self.norms])
            self.twice = np.array([len(n.split()) > len(set(n.split())) for n in self.norms], bool)
            self.n_words = np.array([len(set(n.split())) for n in self.norms])
            holders: dict[str, list[int]] = {}
            for i, n in enumerate(self.norms):
                for w in set(n.split()):
                    holders.setdefault(w, []).append(i)
            self.holders = {w: np.array(i) for w, i in holders.items()}

    def sizes(self, name: str) -> Sizes:
        n, none = len(self.norms), np.zeros(len(self.norms), np.int64)
        if not self.score.words:
            return Sizes(len(name), self.raw.lengths, 0, none, none, none.astype(bool))
        letters, times, words = np.zeros(n, np.int64), np.zeros(n, np.int64), set(name.split())
        for w in words & self.holders.keys():
            letters[self.holders[w]] += len(w) + 1
            times[self.holders[w]] += 1
        return Sizes(len(name), self.raw.lengths, len(sorted_words(name)), self.sorted.lengths, np.maximum(letters - 1, 0), (times == len(words)) | (times == self.n_words))

    def best_two(self, name: str) -> list[tuple[float, int]]:
        """(score, place in order) of the two best labels, equal scores by label."""
        z, common = self.sizes(name), self.raw.common_letters(name)
        bound = self.score.bound(z, common, common).astype(np.float64)
        best: list[tuple[float, int]] = []

        def take(places: Iterable[int], bounds: np.ndarray) -> None:
            """Scores places in the order of their bounds, as long as one can be among the best two."""
            nonlocal best
            for i in places:
                if len(best) == 2:
                    least, at = -best[1][0], best[1][1]
                    if bounds[i] < least - SLACK:
                        return
                    if bounds[i] <= least and i > at:
                        continue  # it can tie at best, and comes later
                self.scored += 1
                best = sorted([*best, (-self.score.exact(name, self.norms[i]), int(i))])[:2]

        first = np.argpartition(-bound, min(SEEDS, len(bound) - 1))[:SEEDS]
        first = first[np.argsort(-self.closer(name, z.at(first), common[first], first), kind="stable")][:2]
        take(first, bound)
        least = -best[1][0] - SLACK if len(best) == 2 else -1.0
        left = np.setdiff1d(np.flatnonzero(bound >= least), first)
        bound[left] = self.closer(name, z.at(left), common[left], left)
        take(left[np.lexsort((left, -bound[left]))], bound)
        return [(-s, i) for s, i in best]

    def closer(self, name: str, z: Sizes, common: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Bounds by common subsequences of the texts, and of their sorted words where no word is shared or repeated."""
        words = common
        if self.score.words and len(name.split()) == len(set(name.split())):
            alone = (z.shared == 0) & ~self.twice[of]
            words = np.where(alone, self.sorted.subsequences(sorted_words(name), of, common), common)
        return self.score.bound(z, self.raw.subsequences(name, of, common), words)
