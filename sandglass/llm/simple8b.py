"""Simple-8b: word-aligned coding of non-negative integers in 64-bit words, encoded and decoded with numpy.

The top 4 bits of a word select how many values of how many bits its 60 payload bits hold. A value of over 60 bits
is an escape: its word's payload is its place in a separate list of raw values, so words can be decoded in any order.
"""

from __future__ import annotations

import numpy as np

#: Fixed values: (values in a word, bits of each), by selector 1..14.
PACKINGS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
COUNTS = np.array([0, *(n for n, _ in PACKINGS), 1], dtype=np.int64)


#: Values of one lane: words never reach over a lane's end, so lanes are packed side by side and can be read alone.
LANE = 256


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escapes), both uint64; each word takes as many values as fit. The last lane is filled up with zeros."""
    n = len(values)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    lanes = -(-n // LANE)
    full = np.zeros(lanes * LANE, dtype=np.uint64)
    full[:n] = values
    most = int(full.max())
    small = full.astype(np.uint32) if most < 1 << 32 else full
    grade = np.zeros(full.shape, dtype=np.int8)  # the first packing that is wide enough
    for _, bits in PACKINGS:
        if bits > most.bit_length():
            break
        grade += small >= small.dtype.type(1 << bits)
    grade = grade.reshape(lanes, LANE)
    choice = np.full((lanes, LANE), len(PACKINGS), dtype=np.int8)
    choice[grade == len(PACKINGS)] = ESCAPE
    run, length = grade.copy(), 1  # largest grade of the values from each place on
    for s in range(len(PACKINGS) - 1, -1, -1):
        count = PACKINGS[s][0]
        while length < count:
            np.maximum(run[:, : LANE - length], grade[:, length:], out=run[:, : LANE - length])
            length += 1
        fits = run[:, : LANE - count + 1] <= s
        if not fits.any():
            break  # more values of fewer bits fit nowhere either
        choice[:, : LANE - count + 1][fits] = s + 1
    choice = choice.ravel()
    steps = COUNTS[choice]
    at = np.arange(0, lanes * LANE, LANE)
    ends = at + LANE
    starts = np.zeros(lanes * LANE, dtype=bool)
    while len(at):
        starts[at] = True
        at = at + steps[at]
        going = at < ends
        at, ends = at[going], ends[going]
    first = np.flatnonzero(starts[:n])
    selector = choice[first].astype(np.int64)
    words = selector.astype(np.uint64) << np.uint64(60)
    for s, (count, bits) in enumerate(PACKINGS, 1):
        own = np.flatnonzero(selector == s)
        if len(own):
            begin = first[own]
            packed = np.zeros(len(own), dtype=np.uint64)
            for k in range(count):
                packed |= full[begin + k] << np.uint64(bits * k)
            words[own] |= packed
    own = np.flatnonzero(selector == ESCAPE)
    words[own] |= np.arange(len(own), dtype=np.uint64)
    return words, full[first[own]]


def decode(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The first n values of the words."""
    words = np.asarray(words, dtype=np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    begin = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), dtype=np.uint64)
    for s, (count, bits) in enumerate(PACKINGS, 1):
        own = np.flatnonzero(selector == s)
        if len(own):
            word, mask = words[own], np.uint64((1 << bits) - 1)
            for k in range(count):
                out[begin[own] + k] = (word >> np.uint64(bits * k)) & mask
    own = np.flatnonzero(selector == ESCAPE)
    if len(own):
        out[begin[own]] = np.asarray(escapes, np.uint64)[(words[own] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out[:n]


def offsets(words: np.ndarray, stride: int) -> np.ndarray:
    """Place of the first value of every ``stride``-th word, so that readers may start there."""
    counts = COUNTS[(words >> np.uint64(60)).astype(np.int64)]
    return (np.cumsum(counts) - counts)[::stride].astype(np.uint32)
