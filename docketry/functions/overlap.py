"""Pairs of word sets that share enough, block against block, with exact scores.

Most pairs of texts of one language share few words. Every word gets one of a few
hundred columns, frequent words one of their own; the product of these counts is never
less than what two sets share, so it drops most pairs without looking at their words.
Pairs that it leaves are counted word by word.

A block is (sizes, words, codes): sets in ascending size, the distinct words of the
block from the most frequent on, and the places of each set's words among them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

STRIP = 1024          # sets of a block that are compared at a time
FOLDS = (128, 256, 512, 1024, 2048, 4096, 8192)
FOLD_PER_WORD = 3     # of a set of middling size: fewer columns leave more pairs, more make the product longer
PAIRS = 250_000       # pairs that are counted exactly at a time, about
ENTRIES = 1_000_000   # words that are looked up at a time

NONE = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32))  # a block without sets


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all runs, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def by_frequency(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words from the most frequent on, and the new place of each."""
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return words[order], rank


def block_of(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block of sets that are listed one after the other in ``values``."""
    words, codes = np.unique(values, return_inverse=True)
    words, rank = by_frequency(words, np.bincount(codes, minlength=len(words)))
    row = np.repeat(np.arange(len(sizes)), sizes) * max(1, len(words))
    row += rank[codes]
    row.sort()
    return sizes, words, (row % max(1, len(words))).astype(np.int32)


def pack(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The steps between the ascending codes of a set in a byte each, and those that need more."""
    steps = np.diff(codes, prepend=np.int32(0))
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    steps[first] = codes[first]
    return np.minimum(steps, 255).astype(np.uint8), steps[steps >= 255]


def unpack(steps: np.ndarray, wide: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    steps = steps.astype(np.int64)
    steps[steps == 255] = wide
    run = np.concatenate([[0], np.cumsum(steps)])
    return (run[1:] - np.repeat(run[np.cumsum(sizes) - sizes], sizes)).astype(np.int32)


def _joint(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray, int]:
    """The codes of both blocks among the words of both."""
    words = np.unique(np.concatenate([a[1], b[1]]))
    counts, places = np.zeros(len(words), dtype=np.int64), []
    for _, own, codes in (a, b):
        places.append(np.searchsorted(words, own))
        counts[places[-1]] += np.bincount(codes, minlength=len(own))
    rank = by_frequency(words, counts)[1]
    return *(rank[place].astype(np.int32)[block[2]] for place, block in zip(places, (a, b))), len(words)


def _folded(codes: np.ndarray, sizes: np.ndarray, fold: int, counts: bool) -> np.ndarray:
    """Words of each set by column, or 1 for any: frequent words have one each, the others share ``fold`` columns; two stay free."""
    own = fold // 2
    place = np.where(codes < own, codes, own + (codes & (fold - 1)))
    place += np.repeat(np.arange(len(sizes), dtype=np.int32) * np.int32(own + fold + 2), sizes)
    table = np.zeros(len(sizes) * (own + fold + 2), dtype=np.float32)
    if counts:
        np.add.at(table, place, np.float32(1))
    else:
        table[place] = 1
    return table.reshape(len(sizes), -1)


def _shared(l: np.ndarray, r: np.ndarray, left: tuple, right: tuple, words: int) -> np.ndarray:
    """How many words the sets of each pair share; ``l`` ascends."""
    (l_codes, l_starts, l_sizes), (r_codes, r_starts, r_sizes) = left, right
    shared, marked = np.zeros(len(l), dtype=np.int64), np.zeros(words, dtype=bool)
    reach = np.cumsum(r_sizes[r])
    at = 0
    while at < len(l):
        done = reach[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(reach, done + ENTRIES, "right")))
        held = r_codes[spans(r_starts[r[at:end]], r_sizes[r[at:end]])]
        ends = reach[at:end] - done
        hit = np.zeros(len(held) + 1, dtype=np.int32)
        firsts = np.flatnonzero(np.diff(l[at:end], prepend=-1))
        begins = (ends - r_sizes[r[at:end]])[firsts].tolist()
        for row, begin, stop in zip(l[at:end][firsts].tolist(), begins, [*begins[1:], len(held)]):
            mine = l_codes[l_starts[row]:l_starts[row] + l_sizes[row]]
            marked[mine] = True
            hit[begin + 1:stop + 1] = marked[held[begin:stop]]
            marked[mine] = False
        run = np.cumsum(hit)
        shared[at:end] = run[ends] - run[ends - r_sizes[r[at:end]]]
        at = end
    return shared


def near_pairs(a: tuple, b: tuple | None, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (place in ``a``, place in ``b``, score) with at least ``threshold`` percent of
    their words in common, each pair once; without ``b`` the pairs inside ``a``."""
    inside = b is None
    b = a if inside else b
    codes_a, codes_b, words = (a[2], a[2], len(a[1])) if inside else _joint(a, b)
    sizes_a, sizes_b = a[0], b[0]
    starts_a, starts_b = np.cumsum(sizes_a) - sizes_a, np.cumsum(sizes_b) - sizes_b
    # The share times 100 is at least threshold - 0.5 where its rounded value reaches the threshold.
    least = threshold - 0.6
    weight = least / (100 + least)

    def strip(codes, starts, sizes, at, fold, small, asks):
        some = sizes[at:at + STRIP]
        table = _folded(codes[starts[at]:starts[at] + some.sum()], some, fold, small)
        table[:, -2 if asks else -1] = -weight * some
        table[:, -1 if asks else -2] = 1
        return table

    def counted(parts):
        l, r = (np.concatenate(side) for side in zip(*parts))
        order = np.argsort(l, kind="stable")
        l, r = l[order], r[order]
        shared = _shared(l, r, (codes_a, starts_a, sizes_a), (codes_b, starts_b, sizes_b), words).astype(np.float64)
        score = np.rint(100.0 * shared / np.maximum(sizes_a[l] + sizes_b[r] - shared, 1)).astype(np.int64)
        near = score >= threshold
        return l[near], r[near], score[near]

    def extent(sizes, at):
        some = sizes[at:at + STRIP]
        return int(some[0]), float(some.mean()), int(some[-1])

    room = np.empty(STRIP * STRIP, dtype=np.float32)
    for at in range(0, len(sizes_a), STRIP):
        low_a, mid_a, high_a = extent(sizes_a, at)
        asking, parts, waiting = {}, [], 0
        for to in range(at if inside else 0, len(sizes_b), STRIP):
            low_b, mid_b, high_b = extent(sizes_b, to)
            if 100 * high_a < least * low_b or 100 * high_b < least * low_a:
                continue  # the smaller set is too small for that share
            wanted = FOLD_PER_WORD * 2 * mid_a * mid_b / max(1, mid_a + mid_b)
            fold = next((n for n in FOLDS if n >= wanted), FOLDS[-1])
            # Counts on the side of the smaller sets: what a set shares is at most its own size.
            small = mid_a <= mid_b
            if (fold, small) not in asking:
                asking[fold, small] = strip(codes_a, starts_a, sizes_a, at, fold, small, True)
            left, right = asking[fold, small], strip(codes_b, starts_b, sizes_b, to, fold, not small, False)
            bound = np.matmul(left, right.T, out=room[:len(left) * len(right)].reshape(len(left), len(right)))
            l, r = np.divmod(np.flatnonzero(bound >= 0), len(right))
            l, r = l + at, r + to
            if inside and at == to:
                l, r = l[l < r], r[l < r]
            parts.append((l, r))
            waiting += len(l)
            if waiting > PAIRS:
                yield counted(parts)
                parts, waiting = [], 0
        if waiting:
            yield counted(parts)
