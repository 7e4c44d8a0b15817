"""Suffix arrays by two-stage sorting, and the repeated strings of a buffer.

Suffixes smaller than their successor are sorted directly; all others are induced by one scan over the
buckets of first bytes. The order is carried to ``depth`` bytes, which is all that finding repeats of
that length needs. Buffers are arrays of bytes plus one, with 0 behind each string; the largest byte
value must not occur (it does not in UTF-8).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

DEPTH = 400
STRIDE = 48  # bytes compared at once by their hash
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))
_ROOT = 0x2545F4914F6CDD1D  # odd, so that its powers have inverses modulo 2**64


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash root and of its inverse modulo 2**64."""
    with np.errstate(over="ignore"):
        up = np.full(n, _ROOT, np.uint64)
        up[:1] = 1
        down = np.full(n, pow(_ROOT, -1, 1 << 64), np.uint64)
        down[:1] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def window_hashes(data: np.ndarray, width: int, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Hash of each ``width`` bytes of the buffer, equal for equal bytes."""
    if len(data) < width:
        return np.zeros(0, np.uint64)
    up, down = tables
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        x = (sums[width:] - sums[:-width]) * down[: len(data) - width + 1]
        x ^= x >> np.uint64(29)
        x *= _MIX[0]
        x ^= x >> np.uint64(32)
        x *= _MIX[1]
        x ^= x >> np.uint64(29)
    return x


def joined(strings: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buffer of the strings and the start of each."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    text = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8) + np.uint8(1)
    return text, np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(strings) else np.zeros(0, np.int64)


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number that sorts like them."""
    w = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    for shift in (1, 2, 4):
        w = (w[:-shift] << np.uint64(8 * shift)) | w[shift:]
    return np.concatenate([w[: len(text)], np.zeros(DEPTH + 8, np.uint64)])


def _ended(words: np.ndarray) -> np.ndarray:
    """Whether a word of eight bytes holds an end mark."""
    ones, highs = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
    with np.errstate(over="ignore"):
        return ((words - ones) & ~words & highs) != 0


def _sort_directly(
    positions: np.ndarray, words: np.ndarray, windows: np.ndarray, strides: np.ndarray, room: np.ndarray, depth: int
) -> np.ndarray:
    """Positions in the order of their suffixes' first ``depth`` bytes."""
    keys = words[positions]
    order = np.argsort(keys, kind="stable")
    positions, keys = positions[order], keys[order]
    at = np.arange(len(positions))  # places of the ties, and the group of each
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    ended = _ended(keys)
    while True:
        sizes = np.bincount(group) if len(group) else np.zeros(0, np.int64)
        tied = (sizes[group] > 1) & ~ended if len(group) else np.zeros(0, bool)
        at = at[tied]
        if not len(at):
            return positions
        own = positions[at]
        group = np.unique(group[tied], return_inverse=True)[1]
        first = own[np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])][group]
        # Ties over the whole depth are final; else the group splits at its first differing word.
        whole = (room[own] >= depth) & (room[first] >= depth) & (windows[own] == windows[first])
        step = np.full(len(own), depth, np.int64)
        open_ = np.flatnonzero(~whole)
        offset = np.full(len(open_), 8, np.int64)
        p, q = own[open_], first[open_]
        fits = np.minimum(np.minimum(room[p], room[q]), depth)
        left = np.arange(len(open_))
        while len(left):  # in strides while their hashes agree, then by words
            left = left[offset[left] + STRIDE <= fits[left]]
            left = left[strides[p[left] + offset[left]] == strides[q[left] + offset[left]]]
            offset[left] += STRIDE
        left = np.arange(len(open_))
        while len(left):
            left = left[offset[left] < depth]
            a, b = words[p[left] + offset[left]], words[q[left] + offset[left]]
            stop = (a != b) | _ended(a)
            step[open_[left[stop]]] = offset[left[stop]]
            left = left[~stop]
            offset[left] += 8
        least = np.full(group[-1] + 1, depth, np.int64)
        np.minimum.at(least, group, step)
        going = least[group] < depth
        at, own, group = at[going], own[going], group[going]
        if not len(at):
            return positions
        keys = words[own + least[group]]
        order = np.lexsort((keys, group))
        positions[at] = own[order]
        keys, group = keys[order], group[order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (group[1:] != group[:-1])])
        group = np.cumsum(new) - 1
        ended = _ended(keys)


def suffix_array(text: np.ndarray, room: np.ndarray, windows: np.ndarray, strides: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """All positions in suffix order, to ``depth`` bytes or the end mark."""
    n = len(text)
    step = np.zeros(n, np.int16)
    step[:-1] = np.diff(text.astype(np.int16))
    step[-1] = 1
    turns = np.flatnonzero(step)
    small = step[turns[np.searchsorted(turns, np.arange(n))]] > 0  # smaller than its successor
    small |= text == 0
    sizes = np.bincount(text, minlength=256)
    n_small = np.bincount(text[small], minlength=256)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    array = np.zeros(n, np.int64)
    direct = _sort_directly(np.flatnonzero(small & (text > 0)), _words(text), windows, strides, room, depth)
    split = np.cumsum(n_small[1:])
    for symbol in range(1, 256):
        if n_small[symbol]:
            array[ends[symbol] - n_small[symbol] : ends[symbol]] = direct[split[symbol - 1] - n_small[symbol] : split[symbol - 1]]
    array[: sizes[0]] = np.flatnonzero(text == 0)
    head = starts.copy()
    for symbol in range(256):
        if not sizes[symbol]:
            continue
        sources, done = [], starts[symbol]
        # Larger suffixes of this bucket may induce others of it: as many waves as a run has bytes.
        while done < head[symbol]:
            before = array[done : head[symbol]] - 1
            done = head[symbol]
            before = before[before >= 0]
            before = before[~small[before]]
            same = text[before] == symbol
            run = before[same]
            array[head[symbol] : head[symbol] + len(run)] = run
            head[symbol] += len(run)
            sources.append(before[~same])
        before = array[ends[symbol] - n_small[symbol] : ends[symbol]] - 1
        before = before[before >= 0]
        sources.append(before[~small[before]])
        before = np.concatenate(sources)
        if len(before):
            first = text[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(first)) + 1, [len(first)]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                bucket = first[a]
                array[head[bucket] : head[bucket] + b - a] = before[a:b]
                head[bucket] += b - a
    return array


def _equal(words: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Whether ``depth`` bytes (a multiple of eight) from a and b on are the same."""
    same = np.ones(len(a), bool)
    left = np.arange(len(a))
    for offset in range(0, depth, 8):
        left = left[words[a[left] + offset] == words[b[left] + offset]]
    same[:] = False
    same[left] = True
    return same


def repeats(strings: Sequence[bytes], places: np.ndarray, depth: int = DEPTH) -> list[tuple[int, int, int]]:
    """(string, start, end) of the runs covered by ``depth`` bytes that start at two places or more.

    ``places`` numbers the first byte of each string; the same place in two strings is one start.
    """
    if not len(strings):
        return []
    text, starts = joined(strings)
    owner = np.repeat(np.arange(len(strings)), np.diff(np.concatenate([starts, [len(text)]])))
    ends = np.concatenate([starts[1:], [len(text)]]) - 1
    index = np.arange(len(text))
    room = ends[owner] - index
    tables = powers(len(text))
    windows, strides = (
        np.concatenate([window_hashes(text, width, tables), np.zeros(min(width - 1, len(text)), np.uint64)])
        for width in (depth, STRIDE)
    )
    order = suffix_array(text, room, windows, strides, depth)
    order = order[room[order] >= depth]
    if len(order) < 2:
        return []
    # Adjacent common prefixes of at least the depth: by hash first, then byte by byte.
    near = np.flatnonzero(windows[order[1:]] == windows[order[:-1]])
    near = near[_equal(_words(text), order[near], order[near + 1], depth)]
    linked = np.zeros(len(order), bool)
    linked[near + 1] = True
    run = np.cumsum(~linked) - 1
    place = places[owner[order]] + order - starts[owner[order]]
    firsts = np.flatnonzero(~linked)
    least, most = np.minimum.reduceat(place, firsts), np.maximum.reduceat(place, firsts)
    found = np.sort(order[(least != most)[run]])
    if not len(found):
        return []
    breaks = np.flatnonzero((np.diff(found) > depth) | (np.diff(owner[found]) != 0))
    first, last = found[np.concatenate([[0], breaks + 1])], found[np.concatenate([breaks, [len(found) - 1]])]
    own = owner[first]
    return list(zip(own.tolist(), (first - starts[own]).tolist(), (last - starts[own] + depth).tolist(), strict=True))
