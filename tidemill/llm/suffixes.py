"""Maximal repeats over a sparse, enhanced suffix array.

The suffixes are those that start at an anchor inside a context (a short stretch of text). They are
sorted; the lengths of the prefixes shared by neighbours define a tree of common-prefix intervals,
found by one scan with a stack. Below each interval the same is done with the texts to the left of
the anchors. A set of contexts is a maximal repeat if its members differ both in what follows (they
span several children of the interval) and in what precedes (they form an interval on the left).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def common_prefix_intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, end) of each interval of depth least or more; lcp[i] is shared by i - 1 and i, lcp[0] is 0."""
    stack: list[tuple[int, int]] = []  # (depth, first), depths rising
    n = len(lcp)
    for i in range(1, n + 1):
        depth = lcp[i] if i < n else 0
        first = i - 1
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def padded(strings: list[bytes], size: int) -> np.ndarray:
    """A row of bytes per string, each byte plus one and zeros behind; UTF-8 has no 0xFF, so none overflows."""
    out = np.zeros((len(strings), size), np.uint8)
    lengths = np.array([len(s) for s in strings], np.int64)
    data = np.frombuffer(b"".join(strings), np.uint8) + np.uint8(1)
    row = np.repeat(np.arange(len(strings)), lengths)
    out[row, np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = data
    return out


def _order(key: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places in the order of key, then rows as strings."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    words = wide.view(">u8").astype(np.uint64)
    return np.lexsort([words[:, k] for k in reversed(range(words.shape[1]))] + [key])


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of padded rows."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def maximal_repeats(
    keys: np.ndarray, left: list[bytes], right: list[bytes], least: int, left_size: int, right_size: int
) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes before the anchor, bytes from it on, contexts) of every maximal repeat of least bytes or more.

    keys: contexts with different keys share no repeat. left: the text before each anchor, reversed.
    right: the text from the anchor on.
    """
    n = len(keys)
    if n < 2:
        return
    rights, lefts = padded(right, right_size), padded(left, left_size)
    order = _order(keys, rights)
    same = np.zeros(n, bool)
    same[1:] = keys[order[1:]] == keys[order[:-1]]
    lcp = np.zeros(n, np.int64)
    lcp[1:] = np.where(same[1:], _shared(rights[order[1:]], rights[order[:-1]]), 0)
    left_rank = np.empty(n, np.int64)
    left_rank[_order(np.zeros(n, np.int64), lefts)] = np.arange(n)
    starts = np.flatnonzero(~same)
    sizes = np.diff(np.append(starts, n))

    pairs = starts[sizes == 2]  # a key with two contexts: one interval on each side
    a, b = order[pairs], order[pairs + 1]
    r, l = lcp[pairs + 1], _shared(lefts[a], lefts[b])
    for k in np.flatnonzero(l + r >= least):
        yield int(l[k]), int(r[k]), [int(a[k]), int(b[k])]

    bits, shared_left = 8 * left_size, [int.from_bytes(x.tobytes(), "big") for x in lefts] if (sizes > 2).any() else []
    lengths = [len(x) for x in left]

    def left_shared(x: int, y: int) -> int:
        return min((bits - (shared_left[x] ^ shared_left[y]).bit_length()) // 8, lengths[x], lengths[y])

    for first, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        depths = lcp[first : first + size].tolist()
        depths[0] = 0
        members = order[first : first + size].tolist()
        yield from _of_key(members, depths, left_rank, left_shared, least, max(1, least - left_size), None)


def _of_key(members: list[int], depths: list[int], left_rank, left_shared, least: int, from_depth: int, below: int | None):
    """The maximal repeats of sorted members of one key, by the lengths they share to the right; below leaves out deeper ones."""
    place = {m: k for k, m in enumerate(members)}
    for depth, lo, hi in common_prefix_intervals(depths, from_depth):
        if below is not None and depth >= below:
            continue
        need = max(0, least - depth)
        if hi - lo == 2:
            x, y = members[lo], members[lo + 1]
            if (shared := left_shared(x, y)) >= need:
                yield shared, depth, [x, y]
            continue
        own = sorted(members[lo:hi], key=left_rank.__getitem__)
        before = [0] + [left_shared(x, y) for x, y in zip(own, own[1:])]
        if need == 0 and min(before[1:]) == 0:
            yield from _if_diverse(0, depth, own, place, depths)
        for shared, i, j in common_prefix_intervals(before, max(1, need)):
            yield from _if_diverse(shared, depth, own[i:j], place, depths)


def _if_diverse(shared: int, depth: int, group: list[int], place: dict[int, int], depths: list[int]):
    """The group, unless all its members also agree in what follows: then a deeper interval reports it."""
    at = [place[m] for m in group]
    low, high = min(at), max(at)
    if min(depths[low + 1 : high + 1]) == depth:
        yield shared, depth, group


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


def piecewise_repeats(left: list[bytes], before: list[int], fewest: list[int], piece: list[bytes], least: int, depth: int, size: int):
    """One step to the right in the maximal repeats of one key: (those that end in this piece, the sets that go on).

    The members share `depth` bytes from the anchor on; piece has the next bytes, fewer than size only at
    the end of a text. left: the text before each anchor, reversed, of at most before + 1 bytes: the
    context and the byte ahead of it. A set that shares that byte too is reported from an earlier anchor,
    one that shares fewer than `fewest` bytes before the anchor from a later one; and one that shares
    the byte ahead and the whole piece has nothing more to report here.
    """
    members = sorted(range(len(piece)), key=piece.__getitem__)
    depths = [0] + [depth + common_prefix(piece[x], piece[y]) for x, y in zip(members, members[1:])]
    rank = {m: k for k, m in enumerate(sorted(members, key=left.__getitem__))}
    found = _of_key(members, depths, rank, lambda x, y: common_prefix(left[x], left[y]), least, 1, depth + size)
    ended = ((shared, d, g) for shared, d, g in found if fewest[g[0]] <= shared <= before[g[0]])
    onward, first = [], 0
    for k in range(1, len(members) + 1):
        if k == len(members) or depths[k] < depth + size:
            own = members[first:k]
            if len(own) > 1 and (len(left[own[0]]) <= before[own[0]] or any(left[m] != left[own[0]] for m in own)):
                onward.append(own)
            first = k
    return ended, onward
