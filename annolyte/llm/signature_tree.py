"""Signature trees: sets under nodes with OR-combined bitmaps and size ranges, joined by dual traversal."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

FANOUT = 8
#: Bits of a bitmap at least and at most; node pairs that are bounded at once, and bytes of their bitmaps.
LEAST_BITS, MOST_BITS, AT_ONCE, AT_BYTES = 256, 1 << 14, 1 << 14, 1 << 23


def bits_for(sizes: np.ndarray) -> int:
    """Four times the median set, so that few tokens share a bit."""
    want = 4 * int(np.median(sizes)) if len(sizes) else LEAST_BITS
    return int(min(MOST_BITS, max(LEAST_BITS, 1 << (want - 1).bit_length())))


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    out = np.empty((len(sets), bits // 64), np.uint64)
    for at in range(0, len(sets), 512):
        part = sets[at : at + 512]
        flags = np.zeros((len(part), bits), np.uint8)
        for i, s in enumerate(part):
            flags[i, (s & np.uint64(bits - 1)).astype(np.int64)] = 1
        out[at : at + len(part)] = np.packbits(flags, axis=1).view(np.uint64)
    return out


class Tree:
    """Level 0 has the sets in the given order; each node above covers FANOUT neighbours."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, groups: np.ndarray, levels: int):
        sizes = sizes.astype(np.int64)
        #: Tokens of a set that share their bit with another: what a bitmap may hide.
        hidden = sizes - np.bitwise_count(maps).sum(1, dtype=np.int64)
        self.levels = [(maps, sizes, sizes, hidden, groups)]
        for _ in range(levels):
            m, low, high, hid, grp = self.levels[-1]
            starts = np.arange(0, len(m), FANOUT)
            top, bottom = np.maximum.reduceat(grp, starts), np.minimum.reduceat(grp, starts)
            self.levels.append((
                np.bitwise_or.reduceat(m, starts, axis=0),
                np.minimum.reduceat(low, starts),
                np.maximum.reduceat(high, starts),
                np.maximum.reduceat(hid, starts),
                np.where((top == bottom) & (bottom >= 0), top, -1),
            ))


def levels_for(n: int) -> int:
    k = 0
    while n > 1:
        n = -(-n // FANOUT)
        k += 1
    return k


def at_once(maps: np.ndarray) -> int:
    """How many pairs of bitmaps are held at once."""
    return max(64, min(AT_ONCE, AT_BYTES // (8 * max(1, maps.shape[1]))))


def overlap(maps: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Bits that each of maps has in common with one."""
    step = at_once(maps)
    return np.concatenate([np.bitwise_count(maps[i : i + step] & one).sum(1, dtype=np.int64) for i in range(0, len(maps), step)])


def dual(a: Tree, b: Tree, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets that the bounds leave, in batches. same: a is b, and each pair comes once."""
    most_pairs = at_once(a.levels[0][0])
    stack = [(len(a.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        if len(i) > most_pairs:
            stack.append((level, i[most_pairs:], j[most_pairs:]))
            i, j = i[:most_pairs], j[:most_pairs]
        am, alow, ahigh, ahid, agrp = a.levels[level]
        bm, blow, bhigh, bhid, bgrp = b.levels[level]
        # Sets whose sizes differ by more than a quarter can't be alike; nodes within one group need no more links.
        ok = (4 * ahigh[i] >= 3 * blow[j]) & (4 * bhigh[j] >= 3 * alow[i]) & ((agrp[i] != bgrp[j]) | (agrp[i] < 0))
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        # Common tokens have common bits, except for those that hide behind another's bit.
        most = np.bitwise_count(am[i] & bm[j]).sum(1, dtype=np.int64) + np.minimum(ahid[i], bhid[j])
        ok = 7 * most >= 3 * (alow[i] + blow[j])
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if level == 0:
            yield (i[i < j], j[i < j]) if same else (i, j)
            continue
        na, nb = len(a.levels[level - 1][0]), len(b.levels[level - 1][0])
        step = np.arange(FANOUT)
        ci = (i[:, None, None] * FANOUT + step[None, :, None]).repeat(FANOUT, 2).ravel()
        cj = (j[:, None, None] * FANOUT + step[None, None, :]).repeat(FANOUT, 1).ravel()
        ok = (ci < na) & (cj < nb)
        if same:
            ok &= ci <= cj
        stack.append((level - 1, ci[ok], cj[ok]))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard of two sorted sets at least 0.75: 100 * intersection >= 75 * union."""
    x, y = len(a), len(b)
    if 4 * min(x, y) < 3 * max(x, y) or not x or not y:
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= 75 * (x + y - inter)


class Groups:
    """Union-find over positions."""

    def __init__(self, n: int, start: np.ndarray | None = None):
        self.up = list(range(n))
        if start is not None:
            first: dict[int, int] = {}
            for i, g in enumerate(start.tolist()):
                self.up[i] = first.setdefault(g, i)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True

    def array(self) -> np.ndarray:
        return np.fromiter((self.find(i) for i in range(len(self.up))), np.int64, len(self.up))


#: Sets that are compared with all others before the traversal; blocks below this size have none.
PIVOTS, SMALL = 8, 16


def one_bitmap(tokens: np.ndarray, most: int = 1 << 16) -> bytes:
    """A document's own bitmap, of two bits or more for each token."""
    bits = min(most, max(64, 1 << (2 * len(tokens) - 1).bit_length()))
    flags = np.zeros(bits, np.uint8)
    flags[(tokens & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags).tobytes()


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps of several lengths at the least of them: a longer one's parts are OR-combined."""
    size = min(len(m) for m in maps)
    out = np.zeros((len(maps), size // 8), np.uint64)
    for i, m in enumerate(maps):
        out[i] = np.bitwise_or.reduce(np.frombuffer(m, np.uint64).reshape(-1, size // 8), axis=0)
    return out


def link(sets: list[np.ndarray], probe: np.ndarray | None = None, groups: np.ndarray | None = None, found: Callable[[int, int], None] = lambda i, j: None) -> Groups:
    """Joins like sets into groups; found(i, j) gets links enough to connect each group.

    probe: if given, only pairs with a set where it's true are compared. groups: what is
    connected already.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    maps = bitmaps(sets, bits_for(sizes))
    least = np.array([int(s[0]) if len(s) else 0 for s in sets], np.uint64)
    common = np.zeros(len(sets))
    if len(sets) >= SMALL:
        tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
        common = np.array([counts[np.searchsorted(tokens, s)].mean() if len(s) else 0.0 for s in sets])
    return traverse(maps, sizes, common, least, lambda a, b: alike(sets[a], sets[b]), found, probe, groups)


def traverse(maps: np.ndarray, sizes: np.ndarray, common: np.ndarray, least: np.ndarray, test: Callable[[int, int], bool], found: Callable[[int, int], None], probe: np.ndarray | None = None, groups: np.ndarray | None = None) -> Groups:
    """Joins into groups the pairs that the bounds leave and test confirms.

    common: how much of a set others share; least: what brings like sets together in the tree's order.
    The sets most in common are compared with all first: a large group of near copies is
    connected by its centre, and nodes within one group are pruned from then on.
    """
    n = len(sizes)
    state = Groups(n, groups)
    if n < 2:
        return state
    hidden = sizes - np.bitwise_count(maps).sum(1, dtype=np.int64)

    def settle(i: np.ndarray, j: np.ndarray) -> None:
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if state.find(a) != state.find(b) and test(a, b):
                state.join(a, b)
                found(a, b)

    if n >= SMALL:
        asked: set[int] = set()
        for _ in range(PIVOTS):
            now = state.array()
            free = ~np.isin(now, [state.find(a) for a in asked]) if asked else np.ones(n, bool)
            if not free.any():
                break
            p = int(np.argmax(np.where(free, common, -np.inf)))
            asked.add(p)
            most = overlap(maps, maps[p]) + np.minimum(hidden, hidden[p])
            ok = (now != now[p]) & (4 * sizes >= 3 * sizes[p]) & (4 * sizes[p] >= 3 * sizes) & (7 * most >= 3 * (sizes + sizes[p]))
            if probe is not None and not probe[p]:
                ok &= probe
            others = np.flatnonzero(ok)
            settle(np.full(len(others), p), others)
    now = state.array()
    if (now == now[0]).all():
        return state
    order = np.lexsort((least, sizes, now))
    if probe is None:
        t = Tree(maps[order], sizes[order], now[order], levels_for(n))
        for i, j in dual(t, t, True):
            _in_turns(state, settle, order[i], order[j])
    else:
        left, right = order[probe[order]], order
        if not len(left):
            return state
        depth = levels_for(n)
        a, b = Tree(maps[left], sizes[left], now[left], depth), Tree(maps[right], sizes[right], now[right], depth)
        for i, j in dual(a, b, False):
            keep = left[i] != right[j]
            _in_turns(state, settle, left[i][keep], right[j][keep])
    return state


def _in_turns(state: Groups, settle: Callable, i: np.ndarray, j: np.ndarray) -> None:
    """Leaves out, again and again, the pairs that other links have connected meanwhile."""
    while len(i):
        now = state.array()
        ok = now[i] != now[j]
        i, j = i[ok], j[ok]
        settle(i[:2000], j[:2000])
        i, j = i[2000:], j[2000:]
