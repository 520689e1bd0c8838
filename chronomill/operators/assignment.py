"""The one-to-one pairs with the greatest total of shared words, without a table of all pairs.

The assignment is solved over few pairs, which also gives each record a price; then all pairs are gone through, a block
at a time, and those that share more words than the prices of both sides together are added. When there is none left,
the assignment is best over all pairs (duality). A pair is looked at again only if it was above its prices or if one of
them has fallen. Memory grows with the records, time with the pairs.
"""

from __future__ import annotations

import numpy as np

COLUMNS = 256  # at most, of words that many pairs share, multiplied as a matrix; other words by their lists
SHARE = 10_000  # one pair of so many makes a word worth a column
CELLS = 1 << 22  # pairs looked at together
FOUND = 1 << 22  # pairs that a pass adds, about
KEPT = 1 << 24  # pairs from which those far below their prices are given up

Side = tuple[np.ndarray, np.ndarray]  # where the words of each record begin (one more than records), words by number


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _spread(starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the lists ``at``: which of them, and the place, of every entry."""
    n = starts[at + 1] - starts[at]
    return np.repeat(np.arange(len(at)), n), np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())


class SharedWords:
    """How many words the records of two sides share, by blocks of pairs."""

    def __init__(self, left: Side, right: Side):
        self.n = [len(s) - 1 for s, _ in (left, right)]
        self.seed = 0
        words = 1 + max(int(w.max(initial=0)) for _, w in (left, right))
        rows = [np.repeat(np.arange(n), np.diff(s)) for n, (s, _) in zip(self.n, (left, right), strict=True)]
        pairs = np.bincount(left[1], minlength=words) * np.bincount(right[1], minlength=words)
        often = np.argsort(-pairs, kind="stable")[:COLUMNS]
        often = often[pairs[often] * SHARE > self.n[0] * self.n[1]]
        place = np.full(words, -1)
        place[often] = np.arange(len(often))
        has = [np.zeros((n, len(often)), bool) for n in self.n]
        for h, r, (_, w) in zip(has, rows, (left, right), strict=True):
            p = place[w]
            h[r[p >= 0], p[p >= 0]] = True
        bits = np.concatenate([np.packbits(h, axis=0) for h in has]).T
        _, one, weight = np.unique(bits, axis=0, return_index=True, return_counts=True)  # words that always come together
        self.left, self.right = has[0][:, one] * weight.astype(np.int16), np.ascontiguousarray(has[1][:, one].T)
        rest = (place < 0) & (pairs > 0)
        (l, wl), (r, wr) = ((x[rest[w]], w[rest[w]]) for x, (_, w) in zip(rows, (left, right), strict=True))
        self.word, self.row_starts = wl, _starts(np.bincount(l, minlength=self.n[0]))
        self.listed, self.starts = r[np.argsort(wr, kind="stable")], _starts(np.bincount(wr, minlength=words))

    def above(self, u: np.ndarray, v: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of ``rows`` and ``cols`` with more shared words than ``u + v``, and that number: of each record that has
        any, for each part of the other side that has any, the one that is most above."""
        nl, nr = len(rows), len(cols)
        none = np.zeros(0, np.int64)
        if not nl or not nr:
            return none, none, none.astype(np.int32)
        parts = int(np.clip(FOUND // (nl + nr), 8, 64))
        tall, wide, high = -(-nl // parts), -(-nr // parts), max(1, CELLS // nr)
        self.seed += 1
        rng = np.random.default_rng(self.seed)
        few = [rng.uniform(-0.3, 0.3, x) for x in ((nl, 4), (4, nr))]  # products stay under 0.4: of equal pairs each record gets another
        b = np.vstack([x.astype(np.float32) for x in (self.right[:, cols], few[1], np.ones(nr), -v[cols])])
        place = np.full(self.n[1], -1)
        place[cols] = np.arange(nr)
        found = []
        for part in range(0, nl, tall):
            best, who = np.full(nr, 0.5, np.float32), np.zeros(nr, np.int64)
            for at in range(part, min(nl, part + tall), high):
                to = min(nl, part + tall, at + high)
                own = rows[at:to]
                s = np.column_stack([x.astype(np.float32) for x in (self.left[own], few[0][at:to], -u[own], np.ones(to - at))]) @ b
                x, w = _spread(self.row_starts, own)
                e, k = _spread(self.starts, self.word[w])
                x, k = x[e], place[self.listed[k]]
                np.add.at(s, (x[k >= 0], k[k >= 0]), 1)
                top = s.max(axis=0)
                j = np.flatnonzero(top > best)
                if len(j):
                    best[j], who[j] = top[j], at + (s.argmax(axis=0)[j] if 2 * len(j) > nr else s[:, j].argmax(axis=0))
                i = np.flatnonzero(s.max(axis=1) > 0.5)
                if len(i):
                    s = s if len(i) == to - at else s[i]
                    for c in range(0, nr, wide):
                        most = s[:, c : c + wide].argmax(axis=1) + c
                        over = s[np.arange(len(i)), most]
                        k = np.flatnonzero(over > 0.5)
                        found.append((i[k] + at, most[k], over[k]))
            j = np.flatnonzero(best > 0.5)
            found.append((who[j], j, best[j]))
        i, j, s = (np.concatenate(x) for x in zip(*found, strict=True))
        i, j = rows[i], cols[j]
        return i, j, np.rint(s).astype(np.int32) + u[i] + v[j]


def assign_sparse(nl: int, nr: int, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The partner of each left record (-1 for none) with the greatest total, and the prices of both sides.

    Pairs ``(i, j)`` come once each, in order of i; weights are positive integers, no other pair can be chosen. All
    unmatched left records have the same price, which falls from the greatest weight to 0; at each, the pairs that cost
    nothing are matched as far as possible, along paths that are sought from all unmatched records at once.
    """
    price = int(w.max(initial=0))
    u, v = np.full(nl, price, np.int32), np.zeros(nr, np.int32)
    mate, owner = np.full(nl, -1), np.full(nr, -1)
    rng = np.random.default_rng(0)
    while price > 0:
        tight = np.flatnonzero(u[i] + v[j] == w)
        to, starts = j[tight], _starts(np.bincount(i[tight], minlength=nl))
        while True:
            front = np.flatnonzero(mate < 0)
            root, grown, seen = np.full(nl, -1), np.zeros(nl, bool), np.zeros(nr, bool)
            parent, reached, ends = np.full(nr, -1), np.zeros(nl, bool), []
            root[front], reached[front] = front, True
            while len(front):
                x, e = _spread(starts, front)
                y = to[e]
                new = ~seen[y]
                x, y = x[new], y[new]
                order = rng.permutation(len(y))
                parent[y[order]] = front[x[order]]
                y = np.unique(y)
                seen[y] = True
                free = y[owner[y] < 0]
                roots, first = np.unique(root[parent[free]], return_index=True)  # one path for each tree
                ends.append(free[first])
                grown[roots] = True
                y = y[owner[y] >= 0]
                front = owner[y]
                root[front], reached[front] = root[parent[y]], True
                front = front[~grown[root[front]]]
            y = np.concatenate([np.zeros(0, np.int64), *ends])
            if not len(y):
                break
            while len(y):
                x = parent[y]
                before = mate[x]
                mate[x], owner[y] = y, x
                y = before[before >= 0]
        out = reached[i] & ~seen[j]
        step = min(price, int((u[i[out]] + v[j[out]] - w[out]).min(initial=price)))
        u[reached] -= step
        v[seen] += step
        price = price - step if (mate < 0).any() else 0
    return mate, u, v


def assign_words(left: Side, right: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, shared words) of the one-to-one pairs with the greatest total; a record's words are distinct."""
    rng = np.random.default_rng(0)
    orders = [rng.permutation(len(s) - 1) for s, _ in (left, right)]  # so that a part is a sample
    sides = [(_starts(np.diff(s)[o]), w[_spread(s, o)[1]]) for o, (s, w) in zip(orders, (left, right), strict=True)]
    shared = SharedWords(*sides)
    nl, nr = shared.n
    u, v = np.zeros(nl, np.int32), np.zeros(nr, np.int32)
    pairs, weights = np.zeros(0, np.int64), np.zeros(0, np.int32)
    mate, total, given_up = np.full(nl, -1), 0, -1
    rows, cols = np.ones(nl, bool), np.ones(nr, bool)
    while True:
        across = shared.above(u, v, np.flatnonzero(rows), np.arange(nr))
        down = shared.above(u, v, np.flatnonzero(~rows), np.flatnonzero(cols))
        i, j, w = (np.concatenate(x) for x in zip(across, down, strict=True))
        if not len(i):
            break
        rows = np.bincount(i, minlength=nl) > 0
        if not len(pairs):
            tops = [np.zeros(n, np.int32) for n in shared.n]
            for top, k in zip(tops, (i, j), strict=True):
                np.maximum.at(top, k, w)
            most = (w == tops[0][i]) | (w == tops[1][j])
            i, j, w = i[most], j[most], w[most]
        elif len(pairs) + len(i) > KEPT and total > given_up:  # never twice at one total, so this ends
            near = u[pairs // nr] + v[pairs % nr] - weights <= 1
            pairs, weights, given_up = pairs[near], weights[near], total
        pairs, first = np.unique(np.concatenate([pairs, i * nr + j]), return_index=True)
        weights = np.concatenate([weights, w])[first]
        before = u, v
        mate, u, v = assign_sparse(nl, nr, pairs // nr, pairs % nr, weights)
        rows, cols = rows | (u < before[0]), v < before[1]
        total = int(u.sum()) + int(v.sum())
    i = np.flatnonzero(mate >= 0)
    w = weights[np.searchsorted(pairs, i * nr + mate[i])]
    i, j = orders[0][i], orders[1][mate[i]]
    order = np.argsort(i)
    return i[order], j[order], w[order]
