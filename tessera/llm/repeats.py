"""Suffix structures over sequences of words: the vocabulary of tandem repeats in a string, and the runs they merge into.

The method of Gusfield and Stoye: the blocks of a Lempel-Ziv factorisation give squares among which is the leftmost
occurrence of every distinct one; these are marked in the suffix tree, and walks along suffix links (which rotate a
square by one word) mark the rest of the vocabulary. The leaves below a mark are all places of its square; places of
squares of one primitive period that follow each other merge into a run.

Names of all substrings whose length is a power of two give the suffix array, and the longest common extension of any
two places forwards and backwards. What touches every place is done for all places at once; the walks are a loop over the
marks, each of a few steps.
"""

from __future__ import annotations

import numpy as np


class Names:
    """Of each place of a string, the rank of the substring of length 2**level that starts there."""

    def __init__(self, s: np.ndarray):
        """s: symbols from 0 on; its last symbol occurs nowhere else, so all suffixes differ."""
        self.n = n = len(s)
        self.levels = [np.unique(s, return_inverse=True)[1].astype(np.int32)]
        while int(self.levels[-1].max()) + 1 < n:
            last, half = self.levels[-1].astype(np.int64), 1 << (len(self.levels) - 1)
            after = np.full(n, -1, np.int64)
            after[: n - half] = last[half:]
            self.levels.append(np.unique(last * (n + 1) + after + 1, return_inverse=True)[1].astype(np.int32))
        self.rank = self.levels[-1]
        self.suffixes = np.empty(n, np.int32)
        self.suffixes[self.rank] = np.arange(n, dtype=np.int32)

    def forwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of what the suffixes from i and from j (different places) have in common."""
        i, j, out = i.astype(np.int64), j.astype(np.int64), np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            name = self.levels[level]
            step = (name[i] == name[j]).astype(np.int64) << level  # equal names never hold the last symbol
            i, j, out = i + step, j + step, out + step
        return out

    def backwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of what the prefixes that end with i and with j (different places) have in common."""
        i, j, out = i.astype(np.int64), j.astype(np.int64), np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            name, size = self.levels[level], 1 << level
            a, b = i - size + 1, j - size + 1
            fits = (a >= 0) & (b >= 0)
            step = (fits & (name[np.where(fits, a, 0)] == name[np.where(fits, b, 0)])).astype(np.int64) << level
            i, j, out = i - step, j - step, out + step
        return out


class SuffixTree:
    """Leaves 0 to n - 1 in the order of the suffix array, inner nodes after them, the root last among them by depth 0."""

    def __init__(self, s: np.ndarray, names: Names):
        n, self.n = len(s), len(s)
        sa = names.suffixes
        common = names.forwards(sa[:-1], sa[1:]) if n > 1 else np.zeros(0, np.int64)
        # inner nodes are the maximal intervals of suffixes that share so many symbols
        parent, depth, left, right, split = [0] * n, (n - sa.astype(np.int64)).tolist(), list(range(n)), list(range(n)), [0] * n
        root = n
        parent.append(n), depth.append(0), left.append(0), right.append(n - 1), split.append(1)
        stack, last = [root], 0  # last: the subtree that ends here and has no parent yet
        for at, height in enumerate(common.tolist(), 1):
            while depth[stack[-1]] > height:
                v = stack.pop()
                parent[last], right[v], last = v, at - 1, v
            if depth[stack[-1]] == height:
                parent[last] = stack[-1]
            else:
                v = len(parent)
                parent.append(0), depth.append(height), left.append(left[last]), right.append(0), split.append(at)
                parent[last] = v
                stack.append(v)
            last = at
        while len(stack) > 1:
            v = stack.pop()
            parent[last], right[v], last = v, n - 1, v
        parent[last] = root
        self.parent, self.depth, self.left, self.right = np.array(parent, np.int32), np.array(depth, np.int64), np.array(left, np.int32), np.array(right, np.int32)
        self.names, self.s = names, s
        self.up = [self.parent]
        while (self.up[-1] != root).any():
            self.up.append(self.up[-1][self.up[-1]])
        # suffix links: a leaf's is the leaf of the next suffix, an inner node's the place of its string without the first symbol
        link = np.full(len(parent), root, np.int32)
        has = sa < n - 1
        link[:n][has] = names.rank[sa[has] + 1]
        inner = np.arange(n + 1, len(parent))
        if len(inner):
            link[inner] = self.locus(sa[np.array(split, np.int32)[inner]] + 1, self.depth[inner] - 1)
        self.link = link

    def locus(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The highest node whose string begins with the ``length`` symbols from ``start`` on."""
        at = self.names.rank[start].astype(np.int64)
        for up in reversed(self.up):
            higher = up[at]
            at = np.where(self.depth[higher] >= length, higher, at)
        return at


def blocks(names: Names) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks: each is the longest text that also begins at an earlier place, or one new symbol."""
    n, sa = names.n, names.suffixes.tolist()
    before, after, stack = [-1] * n, [-1] * n, []
    for i in sa:  # the nearest suffixes on both sides in the suffix array that begin earlier in the string
        while stack and stack[-1] > i:
            after[stack.pop()] = i
        before[i] = stack[-1] if stack else -1
        stack.append(i)
    here, longest = np.arange(n), np.zeros(n, np.int64)
    for side in (np.array(before), np.array(after)):
        has = side >= 0
        longest[has] = np.maximum(longest[has], names.forwards(here[has], side[has]))
    jump, at, out = np.maximum(longest, 1).tolist(), 0, []
    while at < n:
        out.append(at)
        at += jump[at]
    return np.array(out, np.int64)


def leftmost_squares(names: Names, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of squares, the leftmost occurrence of every distinct one among their neighbours to the right or themselves.

    For each block and period: squares whose second half begins in the block (the common extension around the block's end),
    and those that begin before it or in it and reach into the next one (around its start).
    """
    n = names.n
    ends = np.append(starts[1:], n)
    size = ends - starts
    after = np.append(size[1:], 0)

    def spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        which = np.repeat(np.arange(len(count)), count)
        return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + 1

    found = []
    b, k = spread(size)  # around the end
    h1 = ends[b]
    q = h1 - k
    ok = (h1 < n) & (q >= 0)
    b, k, h1, q = b[ok], k[ok], h1[ok], q[ok]
    right, left = names.forwards(h1, q), names.backwards(h1 - 1, q - 1)
    ok = (right + left >= k) & (right > 0)
    found.append((np.maximum(q - left, q - k + 1)[ok], k[ok]))
    b, k = spread(size + after)  # around the start
    h, h1 = starts[b], ends[b]
    q = h + k
    ok = (q < n) & (h >= 1)
    b, k, h, h1, q = b[ok], k[ok], h[ok], h1[ok], q[ok]
    right, left = names.forwards(h, q), names.backwards(h - 1, q - 1)
    start = np.maximum(h - left, h - k + 1)
    ok = (right + left >= k) & (right > 0) & (left > 0) & (start + k <= h1)
    found.append((start[ok], k[ok]))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def vocabulary(tree: SuffixTree, start: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, period) of every distinct square of the string: the node is the highest below which all its places lie."""
    depth, parent, link = tree.depth.tolist(), tree.parent.tolist(), tree.link.tolist()
    first, s = tree.names.suffixes[tree.left].tolist(), tree.s.tolist()
    nodes = np.arange(len(depth))
    nodes = nodes[nodes != tree.n]
    symbols = int(tree.s.max()) + 1
    edge = tree.s[tree.names.suffixes[tree.left[nodes]] + tree.depth[tree.parent[nodes]]]
    child = dict(zip((tree.parent[nodes].astype(np.int64) * symbols + edge).tolist(), nodes.tolist(), strict=True))
    width = tree.n + 1
    begun = np.unique(tree.locus(start, 2 * period) * width + 2 * period).tolist()
    marked = set(begun)
    for key in begun:
        v, length = divmod(key, width)
        while True:
            symbol, u = s[first[v]], link[v]
            while depth[parent[u]] >= length - 1:
                u = parent[u]
            if depth[u] == length - 1:
                u = child.get(u * symbols + symbol, -1)
                if u < 0:
                    break
            elif s[first[u] + length - 1] != symbol:
                break
            key = u * width + length
            if key in marked:
                break
            marked.add(key)
            v = u
    keys = np.array(sorted(marked), np.int64)
    return keys // width, keys % width // 2


def _primitive(names: Names, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the ``period`` symbols from ``start`` on are no repetition of something shorter."""
    out, rest = np.ones(len(start), bool), period.copy()

    def check(which: np.ndarray, factor: np.ndarray | int) -> None:
        part = period[which] // factor
        out[which] &= names.forwards(start[which], start[which] + part) < period[which] - part

    p = 2
    while len(rest) and p * p <= int(rest.max()):
        which = np.flatnonzero(rest % p == 0)
        if len(which):
            check(which, p)
            while len(which):
                rest[which] //= p
                which = which[rest[which] % p == 0]
        p += 1
    which = np.flatnonzero(rest > 1)
    if len(which):
        check(which, rest[which])
    return out


def runs(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all maximal repetitions of exponent two or more, by start and period. s ends with a symbol of its own."""
    none = np.zeros(0, np.int64)
    if len(s) < 3:
        return none, none, none
    names = Names(s)
    start, period = leftmost_squares(names, blocks(names))
    if not len(start):
        return none, none, none
    tree = SuffixTree(s, names)
    node, period = vocabulary(tree, start, period)
    whole = _primitive(names, names.suffixes[tree.left[node]].astype(np.int64), period)
    node, period = node[whole], period[whole]
    count = (tree.right[node] - tree.left[node] + 1).astype(np.int64)
    leaf = np.repeat(tree.left[node].astype(np.int64), count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    places = np.sort(np.repeat(period, count) * np.int64(len(s)) + names.suffixes[leaf])
    new = np.append(True, np.diff(places) != 1)
    new[1:] |= (places[1:] // len(s)) != (places[:-1] // len(s))
    at = np.flatnonzero(new)
    last = places[np.append(at[1:], len(places)) - 1]
    start, period = places[at] % len(s), places[at] // len(s)
    length = last % len(s) - start + 2 * period
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]
