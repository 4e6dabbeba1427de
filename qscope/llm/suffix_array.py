"""Suffix arrays by induced sorting, vectorised: suffixes are classified, the leftmost-smaller
substrings sorted by induction and named, the string of names sorted recursively, and the
array induced from them in one pass each way. Common prefixes come in text order, from the
positions where they can't be derived from the one before."""

from __future__ import annotations

import numpy as np

#: Alphabets above this have buckets that are too small to be handled as arrays.
BUCKETS = 1024


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its right neighbour (S); the last is S."""
    n = len(t)
    step = np.flatnonzero(t[:-1] != t[1:])
    smaller = t[step] < t[step + 1]
    out = np.ones(n, bool)
    if len(step):
        which = np.searchsorted(step, np.arange(n - 1), "left")
        inside = which < len(step)
        out[:-1][inside] = smaller[which[inside]]
        out[:-1][~inside] = False
    else:
        out[:-1] = False
    return out


def _spread(sa: np.ndarray, at: np.ndarray, chars: np.ndarray, items: np.ndarray, k: int, up: bool) -> None:
    """Append items, in order, to their characters' buckets: upwards from at, or downwards."""
    order = np.argsort(chars, kind="stable")
    c, v = chars[order], items[order]
    edge = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    count = np.diff(np.concatenate([edge, [len(c)]]))
    rank = np.arange(len(c)) - np.repeat(edge, count)
    heads = at[c[edge]]
    if up:
        sa[np.repeat(heads, count) + rank] = v
        at[c[edge]] += count
    else:
        sa[np.repeat(heads, count) - rank] = v
        at[c[edge]] -= count


def _induce(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """The suffix array that follows from the order of the leftmost-smaller suffixes `lms`."""
    n = len(t)
    counts = np.bincount(t, minlength=k)
    ends = np.cumsum(counts)
    starts = ends - counts
    sa = np.full(n, -1, np.int32)
    placed = np.bincount(t[lms], minlength=k)
    order = np.argsort(t[lms], kind="stable")
    lms_sorted = lms[order]
    first = np.cumsum(placed) - placed
    head = starts.copy()
    used = np.flatnonzero(counts)
    for c in used:
        done = int(starts[c])
        while done < head[c]:
            j = sa[done : head[c]] - 1
            done = int(head[c])
            j = j[j >= 0]
            j = j[~s_type[j]]
            if len(j):
                _spread(sa, head, t[j], j, k, True)
        mine = lms_sorted[first[c] : first[c] + placed[c]] - 1
        mine = mine[mine >= 0]
        if len(mine):
            _spread(sa, head, t[mine], mine, k, True)
    tail = ends - 1
    for c in used[::-1]:
        done = int(ends[c]) - 1
        while done > tail[c]:
            block = sa[int(tail[c]) + 1 : done + 1][::-1]
            done = int(tail[c])
            j = block - 1
            j = j[j >= 0]
            j = j[s_type[j]]
            if len(j):
                _spread(sa, tail, t[j], j, k, False)
        block = sa[int(starts[c]) : int(head[c])][::-1]
        j = block - 1
        j = j[j >= 0]
        j = j[s_type[j]]
        if len(j):
            _spread(sa, tail, t[j], j, k, False)
    return sa


def _induce_one_by_one(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """The same where buckets are too small to be handled as arrays: suffixes are placed one
    by one, up for the larger ones and down for the smaller ones."""
    char, small = t.tolist(), s_type.tolist()
    counts = np.bincount(t, minlength=k)
    ends = np.cumsum(counts)
    sa = [-1] * len(char)
    tail = ends.tolist()
    for i in reversed(lms.tolist()):
        c = char[i]
        tail[c] -= 1
        sa[tail[c]] = i
    head = (ends - counts).tolist()
    for j in sa:  # what is placed ahead is met later in this pass
        if j > 0 and not small[j - 1]:
            c = char[j - 1]
            sa[head[c]] = j - 1
            head[c] += 1
    tail = ends.tolist()
    for j in reversed(sa):
        if j > 0 and small[j - 1]:
            c = char[j - 1]
            tail[c] -= 1
            sa[tail[c]] = j - 1
    return np.array(sa, np.int32)


def _name(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Names, in text order, of the leftmost-smaller substrings that `order` lists sorted;
    equal substrings have one name."""
    n, m = len(t), len(lms)
    length = np.diff(np.append(lms, n - 1)) + 1
    where = np.full(n, -1, np.int32)
    where[lms] = np.arange(m)
    seq = where[order]
    a, b = seq[:-1], seq[1:]
    same = length[a] == length[b]
    live = np.flatnonzero(same)
    d = 0
    while len(live):
        x, y = lms[a[live]] + d, lms[b[live]] + d
        equal = t[x] == t[y]
        same[live[~equal]] = False
        live = live[equal]
        d += 1
        live = live[length[a[live]] > d]
    names = np.empty(m, np.int64)
    names[seq] = np.concatenate([[0], np.cumsum(~same)])
    return names


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of t in order. t holds small non-negative integers; its last
    must be its only least."""
    n = len(t)
    k = int(t.max()) + 1 if n else 0
    if n < 3:
        return np.arange(n, dtype=np.int32)[::-1]
    induce = _induce_one_by_one if k > BUCKETS else _induce
    s_type = _types(t)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = s_type[1:] & ~s_type[:-1]
    lms = np.flatnonzero(is_lms)
    sa = induce(t, s_type, lms, k)
    sa = _with_last(sa, n)
    order = sa[is_lms[sa]]
    names = _name(t, lms, order)
    if names.max() + 1 < len(lms):
        order = lms[suffix_array(names)]
    return _with_last(induce(t, s_type, order, k), n)


def _with_last(sa: np.ndarray, n: int) -> np.ndarray:
    """The last suffix is the least of all: its bucket is the first place."""
    sa[0] = n - 1
    return sa


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each text position, how long its suffix agrees with the one before it in the array
    (the permuted array). Where the characters to the left agree as well, it is one less
    than the position before has; only the others are compared."""
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    derived = np.zeros(n, bool)
    ok = np.flatnonzero(before > 0)
    ok = ok[ok > 0]
    derived[ok] = t[ok - 1] == t[before[ok] - 1]
    base = np.flatnonzero(~derived)
    length = np.zeros(n, np.int64)
    live = base[before[base] >= 0]
    # Four characters at a time, then one by one.
    quad = t[: max(0, n - 3)].astype(np.uint64)
    for i in (1, 2, 3):
        quad |= t[i : n - 3 + i].astype(np.uint64)[: len(quad)] << np.uint64(16 * i)
    d, close = 0, []
    while len(live):
        x, y = live + d, before[live] + d
        inside = np.maximum(x, y) < len(quad)
        equal = np.zeros(len(live), bool)
        equal[inside] = quad[x[inside]] == quad[y[inside]]
        length[live] = d
        close.append(live[~equal])
        live = live[equal]
        d += 4
    live = np.concatenate(close) if close else live
    for _ in range(3):
        x, y = live + length[live], before[live] + length[live]
        inside = np.maximum(x, y) < n
        live, x, y = live[inside], x[inside], y[inside]
        live = live[t[x] == t[y]]
        length[live] += 1
    last = np.maximum.accumulate(np.where(derived, -1, np.arange(n)))
    return length[last] - (np.arange(n) - last)
