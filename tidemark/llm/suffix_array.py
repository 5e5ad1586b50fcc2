"""Suffix arrays by induced sorting, and permuted longest common prefixes.

Suffixes are S-type (smaller than the next one) or L-type; a leftmost S-type position (LMS) begins an LMS substring.
LMS substrings are sorted by one induction and named in order; the string of names is sorted in turn by the same procedure,
recursively, until all names differ.  A second induction from the sorted LMS suffixes gives the array.  An induction visits
the buckets of first characters in order.  While the alphabet is small against the string, what a bucket holds is moved to
its predecessors' buckets in one vectorised step per run of equal characters.  A string over a large alphabet of names is
sorted as the string of their digits, so that the alphabet is small again; where that would not shorten the next string
of names, and in short strings, suffixes are moved one at a time.  Work is linear in the string either way.
"""

from __future__ import annotations

import numpy as np


def types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is S-type; the last one is L-type (an end smaller than all follows)."""
    n = len(text)
    step = np.full(n, -1, np.int8)
    step[:-1] = (text[1:] > text[:-1]).view(np.int8) - (text[1:] < text[:-1]).view(np.int8)
    at = np.where(step != 0, np.arange(n, dtype=_place(n)), n)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _place(n: int) -> type:
    """The kind of number that places in a string of length n take."""
    return np.int32 if n < 2**31 - 1 else np.int64


def _induce(text: np.ndarray, s_type: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The order that the LMS positions, given in order, induce on all suffixes."""
    n = len(text)
    counts = np.bincount(text, minlength=size)
    ends = np.cumsum(counts)
    starts = ends - counts
    split = (ends - np.bincount(text[s_type], minlength=size)).tolist()  # where a bucket's S part begins
    out = np.full(n, -1, _place(n))
    after_l, after_s = np.zeros(n, bool), np.zeros(n, bool)
    after_l[1:], after_s[1:] = ~s_type[:-1], s_type[:-1]

    # the given positions at the ends of their buckets, in order
    first = np.bincount(text[lms], minlength=size)
    seeds = lms[np.argsort(text[lms], kind="stable")]
    seed_end = np.cumsum(first).tolist()

    def put(edge: np.ndarray, found: np.ndarray, step: int) -> None:
        """Add to what their buckets hold, in the order given: behind it (1) from ``edge`` on, or before it (-1)."""
        chars = text[found]
        order = np.argsort(chars, kind="stable")
        found, chars = found[order], chars[order]
        if 8 * len(chars) < size:
            before = np.searchsorted(chars, chars)
        else:
            sizes = np.bincount(chars, minlength=size)
            before = np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = edge[chars] + step * (np.arange(len(chars)) - before)
        out[at] = found
        edge[chars] = at + step  # of equal ones the last counts

    used = np.flatnonzero(counts).tolist()
    head = starts.copy()
    if not s_type[n - 1]:
        put(head, np.asarray([n - 1], out.dtype), 1)
    for c, at in zip(used, starts[used].tolist()):
        while at < (to := int(head[c])):
            now, at = out[at:to], to
            now = now[after_l[now]]
            if len(now):
                put(head, now - 1, 1)
        here = seeds[seed_end[c] - first[c] : seed_end[c]]
        if len(here):
            put(head, here - 1, 1)  # an LMS position comes after an L-type one

    tail = ends - 1
    for c, low, at in zip(used[::-1], starts[used].tolist()[::-1], ends[used].tolist()[::-1]):
        while at > (to := int(tail[c]) + 1):
            now, at = out[to:at][::-1], to
            now = now[after_s[now]]
            if len(now):
                put(tail, now - 1, -1)
        now = out[low : split[c]][::-1]
        now = now[after_s[now]]
        if len(now):
            put(tail, now - 1, -1)
    return out


def _induce_singly(text: np.ndarray, s_type: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The same order as ``_induce``, one suffix at a time."""
    n = len(text)
    ends = np.cumsum(np.bincount(text, minlength=size))
    head = np.concatenate([[0], ends[:-1]]).tolist()
    tail = ends.tolist()
    # the character of each position of one type, -1 for the other type and for what stands before the string or is not placed yet
    large, small = ([*np.where(kind, text, -1).tolist(), -1, -1] for kind in (~s_type, s_type))
    chars = text.tolist()
    out = [-1] * n
    for i in reversed(lms.tolist()):
        c = chars[i]
        tail[c] -= 1
        out[tail[c]] = i
    if not s_type[n - 1]:
        c = chars[n - 1]
        out[head[c]] = n - 1
        head[c] += 1
    for i in out:  # what a step places is met later in the same pass
        c = large[i - 1]
        if c >= 0:
            p = head[c]
            out[p] = i - 1
            head[c] = p + 1
    tail = ends.tolist()
    for i in reversed(out):
        c = small[i - 1]
        if c >= 0:
            p = tail[c] = tail[c] - 1
            out[p] = i - 1
    return np.asarray(out, np.int64)


def suffix_array(text: np.ndarray, size: int, longer: int = 1 << 62, separator: int | None = None) -> np.ndarray:
    """The suffixes of ``text`` (integers below ``size``) in order.

    A long string over a large alphabet is sorted as the string of its characters' two digits, unless it came from a
    string of digits that was not much longer (``longer``).  A ``separator``, smaller than all other characters, counts as another
    character wherever it stands (in the order of their places, one at the end first), so that no comparison goes beyond it; none
    stands in front or beside another.
    """
    n = len(text)
    if n > 1 << 13 and size * 64 > n and 4 * n < 3 * longer and separator is None:
        base = int(np.ceil(np.sqrt(size)))
        kind = np.int16 if base < 2**15 else np.int64  # short numbers are dealt to buckets faster
        digits = np.stack(np.divmod(text, base), axis=1).astype(kind).reshape(-1)
        order = _sorted(digits, base, 2 * n)
        return order[order % 2 == 0] // 2
    return _sorted(text, size, longer, separator)


def _sorted(text: np.ndarray, size: int, longer: int, separator: int | None = None) -> np.ndarray:
    n = len(text)
    if n < 2:
        return np.arange(n)
    induce = _induce if size * 64 <= n else _induce_singly
    s_type = types(text)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    if not len(lms):
        return induce(text, s_type, lms, size)
    order = induce(text, s_type, lms, size)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = order[is_lms[order]]

    # names: neighbours in order have one name if their substrings, up to the next LMS position, are equal
    length = np.empty(n, _place(n))
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = n - lms[-1] + 1  # past the end: equal to no other
    if separator is not None:
        at_one = text[lms] == separator
        order[: at_one.sum()] = lms[at_one]
    a, b = order[:-1], order[1:]
    differs = (length[a] != length[b]) | (a == lms[-1]) | (b == lms[-1])
    if separator is not None:  # the induction left those that end with one in the order of their places
        differs |= (text[b] == separator) | (text[np.minimum(b + length[b], n) - 1] == separator)
    left = np.flatnonzero(~differs)
    a, b, most = a[left], b[left], length[a[left]]
    k = 0
    while len(left):
        unequal = text[a + k] != text[b + k]
        differs[left[unequal]] = True
        k += 1
        go = np.flatnonzero(~unequal & (k < most))
        left, a, b, most = left[go], a[go], b[go], most[go]
    name = np.empty(n, np.int64)
    name[order] = np.concatenate([[0], np.cumsum(differs)])
    names = name[lms]
    kinds = int(names.max()) + 1
    out = induce(text, s_type, order if kinds == len(lms) else lms[_sorted_names(names, kinds, longer)], size)
    if separator is not None:
        places = np.flatnonzero(text == separator)
        out[: len(places)] = np.roll(places, int(len(places) and places[-1] == n - 1))
    return out


def _sorted_names(names: np.ndarray, kinds: int, longer: int) -> np.ndarray:
    """The suffixes of a string of names in order.

    No comparison goes beyond a name that occurs once, so such a name is left out where it follows another one, and its suffix
    lies where the name tells."""
    count = np.bincount(names, minlength=kinds)
    once = count[names] == 1
    kept = ~once
    kept[1:] |= ~once[:-1]
    at = np.flatnonzero(kept)
    used = np.zeros(kinds, bool)
    used[names[at]] = True
    order = at[suffix_array((np.cumsum(used) - 1)[names[at]], int(used.sum()), longer)]
    single = np.flatnonzero(once)
    place = (np.cumsum(count) - count)[names[single]]
    free = np.ones(len(names), bool)
    free[place] = False
    out = np.empty(len(names), np.int64)
    out[place], out[free] = single, order[~once[order]]
    return out


def permuted_lcp(text: np.ndarray, order: np.ndarray, separator: int | None = None) -> np.ndarray:
    """For each position, how many characters its suffix shares with the one before it in order, up to a separator.

    Where the characters before both suffixes agree (and are no separator), the value is one less than at the position
    before; only the other, irreducible values are found by comparing.
    """
    n = len(order)
    before = np.full(n, -1, _place(n))
    before[order[1:]] = order[:-1]
    hard = before <= 0
    hard[0] = True
    rest = np.flatnonzero(~hard)
    hard[rest] = text[rest - 1] != text[before[rest] - 1]
    if separator is not None:
        hard[1:] |= text[:-1] == separator
    out = np.zeros(n, before.dtype)
    left = np.flatnonzero(hard & (before >= 0))
    here, there = left, before[left].astype(np.int64)
    while len(left):
        fine = (here < n) & (there < n)
        left, here, there = left[fine], here[fine], there[fine]
        mine = text[here]
        same = mine == text[there]
        if separator is not None:
            same &= mine != separator
        left, here, there = left[same], here[same] + 1, there[same] + 1
        out[left] += 1
    position = np.arange(n, dtype=before.dtype)
    head = np.maximum.accumulate(np.where(hard, position, 0))
    value = np.maximum(out[head] - (position - head), 0)
    value[before < 0] = 0
    return value
