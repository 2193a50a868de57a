"""Suffix arrays by induced sorting, and permuted longest common prefixes, in vectorised steps.

`suffix_array` classifies suffixes, sorts the leftmost-smaller (LMS) substrings by inducing from any order of their
heads, names them, sorts the reduced string recursively, and induces the array from the sorted LMS suffixes. A scan of
one bucket is one array operation per round; a bucket needs another round only where its symbol repeats in the text.
A reduced string over a large alphabet is rewritten in fixed-width digits, which keeps the order of its suffixes.
"""

from __future__ import annotations

import numpy as np

#: The largest alphabet whose buckets are scanned one by one; larger ones are rewritten in digits of it.
ALPHABET = 1024
#: Suffixes per symbol in use below which a text is scanned suffix by suffix.
STEPWISE = 100
#: Suffixes of a bucket's round up to which they are put one by one.
FEW = 24


def s_types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last, a unique least sentinel, is."""
    n = len(t)
    step = (t[1:] > t[:-1]).astype(np.int8) - (t[1:] < t[:-1])
    at = np.where(step != 0, np.arange(n - 1, dtype=np.int32), np.int32(n))
    following = np.minimum.accumulate(at[::-1])[::-1]  # the next change; before the sentinel there always is one
    return np.append(step[following] > 0, True)


def induce_stepwise(t: list[int], smaller: list[bool], lms: list[int], sizes: list[int]) -> np.ndarray:
    """`induce`, suffix by suffix: less work than an array operation per bucket where buckets hold few suffixes."""
    n, ends, total = len(t), [], 0
    for size in sizes:
        total += size
        ends.append(total)
    sa, tail = [-1] * n, ends.copy()
    for i in reversed(lms):
        tail[t[i]] -= 1
        sa[tail[t[i]]] = i
    head = [e - size for e, size in zip(ends, sizes, strict=True)]
    for i in range(n):
        j = sa[i] - 1
        if j >= 0 and not smaller[j]:
            c = t[j]
            sa[head[c]] = j
            head[c] += 1
    tail = ends
    for i in range(n - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and smaller[j]:
            c = t[j]
            tail[c] -= 1
            sa[tail[c]] = j
    sa[0] = n - 1
    return np.array(sa, np.int32)


def induce(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """The suffix array induced from LMS positions, given in order within each bucket."""
    n = len(t)
    sa = np.empty(n, np.int32)
    sizes = np.bincount(t, minlength=k)
    if n < STEPWISE * np.count_nonzero(sizes):
        return induce_stepwise(t.tolist(), smaller.tolist(), lms.tolist(), sizes.tolist())
    start = np.concatenate([[0], np.cumsum(sizes)])
    heads = t[lms]
    by_head = lms[np.argsort(heads, kind="stable")]
    lms_at = np.concatenate([[0], np.cumsum(np.bincount(heads, minlength=k))])

    def put(batch: np.ndarray, want_smaller: bool, edge: np.ndarray, sign: int) -> None:
        if len(batch) <= FEW:
            for i in batch.tolist():
                if i and smaller[i - 1] == want_smaller:
                    c = t[i - 1]
                    at = edge[c] - (sign < 0)
                    sa[at] = i - 1
                    edge[c] = at + (sign > 0)
            return
        before = batch[batch > 0] - 1
        before = before[smaller[before] == want_smaller]
        if not len(before):
            return
        symbols = t[before]
        order = np.argsort(symbols, kind="stable")
        symbols, before = symbols[order], before[order]
        first = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
        counts = np.diff(np.append(first, len(symbols)))
        rank = np.arange(len(symbols)) - np.repeat(first, counts)
        sa[edge[symbols] + sign * rank - (sign < 0)] = before
        edge[symbols[first]] += sign * counts

    head = start[:-1].copy()
    for c in range(k):
        if sizes[c]:
            low = start[c]
            while low < head[c]:
                low, batch = head[c], sa[low : head[c]]
                put(batch, False, head, 1)
            put(by_head[lms_at[c] : lms_at[c + 1]], False, head, 1)
    tail = start[1:].copy()
    for c in range(k - 1, -1, -1):
        if sizes[c]:
            high = start[c + 1]
            while high > tail[c]:
                high, batch = tail[c], sa[tail[c] : high][::-1]
                put(batch, True, tail, -1)
            put(sa[start[c] : head[c]][::-1], True, tail, -1)
    sa[0] = n - 1
    return sa


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """The suffix array of symbols t (under k), whose last is a unique least sentinel 0."""
    n = len(t)
    t = t.astype(np.uint16)
    smaller = s_types(t)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if n == 1 or len(lms) <= 1:
        return induce(t, smaller, lms, k)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    sa = induce(t, smaller, lms, k)
    order = sa[is_lms[sa]]
    # name LMS substrings: equal neighbours (length and symbols up to the next LMS position) share a name
    size = np.zeros(n, np.int32)
    size[lms] = np.append(np.diff(lms) + 1, 1)
    a, b = order[:-1], order[1:]
    same = size[a] == size[b]
    same[0] = False  # the sentinel's
    left, offset = np.flatnonzero(same), 0
    while len(left):
        left = left[size[a[left]] > offset]
        equal = t[a[left] + offset] == t[b[left] + offset]
        same[left[~equal]] = False
        left, offset = left[equal], offset + 1
    names = np.zeros(n, np.int32)
    names[order] = np.concatenate([[0], np.cumsum(~same)])
    reduced, kinds = names[lms], int(names[order[-1]]) + 1
    if kinds == len(lms):
        return induce(t, smaller, order, k)
    if kinds <= ALPHABET:
        return induce(t, smaller, lms[suffix_array(reduced, kinds)], k)
    digits = 2
    while (base := int(np.ceil(kinds ** (1 / digits))) + 1) > ALPHABET:
        digits += 1
    # each name in `digits` digits from 1 on, and a sentinel after them all
    spelled = np.empty((len(reduced), digits), np.uint16)
    rest = reduced.copy()
    for d in range(digits - 1, -1, -1):
        spelled[:, d] = rest % base + 1
        rest //= base
    deep = suffix_array(np.append(spelled.reshape(-1), 0), base + 1)[1:]
    return induce(t, smaller, lms[deep[deep % digits == 0] // digits], k)


def common_prefixes(data: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phi (the suffix before, by text position; -1 for the first) and PLCP, the length of the prefix shared with it.

    Only irreducible positions, whose preceding symbols differ, are compared; from there on PLCP falls by one a position.
    data: the text's bytes; sa: of the same positions (no sentinel).
    """
    n = len(data)
    phi = np.full(n, -1, np.int32)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n, dtype=np.int32)
    irreducible = (phi <= 0) | (at == 0)
    inner = np.flatnonzero(~irreducible)
    irreducible[inner] = data[inner - 1] != data[phi[inner] - 1]
    heads = np.flatnonzero(irreducible)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (n + 1, 8), (1, 1)).copy().view(np.uint64).reshape(-1)
    length = np.zeros(n, np.int32)
    live = heads[phi[heads] >= 0]
    while len(live):
        a, b = live + length[live], phi[live] + length[live]
        room = n - np.maximum(a, b)
        a, b = np.minimum(a, n), np.minimum(b, n)
        differ = words[a] ^ words[b]
        # equal low bytes of a little-endian word: trailing zero bits / 8
        low = np.where(differ == 0, 8, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) // 8).astype(np.int32)
        gain = np.minimum(low, room)
        length[live] += gain
        live = live[gain == 8]
    last = np.maximum.accumulate(np.where(irreducible, at, 0))
    return phi, np.maximum(length[last] - (at - last), 0)


def repeated_starts(pieces: list[bytes], length: int, separator: int = 0xFF) -> list[np.ndarray]:
    """For each piece, which of its starts of `length` bytes occur at another start too, in any of the pieces.

    The separator byte must not stand in a piece (0xFF never does in UTF-8).
    """
    text = bytes([separator]).join(pieces) + bytes([separator])
    data = np.frombuffer(text, np.uint8)
    sa = suffix_array(np.append(data.astype(np.uint16) + 1, 0), 257)[1:]
    phi, plcp = common_prefixes(data, sa)
    twice = plcp >= length
    twice[phi[twice]] = True
    out, at = [], 0
    for p in pieces:
        out.append(twice[at : at + max(0, len(p) - length + 1)])
        at += len(p) + 1
    return out
