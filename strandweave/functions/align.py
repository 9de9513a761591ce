"""Pairwise alignment kernels; they run inside Arrow stages."""

from __future__ import annotations

import re

import numpy as np

#: Sequences above this length are not aligned but counted as the threshold.
MAX_ALIGNED = 500


def edits(q: str, r: str, threshold: int, left_free: bool = False, right_free: bool = False) -> int:
    """Edit distance of q and r; a free end lets r overhang there at no cost.

    May return the threshold for anything at or above it.
    """
    fixed = not (left_free or right_free)
    if not q:
        return len(r) if fixed else 0
    if not r:
        return len(q)
    if fixed and abs(len(q) - len(r)) >= threshold or len(q) > MAX_ALIGNED or len(r) > MAX_ALIGNED:
        return threshold
    row = [0] * (len(r) + 1) if left_free else list(range(len(r) + 1))
    for i, a in enumerate(q, 1):
        gap = 0 if right_free and i == len(q) else 1
        before, row[0] = row[0], i
        for j, b in enumerate(r, 1):
            before, row[j] = row[j], min(before + (a != b), row[j] + 1, row[j - 1] + gap)
    return row[-1]


def global_alignment(a: str, b: str, gap_open: int = 5, gap_extend: int = 2, mismatch: int = 3, match: int = 1, band: int = 50) -> tuple[int, str]:
    """(score, CIGAR) of the best banded alignment with affine gaps; the band is
    widened to reach both ends. I: only in a, D: only in b."""
    band = max(band, abs(len(a) - len(b)) + 1)
    low = -(10**9)
    h = {(0, 0): 0}
    e, f, back = {}, {}, {}
    for i in range(len(a) + 1):
        for j in range(max(0, i - band), min(len(b), i + band) + 1):
            if i == j == 0:
                continue
            up = max((h.get((i - 1, j), low) - gap_open - gap_extend, "h"), (e.get((i - 1, j), low) - gap_extend, "e")) if i else (low, "h")
            left = max((h.get((i, j - 1), low) - gap_open - gap_extend, "h"), (f.get((i, j - 1), low) - gap_extend, "f")) if j else (low, "h")
            e[i, j], f[i, j] = up[0], left[0]
            diagonal = h.get((i - 1, j - 1), low) + (match if i and j and a[i - 1] == b[j - 1] else -mismatch) if i and j else low
            best, move = max((diagonal, "M"), (up[0], "I"), (left[0], "D"), key=lambda x: x[0])
            h[i, j] = best
            back[i, j] = (move, up[1], left[1])
    i, j, ops, state = len(a), len(b), [], "h"
    while i or j:
        move, from_up, from_left = back[i, j]
        kind = {"h": move, "e": "I", "f": "D"}[state]
        ops.append(kind)
        if kind == "M":
            i, j, state = i - 1, j - 1, "h"
        elif kind == "I":
            i, state = i - 1, from_up
        else:
            j, state = j - 1, from_left
    return h[len(a), len(b)], compact("".join(reversed(ops)))


def global_alignments(firsts: list[str], seconds: list[str], gap_open: int = 5, gap_extend: int = 2, mismatch: int = 3, match: int = 1, band: int = 50) -> list[tuple[int, str]]:
    """The same for many pairs. Pairs of equal lengths that the band does not touch
    are aligned together, a row of the table of all of them at a time."""
    out: list = [None] * len(firsts)
    groups: dict[tuple[int, int], list[int]] = {}
    for k, (a, b) in enumerate(zip(firsts, seconds)):
        if max(len(a), len(b)) <= band:
            groups.setdefault((len(a), len(b)), []).append(k)
        else:
            out[k] = global_alignment(a, b, gap_open, gap_extend, mismatch, match, band)
    for (n, m), members in groups.items():
        for at in range(0, len(members), 1024):
            some = members[at : at + 1024]
            a = np.array([list(firsts[k].encode()) for k in some], np.uint8).reshape(len(some), n)
            b = np.array([list(seconds[k].encode()) for k in some], np.uint8).reshape(len(some), m)
            for k, found in zip(some, _together(a, b, gap_open, gap_extend, mismatch, match)):
                out[k] = found
    return out


def _together(a: np.ndarray, b: np.ndarray, gap_open: int, gap_extend: int, mismatch: int, match: int) -> list[tuple[int, str]]:
    (size, n), m, low = a.shape, b.shape[1], -(10**9)
    steps = gap_extend * np.arange(m + 1)
    move = np.zeros((n + 1, m + 1, size), np.uint8)  # 0 a pair, 1 only in a, 2 only in b
    from_up, from_left = np.zeros((n + 1, m + 1, size), bool), np.zeros((n + 1, m + 1, size), bool)  # a gap goes on
    e = np.full((size, m + 1), low)
    h = None
    for i in range(n + 1):
        before = h
        if i:
            opened, longer = before - gap_open - gap_extend, e - gap_extend
            from_up[i] = (longer > opened).T
            e = np.maximum(opened, longer)
        pair = np.full((size, m + 1), low)
        if i:
            pair[:, 1:] = before[:, :-1] + np.where(a[:, i - 1, None] == b, match, -mismatch)
        else:
            pair[:, 0] = 0
        best = np.maximum(pair, e)
        # a gap that starts in a gap costs more than one that goes on, so gaps start from what is no gap
        f = np.full((size, m + 1), low)
        f[:, 1:] = np.maximum.accumulate(best + steps, axis=1)[:, :-1] - gap_open - steps[1:]
        h = np.maximum(best, f)
        from_left[i, 1:] = ((f - gap_extend) > (h - gap_open - gap_extend))[:, :-1].T
        move[i] = np.where(pair >= h, 0, np.where(e >= h, 1, 2)).T
    out = []
    for k in range(size):
        i, j, ops, state = n, m, [], 0
        while i or j:
            kind = state or int(move[i, j, k])
            ops.append("MID"[kind])
            if kind == 0:
                i, j = i - 1, j - 1
            elif kind == 1:
                state = 1 if from_up[i, j, k] else 0
                i -= 1
            else:
                state = 2 if from_left[i, j, k] else 0
                j -= 1
        out.append((int(h[k, m]), compact("".join(reversed(ops)))))
    return out


def local_alignment(a: str, b: str, gap: int = 2, mismatch: int = 3, match: int = 1) -> tuple[int, int, int, int, int]:
    """(score, start in a, end in a, start in b, end in b) of the best local match."""
    row = [(0, 0, j) for j in range(len(b) + 1)]
    best = (0, 0, 0, 0, 0)
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], (0, i, 0)
        for j, y in enumerate(b, 1):
            s = before[0] + (match if x == y else -mismatch)
            options = [(0, i, j), (s, before[1], before[2]), (row[j][0] - gap, *row[j][1:]), (row[j - 1][0] - gap, *row[j - 1][1:])]
            before, row[j] = row[j], max(options, key=lambda o: o[0])
            if row[j][0] > best[0]:
                best = (row[j][0], row[j][1], i, row[j][2], j)
    return best


def compact(ops: str) -> str:
    return "".join(f"{len(m.group())}{m.group()[0]}" for m in re.finditer(r"(.)\1*", ops))


def expand(cigar: str) -> str:
    return "".join(op * int(n) for n, op in re.findall(r"(\d+)([A-Z=])", cigar))


def padded(a: str, b: str, cigar: str, gap: str = "-") -> tuple[str, str]:
    """Both sequences with gaps, as the CIGAR aligns them."""
    x, y, i, j = [], [], 0, 0
    for op in expand(cigar):
        x.append(a[i] if op != "D" else gap)
        y.append(b[j] if op != "I" else gap)
        i += op != "D"
        j += op != "I"
    return "".join(x), "".join(y)
