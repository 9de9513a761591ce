"""Matchings, synteny chains and the natural mapping scheme."""

from __future__ import annotations

from dataclasses import dataclass, field

from strandweave.functions.align import edits
from strandweave.operators.index import Position, ViewIndex, reverse_complement

#: Bases at a query's end that an end alignment looks at, at most.
END_BASES = 250


@dataclass(frozen=True)
class Matching:
    start: int
    length: int
    at: Position

    @property
    def end(self) -> int:
        return self.start + self.length


@dataclass
class Natural:
    """Parameters of the natural scheme, by their published names."""

    context: int = 0
    credit: bool = False
    mismatches: int = 0
    ignore_matches_below: int = 0
    min_edit_bound: int = 0
    max_edit_distance: int = 0
    unstable: bool = False
    conflict_below_threshold: bool = False


@dataclass
class Mapped:
    positions: list[Position | None]
    stats: dict[str, int] = field(default_factory=dict)


def matching_statistics(q: str, index: ViewIndex) -> list[tuple[int, int | None, Position | None]]:
    """(longest match, shortest unique match, its position) at each base."""
    out = []
    for i in range(len(q)):
        length, lo, hi = index.longest(q, i)
        unique = index.shortest_unique(q, i, length, lo, hi)
        out.append((length, unique, index.canon[lo] if unique else None))
    return out


def max_matchings(stats) -> list[Matching]:
    """Unique matches that extend neither way and stay unique, ascending. (Where
    positions are merged, a longer match can lie at several again.)"""
    return [
        Matching(i, n, at)
        for i, (n, unique, at) in enumerate(stats)
        if unique is not None and (i == 0 or stats[i - 1][0] <= n or stats[i - 1][1] is None)
    ]


def min_matchings(stats) -> list[Matching]:
    """Unique matches with no shorter one inside, ascending."""
    out = []
    for i, (_, unique, at) in enumerate(stats):
        if unique is not None:
            after = stats[i + 1][1] if i + 1 < len(stats) else None
            if after is None or i + 1 + after > i + unique:
                out.append(Matching(i, unique, at))
    return out


def matching_graph(mums: list[Matching], q: str, index: ViewIndex, most: int) -> dict[int, list[tuple[int, int]]]:
    """Edges (matching -> earlier matching, cost) within ``most`` edits."""
    by_diagonal: dict[tuple[int, int], list[int]] = {}
    edges: dict[int, list[tuple[int, int]]] = {}
    for n, m in enumerate(mums):
        text, offset = m.at
        diagonal = m.start - offset
        edges[n] = [(n, 0)]
        for shift in range(-most, most + 1):
            before = by_diagonal.get((text, diagonal + shift))
            if not before:
                continue
            p = mums[before[-1]]
            q_gap, r_gap = m.start - p.end, offset - (p.at[1] + p.length)
            if q_gap > 0 and r_gap > 0:
                r_from = p.at[1] + p.length
                cost = edits(q[p.end : m.start], index.texts[text][r_from:offset], most + 1)
            else:
                cost = abs(q_gap - r_gap)
            if cost <= most:
                edges[n].append((before[-1], cost))
        by_diagonal.setdefault((text, diagonal), []).append(n)
    return edges


def owners(mums: list[Matching], muss: list[Matching]) -> list[int]:
    """For each minimal match the maximal match that covers it."""
    out, at = [], -1
    for s in muss:
        while at + 1 < len(mums) and mums[at + 1].start <= s.start:
            at += 1
        if at < 0 or mums[at].end < s.end:
            raise ValueError("a minimal match lies in no maximal match")
        out.append(at)
    return out


def _chains(mums, muss, own, edges, most: int, forward: bool) -> list[list[int]]:
    table = [[1] * (most + 1) for _ in muss]
    of: dict[int, list[int]] = {}
    for k, n in enumerate(own):
        of.setdefault(n, []).append(k)
    if not forward:
        inverse: dict[int, list[tuple[int, int]]] = {n: [] for n in edges}
        for n, targets in edges.items():
            for m, cost in targets:
                inverse[m].append((n, cost))
        edges = inverse
    for n in range(len(mums)) if forward else range(len(mums) - 1, -1, -1):
        mine = of.get(n, [])
        for k in mine if forward else reversed(mine):
            row = table[k]
            for m, cost in edges[n]:
                if forward:
                    near = next((j for j in reversed(of.get(m, [])) if muss[j].end <= muss[k].start), None)
                else:
                    near = next((j for j in of.get(m, []) if muss[j].start >= muss[k].end), None)
                if near is not None:
                    for c in range(cost, most + 1):
                        row[c] = max(row[c], table[near][c - cost] + 1)
            for c in range(1, most + 1):
                row[c] = max(row[c], row[c - 1])
    return table


def good_matchings(mums, muss, q: str, index: ViewIndex, p: Natural) -> list[bool]:
    """Which maximal matches stand in a long enough synteny run."""
    most = p.max_edit_distance
    edges, own = matching_graph(mums, q, index, most), owners(mums, muss)
    ahead, back = (_chains(mums, muss, own, edges, most, f) for f in (True, False))
    best = [0] * len(mums)
    for k, n in enumerate(own):
        best[n] = max(best[n], max(ahead[k][c] + back[k][most - c] - 1 for c in range(most + 1)))
    return [b >= max(p.min_edit_bound, 1) and m.length >= p.context for b, m in zip(best, mums)]


def _blacklist(m: Matching, q: str, index: ViewIndex, p: Natural) -> bool:
    if p.conflict_below_threshold:
        return True
    if p.unstable:
        return False
    most, (text, offset) = p.max_edit_distance, m.at
    ref = index.texts[text]
    n = min(m.start, END_BASES)
    r = min(2 * n, offset)
    if edits(q[:n], ref[offset - r : offset], most + 1, left_free=True) <= most:
        return True
    n = min(len(q) - m.end, END_BASES)
    r = min(2 * n, len(ref) - offset - m.length)
    return edits(q[m.end : m.end + n], ref[offset + m.length : offset + m.length + r], most + 1, right_free=True) <= most


def natural_map(query: str, index: ViewIndex, p: Natural = Natural()) -> Mapped:
    """Map each base of a query to the one position its matches agree on."""
    q = query.upper()
    found: list[Position | None] = [None] * len(q)
    stats = matching_statistics(q, index)
    mums, muss = max_matchings(stats), min_matchings(stats)
    counts = {"mapped": 0, "unmapped": 0, "credit": 0, "conflicted": 0, "conflictedCredit": 0}
    if muss:
        votes: list[set[Position]] = [set() for _ in q]
        banned = [False] * len(q)
        for m, good in zip(mums, good_matchings(mums, muss, q, index, p)):
            if good:
                for i in range(m.start, m.end):
                    votes[i].add((m.at[0], m.at[1] + i - m.start))
            elif m.length >= p.ignore_matches_below and _blacklist(m, q, index, p):
                banned[m.start : m.end] = [True] * m.length
        first, last = (0, len(q) - 1) if p.unstable else (muss[0].end - 1, muss[-1].start)
        for i in range(first, last + 1):
            if not banned[i] and len(votes[i]) == 1:
                found[i] = next(iter(votes[i]))
            elif len(votes[i]) > 1:
                counts["conflicted"] += 1
    if p.credit:
        _credit(q, found, index, p.mismatches, counts)
    counts["mapped"] = sum(x is not None for x in found)
    counts["unmapped"] = len(q) - counts["mapped"]
    return Mapped(found, counts)


def _credit(q: str, found: list[Position | None], index: ViewIndex, most: int, counts: dict[str, int]) -> None:
    """Fill unmapped bases between mapped ones with what both sides imply."""
    mapped = [i for i, x in enumerate(found) if x is not None]
    if not mapped:
        return
    implied: dict[int, set[Position]] = {}
    for order in (range(mapped[0], mapped[-1] + 1), range(mapped[-1], mapped[0] - 1, -1)):
        provider, missed = -1, 0
        for i in order:
            if found[i] is not None:
                provider, missed = i, 0
                continue
            text, offset = found[provider]
            at = (text, offset + i - provider)
            if not 0 <= at[1] < index.length(text):
                continue
            missed += index.texts[text][at[1]] != q[i]
            if missed <= most:
                implied.setdefault(i, set()).add(at)
    for i, places in implied.items():
        if len(places) > 1:
            counts["conflictedCredit"] += 1
        else:
            text, offset = next(iter(places))
            if index.texts[text][offset] == q[i]:
                found[i] = (text, offset)
                counts["credit"] += 1


def minimum_contexts(contig: str, index: ViewIndex, bound: int = 0) -> list[int]:
    """Per base the length of context a mapping there needs."""
    muss = min_matchings(matching_statistics(contig.upper(), index))
    runs = []
    for k, s in enumerate(muss):
        taken, end = 1, s.end
        for later in muss[k + 1 :]:
            if taken >= bound:
                break
            if later.start >= end:
                taken, end = taken + 1, later.end
        if taken >= bound:
            runs.append((s.start, end))
    if not runs:
        raise ValueError("no run of unique matches: no base can be mapped")
    n = len(contig)
    best = [n * 4 + 1] * n
    for a, b in runs:
        for i in range(a, b):
            best[i] = min(best[i], b - a)
    latest = None
    ends = sorted(runs, key=lambda r: (r[1], r[0]))
    at = 0
    for i in range(n):
        while at < len(ends) and ends[at][1] <= i:
            latest = ends[at][0] if latest is None else max(latest, ends[at][0])
            at += 1
        if latest is not None:
            best[i] = min(best[i], i - latest + 1)
    nearest, at = None, len(runs) - 1
    for i in range(n - 1, -1, -1):
        while at >= 0 and runs[at][0] > i:
            nearest = runs[at][1] if nearest is None else min(nearest, runs[at][1])
            at -= 1
        if nearest is not None:
            best[i] = min(best[i], nearest - i)
    return best


def flipped_reverse(found: list[Position | None], index: ViewIndex) -> list[Position | None]:
    """The mapping of the reverse complement that this mapping implies."""
    return [None if x is None else index.flip(x) for x in reversed(found)]


__all__ = [
    "Matching", "Natural", "Mapped", "matching_statistics", "max_matchings", "min_matchings", "natural_map", "minimum_contexts",
    "flipped_reverse", "reverse_complement",
]
