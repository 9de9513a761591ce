"""The zip mapping scheme: one-sided contexts, retracted until both sides agree."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from strandweave.operators.index import Position, ViewIndex, reverse_complement
from strandweave.operators.matching import matching_statistics, min_matchings


@dataclass
class Zip:
    """Parameters of the zip scheme, by their published names."""

    min_context: int = 0
    max_range_count: int = 100
    max_extend_through: int = 100
    use_retraction: bool = True
    give_up_if_hard: bool = False
    mismatch_tolerance: int = 0
    min_unique_strings: int = 0
    credit: bool = False
    credit_mismatches: int = 0


# ---- search states: an exact interval, or rows within a mismatch budget ------


class Exact:
    """The rows that start with s[:length]."""

    def __init__(self, index: ViewIndex, s: str, length: int, rows: Sequence[int] | None = None):
        self.index, self.s, self.length = index, s, length
        self.lo, self.hi = rows or index.interval(s[:length])

    @classmethod
    def longest(cls, index: ViewIndex, s: str, budget: int) -> "Exact":
        length, *rows = index.longest(s, 0)
        return cls(index, s, length, rows)

    def positions(self) -> set[Position]:
        return self.index.positions(self.lo, self.hi)

    def unique(self) -> bool:
        return self.index.unique(self.lo, self.hi)

    def ranges(self) -> int:
        return self.index.run[self.hi - 1] - self.index.run[self.lo] + 1 if self.hi > self.lo else 0

    def retracted(self) -> "Exact":
        return Exact(self.index, self.s, self.index.parent(self.lo, self.hi))

    def extends_through(self, opposing: str) -> bool:
        """Retract to the shortest unique context, then extend to the left over
        the opposing context; the shared base is searched already."""
        if self.index.canon is self.index.rows and self.unique():
            shortest = self.index.parent(self.lo, self.hi) + 1  # a second row is a second position
        else:
            state, last = self, self.length
            while state.length and state.unique():
                last, state = state.length, state.retracted()
            shortest = min(state.length + 1, last) if state.length or not state.unique() else 1
        return self.index.count(opposing[:-1] + self.s[: max(shortest, 1)]) > 0


class Tolerant:
    """The rows that start with s[:length] but for ``budget`` mismatches."""

    def __init__(self, index: ViewIndex, s: str, length: int, budget: int):
        self.index, self.s, self.length, self.budget = index, s, length, budget
        self.members = _neighbourhood(index, s, length, budget)

    @classmethod
    def longest(cls, index: ViewIndex, s: str, budget: int) -> "Tolerant":
        low, high = 0, len(s)
        while low < high:  # having rows is monotone in the length
            middle = (low + high + 1) // 2
            if _neighbourhood(index, s, middle, budget):
                low = middle
            else:
                high = middle - 1
        return cls(index, s, low, budget)

    def positions(self) -> set[Position]:
        return {self.index.canon[k] for k in self.members}

    def unique(self) -> bool:
        return len(self.positions()) == 1

    def ranges(self) -> int:
        return len({self.index.run[k] for k in self.members})

    def retracted(self) -> "Tolerant":
        n = self.length - 1
        while n > 0 and len(_neighbourhood(self.index, self.s, n, self.budget)) == len(self.members):
            n -= 1
        return Tolerant(self.index, self.s, n, self.budget)

    def extends_through(self, opposing: str) -> bool:
        n = self.length
        while n > 1 and len({self.index.canon[k] for k in _neighbourhood(self.index, self.s, n - 1, self.budget)}) == 1:
            n -= 1
        whole = opposing[:-1] + self.s[:n]
        return bool(_neighbourhood(self.index, whole, len(whole), self.budget, len(opposing) - 1))


def _neighbourhood(index: ViewIndex, s: str, length: int, budget: int, exact_at: int = 0) -> list[int]:
    """Rows within a Hamming budget of s[:length], by splitting row intervals.
    The base that is being mapped, at ``exact_at``, must match."""
    out, stack = [], [(0, len(index.rows), 0, budget)]
    while stack:
        lo, hi, depth, left = stack.pop()
        if depth == length:
            out += range(lo, hi)
            continue
        k = lo
        while k < hi:
            text, offset = index.rows[k]
            if offset + depth >= len(index.texts[text]):
                k += 1
                continue
            base, end = index.texts[text][offset + depth], k + 1
            while end < hi and index.lcp[end] > depth:
                end += 1
            cost = base != s[depth]
            if cost <= (0 if depth == exact_at else left):
                stack.append((k, end, depth + 1, left - cost))
            k = end
    return sorted(out)


# ---- one base ----------------------------------------------------------------


class _Side:
    """Retractions of one side, made when asked for: (state, valid). Where it is
    valid, ``selected`` has its positions on the query's strand, and those that its
    last retraction brought."""

    def __init__(self, root, most: int, flip: Callable[[Position], Position] | None = None):
        self.most, self.flip = most, flip
        self.entries = [(root, root.ranges() <= most)]
        self.sets: dict[int, set[Position]] = {}

    def __getitem__(self, k: int):
        while len(self.entries) <= k:
            state, valid = self.entries[-1]
            nxt = state.retracted()
            self.entries.append((nxt, valid and nxt.ranges() - state.ranges() <= self.most))
        return self.entries[k]

    def positions(self, k: int) -> set[Position]:
        if k not in self.sets:
            found = self[k][0].positions()
            self.sets[k] = set(map(self.flip, found)) if self.flip else found
        return self.sets[k]

    def selected(self, k: int) -> tuple[set[Position], set[Position]]:
        return self.positions(k), self.positions(k) - self.positions(k - 1) if k else self.positions(k)


def map_base(q: str, rc: str, i: int, index: ViewIndex, p: Zip, stats: Counter) -> tuple[Position, int, int] | None:
    """(position, left context, right context) of one base, if exactly one."""
    kind = Tolerant if p.mismatch_tolerance else Exact
    budget = p.mismatch_tolerance
    lefts = _Side(kind.longest(index, rc[len(q) - 1 - i :], budget), p.max_range_count, index.flip)
    rights = _Side(kind.longest(index, q[i:], budget), p.max_range_count)
    stats["basesAttempted"] += 1
    found: set[Position] = set()
    widest = [0, 0]
    queue = deque([(0, 0, False, True)])  # left and right index, retracted right last, left still whole
    while queue:
        a, b, from_right, edge = queue.popleft()
        (left, l_valid), (right, r_valid) = lefts[a], rights[b]
        if not left.length or not right.length:
            continue
        widest = [max(widest[0], left.length), max(widest[1], right.length)]
        if left.length + right.length - 1 >= p.min_context:
            got, retract_left, retract_right, easy = _explore(
                q, i, index, p, stats, left, right, l_valid and r_valid, lambda: (*lefts.selected(a), *rights.selected(b)), from_right, edge
            )
            if not easy:
                stats["tooHardRetraction"] += 1
                if p.give_up_if_hard:
                    return None
            found |= got
            if len(found) > 1:
                break
            if retract_left:
                queue.append((a + 1, b, False, False))
            if retract_right:
                queue.append((a, b + 1, True, edge))
        if not p.use_retraction:
            break
    if len(found) != 1:
        stats["ambiguous"] += 1
        return None
    stats["unambiguous"] += 1
    return next(iter(found)), widest[0], widest[1]


def _explore(q, i, index, p, stats, left, right, valid, selected, from_right, edge):
    tried_left = tried_right = False
    if left.unique() and right.length < p.max_extend_through:
        tried_left = True
        stats["extendThroughAttampts"] += 1
        if left.extends_through(reverse_complement(q[i : i + right.length])):
            stats["extendThroughSuccesses"] += 1
            return {index.flip(next(iter(left.positions())))}, False, False, True
    if right.unique() and left.length < p.max_extend_through:
        tried_right = True
        stats["extendThroughAttampts"] += 1
        if right.extends_through(q[i - left.length + 1 : i + 1]):
            stats["extendThroughSuccesses"] += 1
            return set(right.positions()), False, False, True
    if valid:
        l_all, l_new, r_all, r_new = selected()
        shared = r_new & l_all if from_right else l_new & r_all
        if shared:
            return shared, False, False, True
    retract_left = left.length > 1 and (valid or tried_right)
    retract_right = right.length > 1 and ((edge and valid) or tried_left)
    return set(), retract_left, retract_right, valid


# ---- whole queries -------------------------------------------------------------


def activities(spans: list[tuple[int, int]], threshold: int | None = None) -> int:
    """How many non-overlapping half-open spans can be chosen, greedily by end;
    counting stops at the threshold."""
    n, end = 0, -1
    for a, b in sorted(spans, key=lambda s: (s[1], s[0])):
        if a >= end:
            n, end = n + 1, b
            if threshold is not None and n >= threshold:
                break
    return n


def zip_map(query: str, index: ViewIndex, p: Zip = Zip()) -> tuple[list[Position | None], dict[str, int]]:
    q = query.upper()
    rc = reverse_complement(q)
    stats: Counter = Counter()
    mapped = [map_base(q, rc, i, index, p, stats) for i in range(len(q))]
    if p.min_unique_strings:
        spans = [(m.start, m.end) for m in min_matchings(matching_statistics(q, index))]
        for i, m in enumerate(mapped):
            if m is not None:
                lo, hi = i - m[1] + 1, i + m[2]
                stats["activitySelectionRuns"] += 1
                n = activities([s for s in spans if s[0] >= lo and s[1] <= hi], p.min_unique_strings)
                stats["activitiesSelected"] += n
                stats["filterPass" if n >= p.min_unique_strings else "filterFail"] += 1
                if n < p.min_unique_strings:
                    mapped[i] = None
    found = [None if m is None else m[0] for m in mapped]
    if p.credit:
        found = apply_credit(q, found, index, p.credit_mismatches)
    stats["mapped"] = sum(x is not None for x in found)
    stats["unmapped"] = len(found) - stats["mapped"]
    return found, dict(stats)


# ---- credit between anchors -----------------------------------------------------


def walk_left(bases: str, anchor: Position, index: ViewIndex, most: int) -> list[Position | None]:
    """Positions of the bases left of an anchor, nearest first: all rows at the
    anchor's position step left together; exact steps are preferred, mismatches
    are taken only where there are none. A base counts if its step was exact and
    leads to one position."""
    group = {(r, 0) for r in index.by_canon.get(anchor, [])}
    known = index.canon_of
    out: list[Position | None] = []
    for base in reversed(bases):
        steps = [((t, o - 1), missed) for (t, o), missed in group if o > 0 and (t, o - 1) in known]
        exact = {(r, missed) for r, missed in steps if index.texts[r[0]][r[1]] == base}
        group = exact or {(r, missed + 1) for r, missed in steps if missed < most}
        places = {known[r] for r, _ in group}
        out.append(next(iter(places)) if exact and len(places) == 1 else None)
    return out


def apply_credit(query: str, found: list[Position | None], index: ViewIndex, most: int) -> list[Position | None]:
    """Fill maximal unmapped runs between two anchors from both sides: one side's
    answer, or the one both give; where they differ the base stays unmapped."""
    q, out = query.upper(), list(found)
    anchors = [i for i, x in enumerate(found) if x is not None]
    for a, b in zip(anchors, anchors[1:]):
        if b - a < 2:
            continue
        gap = q[a + 1 : b]
        from_right = walk_left(gap, found[b], index, most)[::-1]
        from_left = [None if x is None else index.flip(x) for x in walk_left(reverse_complement(gap), index.flip(found[a]), index, most)][::-1]
        from_left = from_left[::-1]
        for k in range(len(gap)):
            x, y = from_left[k], from_right[k]
            out[a + 1 + k] = x if y is None else y if x is None else x if x == y else None
    return out
