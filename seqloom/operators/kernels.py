"""Banded pair-HMM sweeps over many (reference, band) lanes of one read at once.

A lane is a run of neighbouring diagonals d = i - j of one reference; lanes
don't touch. All lanes advance by anti-diagonals: at step s, column c of a lane
stands at j = (s - c) / 2, so the cells that a cell needs are its own column
two steps ago and its neighbours one step ago, and a step is a few array
operations over all lanes and every other column.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..functions.stats import BINS, log_nb
from ..plans.model import Params

START, FROM_M, FROM_I, FROM_D = 3, 0, 1, 2
_CODE = np.full(256, 255, np.uint8)
for _i, _b in enumerate("ACGT"):
    _CODE[ord(_b)] = _CODE[ord(_b.lower())] = _i


def tokens(seq: str) -> np.ndarray:
    t = _CODE[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]
    if (t == 255).any():
        raise ValueError(f"not a nucleotide: {seq[int(np.argmax(t == 255))]!r}")
    return t.astype(np.int64)


def quals(qual: str | None, size: int) -> np.ndarray | None:
    if qual is None or len(qual) != size:
        return None
    return np.clip(np.frombuffer(qual.encode("latin-1", "replace"), np.uint8).astype(np.int64) - 33, 0, BINS - 1)


def context_codes(t: np.ndarray, k: int) -> np.ndarray:
    """Base-4 codes of the k bases ending at each place; before the start stands the commonest base."""
    if k == 0:
        return np.zeros(len(t), np.int64)
    common = int(np.argmax(np.bincount(t, minlength=4)))
    padded = np.concatenate([np.full(k - 1, common), t])
    out = np.zeros(len(t), np.int64)
    for i in range(k):
        out = out * 4 + padded[i : i + len(t)]
    return out


@dataclass
class Scores:
    """Log tables of the parameters; a column more at the end stands for a missing quality."""

    match: np.ndarray  # [ref, context, quality]
    insert: np.ndarray  # [base, quality]
    m2m: np.ndarray
    m2i: np.ndarray
    m2d: np.ndarray
    m2e: np.ndarray
    d2d: float
    d2m: float
    i2i: float
    i2m: float
    match_order: int
    gap_order: int

    @classmethod
    def of(cls, p: Params) -> Scores:
        def table(cells: np.ndarray) -> np.ndarray:
            flat = [np.append(np.log(c[0]) + log_nb(c[1], c[2]), np.log(c[0])) if c[0] > 0 else np.full(BINS + 1, -np.inf) for c in cells.reshape(-1, 3)]
            return np.array(flat).reshape(*cells.shape[:-1], BINS + 1)

        with np.errstate(divide="ignore"):
            bi, nbi, bd, nbd = np.log(p.begin_insert), np.log1p(-p.begin_insert), np.log(p.begin_delete), np.log1p(-p.begin_delete)
            ei, nei, ed, ned = np.log(p.extend_insert), np.log1p(-p.extend_insert), np.log(p.extend_delete), np.log1p(-p.extend_delete)
            return cls(table(p.match), table(p.insert), nbi + nbd, bi, nbi + bd, bi, ed, ned, ei, nei, p.match_order, p.gap_order)


def envelope(diags: np.ndarray | None, x_len: int, y_len: int) -> list[tuple[int, int]]:
    """Runs (first diagonal, width) of sorted ``diags``; None is the full matrix."""
    if diags is None:
        return [(1 - y_len, x_len + y_len - 1)]
    diags = np.unique(diags)
    cuts = np.flatnonzero(np.diff(diags) > 1) + 1
    return [(int(r[0]), len(r)) for r in np.split(diags, cuts)]


def beside(columns: slice) -> tuple[slice, slice, slice]:
    """The places of ``columns``, of those behind and of those before them, in a state with a column more on either side."""
    return tuple(slice(columns.start + n, columns.stop + n, 2) for n in (1, 2, 0))


class Sweep:
    """One read (tokens y, qualities) against lanes of references."""

    def __init__(self, y: np.ndarray, y_qual: np.ndarray | None, refs: list[np.ndarray], lanes: list[tuple[int, int, int]], scores: Scores, *, local: bool = True):
        """``lanes``: (reference, first diagonal, width)."""
        self.s, self.y, self.refs, self.local, self.n = scores, y, refs, local, len(y)
        self.owner = np.array([r for r, _, _ in lanes], np.int64)
        self.first = np.array([d for _, d, _ in lanes], np.int64)[:, None]
        widths = np.array([w for _, _, w in lanes], np.int64)[:, None]
        self.width = int(widths.max())
        self.inside = np.arange(self.width)[None, :] < widths
        self.x_len = np.array([len(refs[r]) for r in self.owner], np.int64)[:, None]
        # the stretch of each reference that its lane can touch
        low = np.maximum(self.first[:, 0], 0)
        size = self.n + self.width
        self.base = low[:, None]
        self.x = np.zeros((len(lanes), size + 1), np.int64)
        self.row = np.arange(len(lanes))[:, None] * (size + 1)
        for k, (r, _, _) in enumerate(lanes):
            part = refs[r][low[k] : low[k] + size]
            self.x[k, : len(part)] = part
        q = np.full(self.n, BINS) if y_qual is None else y_qual
        self.q = y_qual
        self.context, gap = context_codes(y, scores.match_order), context_codes(y, scores.gap_order)
        self.emit = np.full((self.n + 1, 4), -np.inf)
        self.emit[1:] = scores.match[:, self.context, q].T
        self.emit_i = np.append(-np.inf, scores.insert[y, q])
        self.gap = np.append(0, gap)  # by j; nothing stands before the first base

    def steps(self, reverse: bool = False):
        """(s, columns, j, i, live) of each step."""
        order = range(2, 2 * self.n + self.width)
        for s in reversed(order) if reverse else order:
            low, high = max(0, s - 2 * self.n), min(self.width - 1, s - 2)
            low += (low ^ s) & 1
            cols = np.arange(low, high + 1, 2)
            if len(cols):
                j = (s - cols) // 2
                i = self.first + cols + j
                at = slice(low, high + 1, 2)
                yield s, at, j, i, (i >= 1) & (i <= self.x_len) & self.inside[:, at]

    def bases(self, i: np.ndarray) -> np.ndarray:
        return self.x.ravel().take(np.clip(i - 1 - self.base, 0, self.x.shape[1] - 1) + self.row)

    def matched(self, j: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.emit[j, self.bases(i)]

    def inserted(self, j: np.ndarray) -> np.ndarray:
        return self.emit_i[j]

    def gap_at(self, j: np.ndarray) -> np.ndarray:
        return self.gap[j]

    def _ends(self, j: np.ndarray, i: np.ndarray, live: np.ndarray) -> np.ndarray:
        return live & (j == self.n) & (True if self.local else i == self.x_len)

    def _starts(self, j: np.ndarray, i: np.ndarray) -> np.ndarray:
        return np.where((j == 1) & (self.local | (i == 1)), 0.0, -np.inf)

    def _state(self) -> list[np.ndarray]:
        return [np.full((len(self.first), self.width + 2), -np.inf) for _ in range(3)]  # a column more on either side

    def viterbi(self, trace: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, j-end's i) of each lane's best path, and back pointers by step; of equal ends the largest i."""
        s_, n = self.s, self.n
        m, ins, dele = self._state()
        best, where = np.full(len(self.first), -np.inf), np.zeros(len(self.first), np.int64)
        back = np.zeros((2 * n + self.width, len(self.first), self.width), np.uint8) if trace else np.zeros((0, 0, 0), np.uint8)
        for s, c, j, i, live in self.steps():
            g, before = self.gap_at(j), self.gap_at(j - 1)
            own, up, down = beside(c)
            options = [m[:, own] + s_.m2m[before], ins[:, own] + s_.i2m, dele[:, own] + s_.d2m, self._starts(j, i)]
            mat = np.where(live, np.maximum(np.maximum(options[0], options[1]), np.maximum(options[2], options[3])) + self.matched(j, i), -np.inf)
            a, b = m[:, up] + s_.m2i[before], ins[:, up] + s_.i2i
            into = np.where(live, np.maximum(a, b) + self.inserted(j), -np.inf)
            e, f = m[:, down] + s_.m2d[g], dele[:, down] + s_.d2d
            out = np.where(live, np.maximum(e, f), -np.inf)
            if trace:
                from_m = np.stack(np.broadcast_arrays(*options)).argmax(0)
                back[s][:, c] = from_m | (b > a) << 2 | (f > e) << 3
            m[:, own], ins[:, own], dele[:, own] = mat, into, out
            ends = self._ends(j, i, live)
            if ends.any():
                total = np.where(ends, mat + s_.m2e[g], -np.inf)
                top = total.max(1)
                at = i[np.arange(len(i)), total.argmax(1)]
                better = (top > best) | (top == best) & (at > where) & np.isfinite(top)
                best, where = np.where(better, top, best), np.where(better, at, where)
        return best, where, back

    def path(self, lane: int, end: int, back: np.ndarray) -> list[tuple[int, int, str]]:
        """Columns (i, j, state) of the best path that ends at (end, last j); i or j is the last one used at a gap."""
        i, j, state, out = end, self.n, FROM_M, []
        first = int(self.first[lane, 0])
        while True:
            c = i - j - first
            code = int(back[2 * j + c, lane, c])
            out.append((i, j, "MID"[state]))
            if state == FROM_M:
                state = code & 3
                i, j = i - 1, j - 1
                if state == START:
                    return out[::-1]
            elif state == FROM_I:
                state, j = (FROM_I if code & 4 else FROM_M), j - 1
            else:
                state, i = (FROM_D if code & 8 else FROM_M), i - 1

    def forward(self, keep: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Log likelihood of each lane; with ``keep`` the matrices by step (M, I, D)."""
        s_, n = self.s, self.n
        m, ins, dele = self._state()
        total = np.full(len(self.first), -np.inf)
        kept = np.full((2 * n + self.width, 3, len(self.first), self.width), -np.inf) if keep else None
        for s, c, j, i, live in self.steps():
            g, before = self.gap_at(j), self.gap_at(j - 1)
            own, up, down = beside(c)
            mat = np.logaddexp(np.logaddexp(m[:, own] + s_.m2m[before], ins[:, own] + s_.i2m), np.logaddexp(dele[:, own] + s_.d2m, self._starts(j, i)))
            mat = np.where(live, mat + self.matched(j, i), -np.inf)
            into = np.where(live, np.logaddexp(m[:, up] + s_.m2i[before], ins[:, up] + s_.i2i) + self.inserted(j), -np.inf)
            out = np.where(live, np.logaddexp(m[:, down] + s_.m2d[g], dele[:, down] + s_.d2d), -np.inf)
            m[:, own], ins[:, own], dele[:, own] = mat, into, out
            if keep:
                kept[s, 0][:, c], kept[s, 1][:, c], kept[s, 2][:, c] = mat, into, out
            ends = self._ends(j, i, live)
            if ends.any():
                total = np.logaddexp(total, np.logaddexp.reduce(np.where(ends, mat + s_.m2e[g], -np.inf), axis=1))
        return total, kept

    def backward_counts(self, kept: np.ndarray, total: np.ndarray, cells: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(log likelihood from the other side, count vector) of each lane, each weighted to its own ``total``; needs qualities.

        With a list of ``cells`` instead, qualities or not, what it gets is (lanes, i, j, log sums up to there in M, I and D,
        posterior probabilities of M, I and D) of the live cells, a step each.
        """
        if self.q is None and cells is None:
            raise ValueError("counts need qualities")
        s_, lanes = self.s, len(self.first)
        n_match, n_gap = s_.match.shape[1], len(s_.m2m)
        m, ins, dele = self._state()  # m holds emission + what follows at a column's next cell
        insert, match = np.zeros((lanes, 4, BINS)), np.zeros((lanes, 4, n_match, BINS))
        gaps, runs = np.zeros((lanes, 4, n_gap)), np.zeros((lanes, 4))
        start = np.full(lanes, -np.inf)
        row, norm = np.arange(lanes)[:, None], total[:, None]
        with np.errstate(invalid="ignore"):
            for s, c, j, i, live in self.steps(reverse=True):
                g, (own, up, down) = self.gap_at(j), beside(c)
                f = [np.where(live, kept[s, k][:, c] - norm, -np.inf) for k in range(3)]
                end = np.where(self._ends(j, i, live), s_.m2e[g], -np.inf)
                after = np.minimum(j + 1, self.n)
                m_m, m_i, m_d = s_.m2m[g] + m[:, own], s_.m2i[g] + np.where(j < self.n, self.inserted(after), -np.inf) + ins[:, down], s_.m2d[g] + dele[:, up]
                i_i, i_m = s_.i2i + np.where(j < self.n, self.inserted(after), -np.inf) + ins[:, down], s_.i2m + m[:, own]
                d_d, d_m = s_.d2d + dele[:, up], s_.d2m + m[:, own]
                for k, t in enumerate((m_m, m_i, m_d, end) if self.q is not None else ()):
                    np.add.at(gaps[:, k], (row, g[None, :]), np.exp(f[0] + t))
                if self.q is not None:
                    runs += np.stack([np.exp(f[2] + d_d).sum(1), np.exp(f[2] + d_m).sum(1), np.exp(f[1] + i_i).sum(1), np.exp(f[1] + i_m).sum(1)], 1)
                b_m = np.logaddexp(np.logaddexp(m_m, m_i), np.logaddexp(m_d, end))
                b_i, b_d = np.logaddexp(i_i, i_m), np.logaddexp(d_d, d_m)
                if cells is not None:
                    lane, at = np.nonzero(live)
                    posts = [np.exp(a + b)[lane, at] for a, b in zip(f, (b_m, b_i, b_d))]
                    cells.append((lane, i[lane, at], j[at], *((x + norm)[lane, at] for x in f), *posts))
                if self.q is None:
                    into = np.where(live, b_m + self.matched(j, i), -np.inf)
                    m[:, own], ins[:, own], dele[:, own] = into, np.where(live, b_i, -np.inf), np.where(live, b_d, -np.inf)
                    continue
                base = self.bases(i)
                np.add.at(match, (row, base, self.context[j - 1][None, :], self.q[j - 1][None, :]), np.exp(f[0] + b_m))
                np.add.at(insert, (row, self.y[j - 1][None, :], self.q[j - 1][None, :]), np.exp(f[1] + b_i))
                into = np.where(live, b_m + self.emit[j, base], -np.inf)
                start = np.logaddexp(start, np.logaddexp.reduce(np.where(live, into + self._starts(j, i), -np.inf), axis=1))
                m[:, own], ins[:, own], dele[:, own] = into, np.where(live, b_i, -np.inf), np.where(live, b_d, -np.inf)
        vector = np.concatenate([insert.reshape(lanes, -1), match.reshape(lanes, -1), gaps.reshape(lanes, -1), runs], 1)
        return start, vector


class PairSweep(Sweep):
    """Lanes that each have a read of their own, all of one length and without qualities: many short pairs take as many steps as one."""

    def __init__(self, reads: np.ndarray, refs: list[np.ndarray], lanes: list[tuple[int, int, int]], scores: Scores, *, local: bool = True):
        """``reads`` [pair, place] are tokens; ``lanes``: (pair, first diagonal, width)."""
        super().__init__(reads[0], None, refs, lanes, scores, local=local)
        self.reads = ys = reads[self.owner]
        self.contexts, gap = (np.stack([context_codes(y, k) for y in ys]) if k > 1 else ys * k for k in (scores.match_order, scores.gap_order))
        none = np.full((len(ys), 1), -np.inf)
        self.each_i = np.concatenate([none, scores.insert[ys, BINS]], 1)
        self.emits = np.ascontiguousarray(scores.match[:, :, BINS])
        self.each_gap = np.concatenate([np.zeros((len(ys), 1), np.int64), gap], 1)

    def matched(self, j: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.emits.ravel().take(self.bases(i) * self.emits.shape[1] + self.contexts[:, j - 1])

    def inserted(self, j: np.ndarray) -> np.ndarray:
        return self.each_i[:, j]

    def gap_at(self, j: np.ndarray) -> np.ndarray:
        return self.each_gap[:, j]


def seed_counts(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(diagonals, matching k-mers on each) of two token arrays."""
    if len(x) < k or len(y) < k:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = lambda t: context_codes(t, k)[k - 1 :]
    cx, cy = code(x), code(y)
    order = np.argsort(cy, kind="stable")
    low, high = np.searchsorted(cy[order], cx), np.searchsorted(cy[order], cx, "right")
    n = high - low
    where = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    return np.unique(np.repeat(np.arange(len(cx)), n) - order[where], return_counts=True)


class SeedIndex:
    """Places of the k-mers of many reads, so that a reference's diagonals are counted for all of them at once."""

    def __init__(self, ys: list[np.ndarray], k: int):
        self.k, self.longest = k, max((len(y) for y in ys), default=0)
        each = [context_codes(y, k)[k - 1 :] if len(y) >= k else np.empty(0, np.int64) for y in ys]
        codes = np.concatenate([np.empty(0, np.int64), *each])
        order = np.argsort(codes, kind="stable")
        self.codes = codes[order]
        self.of = np.repeat(np.arange(len(ys)), [len(c) for c in each])[order]
        self.at = np.concatenate([np.empty(0, np.int64), *(np.arange(len(c)) for c in each)])[order]
        self.first = np.append(0, np.cumsum(np.bincount(codes, minlength=4**k))) if k <= 8 else None
        self._keys: dict[int, np.ndarray] = {}

    def places(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, behind the last) of the places of each code."""
        if self.first is not None:
            return self.first[codes], self.first[codes + 1]
        return np.searchsorted(self.codes, codes), np.searchsorted(self.codes, codes, "right")

    def seeds(self, x: np.ndarray, threshold: int, *, stretch: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
        """(reads, diagonals) with at least ``threshold`` matching k-mers.

        Hits are counted by 32 neighbouring diagonals first, and by diagonal where these reach the threshold. A long
        reference is taken a stretch of diagonals at a time; at its rims a diagonal may be counted in part as well, which finds it twice at most.
        """
        if len(x) < self.k or not len(self.codes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        low, high = self.places(context_codes(x, self.k)[self.k - 1 :])
        found = [np.empty((2, 0), np.int64)]
        for d in range(1 - self.longest, len(low), stretch):
            a, b = max(0, d), min(len(low), d + stretch + self.longest)
            n = high[a:b] - low[a:b]
            total = int(n.sum())
            if total < threshold:
                continue
            bits = max(5, int(min(stretch, len(low) + self.longest) + 2 * self.longest).bit_length())
            if bits not in self._keys:
                self._keys[bits] = (self.of << bits) - self.at
            hits = np.repeat(low[a:b] - (np.cumsum(n) - n), n) + np.arange(total)
            keys = self._keys[bits][hits] + np.repeat(np.arange(a, b) - d + self.longest, n)
            full = np.bincount(keys >> 5) >= max(threshold, 1)
            if full.any():
                keys, count = np.unique(keys[full[keys >> 5]], return_counts=True)
                keys = keys[count >= threshold]
                found.append(np.stack([keys >> bits, (keys & ((1 << bits) - 1)) + d - self.longest]))
        return tuple(np.unique(np.concatenate(found, axis=1), axis=1)) if len(found) > 2 else tuple(found[-1])


def widen(diags: np.ndarray, x_len: int, y_len: int, band: int) -> np.ndarray:
    """``diags`` with half a band on either side, and diagonal 0."""
    half = np.arange(-(band // 2), band // 2 + 1)
    return np.unique(np.append(np.clip((diags[:, None] + half).ravel(), 1 - y_len, x_len - 1), 0))


def straight_scores(xs: list[np.ndarray], ys: list[np.ndarray], qs: list[np.ndarray | None], scores: Scores, *, local: bool = True) -> np.ndarray:
    """[read, reference]: score of diagonal 0 alone. It holds one path, so this is the best and the sum of all.

    Bases of references as zeros and ones times scores of reads: sums of the same numbers as in a sweep, in another order.
    """
    longest, never = max(map(len, ys)), -1e30
    emit, rest = np.zeros((len(ys), longest, 4)), np.zeros(len(ys))
    for r, (y, q) in enumerate(zip(ys, qs)):
        emit[r, : len(y)] = scores.match[:, context_codes(y, scores.match_order), np.full(len(y), BINS) if q is None else q].T
        gap = context_codes(y, scores.gap_order)
        rest[r] = scores.m2m[gap[:-1]].sum() + scores.m2e[gap[-1]]
    emit = np.maximum(emit, never).reshape(len(ys), -1)
    sizes, out = np.array([len(y) for y in ys])[:, None], np.empty((len(ys), len(xs)))
    for at in range(0, len(xs), 1000):
        some = xs[at : at + 1000]
        bases = np.full((len(some), longest), 4)
        for n, x in enumerate(some):
            bases[n, : len(x)] = x[:longest]
        there = (bases[:, :, None] == np.arange(4)).astype(float).reshape(len(some), -1)
        x_len = np.array([len(x) for x in some])
        got = emit @ there.T + rest[:, None]
        out[:, at : at + 1000] = np.where(((sizes <= x_len) if local else (sizes == x_len)) & (got > never / 2), got, -np.inf)
    return out


def most_of_short(ys: list[np.ndarray], qs: list[np.ndarray | None], scores: Scores, size: int, *, sums: bool = False) -> np.ndarray:
    """[read, bases]: no reference of so many bases (0 to ``size``) gives the read a best path with a higher score, whatever the bases are.

    Each base that is matched counts as the likeliest one, and a run of deletions as one of no length. With ``sums`` the same
    of the sum over all paths: then runs of deletions of all lengths count, and each place where a path may begin.
    """
    either = np.logaddexp if sums else np.maximum
    longest, sizes = max(map(len, ys)), np.array([len(y) for y in ys])
    match, insert = np.full((2, longest, len(ys), 1), -np.inf)
    for r, (y, q) in enumerate(zip(ys, qs)):
        q = np.full(len(y), BINS) if q is None else q
        match[: len(y), r, 0] = scores.match[:, context_codes(y, scores.match_order), q].max(0)
        insert[: len(y), r, 0] = scores.insert[y, q]
    with np.errstate(divide="ignore"):
        runs = -np.log1p(-np.exp(scores.d2d)) if sums else 0.0
        begins = np.log(np.arange(size + 1)) if sums else 0.0
    to_insert, on = scores.m2i.max(), either(scores.m2m.max(), scores.m2d.max() + scores.d2m + runs)
    m, ins, ends = np.full((3, len(ys), size + 1), -np.inf)  # by the number of matches
    m[:, 1:2] = match[0]
    for j in range(longest):
        if j:
            before = m
            m = np.full_like(before, -np.inf)
            m[:, 1:] = match[j] + either(before[:, :-1] + on, ins[:, :-1] + scores.i2m)
            ins = insert[j] + either(before + to_insert, ins + scores.i2i)
        ends[sizes == j + 1] = m[sizes == j + 1]
    return either.accumulate(ends, axis=1) + scores.m2e.max() + begins


def short_forward(xs: list[np.ndarray], y: np.ndarray, q: np.ndarray | None, scores: Scores, *, local: bool = True) -> np.ndarray:
    """Log likelihood of each whole matrix of short references, as ``Sweep.forward`` has it.

    Columns are bases of the reference instead of diagonals, of which a long read has many; sums are kept as numbers near 1
    and the logarithm of what they were divided by.
    """
    n, width, lanes = len(y), max(map(len, xs)), len(xs)
    at = np.full(n, BINS) if q is None else q
    emit, own = scores.match[:, context_codes(y, scores.match_order), at], scores.insert[y, at]
    level = np.maximum(emit.max(0), own)
    if not np.isfinite(level).all():
        return np.full(lanes, -np.inf)
    codes, x_len = np.full((lanes, width), 4), np.array([len(x) for x in xs])
    for k, x in enumerate(xs):
        codes[k, : len(x)] = x
    steps = n + width - 1

    def by_step(v: np.ndarray) -> np.ndarray:
        """[..., i, j] as [i + j, ..., i]: rows one longer than the steps shift by one each when read as rows of that length."""
        wide = np.zeros((*v.shape[:-1], steps + 1))
        wide[..., :n] = v
        return np.ascontiguousarray(np.moveaxis(wide.reshape(*v.shape[:-2], -1)[..., : width * steps].reshape(*v.shape[:-1], steps), -1, 0))

    of_j = lambda v: by_step(np.broadcast_to(v, (width, n)))
    gap = context_codes(y, scores.gap_order)
    before = np.append(0, gap[:-1])
    table = np.vstack([np.exp(emit - level), np.zeros(n)])
    e, e_i = by_step(table[codes]), of_j(np.exp(own - level))
    m2m, m2i, m2d = of_j(np.exp(scores.m2m[before])), of_j(np.exp(scores.m2i[before])), of_j(np.exp(scores.m2d[gap]))
    i2m, i2i, d2m, d2d = np.exp([scores.i2m, scores.i2i, scores.d2m, scores.d2d])
    m, ins, dele = np.zeros((3, 2, lanes, width))  # the last step and the one before
    total, start, shift = np.zeros(lanes), np.ones(lanes), np.zeros(lanes)
    for s in range(steps):
        mat, out = np.zeros((2, lanes, width))
        mat[:, 1:] = m[1][:, :-1] * m2m[s][1:] + ins[1][:, :-1] * i2m + dele[1][:, :-1] * d2m
        if s < width and (local or s == 0):
            mat[:, s] += start
        mat *= e[s]
        into = (m[0] * m2i[s] + ins[0] * i2i) * e_i[s]
        out[:, 1:] = m[0][:, :-1] * m2d[s][1:] + dele[0][:, :-1] * d2d
        last = s - n + 1
        if last >= 0:
            total += mat[:, last] if local else np.where(x_len == last + 1, mat[:, last], 0.0)
        m, ins, dele = (mat, m[0]), (into, ins[0]), (out, dele[0])
        if s % 8 == 7:
            top = np.maximum.reduce([v.max(1) for v in (*m, *ins, *dele)] + [total])
            by = np.where(top > 0, 1 / np.where(top > 0, top, 1), 1.0)
            m, ins, dele = (tuple(v * by[:, None] for v in state) for state in (m, ins, dele))
            total, start, shift = total * by, start * by if s < width else start, shift - np.log(by)
    with np.errstate(divide="ignore"):
        return np.log(total) + shift + level.sum() + scores.m2e[gap[-1]]


def choose_diagonals(x: np.ndarray, y: np.ndarray, *, k: int, threshold: int | None, band: int, max_bytes: int | None = None, cell: int = 24) -> np.ndarray | None:
    """Diagonals to search: seeds with at least ``threshold`` k-mers, widened by band / 2, and diagonal 0; None for all.

    With ``max_bytes`` in place of a threshold, whole levels of the count are taken from the highest on, as long as the
    stored band stays below it.
    """
    if max_bytes is None and min(len(x), len(y)) < 2 * (k + threshold):
        return None
    diags, n = seed_counts(x, y, k)
    widened = lambda d: widen(d, len(x), len(y), band)
    if max_bytes is None:
        return widened(diags[n >= threshold])
    chosen = widened(np.empty(0, np.int64))
    for level in np.unique(n)[::-1]:
        more = widened(diags[n >= level])
        stored = np.unique((more[:, None] + np.arange(-1, 2)).ravel())
        if len(stored) * min(len(x), len(y)) * cell >= max_bytes:
            break
        chosen = more
    return chosen


class OverlapSweep:
    """Two reads against each other with free ends: the best path through a three-state model of both.

    ``compat`` keeps the customary mapping of transitions, in which the run and end scores of gaps stand crossed;
    without it each transition has the score that its name says.
    """

    def __init__(self, x: np.ndarray, xq: np.ndarray | None, y: np.ndarray, yq: np.ndarray | None, params: Params, scores: Scores, diags: np.ndarray | None, *, complemented: bool = False, compat: bool = True):
        self.nx, self.ny = len(x), len(y)
        mo, go = params.match_order, params.gap_order
        # a complemented read is read along its original strand, and complemented reference bases emit it
        turn = (lambda t, k: context_codes(3 - t[::-1], k)[::-1]) if complemented else context_codes
        cx, cy = context_codes(x, mo), turn(y, mo)
        gx, gy = np.append(0, context_codes(x, go)), np.append(0, turn(y, go))
        y_own = 3 - y if complemented else y
        qx, qy = (np.full(len(t), BINS) if q is None else q for t, q in ((x, xq), (y, yq)))
        ins_x, ins_y = scores.insert[x, qx], scores.insert[y_own, qy]
        self.flanks = float(ins_x.sum() + ins_y.sum())
        strand = [3, 2, 1, 0] if complemented else [0, 1, 2, 3]
        with np.errstate(divide="ignore"):
            self.mx = np.log(params.ref_base)[:, None] + scores.match[:, cx, qx] - ins_x
            bi, bd = params.begin_insert, params.begin_delete
            delete = (1 - bi) * bd
            gap = bi + delete
            is_insert = bi / gap
            near = is_insert * bi + (1 - is_insert) * gap / (1 - params.extend_delete * (1 - gap))
            go_on = 1 / (is_insert.mean() / params.extend_insert + (1 - is_insert.mean()) / params.extend_delete)
            again, other, back = np.log(go_on), np.log1p(-go_on) + np.log(near.mean()), np.log1p(-go_on) + np.log1p(-near.mean())
            self.open_x, self.open_y, self.none_x, self.none_y = np.log(gap)[gx], np.log(gap)[gy], np.log1p(-gap)[gx], np.log1p(-gap)[gy]
        self.my = scores.match[strand][:, cy, qy] - ins_y
        # (to match, same gap again, I from D, D from I)
        if compat:
            self.i2m, self.d2m, self.i2i, self.d2d, self.d2i, self.i2d = again, other, back, again, back, back
            self.trace_i2d = other
        else:
            self.i2m, self.d2m, self.i2i, self.d2d, self.d2i, self.i2d = back, back, again, again, other, other
            self.trace_i2d = other
        runs = envelope(diags, self.nx, self.ny)
        self.first, last = runs[0][0], runs[-1][0] + runs[-1][1] - 1
        self.allowed = np.zeros(last - self.first + 1, bool)
        for d, w in runs:
            self.allowed[d - self.first : d - self.first + w] = True

    def run(self) -> tuple[float, list[tuple[int, int, str]]]:
        """(score, path as (i, j, state)); the path is empty if there is none."""
        width = len(self.allowed)
        m, ins, dele = (np.full(width + 2, -np.inf) for _ in range(3))
        steps = self.nx + self.ny
        back = np.zeros((steps + 1, width), np.uint8)
        ends: list[tuple[float, int, int, int]] = []
        for s in range(2, steps + 1):
            d = np.arange(self.first, self.first + width)
            c = np.flatnonzero(((d + s) & 1 == 0) & self.allowed & (s + d >= 2) & (s - d >= 2) & (s + d <= 2 * self.nx) & (s - d <= 2 * self.ny))
            if not len(c):
                continue
            i, j = (s + d[c]) // 2, (s - d[c]) // 2
            own, up, down = c + 1, c + 2, c
            edge = np.where((i == 1) | (j == 1), 0.0, -np.inf)
            options = np.stack([m[own] + self.none_x[i - 1] + self.none_y[j - 1], ins[own] + self.i2m, dele[own] + self.d2m, edge])
            mat = options.max(0) + np.logaddexp.reduce(self.mx[:, i - 1] + self.my[:, j - 1], axis=0)
            a, b, e = m[up] + self.open_x[i], ins[up] + self.i2i, dele[up] + self.d2i
            into = np.maximum(np.logaddexp(b, e), a)
            f, g, h = m[down] + self.none_x[i - 1] + self.open_y[j], dele[down] + self.d2d, ins[down] + self.i2d
            out = np.maximum(np.logaddexp(g, h), f)
            from_i = np.stack([a, b, e]).argmax(0)
            from_d = np.stack([f, ins[down] + self.trace_i2d, g]).argmax(0)
            back[s, c] = options.argmax(0) | from_i << 2 | from_d << 4
            m[own], ins[own], dele[own] = mat, into, out
            for k in np.flatnonzero((i == self.nx) | (j == self.ny)):
                if np.isfinite(mat[k]):
                    # of equal ends the corner comes first, then the last column from the far end, then the last row
                    rank = 0 if i[k] == self.nx and j[k] == self.ny else (self.nx - i[k] + 1 if j[k] == self.ny else self.nx + self.ny - j[k] + 2)
                    ends.append((-float(mat[k]), int(rank), int(i[k]), int(j[k])))
        if not ends:
            return -np.inf, []
        score, _, i, j = min(ends)
        state, path = FROM_M, []
        while state != START:
            code = int(back[i + j, i - j - self.first])
            path.append((i, j, "MID"[state]))
            if state == FROM_M:
                state, i, j = code & 3, i - 1, j - 1
            elif state == FROM_I:
                state, j = code >> 2 & 3, j - 1
            else:
                state, i = code >> 4 & 3, i - 1
        return -score + self.flanks, path[::-1]
