import math
import random

import numpy as np
import pytest

from seqloom.functions.stats import BINS, digamma, fit_nb, log_nb, trigamma
from seqloom.operators.kernels import OverlapSweep, Scores, Sweep, choose_diagonals, context_codes, envelope, seed_counts, tokens
from seqloom.plans.model import BASES, Counts, NullModel, Params

INF = float("inf")


def some_params(match_order=1, gap_order=0, seed=1):
    rng = np.random.default_rng(seed)
    g, m = 4**gap_order, 4**match_order
    cells = lambda *s: np.stack([rng.uniform(0.1, 0.4, s), rng.uniform(0.5, 0.9, s), rng.uniform(5, 60, s)], -1)
    return Params(rng.uniform(0.02, 0.2, g), rng.uniform(0.02, 0.2, g), 0.6, 0.5, cells(4), cells(4, m), match_order=match_order, gap_order=gap_order)


def plain(x, y, q, s, local, add, allowed=lambda d: True):
    """Cell by cell: log likelihood or best score by what ``add`` does with alternatives."""
    nx, ny = len(x), len(y)
    ctx, gap = context_codes(y, s.match_order), np.append(0, context_codes(y, s.gap_order))
    M, I, D = ({} for _ in range(3))
    at = lambda t, i, j: t.get((i, j), -INF)
    end = -INF
    for j in range(1, ny + 1):
        for i in range(1, nx + 1):
            if not allowed(i - j):
                continue
            start = 0.0 if j == 1 and (i == 1 or local) else -INF
            c, b = gap[j], gap[j - 1]
            M[i, j] = add(at(M, i - 1, j - 1) + s.m2m[b], at(I, i - 1, j - 1) + s.i2m, at(D, i - 1, j - 1) + s.d2m, start) + s.match[x[i - 1], ctx[j - 1], q[j - 1]]
            I[i, j] = add(at(I, i, j - 1) + s.i2i, at(M, i, j - 1) + s.m2i[b]) + s.insert[y[j - 1], q[j - 1]]
            D[i, j] = add(at(D, i - 1, j) + s.d2d, at(M, i - 1, j) + s.m2d[c])
            if j == ny and (local or i == nx):
                end = add(end, M[i, j] + s.m2e[c])
    return end


def lse(*v):
    top = max(v)
    return top if top == -INF else top + math.log(sum(math.exp(a - top) for a in v))


@pytest.mark.parametrize("local", [True, False])
@pytest.mark.parametrize("orders", [(1, 0), (2, 1)])
def test_sweeps_match_plain_recursions(local, orders):
    rng = random.Random(4)
    s = Scores.of(some_params(*orders))
    for trial in range(6):
        xs = [np.array([rng.randrange(4) for _ in range(rng.randrange(6, 18))]) for _ in range(3)]
        y = np.array([rng.randrange(4) for _ in range(rng.randrange(3, 9))])
        q = np.array([rng.randrange(BINS) for _ in y])
        diags = None if trial % 2 else np.array([-2, -1, 0, 1, 4, 5, 6])
        lanes = [(n, d, w) for n, x in enumerate(xs) for d, w in envelope(diags, len(x), len(y))]
        sweep = Sweep(y, q, xs, lanes, s, local=local)
        best, end, back = sweep.viterbi()
        forward, kept = sweep.forward(keep=True)
        backward, counts = sweep.backward_counts(kept, forward)
        for n, x in enumerate(xs):
            own = [k for k, lane in enumerate(lanes) if lane[0] == n]
            allowed = (lambda d: True) if diags is None else (lambda d: d in diags)
            assert max(best[own]) == pytest.approx(plain(x, y, q, s, local, max, allowed))
            total = plain(x, y, q, s, local, lse, allowed)
            assert np.logaddexp.reduce(forward[own]) == pytest.approx(total)
        live = np.isfinite(forward)
        assert backward[live] == pytest.approx(forward[live])
        emitted = counts[:, : 4 * BINS + 4 * s.match.shape[1] * BINS].sum(1)
        assert emitted[live] == pytest.approx(np.full(live.sum(), len(y)))
        for k in np.flatnonzero(live):
            path = sweep.path(k, int(end[k]), back)
            assert [j for _, j, state in path if state != "D"] == list(range(1, len(y) + 1))


def test_identical_sequences_align_without_gaps():
    y = tokens("ACGTTGCAACGTTAGCCGATCGATTACG")
    sweep = Sweep(y, np.full(len(y), 30), [y], [(0, -3, 7)], Scores.of(Params.default()))
    best, end, back = sweep.viterbi()
    assert [s for _, _, s in sweep.path(0, int(end[0]), back)] == ["M"] * len(y)
    assert seed_counts(y, y, 6)[1].max() == len(y) - 5


def test_counts_by_small_changes_of_a_parameter():
    """The derivative of the log likelihood with respect to log d2d is the expected number of such steps."""
    rng = random.Random(8)
    x, y = (np.array([rng.randrange(4) for _ in range(n)]) for n in (14, 9))
    q = np.array([rng.randrange(20, 40) for _ in y])
    s = Scores.of(some_params())
    run = lambda: Sweep(y, q, [x], [(0, 1 - len(y), len(x) + len(y) - 1)], s)
    forward, kept = run().forward(keep=True)
    _, counts = run().backward_counts(kept, forward)
    s.d2d += 1e-6
    more, _ = run().forward()
    assert (more - forward)[0] / 1e-6 == pytest.approx(counts[0, -4], rel=1e-4)


def test_overlap_of_shifted_reads_and_their_complements():
    rng = random.Random(9)
    genome = [rng.randrange(4) for _ in range(90)]
    x, y = np.array(genome[:60]), np.array(genome[25:])
    p = Params.default()
    s = Scores.of(p)
    for compat in (True, False):
        score, path = OverlapSweep(x, None, y, None, p, s, None, compat=compat).run()
        assert path[0][:2] == (26, 1) and path[-1][:2] == (60, 35) and {c for _, _, c in path} == {"M"}
        banded, same = OverlapSweep(x, None, y, None, p, s, np.arange(20, 31), compat=compat).run()
        assert same == path and banded == pytest.approx(score)
    _, path = OverlapSweep(x, None, y, None, p, s, None, complemented=True).run()
    assert path[0][:2] == (26, 1)


def test_diagonals():
    x, y = tokens("ACGTACGGTTAACCGGTATCGATCGGGATTACAGCCA" * 3), tokens("TTAACCGGTATCGATCGGGATTACAGCCA" * 2)
    assert choose_diagonals(x, y, k=6, threshold=40, band=4) is None
    d = choose_diagonals(x, y, k=6, threshold=10, band=4)
    assert 0 in d and 8 in d and 10 in d and set(np.diff(d)) - {1}
    small = choose_diagonals(x, y, k=6, threshold=None, band=4, max_bytes=20_000)
    assert len(small) < len(choose_diagonals(x, y, k=6, threshold=None, band=4, max_bytes=10**7))
    assert len(seed_counts(tokens("ACG"), y, 6)[0]) == 0


def test_special_functions_and_fit():
    assert digamma(1.0) == pytest.approx(-0.5772156649) and trigamma(1.0) == pytest.approx(math.pi**2 / 6)
    assert np.exp(log_nb(0.5, 7.5, 400)).sum() == pytest.approx(1)
    sample = np.bincount(np.random.default_rng(3).negative_binomial(5, 0.1, 10_000), minlength=200)[:200]
    p, r = fit_nb(sample)
    assert p == pytest.approx(0.1, rel=0.1) and r == pytest.approx(5, rel=0.1)
    assert all(map(math.isnan, fit_nb(np.zeros(BINS))))
    assert all(map(math.isfinite, fit_nb(np.eye(BINS)[30] * 50)))


def test_json_round_trips():
    for p in (Params.default(), some_params(2, 1)):
        assert Params.from_json(p.to_json()).to_json() == p.to_json()
    hist = np.random.default_rng(1).integers(0, 50, (4, BINS)).astype(float)
    null = NullModel.fit(hist, 20)
    assert NullModel.from_json(null.to_json()).to_json() == null.to_json()
    prior = Counts.prior(null, 2, 1)
    assert Counts.from_json(prior.to_json()).to_json() == prior.to_json()
    fitted = prior.fit()
    assert fitted.match.shape == (4, 16, 3) and fitted.begin_insert == pytest.approx(np.full(4, 0.1)) and math.isfinite(prior.log_prior(fitted))
    assert [b for b, c in zip(BASES, fitted.match[:, :4, 0].argmax(1)) if BASES[c] != b] == []
    with pytest.raises(ValueError, match="Missing parameter"):
        Params.from_json("{}")
    assert len(Params.default().rows()) == 24
