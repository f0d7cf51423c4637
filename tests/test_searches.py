"""Searching many reads at once finds what each pair by itself does."""

import numpy as np
import pytest

from seqloom.operators.align import EnvelopeConfig, align, lanes_of, searches
from seqloom.operators.kernels import Scores, SeedIndex, Sweep, most_of_short, seed_counts, short_forward
from seqloom.plans.model import NullModel, Params

SCORES = Scores.of(Params.default())


def some_tokens():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 4, 1500)
    xs = [rng.integers(0, 4, n) for n in (1, 5, 30, 51, 52, 300, 900)] + [base, np.concatenate([base[100:400], rng.integers(0, 4, 200)]), np.zeros(300, np.int64)]
    return xs, [rng.integers(0, 4, n) for n in (20, 66, 180)] + [base[150:330], base[:180], np.zeros(90, np.int64), base[380:500]]


@pytest.mark.parametrize("config", [EnvelopeConfig(), EnvelopeConfig(k=3, threshold=4, band=8), EnvelopeConfig(k=9, threshold=3, band=10), EnvelopeConfig(threshold=None, max_bytes=50_000)])
@pytest.mark.parametrize("local", [True, False])
def test_lanes_are_those_of_each_pair(config, local):
    xs, ys = some_tokens()
    if config.threshold is None:
        config = EnvelopeConfig(max_bytes=50_000)
    for y, s in zip(ys, searches(xs, ys, [None] * len(ys), SCORES, config, local=local, at_once=3), strict=True):
        assert sorted(s.lanes + s.short + [(int(n), 0, 1) for n in s.straight]) == sorted(lanes_of(xs, y, config))
        for n, v in zip(s.straight, s.score):
            assert v == pytest.approx(float(Sweep(y, None, xs, [(int(n), 0, 1)], SCORES, local=local).forward()[0][0]), abs=1e-9)
        if s.short:
            sweep = Sweep(y, None, xs, s.short, SCORES, local=local)
            assert (sweep.viterbi(trace=False)[0] <= s.most + 1e-9).all()


@pytest.mark.parametrize("stretch", [64, 1 << 15])
def test_seeds_of_many_reads_are_those_of_each(stretch):
    xs, ys = some_tokens()
    index = SeedIndex(ys, 6)
    for x in xs:
        got = set(zip(*(v.tolist() for v in index.seeds(x, 5, stretch=stretch))))
        assert got == {(r, int(d)) for r, y in enumerate(ys) for d, n in zip(*seed_counts(x, y, 6)) if n >= 5}


@pytest.mark.parametrize("local", [True, False])
def test_short_references_have_the_likelihood_of_their_whole_matrix(local):
    rng, params = np.random.default_rng(2), Params.default()
    params.match_order, params.gap_order = 2, 1
    params.match, params.begin_insert = np.tile(params.match, (1, 4, 1)), np.array([0.1, 0.05, 0.2, 0.1])
    params.begin_delete = params.begin_insert[::-1].copy()
    scores = Scores.of(params)
    xs = [rng.integers(0, 4, n) for n in (1, 2, 9, 40, 51)]
    for size in (1, 7, 51, 400):
        y, q = rng.integers(0, 4, size), rng.integers(0, 40, size)
        for quality in (None, q):
            whole = Sweep(y, quality, xs, [(n, 1 - size, len(x) + size - 1) for n, x in enumerate(xs)], scores, local=local).forward()[0]
            got = short_forward(xs, y, quality, scores, local=local)
            assert ((got == whole) | (np.abs(got - whole) < 1e-8)).all()


def test_sums_of_short_references_stay_below_what_their_size_allows():
    rng, hopeless = np.random.default_rng(5), 0
    for size in (1, 6, 30, 60, 200):
        y, q = rng.integers(0, 4, size), rng.integers(0, 40, size)
        for quality in (None, q):
            most = most_of_short([y], [quality], SCORES, 52, sums=True)[0]
            for x in (*(rng.integers(0, 4, n) for n in (1, 5, 20, 51)), y[:50], y[5:40]):
                if len(x):
                    for local in (True, False):
                        assert short_forward([x], y, quality, SCORES, local=local)[0] <= most[len(x)] + 1e-9
            if size == 200:  # so the E-step need not compute it
                hopeless += most[51] < np.log(0.25) * size - 60
    assert hopeless


@pytest.mark.parametrize(("best_only", "threshold"), [(True, 0.0), (True, None), (False, None), (False, 0.0)])
def test_few_sweeps_give_what_all_pairs_give(spark, monkeypatch, best_only, threshold):
    """Most pairs can't reach the threshold, or the best score, and take no sweep."""
    from seqloom.operators import align as module

    xs, ys = some_tokens()
    text = lambda t: "".join("ACGT"[b] for b in t)
    refs = spark.createDataFrame([(n, f"x{n}", text(x), True, None) for n, x in enumerate(xs)], "idx long, name string, seq string, is_orig boolean, source struct<name:string>").coalesce(1)
    reads = spark.createDataFrame([(n, f"y{n}", text(y), None) for n, y in enumerate(ys)], "idx long, name string, seq string, qual string").coalesce(1)
    null = NullModel(0.99, np.array([(0.25, 0.5, 1.0)] * 4))
    wanted = []
    for r, y in enumerate(ys):
        base, best = null.log_likelihood(y, None), {}
        for n, d, w in lanes_of(xs, y, EnvelopeConfig()):
            v = float(Sweep(y, None, xs, [(n, d, w)], SCORES).viterbi(trace=False)[0][0]) - base
            if np.isfinite(v):
                best[n] = max(best.get(n, -np.inf), v)
        order = sorted(best, key=lambda n: (-best[n], n))
        wanted += [(r, n, round(best[n], 6)) for n in (order[:1] if best_only else order) if threshold is None or best[n] >= threshold]
    got = align(reads, refs, null=null, best_only=best_only, threshold=threshold, use_quals=False).collect()
    assert sorted((r["y_idx"], r["x_idx"], round(r["score"], 6)) for r in got) == sorted(wanted)
