"""Kernels: the haplotype sort, the copying model, imputation and phasing on small cases with known answers."""

import numpy as np
import pytest

from loomgene.operators import hmm, pbwt, states
from loomgene.plans.impute import bridged, impute_window
from loomgene.plans.phase import bridge, genotype_emissions, phase_window


def test_sort_of_four():
    _, order, start = next(pbwt.sweep(np.array([[0, 1, 0, 1]])))
    assert order.tolist() == [0, 2, 1, 3] and start.tolist() == [1, 0, 1, 0]
    _, order, _ = next(pbwt.sweep(np.array([[0, 1, 255, 0]])))
    assert order.tolist() == [0, 3, 1, 2]


def test_sort_matches_prefixes():
    a = np.random.default_rng(1).integers(0, 3, (25, 30))
    for walk, part in ((pbwt.sweep, lambda m: a[: m + 1][::-1]), (pbwt.backward_sweep, lambda m: a[m:])):
        for m, order, start in walk(a):
            keys = [tuple(x) for x in part(m).T]
            assert order.tolist() == sorted(range(30), key=lambda h: (keys[h], h))
            for k in range(1, 30):
                x, y = keys[order[k - 1]], keys[order[k]]
                same = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), len(x))
                assert start[k] == (m - same + 1 if walk is pbwt.sweep else m + same - 1)


def test_neighbours_are_the_longest_matches():
    a = np.random.default_rng(2).integers(0, 2, (20, 24))
    for m, order, start in pbwt.sweep(a):
        rank = 7
        hap = order[rank]
        near = pbwt.neighbours(order, start, m, rank, 4)
        length = lambda h: next((i for i, d in enumerate((a[: m + 1, h] != a[: m + 1, hap])[::-1]) if d), m + 1)
        others = sorted((length(h) for h in range(24) if h >> 1 != hap >> 1), reverse=True)
        assert len(near) == 4 and hap >> 1 not in {h >> 1 for h in near}
        assert sorted(map(length, near), reverse=True) == others[:4]
        spiral = pbwt.spiral(order, rank, 6)
        assert len(spiral) == 6 == len(set(spiral)) and spiral == sorted(spiral)
        block = pbwt.match_block(order, start, max(0, m - 2), rank, 10)
        assert all(length(h) >= min(3, m + 1) for h in block)
    assert pbwt.match_span(np.array([[0, 0, 1], [1, 1, 1], [0, 1, 0]]), 0, 1) == 2


def brute(e, r):
    """Posteriors by summing over all paths."""
    import itertools

    m, k = e.shape
    out, total = np.zeros((m, k)), 0.0
    for path in itertools.product(range(k), repeat=m):
        p = e[0, path[0]] / k
        for i in range(1, m):
            p *= e[i, path[i]] * ((1 - r[i]) * (path[i] == path[i - 1]) + r[i] / k)
        total += p
        for i, s in enumerate(path):
            out[i, s] += p
    return out / total, np.log(total)


def test_posteriors_match_all_paths():
    rng = np.random.default_rng(3)
    e, r = rng.random((5, 3)), np.array([0, 0.1, 0.5, 0.9, 0.01])
    p, ll = hmm.posteriors(e[:, None, :], r)
    want, log = brute(e, r)
    assert np.allclose(p[:, 0], want) and np.isclose(ll[0], log)
    assert np.allclose(hmm.backward_step(np.ones(4), np.array([1.0, 2, 3, 4]), 0.3).sum(), 1)


def test_sampled_paths_follow_posteriors():
    rng = np.random.default_rng(4)
    e, r = rng.random((4, 1, 3)), np.array([0, 0.2, 0.2, 0.2])
    paths = hmm.sample_paths(np.repeat(e, 40_000, 1), r, rng)
    p, _ = hmm.posteriors(e, r)
    for m in range(4):
        assert np.allclose(np.bincount(paths[m], minlength=3) / 40_000, p[m, 0], atol=0.01)


@pytest.mark.parametrize("n, k, rate", [(1, 20, 0.02), (3, 5, 0.001), (1, 4, 1e-7)])
def test_runs_side_by_side_are_a_single_pass(monkeypatch, n, k, rate):
    """Also where hardly anything switches, so that each run waits for the one before."""
    rng = np.random.default_rng(k)
    alleles, r = rng.integers(0, 2, (1403, 1, k)), np.full(1403, rate)
    e = np.where(alleles == np.repeat(alleles[:, :, 0], n, 1)[..., None], 0.99, 0.01)
    found = []
    for run in (100, 1 << 40):
        monkeypatch.setattr(hmm, "RUN", run)
        counts = hmm.expected_counts((e > 0.5).astype(float), e, r, r)
        found.append([hmm.forward(e, r), *hmm.posteriors(e, r), np.array([counts[x] for x in sorted(counts)]), hmm.sample_paths(e, r, np.random.default_rng(1))])
    for x, y in zip(*found):
        assert np.allclose(x, y, rtol=1e-9, atol=1e-12)
    assert (found[0][-1] == found[1][-1]).all()


def test_long_chromosomes_take_few_steps():
    import time

    rng = np.random.default_rng(2)
    alleles = rng.integers(0, 2, (30_000, 1, 20))
    e, r = np.where(alleles == alleles[..., :1], 0.99, 0.01), np.full(30_000, 0.02)
    began = time.process_time()
    f = e[0] / 20
    for m in range(1, len(e)):
        f = hmm.forward_step(f, e[m], r[m])
    one = time.process_time() - began
    assert min(_took(lambda: hmm.sample_paths(e, r, rng)) for _ in range(3)) < one


def _took(f):
    import time

    began = time.process_time()
    f()
    return time.process_time() - began


def test_named_haplotypes_are_counted_without_lists(monkeypatch):
    rng = np.random.default_rng(1)
    for _ in range(20):
        m, ref, n, near = (int(rng.integers(a, b)) for a, b in ((1, 60), (2, 40), (1, 20), (1, 15)))
        a, asked = rng.integers(0, 2, (m, ref + n)), set(rng.choice(m, max(1, m // 2), False).tolist())
        lists = states.neighbours_at(a, asked, list(range(ref, ref + n)), near, ref)
        want = [states.one_set([x[h] for x in lists.values()], ref // 2, ref, h) for h in range(ref, ref + n)]
        found = states.named_counts(a, asked, near, ref)
        assert all((states.most_named(c, ref // 2, ref + j) == w).all() for j, (c, w) in enumerate(zip(found, want)))


def test_imputing_a_long_window_is_bounded():
    """Lists of names for each of 6,000 clusters took more than 20 MB; the results of 6,000 markers are 2 MB."""
    import tracemalloc

    rng = np.random.default_rng(2)
    panel, t = rng.integers(0, 2, (6000, 40)).astype(np.uint8), rng.integers(0, 2, (6000, 20)).astype(np.uint8)
    from loomgene.plans.impute import chosen_states

    tracemalloc.start()
    chosen_states(panel, t, np.arange(6000), 24, 12, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5e6


def test_greedy_turns_of_few_haplotypes(monkeypatch):
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, free = rng.integers(0, 2, (40, 12)), rng.random((40, 6)) < 0.5
        monkeypatch.setattr(pbwt, "FEW", 0)
        want = pbwt.rephase_greedily(a, free)
        monkeypatch.setattr(pbwt, "FEW", 12)
        assert (pbwt.rephase_greedily(a, free) == want).all()


def test_expected_counts_add_up_and_em_moves():
    rng = np.random.default_rng(5)
    states_ = rng.integers(0, 2, (30, 6))
    seen = states_[:, [2, 4]].copy()
    seen[5, 0] = 255
    e = hmm.match_emissions(seen, states_[:, None, :], 0.05)
    hit = np.where((seen == 255)[..., None], np.nan, (states_[:, None, :] == seen[..., None]).astype(float))
    r, dist = np.full(30, 0.05), np.full(30, 0.01)
    both = hmm.expected_counts(hit, e, r, dist)
    parts = [hmm.expected_counts(hit[:, [i]], e[:, [i]], r, dist) for i in (0, 1)]
    for k, v in both.items():
        assert v == pytest.approx(sum(p[k] for p in parts))
    assert both["match"] + both["mismatch"] == pytest.approx(59)
    err, rho = hmm.em_update(both, 1e-6, 5.0)
    assert err == pytest.approx(both["mismatch"] / 59) and 0 < rho < 5
    assert hmm.em_update({"match": 1, "mismatch": 0, "switches": 0, "dist": 1}, 0.01, 3.0) == (0.01, 3.0)


def test_cluster_emissions_take_the_worst():
    states_ = np.array([[0, 1], [0, 1], [0, 0]])
    e = hmm.cluster_log_emissions(np.array([[0], [0], [255]]), states_, np.array([0, 2]), 0.1)
    assert np.allclose(e[0, 0], [2 * np.log(0.9), 2 * np.log(0.9) + np.log(0.1) - np.log(0.9)]) and np.allclose(e[1], 0)


def test_mosaic():
    m = states.Mosaic(2)
    for hap, at in ((5, 0), (6, 2), (5, 4), (7, 10), (6, 20)):
        m.see(hap, at)
    assert m.intervals() == [(0, 5, 12), (0, 6, None), (1, 6, 6), (1, 7, None)]
    panel = np.arange(30)[:, None] * 100 + np.arange(8)
    a = m.alleles(panel)
    assert a[11, 0] == 1105 and a[12, 0] == 1206 and a[5, 1] == 506 and a[6, 1] == 607


def test_one_state_set():
    assert states.one_set([[1, 2], [2, 9]], 3, 10).tolist() == [1, 2, 9] and states.one_set([], 20, 4).tolist() == [0, 1, 2, 3]
    groups = states.prefix_classes(np.array([[0, 0, 0, 1, 1, 1], [0, 0, 0, 0, 1, 1]]), np.array([0, 1]), 3)
    assert groups[0] == [[0, 1, 2], [3, 4, 5]] and sorted(map(len, groups[1])) == [6]


def two_groups(m, h):
    p = np.zeros((m, h), np.int64)
    p[:, h // 2 :] = 1
    return p


def typed(t):
    return (t != 255).any(1)


@pytest.mark.parametrize("k", [50, 1600])
def test_slam_dunk(k):
    t = np.zeros((50, 2), np.int64)
    t[1::2] = 255
    p = impute_window(two_groups(50, 100), np.arange(50) * 0.001, t, typed(t), 1e5, 1e-3, k, 0.005)[0][0]
    assert p[1::2].sum(1).max() < 0.1 and (p[0::2] == 0).all()


def test_recombination_and_population_structure():
    t = np.repeat(np.where(np.arange(50) < 20, 0, 1)[:, None], 2, 1)
    t[[15, 25]] = 255
    p = impute_window(two_groups(50, 100), np.arange(50) * 0.1, t, typed(t), 1e4, 1e-3, 100, 0.005)[0][0]
    assert p[15].sum() < 0.1 and p[25].sum() > 1.9
    t = np.repeat(np.where(np.arange(100) < 50, 0, 1)[:, None], 2, 1)
    t[[48, 52]] = 255
    p = impute_window(two_groups(100, 200), np.arange(100) * 0.1, t, typed(t), 1e4, 1e-3, 50, 0.005)[0][0]
    assert p[48].sum() < 0.1 and p[52].sum() > 1.9


def test_array_density_is_recovered():
    panel = np.array([[1 if (7 * m + 13 * (h % 8)) % 10 < 4 else 0 for h in range(40)] for m in range(100)])
    truth = panel[:, [3, 12, 21, 30, 5, 14]]
    t = truth.copy()
    t[np.arange(100) % 5 != 0] = 255
    p = impute_window(panel, np.arange(100) * 0.001, t, typed(t), 1e4, 1e-3, 40, 0.0)[0][0]
    rest = np.arange(100) % 5 != 0
    ds, want = p[rest].reshape(80, 3, 2).sum(2).ravel(), truth[rest].reshape(80, 3, 2).sum(2).ravel()
    assert np.corrcoef(ds, want)[0, 1] ** 2 > 0.5


def test_no_typed_marker_gives_panel_frequency():
    t = np.full((4, 2), 255)
    panel = np.array([[0, 1], [1, 1], [0, 0], [255, 1]])
    assert impute_window(panel, np.arange(4.0), t, typed(t), 1e4, 0.01, 10, 0.1)[0][0].tolist() == [[0.5, 0.5], [1, 1], [0, 0], [1, 1]]


def test_bridge_between_anchors():
    prob = np.array([[[0.9, 0.1]], [[0.9, 0.1]]])
    p = bridged(prob, np.array([0.0, 1.0]), np.array([0.0, 0.5, 1.0, 9.0]), np.array([[0, 1]] * 4), 1.0)
    assert p[0, 0] == pytest.approx(0.1) and p[2, 0] == pytest.approx(0.1) and p[1, 0] < 0.25 and p[3, 0] == pytest.approx(0.5, abs=0.01)


def test_genotype_emission():
    a = np.array([[[0, 1]]])
    e = genotype_emissions(np.array([[0]]), np.array([[1]]), np.array([[0]]), a, 0.01)
    assert e[0, 0, 1] > 0.97 and e[0, 0, 0] < 0.03
    assert (genotype_emissions(np.array([[255]]), np.array([[255]]), np.array([[0]]), a, 0.01) == 1).all()


def switches(h, truth, het):
    o = (h == truth)[het]
    return int((o[1:] != o[:-1]).sum())


def test_perfect_linkage_has_no_switch():
    a1, a2 = np.zeros((10, 21), np.int64), np.zeros((10, 21), np.int64)
    a1[:, 10:20] = a2[:, 10:20] = 1
    a2[:, 20] = 1
    h1, h2 = phase_window(a1, a2, np.arange(10) * 0.1, ne=1e4)
    assert switches(h1[:, 20], np.zeros(10, np.int64), np.ones(10, bool)) == 0
    assert (h1[:, 20] + h2[:, 20] == 1).all()


def test_torture_with_panel():
    a1, a2 = np.zeros((50, 1), np.int64), np.ones((50, 1), np.int64)
    h1, _ = phase_window(a1, a2, np.arange(50) * 0.1, panel=two_groups(50, 200), k=50, ne=1e4)
    assert switches(h1[:, 0], np.zeros(50, np.int64), np.ones(50, bool)) < 5


def mosaic(n, m, founders, rng):
    f = rng.integers(0, 2, (m, founders))
    out = np.empty((m, n), np.int64)
    for h in range(n):
        at = rng.integers(founders, size=m)
        keep = rng.random(m) > 0.01
        for i in range(1, m):
            at[i] = at[i - 1] if keep[i] else at[i]
        out[:, h] = f[np.arange(m), at]
    return out


@pytest.mark.parametrize("dynamic", [False, True])
def test_phasing_keeps_genotypes_fills_gaps_and_repeats(dynamic):
    haps = mosaic(24, 80, 4, np.random.default_rng(6))
    t1, t2 = haps[:, 0::2], haps[:, 1::2]
    a1, a2 = np.minimum(t1, t2), np.maximum(t1, t2)
    gap = np.random.default_rng(7).random(a1.shape) < 0.05
    g1, g2 = np.where(gap, 255, a1), np.where(gap, 255, a2)
    fixed = np.zeros(a1.shape, bool)
    fixed[:, 0] = True
    options = dict(burnin=2, iterations=3, ne=1e4, dynamic=dynamic, seed=9)
    h1, h2 = phase_window(g1, g2, np.arange(80) * 0.01, fixed=fixed, **options)
    known = ~gap
    assert (np.minimum(h1, h2)[known] == a1[known]).all() and (np.maximum(h1, h2)[known] == a2[known]).all()
    assert ((h1 != 255) & (h2 != 255)).all() and (h1[known[:, 0], 0] == g1[known[:, 0], 0]).all()
    again = phase_window(g1, g2, np.arange(80) * 0.01, fixed=fixed, **options)
    assert (again[0] == h1).all() and (again[1] == h2).all()


def test_phasing_beats_chance():
    haps = mosaic(60, 200, 5, np.random.default_rng(8))
    t1, t2 = haps[:, 0::2], haps[:, 1::2]
    a1, a2 = np.minimum(t1, t2), np.maximum(t1, t2)
    h1, _ = phase_window(a1, a2, np.arange(200) * 0.01, panel=mosaic(60, 200, 5, np.random.default_rng(8)), burnin=3, iterations=4, ne=1e4)
    het = a1 != a2
    wrong = sum(switches(h1[:, s], t1[:, s], het[:, s]) for s in range(30))
    assert wrong / (het.sum() - 30) < 0.1


def rare_case():
    """Six samples that copy two haplotypes each of a panel of 500; markers at which one panel haplotype, the one copied, has the rare allele."""
    rng = np.random.default_rng(12)
    panel = rng.integers(0, 2, (160, 500))
    t1, t2 = panel[:, 440:446].copy(), panel[:, 460:466].copy()
    rare = np.arange(5, 160, 8)
    for a in (panel, t1, t2):
        a[rare] = 0
    return panel, t1, t2, rare


def test_rare_alleles_follow_carriers_beyond_the_states():
    panel, t1, t2, rare = rare_case()
    panel[rare, 440] = t1[rare, 0] = 1
    h1, h2 = phase_window(np.minimum(t1, t2), np.maximum(t1, t2), np.arange(160) * 0.01, panel=panel, k=40, rare=0.12, burnin=2, iterations=3, ne=1e4)
    near = (h1[rare - 1, 0] == t1[rare - 1, 0]) & (h2[rare - 1, 0] == t2[rare - 1, 0])
    het = t1[rare - 1, 0] != t2[rare - 1, 0]
    assert het.sum() > 5 and (h1[rare, 0] + h2[rare, 0] == 1).all()
    assert ((h1[rare, 0] == 1) == near)[het].all()


def test_rare_missing_calls_follow_the_states():
    panel, t1, t2, rare = rare_case()
    panel[rare, 440] = t1[rare, 0] = 1
    a1, a2 = np.minimum(t1, t2), np.maximum(t1, t2)
    a1[rare[::2]] = a2[rare[::2]] = 255
    h1, h2 = phase_window(a1, a2, np.arange(160) * 0.01, panel=panel, k=40, rare=0.12, burnin=2, iterations=3, ne=1e4)
    assert (h1 + h2)[rare].tolist() == (t1 + t2)[rare].tolist()


def test_a_singleton_goes_to_the_shorter_match():
    panel, t1, t2, rare = rare_case()
    t2[:, 0] = np.where(np.arange(160) // 10 % 2, panel[:, 300], panel[:, 301])
    t2[rare, 0] = 1
    fixed = np.ones(t1.shape, bool)
    fixed[rare] = False
    h1, h2 = phase_window(t1, t2, np.arange(160) * 0.01, panel=panel, fixed=fixed, k=40, rare=0.12, burnin=1, iterations=1, ne=1e4)
    assert (h2[rare, 0] == 1).all() and (h1[rare, 0] == 0).all()


def test_rare_markers_lie_between_two_anchors():
    before, after = np.array([0.9, 0.1]), np.array([0.1, 0.9])
    assert np.allclose(bridge(before, after, 0.5, 0.5, 0.1), 0.5) and bridge(before, after, 0.9, 0.1, 5.0)[1] > 0.5 > bridge(before, after, 0.1, 0.9, 5.0)[1]
    assert bridge(before, after, 0, 1, 1.0) is before and bridge(before, after, 1, 0, 1.0) is after


def test_empty_and_lone():
    none = np.empty((0, 0), np.int64)
    assert phase_window(none, none, np.empty(0))[0].shape == (0, 0)
    h1, h2 = phase_window(np.array([[0], [255]]), np.array([[1], [255]]), np.array([0.0, 1.0]))
    assert h1[0, 0] + h2[0, 0] == 1 and h1[1, 0] in (0, 1)


def test_matches_with_an_allele_and_greedy_turns():
    founders = np.array([[0, 1], [1, 0], [0, 1], [1, 0], [1, 0]])
    haps = founders[:, [0, 0, 1, 1, 0, 1]]
    order, start = np.arange(6), np.zeros(6, np.int64)
    for m in range(4):
        order, start = pbwt.step(order, start, haps[m], m)
    rank = int(np.flatnonzero(order == 4)[0])
    assert pbwt.match_with_allele(order, start, 4, rank, 1, haps[4]) == 4 and pbwt.match_with_allele(order, start, 4, rank, 0, haps[4]) == 0
    turned = haps.copy()
    turned[2:, 4], turned[2:, 5] = haps[2:, 5], haps[2:, 4]
    free = np.zeros((5, 3), bool)
    free[:, 2] = True
    fixed = pbwt.rephase_greedily(turned, free)
    assert (fixed == haps).all()
    assert pbwt.combined_neighbours([8, 9, 2], [2, 6], [7, 3], 1, 4) == [8, 9, 6, 7]


def test_several_alternatives():
    panel = np.zeros((30, 30), np.int64)
    panel[:, 10:20], panel[:, 20:] = 1, 2
    t = np.full((30, 3), 255)
    t[::3] = [0, 1, 2]
    p = impute_window(panel, np.arange(30) * 0.001, t, typed(t), 1e3, 1e-3, 100, 0.0, alts=2)[0]
    assert p.shape == (2, 30, 3) and np.allclose(p[:, :28].transpose(1, 2, 0), [[0, 0], [1, 0], [0, 1]], atol=0.05)


def test_the_partner_rules_alleles_out():
    """The first haplotype's alleles leave the others of each genotype for the second; doubtful calls weigh less."""
    panel = two_groups(30, 40)
    t = np.full((30, 2), 255)
    t[::3] = [0, 1]
    t[15, 0], t[15, 1] = 1, 0  # turned by mistake: the first haplotype's neighbours say 0, so 1 is left for the second
    p, model = impute_window(panel, np.arange(30) * 0.001, t, typed(t), 1e3, 1e-3, 100, 0.0, lock=True)
    assert (model[0][:, 0] < 0.2).all() and (model[0][:, 1] > 0.8).all() and p[0][15].tolist() == [1, 0]
    e = hmm.match_emissions(np.array([[0]]), np.array([[0, 1, 255]]), 0.01, np.array([[0.5]]))
    assert np.allclose(e, [[[0.745, 0.255, 1.0]]])
    sure = hmm.cluster_log_emissions(np.array([[0], [0]]), np.array([[0, 1], [0, 0]]), np.array([0]), 0.01, np.array([[1.0], [0.0]]))
    assert np.allclose(np.exp(sure - sure.max()), [[[1.0, 0.01 / 0.99]]])
