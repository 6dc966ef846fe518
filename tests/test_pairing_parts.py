"""The parts of the greedy pairing: upper bounds, and taking in order with bounds of tiles."""

import numpy as np
import pyarrow as pa

from storylens.operators import pairing as P


def _sides(seed, n, m, d=6):
    rng = np.random.default_rng(seed)
    cv, pv = rng.normal(size=(n, d)).round(1), rng.normal(size=(m, d)).round(1)
    pv[::7], cv[::11] = pv[0], 0.0  # copies, and similarities of 0 to all
    length = lambda v: np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    return cv / length(cv), pv / length(pv)


def _greedy(cv, pv, pidx):
    """The definition, with similarities that are sums in one order."""
    sims, out = np.stack([np.einsum("ij,j->i", pv, v) for v in cv]), []
    for row in sims:
        j = max(range(len(pidx)), key=lambda j: (row[j], pidx[j]))
        if row[j] == -np.inf:
            break
        out.append((int(pidx[j]), row[j]))
        sims[:, j] = -np.inf
    return out


def test_no_similarity_exceeds_its_bound():
    cv, pv = _sides(1, 40, 130)
    starts = np.array([0, 7, 8, 60, 129])
    bounds = P._upper_bounds(cv, pv * 3, starts, 16)
    best = np.maximum.reduceat(cv @ (pv * 3).T, starts, axis=1)
    assert bounds.shape == (40, 5) and (bounds >= best).all() and (bounds - best < 1e-4).all()


def test_taking_by_bounds_of_tiles_is_greedy():
    """Tiles in any order, groups of any size, more choosers than partners: the pairs of the definition."""
    for seed, (n, m) in enumerate([(60, 70), (30, 200), (50, 50), (80, 40)]):
        cv, pv = _sides(seed, n, m)
        pidx = np.random.default_rng(seed).permutation(m) * 3
        want = _greedy(cv, pv, pidx)
        tile = pidx % 4
        order = np.lexsort((-pidx, tile))
        starts = np.concatenate([np.flatnonzero(tile[order] == t)[::9] for t in range(4)])
        for block in (1, 16, 512):
            bounds = P._upper_bounds(cv, pv[order], starts, 8)
            got = P._greedy("d", np.arange(n), cv, pidx[order], pv[order], block, 8, 9, starts, bounds).to_pylist()
            assert [(r["pidx"], r["sim"]) for r in got] == want and [r["cidx"] for r in got] == list(range(len(want)))
            down = np.argsort(-pidx)
            alone = P._greedy("d", np.arange(n), cv, pidx[down], pv[down], block, 8, 9).to_pylist()
            assert alone == got


def test_few_groups_are_looked_into(monkeypatch):
    """The task that settles a dimension met every partner for every chooser."""
    rng = np.random.default_rng(3)
    cv, pv = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.normal(size=(2, 600, 64)))
    starts, looked = np.arange(0, 600, 10), []
    einsum = np.einsum
    bounds = P._upper_bounds(cv[:60], pv, starts, 64)
    monkeypatch.setattr(P.np, "einsum", lambda s, a, b: looked.append(len(a)) or einsum(s, a, b))
    P._take(cv[:60], pv, np.arange(600)[::-1], starts, bounds, np.ones(600, bool))
    assert sum(looked) < 60 * 600 / 10


def test_packed_vectors_come_back():
    vec = pa.array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0], [7.0, 8.0]])
    rb = pa.RecordBatch.from_arrays([pa.array([4, 1, 3, 2]), vec], ["cidx", "vec"]).slice(1, 3)
    t = pa.Table.from_batches([*P._packed([rb.slice(0, 2)]), *P._packed([rb.slice(2)])])
    idx, v = P._ordered(t, [("cidx", "ascending")], "cidx")
    assert idx.tolist() == [1, 2, 3] and v.tolist() == [[3.0, 4.0], [7.0, 8.0], [5.0, 6.0]]
