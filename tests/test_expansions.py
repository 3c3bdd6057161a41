"""Sums over whole groups without meeting all pairs, against NumPy over all pairs."""

import numpy as np
import pytest

from diurnal.catalog import ORACLES, QUERIES, measures
from diurnal.operators import expansions, kernels


def all_pairs(p, q, held, beta):
    return np.exp(-beta * np.sqrt(((p[:, None] - q[None]) ** 2).sum(2))) @ held


@pytest.mark.parametrize("beta, error", [(4.0, 1e-11), (0.3, 1e-9), (40.0, 1e-5)])
def test_most_pairs_never_meet(monkeypatch, beta, error):
    rng = np.random.default_rng(4)
    core, spot = 2 + rng.normal(0, 0.01, (9000, 2)), 1 + rng.normal(0, 1e-5, (6000, 2))
    q = np.r_[rng.uniform(0, 5, (12000, 2)), core, spot, np.full((900, 2), 3.3)]
    p = np.r_[q[::3], rng.uniform(4, 6, (500, 2))]
    held = rng.integers(0, 50, (len(q), 3)).astype(float)
    met, meet = [], expansions._meet
    monkeypatch.setattr(expansions, "_meet", lambda px, py, qx, *rest: (met.append(len(px) * len(qx)), meet(px, py, qx, *rest)))
    got = expansions.sums(*p.T, *q.T, held, beta, error)
    assert (np.abs(got[::20] - all_pairs(p[::20], q, held, beta)) <= error * held.sum(0)).all()
    assert sum(met) < len(p) * len(q) / 4


def test_pairs_that_meet_grow_with_the_places(monkeypatch):
    """Twice the places at twice the density meet about twice the pairs, not four times."""
    rng, found = np.random.default_rng(6), []
    for n in (10_000, 40_000):
        q, met, meet = rng.uniform(0, 5, (n, 2)), [], expansions._meet
        with monkeypatch.context() as m:
            m.setattr(expansions, "_meet", lambda px, py, qx, *rest: met.append(len(px) * len(qx)))
            expansions.sums(*q.T, *q.T, np.ones((n, 1)), 4.0, 1e-11)
        found.append(sum(met))
    assert found[1] < 6 * found[0]


def test_odd_sets():
    q, held = np.zeros((400, 2)), np.ones((400, 1))
    assert (expansions.sums(*q.T, *q.T, held, 4.0, 1e-11) == 400).all()  # all at one place
    assert expansions.sums(*q[:0].T, *q.T, held, 4.0, 1e-11).shape == (0, 1)
    assert (expansions.sums(*q.T, *q[:0].T, held[:0], 4.0, 1e-11) == 0).all()
    held[3] = np.nan
    assert np.isnan(expansions.sums(*q.T, *q.T, held, 4.0, 1e-11)).all()


def test_groups_of_many_parts(spark, monkeypatch, error=1e-8):
    """Cells far away stand at their nodes, also those of a group beyond one task; null groups and counts are kept."""
    for name, value in (("CROWD", 300), ("CROWD_AROUND", 900), ("TASK_ROWS", 500)):
        monkeypatch.setattr(kernels, name, value)
    stood, standing = [], kernels._standing
    monkeypatch.setattr(kernels, "_standing", lambda *a: stood.extend(a[-1]) or standing(*a))
    rng = np.random.default_rng(12)
    xy = np.r_[rng.uniform(0, 8, (3000, 2)), 2.7 + rng.normal(0, 0.05, (1500, 2)), np.full((40, 2), 6.1)]
    a, b = rng.integers(0, 50, (2, len(xy))).astype(float)
    rows = [(1, *map(float, xy[i]), float(a[i]), float(b[i])) for i in range(len(xy))]
    rows += [(None, 1.0, 1.0, None, 2.0), (None, 1.5, 1.0, None, 3.0)]
    df = spark.createDataFrame(rows, "m int, x double, y double, a double, b double").repartition(4)
    at = kernels.places(df, ["m"], "x", "y", {"a": "a", "b": "b"})
    found = kernels.sums_of_all(at, ["m"], ["a", "b"], 1.0, error).collect()
    got = {(r["m"], r["_x"], r["_y"]): (r["env_a"], r["env_b"]) for r in found}
    assert len(got) == len(found) == 4503 and stood
    want = all_pairs(xy, xy, np.c_[a, b], 1.0)
    env = np.array([got[1, *p] for p in xy.tolist()])
    assert (np.abs(env - want) <= error * np.array([a.sum(), b.sum()])).all()
    assert got[None, 1.0, 1.0] == (None, pytest.approx(2.0 + 3.0 * np.exp(-0.5)))


def test_spatial_theil_counts_all_areas_of_a_metro(spark, monkeypatch):
    """Areas beyond any radius are in one another's surroundings."""
    rng = np.random.default_rng(2)
    xy, c = np.r_[rng.uniform(0, 0.5, (20, 2)), rng.uniform(1.5, 2, (20, 2))], rng.integers(1, 30, (40, 5)).astype(float)
    groups = ("nha", "nhb", "h", "nhw", "nho")
    rows = [(1, "2000", i, *map(float, xy[i]), *map(float, c[i])) for i in range(40)]
    areas = spark.createDataFrame(rows, "metro_id int, year string, unit_id int, x double, y double, " + ", ".join(f"res_{g}_est double" for g in groups))
    monkeypatch.setattr(measures, "located", lambda *_: areas)
    found = QUERIES["msr_spatial_theil"](spark, "").first()["spat_multi_theil_nhood"]
    env = all_pairs(xy, xy, c[:, :4], measures.BETA)
    share, t = env / env.sum(1, keepdims=True), c[:, :4].sum(1)
    entropy = lambda p: -(p * np.log(p)).sum(-1)
    assert found == pytest.approx(1 - (t * entropy(share)).sum() / (t.sum() * entropy(c[:, :4].sum(0) / t.sum())), abs=1e-6)
    assert "where d <=" not in ORACLES["msr_spatial_theil"]
