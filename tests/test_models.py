"""Least squares against dense matrix formulas."""

import numpy as np
import pytest

from diurnal.operators import cells, regression
from diurnal.operators.regression import Spec


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 500
    g = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 12, n))
    x = rng.normal(size=(n, 3)) + g[:, None] * 0.1
    w = rng.uniform(0.5, 2, n)
    cat = rng.integers(0, 3, n)
    per = rng.integers(0, 2, n)
    y = x @ [1.0, -2.0, 0.5] + 0.3 * cat + 0.2 * per * cat + g * 0.2 + rng.normal(size=n)
    cl = rng.integers(0, 60, n)
    rows = [
        (int(g[i]), *map(float, x[i]), float(w[i]), f"c{cat[i]}", f"p{per[i]}", int(cl[i]), float(y[i])) for i in range(n)
    ]
    df = spark.createDataFrame(rows, "g int, x1 double, x2 double, x3 double, w double, cat string, per string, cl int, y double")
    return g, x, w, cat, per, cl, y, df.repartition(4)


def dense_cluster(X, y, cluster, w, k_dof):
    A = np.linalg.inv((X * w[:, None]).T @ X)
    b = A @ (X * w[:, None]).T @ y
    u = (y - X @ b) * w
    S = np.array([(X[cluster == c] * u[cluster == c][:, None]).sum(0) for c in np.unique(cluster)])
    G, n = len(S), len(y)
    V = A @ (S.T @ S) @ A * G / (G - 1) * (n - 1) / (n - k_dof)
    return b, np.sqrt(np.diag(V))


@pytest.mark.parametrize("weight", [None, "w"])
def test_absorbed_effect_equals_dummies(data, weight):
    g, x, w, _, _, _, y, df = data
    wt = w if weight else np.ones_like(w)
    D = (g[:, None] == np.unique(g)[None, :]).astype(float)
    b, se = dense_cluster(np.c_[x, D], y, g, wt, k_dof=4)
    got = {r["term"]: r for r in regression.fit(df, Spec("y", ["x1", "x2", "x3"], "g", weight)).collect()}
    assert [got[f"x{i}"]["estimate"] for i in (1, 2, 3)] == pytest.approx(b[:3])
    assert [got[f"x{i}"]["se"] for i in (1, 2, 3)] == pytest.approx(se[:3])


def test_plain_ols(data):
    _, x, _, _, _, _, y, df = data
    X = np.c_[np.ones(len(y)), x]
    A = np.linalg.inv(X.T @ X)
    b = A @ X.T @ y
    s2 = ((y - X @ b) ** 2).sum() / (len(y) - 4)
    got = regression.fit(df, Spec("y", ["x1", "x2", "x3"])).collect()
    assert [r["estimate"] for r in got] == pytest.approx(b)
    assert [r["se"] for r in got] == pytest.approx(np.sqrt(s2 * np.diag(A)))


def test_dependent_regressor_has_no_estimate(data):
    df = data[-1].selectExpr("*", "2 * x1 - x2 as x4")
    got = {r["term"]: r["estimate"] for r in regression.fit(df, Spec("y", ["x1", "x2", "x4"], "g")).collect()}
    assert got["x4"] is None and got["x1"] is not None


def test_empty_input(data):
    assert regression.fit(data[-1].filter("false"), Spec("y", ["x1"], "g")).collect() == []


def test_interaction_with_cluster_errors(data):
    _, _, _, cat, per, cl, y, df = data
    names = ["(Intercept)", "catc1", "catc2", "perp1", "catc1:perp1", "catc2:perp1"]
    one = np.ones(len(y))
    X = np.c_[one, cat == 1, cat == 2, per == 1, (cat == 1) & (per == 1), (cat == 2) & (per == 1)].astype(float)
    b, se = dense_cluster(X, y, cl, one, k_dof=6)
    got = {r["term"]: r for r in cells.interaction_cluster_se(df, ["y"], "cat", "per", "c0", "p0", "cl").collect()}
    assert [got[t]["estimate"] for t in names] == pytest.approx(b)
    assert [got[t]["se"] for t in names] == pytest.approx(se)


def test_margins(data):
    _, _, _, cat, per, cl, y, df = data
    cell = cat * 2 + per
    X = (cell[:, None] == np.arange(6)[None, :]).astype(float)
    b, se = dense_cluster(X, y, cl, np.ones(len(y)), k_dof=6)
    got = {(r["cat"], r["per"]): r for r in cells.margins(df, ["y"], ["cat", "per"], "cl").collect()}
    for c in range(3):
        for p in range(2):
            r = got[f"c{c}", f"p{p}"]
            assert (r["pred"], r["se"]) == pytest.approx((b[c * 2 + p], se[c * 2 + p]))
            assert r["upper"] - r["lower"] == pytest.approx(2 * 1.959964 * r["se"])


@pytest.mark.parametrize("weight", [None, "w"])
def test_category_margins_with_absorbed_effect(data, weight):
    g, _, w, cat, per, _, y, df = data
    wt = w if weight else np.ones_like(w)
    cell = cat * 2 + per
    D = (g[:, None] == np.unique(g)[None, :]).astype(float)
    C = (cell[:, None] == np.arange(1, 6)[None, :]).astype(float)
    X = np.c_[C, D]
    b = np.linalg.solve((X * wt[:, None]).T @ X, (X * wt[:, None]).T @ y)
    level = b[5:].mean()
    got = {
        (r["cat"], r["per"]): r["pred"]
        for r in regression.category_margins(df, ["y"], ["cat", "per"], ["c0", "p0"], "g", weight).collect()
    }
    assert got["c0", "p0"] == pytest.approx(level)
    for i in range(1, 6):
        assert got[f"c{i // 2}", f"p{i % 2}"] == pytest.approx(level + b[i - 1])


def test_category_predictions(data):
    _, _, _, cat, _, _, y, df = data
    got = {r["cat"]: r for r in cells.group_predictions(df, ["y"], ["cat"]).collect()}
    X = (cat[:, None] == np.arange(3)[None, :]).astype(float)
    m = X.T @ y / X.sum(0)
    s2 = ((y - X @ m) ** 2).sum() / (len(y) - 3)
    for c in range(3):
        assert (got[f"c{c}"]["pred"], got[f"c{c}"]["se"]) == pytest.approx((m[c], np.sqrt(s2 / X.sum(0)[c])))


def test_stars(spark):
    df = spark.createDataFrame([(-4.0,), (2.7,), (2.0,), (1.0,), (None,)], "t double")
    assert [r[0] for r in df.select(regression.stars(df.t)).collect()] == ["***", "**", "*", "", ""]


def test_shifted_variables_change_nothing(data):
    df = data[-1]
    for shift in (1e6, 1e8):
        moved = df.withColumns({"x1": df.x1 + shift, "y": df.y - 3 * shift})
        for absorb in ("g", None):
            spec = Spec("y", ["x1", "x2", "x3"], absorb)
            a = {r["term"]: r for r in regression.fit(df, spec).collect()}
            b = {r["term"]: r for r in regression.fit(moved, spec).collect()}
            for t in ("x1", "x2", "x3"):
                assert (b[t]["estimate"], b[t]["se"]) == pytest.approx((a[t]["estimate"], a[t]["se"]), rel=1e-6)


def test_nothing_to_estimate_is_null(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0), (1, 1.0, 4.0, 5.0), (2, 7.0, 1.0, 2.0), (2, 7.0, 5.0, 9.0)], "g int, c double, x double, y double")
    constant = regression.fit(df, Spec("y", ["c"], "g")).first()
    assert (constant["estimate"], constant["se"], constant["t"]) == (None, None, None)
    one = regression.fit(df.filter("g = 1"), Spec("y", ["x"], "g")).first()
    assert one["estimate"] == pytest.approx(1.0) and one["se"] is None
    exact = regression.fit(df.filter("g = 1"), Spec("y", ["x"])).collect()
    assert [r["se"] for r in exact] == [None, None] and [r["t"] for r in exact] == [None, None]


def test_unknown_outcomes_do_not_touch_other_models(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 1.0), ("a", 2, 3.0, None), ("a", 3, 8.0, 2.0), ("b", 1, 2.0, 5.0), ("b", 4, 4.0, 7.0)], "c string, u int, y1 double, y2 double")
    got = {(r["outcome"], r["c"]): (r["n"], r["pred"]) for r in cells.margins(df, ["y1", "y2"], ["c"], "u").collect()}
    assert got == {("y1", "a"): (3, 4.0), ("y2", "a"): (2, 1.5), ("y1", "b"): (2, 3.0), ("y2", "b"): (2, 6.0)}
    means = {(r["outcome"], r["c"]): r["mean"] for r in cells.cell_means(df, ["y1", "y2"], ["c"]).collect()}
    assert means == {("y1", "a"): 4.0, ("y2", "a"): 1.5, ("y1", "b"): 3.0, ("y2", "b"): 6.0}


@pytest.mark.parametrize("weight", [None, "w"])
def test_margins_with_group_effects_and_their_errors(data, weight):
    g, _, w, cat, per, _, y, df = data
    known = np.arange(len(y)) % 9 != 0
    rows = df.withColumn("z", df.y)
    got = {}
    for r in regression.category_margins(rows, ["y", "z"], ["cat", "per"], ["c0", "p0"], "g", weight).collect():
        got[r["outcome"], r["cat"], r["per"]] = r
    wt = w if weight else np.ones_like(w)
    names = sorted({(a, b) for a, b in zip(cat, per)})
    C = np.array([[(a, b) == n for n in names[1:]] for a, b in zip(cat, per)], float)
    groups = np.unique(g)
    X = np.c_[C, (g[:, None] == groups[None, :]).astype(float)]
    A = np.linalg.inv((X * wt[:, None]).T @ X)
    b = A @ (X * wt[:, None]).T @ y
    u = (y - X @ b) * wt
    S = np.array([(X[g == k] * u[g == k][:, None]).sum(0) for k in groups])
    G, n, K = len(groups), len(y), X.shape[1]
    V = A @ (S.T @ S) @ A * G / (G - 1) * (n - 1) / (n - K)
    assert known.any()
    for i, (a, p) in enumerate(names):
        at = np.r_[[float(j == i - 1) for j in range(len(names) - 1)], np.full(G, 1 / G)]
        r = got["y", f"c{a}", f"p{p}"]
        se = np.sqrt(at @ V @ at)
        assert (r["pred"], r["se"]) == pytest.approx((at @ b, se))
        assert (r["lower"], r["upper"]) == pytest.approx((at @ b - 1.959964 * se, at @ b + 1.959964 * se))


def test_full_panel_model_equals_numpy(spark, sf):
    from diurnal.catalog import models

    panel, dummies = models._small_panel(spark, sf)
    x = [*dummies, "avg_div_nhood", "multi_theil_nhood", *models._PANEL_X]
    p = panel.dropna(subset=["avg_div_whood", "metro_id", *x]).toPandas()
    centred = lambda c: (p[c].astype(float) - p.groupby("metro_id")[c].transform("mean")).to_numpy()
    got = {r["term"]: r for r in regression.fit(panel, Spec("avg_div_whood", x, "metro_id")).collect()}
    used = [t for t in x if got[t]["estimate"] is not None]
    assert set(x) - set(used) <= {"met_shr_for_born"}  # a sum of two other shares in the fixture
    b = np.linalg.lstsq(np.column_stack([centred(t) for t in used]), centred("avg_div_whood"), rcond=None)[0]
    assert [got[t]["estimate"] for t in used] == pytest.approx(b, rel=1e-4, abs=1e-7)
