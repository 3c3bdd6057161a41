"""Least squares from distributed moment sums.

A first aggregate gives the means of all variables, which are then subtracted: sums of products
of centred values keep their digits however far the values lie from 0. Each absorbed group
contributes its sums of products, with partial aggregation. Within-group moments follow from
those sums, so no group mean is joined back to the rows and a dominant group is no problem. Only k x k matrices reach the
driver, k being the number of regressors.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .cells import Z_95
from .reshape import stack

_FIT_SCHEMA = (
    "model string, outcome string, term string, estimate double, se double, t double, n long, r2 double"
)
# Two-sided normal cut-offs for the .05, .01 and .001 levels.
STAR_CUTS = [(3.290527, "***"), (2.575829, "**"), (1.959964, "*")]


@dataclass(frozen=True)
class Spec:
    """A linear model. ``absorb`` names the fixed effect, ``weight`` makes it weighted.

    ``vcov`` is ``"cluster"`` (by the fixed effect) or ``"iid"``. For clustered errors the
    fixed effect is nested in the clusters, so it costs no degrees of freedom beyond one.
    """

    outcome: str
    regressors: Sequence[str]
    absorb: str | None = None
    weight: str | None = None
    vcov: str = "cluster"
    name: str = ""


def period_dummies(df: DataFrame, column: str, levels: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """0/1 columns for all levels but the first."""
    names = {f"{column}{level}": level for level in levels[1:]}
    return (
        df.withColumns({n: (F.col(column) == v).cast("double") for n, v in names.items()}),
        list(names),
    )


def _used(df: DataFrame, spec: Spec) -> DataFrame:
    """Rows with all of the model's variables known: ``grp``, ``w`` and ``v0`` (outcome), ``v1``, ..."""
    variables = [spec.outcome, *spec.regressors]
    needed = [*variables, *[c for c in (spec.absorb, spec.weight) if c]]
    v = [F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(variables)]
    w = (F.col(spec.weight).cast("double") if spec.weight else F.lit(1.0)).alias("w")
    group = (F.col(spec.absorb) if spec.absorb else F.lit(0)).alias("grp")
    return df.dropna(subset=needed).select(group, w, *v)


def _moments(x: DataFrame, means: Sequence[float]) -> DataFrame:
    """Sums per absorbed group: rows, weight, centred variables and products of these."""
    m = len(means)
    x = x.withColumns({f"v{i}": F.col(f"v{i}") - F.lit(mean) for i, mean in enumerate(means)})
    return x.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("w").alias("sw"),
        *[F.sum(F.col("w") * F.col(f"v{i}")).alias(f"s{i}") for i in range(m)],
        *[
            F.sum(F.col("w") * F.col(f"v{i}") * F.col(f"v{j}")).alias(f"p{i}_{j}")
            for i in range(m)
            for j in range(i, m)
        ],
    )


def _within(i: int, j: int) -> Column:
    i, j = min(i, j), max(i, j)
    return F.col(f"p{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("sw")


def _independent(gram: np.ndarray) -> list[int]:
    """Regressors that are not linear combinations of earlier ones."""
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    unit = gram / np.outer(scale, scale)
    keep: list[int] = []
    for j in range(len(gram)):
        trial = [*keep, j]
        if np.linalg.matrix_rank(unit[np.ix_(trial, trial)], tol=1e-9, hermitian=True) == len(trial):
            keep = trial
    return keep


def fit(df: DataFrame, spec: Spec) -> DataFrame:
    """Long coefficient table: model, term, estimate, se, t, n, within r2.

    A regressor that depends on earlier ones (one that is constant within the groups among
    them) gets a NULL estimate. Where no degrees of freedom are left, or with one cluster, errors
    and t are NULL; r2 is NULL if the outcome does not vary. Without ``absorb`` there is one
    group, so its mean is the intercept; the intercept row is then part of the table.
    """
    x = _used(df, spec)
    k = len(spec.regressors)
    first = x.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"v{i}").alias(f"v{i}") for i in range(k + 1)]).first()
    if not first["n"]:
        return df.sparkSession.createDataFrame([], _FIT_SCHEMA)
    centre = [first[f"v{i}"] for i in range(k + 1)]
    by_group = settle(_moments(x, centre))
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    row = by_group.agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("g"),
        *[F.sum(_within(i, j)).alias(f"c{i}_{j}") for i, j in pairs],
        *[F.sum(f"p{i}_{i}").alias(f"t{i}") for i in range(k + 1)],
        *[F.sum(f"s{i}").alias(f"m{i}") for i in range(k + 1)],
        F.sum("sw").alias("sw"),
    ).first()
    gram = np.empty((k + 1, k + 1))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = row[f"c{i}_{j}"] if row[f"c{i}_{j}"] is not None else np.nan
    for i in range(k + 1):  # what is left of a variable that is constant within groups is rounding
        if gram[i, i] <= 1e-13 * row[f"t{i}"]:
            gram[i, :] = gram[:, i] = 0.0
    used = [0, *[j + 1 for j in _independent(gram[1:, 1:]) if gram[j + 1, j + 1] > 0]]
    gram = gram[np.ix_(used, used)]
    left_out = [t for j, t in enumerate(spec.regressors) if j + 1 not in used]
    pick, k = used[1:], len(used) - 1
    bread = np.linalg.inv(gram[1:, 1:])
    beta = bread @ gram[1:, 0]
    rss = max(gram[0, 0] - beta @ gram[1:, 0], 0.0)
    n, g = row["n"], row["g"]
    unknown = np.full((k, k), np.nan)

    if spec.absorb and spec.vcov == "cluster":
        cov = unknown
        if k and g > 1 and n > k + 1:
            scores = [
                _within(i, 0) - sum(float(b) * _within(i, j) for b, j in zip(beta, pick)) for i in pick
            ]
            meat_row = (
                by_group.select(*[s.alias(f"u{i}") for i, s in enumerate(scores)])
                .agg(
                    *[
                        F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"m{i}_{j}")
                        for i in range(k)
                        for j in range(i, k)
                    ]
                )
                .first()
            )
            meat = np.empty((k, k))
            for i in range(k):
                for j in range(i, k):
                    meat[i, j] = meat[j, i] = meat_row[f"m{i}_{j}"]
            cov = g / (g - 1) * (n - 1) / (n - k - 1) * bread @ meat @ bread
    else:
        cov = rss / (n - k - g) * bread if n > k + g else unknown
    se = np.sqrt(np.diag(cov))

    terms, est, err = [spec.regressors[j - 1] for j in pick], list(beta), list(se)
    if not spec.absorb:
        means = np.array([centre[i] + row[f"m{i}"] / row["sw"] for i in used])
        terms.insert(0, "(Intercept)")
        est.insert(0, means[0] - beta @ means[1:])
        free = n > k + 1
        err.insert(0, np.sqrt(rss / (n - k - 1) / row["sw"] + means[1:] @ cov @ means[1:]) if free else np.nan)
    r2 = float(1 - rss / gram[0, 0]) if gram[0, 0] > 0 else None
    name = spec.name or spec.outcome

    def known(value: float) -> float | None:
        return float(value) if np.isfinite(value) else None

    rows = [
        (name, spec.outcome, t, known(b), known(s), known(b / s) if s > 0 else None, int(n), r2)
        for t, b, s in zip(terms, est, err)
    ]
    rows += [(name, spec.outcome, t, None, None, None, int(n), r2) for t in left_out]
    return df.sparkSession.createDataFrame(rows, _FIT_SCHEMA)


def stars(t: Column) -> Column:
    out = F.when(t.isNull(), F.lit(""))
    for cut, mark in STAR_CUTS:
        out = out.when(F.abs(t) >= cut, F.lit(mark))
    return out.otherwise(F.lit(""))


def label_terms(fits: Sequence[DataFrame], labels: Mapping[str, str]) -> DataFrame:
    """Coefficient table of several models with readable terms and significance stars."""
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return stack(*fits).withColumns(
        {
            "term": F.coalesce(F.try_element_at(known, F.col("term")), F.col("term")),
            "stars": stars(F.col("t")),
        }
    )


def category_margins(
    df: DataFrame,
    outcomes: Sequence[str],
    cells: Sequence[str],
    base: Sequence[str],
    absorb: str,
    weight: str | None = None,
    z: float = Z_95,
) -> DataFrame:
    """Margins of ``outcome ~ category cells + absorbed effect``: cell effects at the average group.

    A cell's margin is its coefficient (the base cell's is 0) plus the mean over groups, with
    equal weights, of each group's own level; ``se``, ``lower`` and ``upper`` follow from errors
    clustered by group. Every outcome is a model of its own, over the rows where it is known. Rows are folded
    once to sums per (outcome, group, cell). The cells of a group, at most as many as there are
    category combinations, are one array, from which cross products are summed over groups. Only
    matrices of cells by cells reach the driver. A cell that depends on others has NULL results; with one
    group or no degrees of freedom the errors are NULL.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    used = df.dropna(subset=[*cells, absorb, *([weight] if weight else [])])
    centre = used.agg(*[F.avg(F.col(y).cast("double")).alias(y) for y in outcomes]).first()
    schema = ", ".join(
        ["outcome string", *[f"`{c}` string" for c in cells], "pred double, se double, lower double, upper double"]
    )
    known = [y for y in outcomes if centre[y] is not None]
    if not known:
        return df.sparkSession.createDataFrame([], schema)
    label = F.to_json(F.array(*[F.col(c).cast("string") for c in cells]))
    sums = used.groupBy(F.col(absorb).alias("grp"), label.alias("cell")).agg(
        *[F.count(y).alias(f"k_{y}") for y in known],
        *[F.sum(F.when(F.col(y).isNotNull(), w)).alias(f"n_{y}") for y in known],
        *[F.sum(w * (F.col(y) - F.lit(centre[y]))).alias(f"s_{y}") for y in known],
    )
    parts = F.array(
        *[
            F.struct(F.lit(y).alias("outcome"), F.col(f"k_{y}").alias("k"), F.col(f"n_{y}").alias("n"), F.col(f"s_{y}").alias("s"))
            for y in known
        ]
    )
    long = sums.select("grp", "cell", F.inline(parts)).filter((F.col("k") > 0) & (F.col("n") > 0))
    whole = lambda field: F.aggregate("own", F.lit(0.0), lambda a, x: a + x[field])
    groups = settle(
        long.groupBy("outcome", "grp")
        .agg(F.collect_list(F.struct("cell", "k", F.col("n").cast("double").alias("n"), "s")).alias("own"))
        .withColumns({"n_all": whole("n"), "s_all": whole("s")})
    )
    c = groups.select("outcome", "n_all", "s_all", "own", F.inline("own"))
    part = F.col("n") / F.col("n_all")
    single = c.groupBy("outcome", "cell").agg(
        F.sum("k").alias("k"),
        F.sum("n").alias("n"),
        F.sum(F.col("s") - part * F.col("s_all")).alias("r"),
        F.sum(part).alias("q"),
    )
    other = F.transform("own", lambda x: F.struct(x["cell"].alias("cell2"), x["n"].alias("n2")))
    products = (
        c.select("outcome", "cell", part.alias("part"), F.inline(other))
        .groupBy("outcome", "cell", "cell2")
        .agg(F.sum(F.col("part") * F.col("n2")).alias("p"))
    )
    size = groups.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("g"), F.avg(F.col("s_all") / F.col("n_all")).alias("level")
    )
    rows = {(r["outcome"], r["cell"]): r for r in single.collect()}
    cross = {(r["outcome"], r["cell"], r["cell2"]): r["p"] for r in products.collect()}
    sizes = {r["outcome"]: r for r in size.collect()}
    first = json.dumps([str(b) for b in base], separators=(",", ":"), ensure_ascii=False)
    solved = {}
    for y in known:
        names = sorted(cell for o, cell in rows if o == y and cell != first)
        gram = np.array(
            [[(rows[y, a]["n"] if a == b else 0.0) - cross.get((y, a, b), 0.0) for b in names] for a in names]
        ).reshape(len(names), len(names))
        keep = [j for j in _independent(gram) if gram[j, j] > 1e-13 * rows[y, names[j]]["n"]]
        names = [names[j] for j in keep]
        bread = np.linalg.inv(gram[np.ix_(keep, keep)])
        solved[y] = names, bread, bread @ np.array([rows[y, a]["r"] for a in names])

    # scores: residual sums of a group's cells, which add up to 0 over the group
    betas = {f"{y}|{a}": float(b) for y, (names, _, beta) in solved.items() for a, b in zip(names, beta)}
    table = F.create_map(*[F.lit(x) for pair in (betas or {"": 0.0}).items() for x in pair])
    beta_of = lambda cell: F.coalesce(F.try_element_at(table, F.concat("outcome", F.lit("|"), cell)), F.lit(0.0))
    fitted = groups.withColumn("own", F.transform("own", lambda x: F.struct(x["cell"].alias("cell"), x["n"].alias("n"), (x["s"] - beta_of(x["cell"]) * x["n"]).alias("e"))))
    level = F.aggregate("own", F.lit(0.0), lambda a, x: a + x["e"]) / F.col("n_all")
    scores = fitted.withColumn("level", level).withColumn("own", F.transform("own", lambda x: F.struct(x["cell"].alias("cell"), (x["e"] - F.col("level") * x["n"]).alias("u"))))
    second = F.transform("own", lambda x: F.struct(x["cell"].alias("cell2"), x["u"].alias("u2")))
    meat = {
        (r["outcome"], r["cell"], r["cell2"]): r["m"]
        for r in scores.select("outcome", "own", F.inline("own"))
        .select("outcome", "cell", "u", F.inline(second))
        .groupBy("outcome", "cell", "cell2")
        .agg(F.sum(F.col("u") * F.col("u2")).alias("m"))
        .collect()
    }
    out = []
    for y in known:
        names, bread, beta = solved[y]
        g, n = sizes[y]["g"], sum(r["k"] for (o, _), r in rows.items() if o == y)
        q = np.array([rows[y, a]["q"] for a in names]) / g
        middle = np.array([[meat.get((y, a, b), 0.0) for b in names] for a in names]).reshape(len(names), len(names))
        left = n - (len(names) + g)
        factor = g / (g - 1) * (n - 1) / left if g > 1 and left > 0 else None
        average = centre[y] + sizes[y]["level"] - float(q @ beta)
        for cell in sorted(cell for o, cell in rows if o == y):
            if cell != first and cell not in names:
                out.append((y, *json.loads(cell), None, None, None, None))
                continue
            at = -q + (np.array([float(a == cell) for a in names]))
            pred = average + (float(beta[names.index(cell)]) if cell in names else 0.0)
            se = None if factor is None else float(np.sqrt(max(factor * at @ bread @ middle @ bread @ at, 0.0)))
            bounds = (None, None) if se is None else (pred - z * se, pred + z * se)
            out.append((y, *json.loads(cell), pred, se, *bounds))
    return df.sparkSession.createDataFrame(out, schema)
