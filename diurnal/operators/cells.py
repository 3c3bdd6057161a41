"""Linear models whose regressors are categories: all results are contrasts of cell means."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .joins import attach, natural_join

Z_95 = 1.959964  # fixed value: two-sided 95% normal quantile


def _long(df: DataFrame, ids: Sequence[str], outcomes: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Wide aggregates to one row per outcome; ``outcomes`` maps a label to {name: column}."""
    rows = F.array(
        *[
            F.struct(
                F.lit(label).alias("outcome"), *[F.col(c).alias(n) for n, c in columns.items()]
            )
            for label, columns in outcomes.items()
        ]
    )
    return df.select(*ids, F.inline(rows))


def cluster_cells(
    df: DataFrame, outcomes: Sequence[str], cells: Sequence[str], cluster: str
) -> DataFrame:
    """Row count and sum of each outcome per (outcome, cluster, cell).

    This is the only shuffle of the full table: all outcomes are summed side by side and
    turned into rows afterwards. Each outcome is a model of its own: rows count where that
    outcome and all cell columns are known.
    """
    used = df.dropna(subset=list(cells))
    sums = used.groupBy(cluster, *cells).agg(
        *[F.count(c).alias(f"_n_{c}") for c in outcomes], *[F.sum(c).alias(f"_s_{c}") for c in outcomes]
    )
    long = _long(sums, [cluster, *cells], {c: {"n": f"_n_{c}", "s": f"_s_{c}"} for c in outcomes})
    return long.filter(F.col("n") > 0)


def _model_size(by_cluster: DataFrame, cells: Sequence[str], cluster: str) -> DataFrame:
    """Per outcome: rows, cells and clusters, and the small-sample factor of the sandwich."""
    return (
        by_cluster.groupBy("outcome")
        .agg(
            F.sum("n").alias("n_obs"),
            F.count_distinct(F.struct(*cells)).alias("k"),
            F.count_distinct(cluster).alias("g"),
        )
        .withColumn(
            "factor",
            F.try_divide(F.col("g"), F.col("g") - 1)
            * F.try_divide(F.col("n_obs") - 1, F.col("n_obs") - F.col("k")),
        )
    )


def margins(
    df: DataFrame, outcomes: Sequence[str], cells: Sequence[str], cluster: str, z: float = Z_95
) -> DataFrame:
    """Predicted outcome per cell with a cluster-robust standard error and interval.

    The (few) cell means are attached to the rows per cluster and cell, so that the squares are those of
    residual sums; an expansion into sums of squares would lose digits.
    """
    by_cluster = settle(cluster_cells(df, outcomes, cells, cluster))
    means = by_cluster.groupBy("outcome", *cells).agg(
        F.sum("n").alias("n_cell"), (F.sum("s") / F.sum("n")).alias("pred")
    )
    residual = F.col("s") - F.col("n") * F.col("pred")
    stats = (
        attach(by_cluster, means, ["outcome", *cells], [cluster], "inner")
        .groupBy("outcome", *cells)
        .agg(
            F.max("n_cell").alias("n"),
            F.max("pred").alias("pred"),
            F.sum(residual * residual).alias("meat"),
        )
    )
    se = F.sqrt(F.col("factor") * F.col("meat")) / F.col("n")
    size = _model_size(by_cluster, cells, cluster).select("outcome", "factor")
    return (
        natural_join(stats, size, "left", ["outcome"])
        .select("outcome", *cells, F.col("n"), F.col("pred"), se.alias("se"))
        .withColumns({"lower": F.col("pred") - z * F.col("se"), "upper": F.col("pred") + z * F.col("se")})
    )


def cell_means(df: DataFrame, outcomes: Sequence[str], cells: Sequence[str]) -> DataFrame:
    """Mean of each outcome per cell, all outcomes in one aggregation.

    An outcome's mean is over the rows where it is known; a cell without any is left out.
    """
    means = df.dropna(subset=list(cells)).groupBy(*cells).agg(
        *[F.count(c).alias(f"_n_{c}") for c in outcomes], *[F.avg(c).alias(f"_m_{c}") for c in outcomes]
    )
    long = _long(means, cells, {c: {"n": f"_n_{c}", "mean": f"_m_{c}"} for c in outcomes})
    return long.filter(F.col("n") > 0)


def _term(a: str, b: str, base_a: str, base_b: str) -> Column:
    first = F.concat(F.lit(a), F.col(a))
    second = F.concat(F.lit(b), F.col(b))
    return (
        F.when((F.col(a) == base_a) & (F.col(b) == base_b), F.lit("(Intercept)"))
        .when(F.col(b) == base_b, first)
        .when(F.col(a) == base_a, second)
        .otherwise(F.concat(first, F.lit(":"), second))
    )


def _contrasts(means: DataFrame, a: str, b: str, base_a: str, base_b: str) -> DataFrame:
    """Treatment-coded coefficients from cell means (outcome, a, b, mean).

    The windows run over cell means: one row per combination of two category labels.
    """
    m = F.col("mean")
    base = lambda column, level: F.col(column) == level

    def pick(condition: Column, *by: str) -> Column:
        return F.max(F.when(condition, m)).over(Window.partitionBy("outcome", *by))

    at_base = pick(base(a, base_a) & base(b, base_b))
    same_a = pick(base(b, base_b), a)
    same_b = pick(base(a, base_a), b)
    coefficient = (
        F.when(base(a, base_a) & base(b, base_b), m)
        .when(base(a, base_a) | base(b, base_b), m - at_base)
        .otherwise(m - same_a - same_b + at_base)
    )
    return means.select(
        "outcome", _term(a, b, base_a, base_b).alias("term"), coefficient.alias("estimate")
    )


def interaction_coefficients(
    df: DataFrame, outcomes: Sequence[str], a: str, b: str, base_a: str, base_b: str
) -> DataFrame:
    """Coefficients of ``outcome ~ a * b`` with treatment coding, per outcome and term."""
    return _contrasts(cell_means(df, outcomes, [a, b]), a, b, base_a, base_b)


def interaction_cluster_se(
    df: DataFrame, outcomes: Sequence[str], a: str, b: str, base_a: str, base_b: str, cluster: str
) -> DataFrame:
    """Coefficients of ``outcome ~ a * b`` with cluster-robust standard errors.

    Every cell takes part in its own coefficient and, if it is a base cell, in those that are
    contrasted with it. A cluster's score for a coefficient is the signed sum of its residual
    sums over the cells taking part.
    """
    by_cluster = settle(cluster_cells(df, outcomes, [a, b], cluster))
    cells = settle(
        by_cluster.groupBy("outcome", a, b).agg(F.sum("n").alias("n_cell"), F.sum("s").alias("s_cell"))
    )
    labels = cells.select(F.col(a).alias("_a"), F.col(b).alias("_b")).distinct()
    base_row_a, base_row_b = F.col(a) == base_a, F.col(b) == base_b
    takes_part = (base_row_a | (F.col(a) == F.col("_a"))) & (base_row_b | (F.col(b) == F.col("_b")))
    sign = F.when(base_row_a & (F.col("_a") != base_a), -1).otherwise(1) * F.when(
        base_row_b & (F.col("_b") != base_b), -1
    ).otherwise(1)
    targets = labels.agg(F.collect_set(F.struct("_a", "_b")).alias("targets"))
    contrasts = (
        cells.select(a, b)
        .distinct()
        .withColumn("targets", targets.scalar())
        .select(a, b, F.inline("targets"))
        .filter(takes_part)
        .select(a, b, "_a", "_b", sign.alias("sign"))
    )
    term_of = _term(a, b, base_a, base_b)
    score = F.col("sign") * (F.col("s") - F.col("n") * F.col("s_cell") / F.col("n_cell")) / F.col("n_cell")
    residuals = attach(by_cluster, cells, ["outcome", a, b], [cluster])
    scores = attach(residuals, contrasts, [a, b], [cluster], "inner").select(
        "outcome", F.col("_a").alias(a), F.col("_b").alias(b), cluster, score.alias("score")
    )
    meat = (
        scores.groupBy("outcome", a, b, cluster)
        .agg(F.sum("score").alias("score"))
        .groupBy("outcome", term_of.alias("term"))
        .agg(F.sum(F.col("score") * F.col("score")).alias("meat"))
    )
    size = _model_size(by_cluster, [a, b], cluster).select("outcome", "factor")
    means = cells.withColumn("mean", F.col("s_cell") / F.col("n_cell"))
    estimates = _contrasts(means, a, b, base_a, base_b)
    return natural_join(
        natural_join(estimates, meat, "left", ["outcome", "term"]), size, "left", ["outcome"]
    ).select(
        "outcome",
        "term",
        "estimate",
        F.when(F.col("estimate").isNotNull(), F.sqrt(F.col("factor") * F.col("meat"))).alias("se"),
    )


def group_predictions(df: DataFrame, outcomes: Sequence[str], cells: Sequence[str]) -> DataFrame:
    """Predictions of ``outcome ~ category`` with classical standard errors (pooled variance)."""
    used = df.dropna(subset=list(cells))
    stats = _long(
        used.groupBy(*cells).agg(
            *[F.count(c).alias(f"_n_{c}") for c in outcomes],
            *[F.avg(c).alias(f"_m_{c}") for c in outcomes],
            *[F.var_samp(c).alias(f"_v_{c}") for c in outcomes],
        ),
        cells,
        {c: {"n": f"_n_{c}", "pred": f"_m_{c}", "v": f"_v_{c}"} for c in outcomes},
    ).filter(F.col("n") > 0)
    pooled = stats.groupBy("outcome").agg(
        F.try_divide(
            F.sum(F.coalesce(F.col("v"), F.lit(0.0)) * (F.col("n") - 1)),
            F.sum("n") - F.count(F.lit(1)),
        ).alias("sigma2")
    )
    return natural_join(stats, pooled, "left", ["outcome"]).select(
        "outcome", *cells, "n", "pred", F.sqrt(F.col("sigma2") / F.col("n")).alias("se")
    )
