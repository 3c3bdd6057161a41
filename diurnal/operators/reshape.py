"""Projection, reshaping and table-update operators."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ..session import settle
from .joins import attach


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last`` in the order of the table."""
    names = df.columns
    return names[names.index(first) : names.index(last) + 1]


def starting_with(df: DataFrame, *prefixes: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefixes)]


def ending_with(df: DataFrame, *suffixes: str) -> list[str]:
    return [c for c in df.columns if c.endswith(suffixes)]


def text_columns(df: DataFrame, *, but: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, StringType) and f.name not in but]


def number_columns(df: DataFrame, *, but: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in but]


def across(df: DataFrame, columns: Sequence[str], f: Callable[[Column], Column]) -> DataFrame:
    """The same expression over several columns."""
    return df.withColumns({c: f(F.col(c)) for c in columns})


def rename_all(df: DataFrame, f: Callable[[str], str], but: Sequence[str] = ()) -> DataFrame:
    return df.toDF(*[c if c in but else f(c) for c in df.columns])


def code_totals(mapping: Mapping[str, Sequence[str]], period: str) -> list[Column]:
    """Named totals as sums of coded source columns, tagged with their period."""
    sums = [
        sum([F.col(c) for c in codes[1:]], F.col(codes[0])).alias(name)
        for name, codes in mapping.items()
    ]
    return [F.lit(period).alias("year"), *sums]


def widen(
    df: DataFrame,
    ids: Sequence[str],
    names: str,
    levels: Sequence[str],
    measures: Sequence[str],
    template: str = "{level}_{measure}",
) -> DataFrame:
    """Long to wide. The levels are given, so no extra job looks for them."""
    cells = [
        F.max(F.when(F.col(names) == level, F.col(m))).alias(template.format(level=level, measure=m))
        for m in measures
        for level in levels
    ]
    return df.groupBy(*ids).agg(*cells)


def widen_sum(
    df: DataFrame, ids: Sequence[str], names: str, levels: Sequence[str], measure: str, prefix: str
) -> DataFrame:
    """Long to wide with cells summed; a cell without rows, or with a NULL, is NULL."""

    def cell(level: str) -> Column:
        inside = F.col(names) == level
        return F.when(
            F.count_if(inside) == F.count(F.when(inside, F.col(measure))),
            F.sum(F.when(inside, F.col(measure))),
        ).alias(prefix + level)

    return df.groupBy(*ids).agg(*[cell(level) for level in levels])


def widen_sums(
    df: DataFrame, ids: Sequence[str], dimensions: Sequence[tuple[Column, Sequence[str], str]], measure: str
) -> DataFrame:
    """Several :func:`widen_sum` of one table side by side, in one aggregation.

    ``dimensions`` holds (names, levels, prefix) of each. Equals joining the wide tables on
    ``ids``, since every id of the table is in each of them, without shuffling any of them.
    """
    named = df.withColumns({f"_d{k}": names for k, (names, _, _) in enumerate(dimensions)})
    cells = []
    for k, (_, levels, prefix) in enumerate(dimensions):
        for level in levels:
            inside = F.col(f"_d{k}") == level
            whole = F.count_if(inside) == F.count(F.when(inside, F.col(measure)))
            cells.append(F.when(whole, F.sum(F.when(inside, F.col(measure)))).alias(prefix + level))
    return named.groupBy(*ids).agg(*cells)


def expand_nested(df: DataFrame, ids: Sequence[str], nested: str) -> DataFrame:
    """Rows of a nested table column (array of structs)."""
    return df.select(*ids, F.inline(nested))


def repair(
    df: DataFrame, target: str, rules: Sequence[tuple[Mapping[str, str], str]]
) -> DataFrame:
    """Overwrite ``target`` where the named columns have the given values.

    Rules are few and fixed, so they become one CASE expression; later rules see earlier
    results, as in a sequence of assignments.
    """
    for where, value in rules:
        hit = F.lit(True)
        for c, v in where.items():
            hit = hit & (F.col(c) == v)
        df = df.withColumn(target, F.when(hit, F.lit(value)).otherwise(F.col(target)))
    return df


def stack(*tables: DataFrame) -> DataFrame:
    """Tables on top of each other; a column absent from one is NULL there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def replace_period(df: DataFrame, period: str, recomputed: DataFrame) -> DataFrame:
    """The table with one period's rows exchanged; rows without a period go too."""
    return stack(df.filter(F.col("year") != period), recomputed)


def shares_of_total(
    df: DataFrame,
    keys: Sequence[str],
    count: str,
    share: str = "shr",
    total: str = "total",
    spread: Sequence[str] | None = None,
) -> DataFrame:
    """Share of the group's total, and the total.

    Totals are aggregated (partial sums first) and attached, rather than windowed, so no
    group has to fit one task.
    """
    df = settle(df)
    totals = df.groupBy(*keys).agg(F.sum(count).alias(total))
    return attach(df, totals, keys, spread or df.columns).withColumn(
        share, F.try_divide(F.col(count), F.col(total))
    )


def ratio_to_reference(
    df: DataFrame,
    keys: Sequence[str],
    category: str,
    reference: str,
    ratios: Mapping[str, str],
) -> DataFrame:
    """Each measure over the reference category's value in the same group.

    ``ratios`` maps new column to measure. A group without the reference has NULL ratios.
    """
    df = settle(df)
    base = (
        df.filter(F.col(category) == reference)
        .groupBy(*keys)
        .agg(*[F.max(m).alias(f"_{new}") for new, m in ratios.items()])
    )
    joined = attach(df, base, keys, [category])
    return joined.withColumns(
        {new: F.try_divide(F.col(m), F.col(f"_{new}")) for new, m in ratios.items()}
    ).drop(*[f"_{new}" for new in ratios])


def zscores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Center and scale columns by their overall mean and sample deviation (one row of numbers)."""
    stats = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_samp(c).alias(f"s_{c}") for c in columns],
    ).first()
    number = lambda v: F.lit(v).cast("double")
    return df.withColumns(
        {c: F.try_divide(F.col(c) - number(stats[f"m_{c}"]), number(stats[f"s_{c}"])) for c in columns}
    )
