"""Shares, changes, diversity and area types as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import ColumnLike, as_col, ratio

# Worker groups (white, black, Latinx, Asian, other) and their labels.
NAMED_GROUPS = ["nhw", "nhb", "h", "nha"]
GROUPS = [*NAMED_GROUPS, "nho"]
PREDOMINANT = {
    "nhw": "Predominantly White",
    "nhb": "Predominantly Black",
    "nha": "Predominantly Asian",
    "h": "Predominantly Latinx",
}
TYPES_7 = [*PREDOMINANT.values(), "White-Mixed", "Non-White-Mixed", "Multiethnic"]
# Side of the day -> column prefix of its counts.
SIDES = {"pm": "res", "am": "pow"}
PERIODS = ["2000", "2006-2010 ACS", "2012-2016 ACS"]


def total(columns: Sequence[ColumnLike]) -> Column:
    return reduce(add, [as_col(c) for c in columns])


def share_columns(side: str) -> dict[str, Column]:
    """Share of every group at ``pm`` or ``am``; the fifth group is the residual."""
    p = SIDES[side]
    whole = F.col(f"{p}_total_est")
    named = [F.col(f"{p}_{g}_est") for g in NAMED_GROUPS]
    shares = {f"trt_shr_{g}_{side}": ratio(c, whole) for g, c in zip(NAMED_GROUPS, named)}
    shares[f"trt_shr_nho_{side}"] = ratio(whole - total(named), whole)
    return shares


def change_columns() -> dict[str, Column]:
    """Day share minus night share of every group."""
    return {f"chg_{g}": F.col(f"trt_shr_{g}_am") - F.col(f"trt_shr_{g}_pm") for g in GROUPS}


def entropy(shares: Sequence[ColumnLike]) -> Column:
    """Sum of p * ln(1/p); an empty category adds 0, a missing share makes it NULL."""
    return total([F.when(as_col(p) != 0, as_col(p) * F.ln(1 / as_col(p))).otherwise(as_col(p)) for p in shares])


def _mixed(share: Column) -> Column:
    return (share < 0.75) & (share >= 0.5)


def _predominant(shares: dict[str, Column]) -> Column:
    first, *rest = PREDOMINANT.items()
    out = F.when(shares[first[0]] >= 0.75, F.lit(first[1]))
    for group, label in rest:
        out = out.when(shares[group] >= 0.75, F.lit(label))
    return out.when(_mixed(shares["nhw"]), F.lit("White-Mixed"))


def type7(side: str) -> Column:
    """Seven-class type of an area from its shares at ``pm`` or ``am``."""
    s = {g: F.col(f"trt_shr_{g}_{side}") for g in NAMED_GROUPS}
    mixed = _mixed(s["nhb"]) | _mixed(s["h"]) | _mixed(s["nha"])
    return _predominant(s).when(mixed, F.lit("Non-White-Mixed")).otherwise(F.lit("Multiethnic"))


def type9(side: str) -> Column:
    """Nine-class type, naming the group of a non-white mixed area."""
    s = {g: F.col(f"trt_shr_{g}_{side}") for g in NAMED_GROUPS}
    return (
        _predominant(s)
        .when(_mixed(s["nhb"]), F.lit("Black-Mixed"))
        .when(_mixed(s["h"]), F.lit("Latinx-Mixed"))
        .when(_mixed(s["nha"]), F.lit("Asian-Mixed"))
        .otherwise(F.lit("Multiethnic"))
    )


def day_night_flag(category: ColumnLike, part: str, word: str, side: str) -> Column:
    """``Segregated Daytime`` / ``Not Segregated Daytime`` and the like."""
    time = {"am": "Daytime", "pm": "Nighttime"}[side]
    category = as_col(category)
    return (
        F.when(category.isNull(), None)
        .when(category.contains(part), F.lit(f"{word} {time}"))
        .otherwise(F.lit(f"Not {word} {time}"))
    )


def segregation_level(d: ColumnLike) -> Column:
    """Named level of a dissimilarity value; NULL stays NULL."""
    d = as_col(d)
    return (
        F.when(d >= 0.8, "Extreme Segregation")
        .when(d >= 0.6, "High Segregation")
        .when(d >= 0.4, "Moderate Segregation")
        .when(d < 0.4, "Low Segregation")
    )
