"""Text functions and label parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import ColumnLike, as_col

# Endings that mark the legal type of a county-like area.
COUNTY_ENDINGS = " County| Parish| Census Area| Municipality| City and Borough| Borough| city"
# Earnings bands by exclusive upper bound.
EARNING_BANDS = [(25000.0, "0_24999"), (50000.0, "25000_49999"), (75000.0, "50000_74999")]
TOP_EARNING_BAND = "75000_or_more"


def split_piece(c: ColumnLike, pattern: str, pieces: int, k: int) -> Column:
    """Piece ``k`` (from 1) of at most ``pieces`` pieces; '' when there is none."""
    c = as_col(c)
    piece = F.try_element_at(F.split(c, pattern, pieces), F.lit(k))
    return F.when(c.isNotNull(), F.coalesce(piece, F.lit("")))


def pad_left(c: ColumnLike, width: int, fill: str = "0") -> Column:
    """Pad on the left; longer text is kept whole."""
    c = as_col(c)
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, fill))


def remove_all(c: ColumnLike, pattern: str) -> Column:
    return F.regexp_replace(as_col(c), pattern, "")


def parse_number(c: ColumnLike) -> Column:
    """First number in messy text without thousands marks; NULL when there is none."""
    digits = F.regexp_extract(as_col(c), r"-?[0-9][0-9,]*\.?[0-9]*", 0)
    return F.regexp_replace(digits, ",", "").try_cast("double")


def decode_latin1(raw: ColumnLike) -> Column:
    """Latin-1 bytes (binary, or text holding the raw bytes) to proper text."""
    return F.decode(as_col(raw).cast("binary"), "ISO-8859-1")


def percent_label(share: ColumnLike) -> Column:
    """Share as whole percent text, half rounded away from zero."""
    return F.concat(F.round(as_col(share) * 100).cast("bigint").cast("string"), F.lit("%"))


def tract_code(name: ColumnLike) -> Column:
    """Six-digit code of a tract name such as ``Census Tract 12.03``."""
    code = remove_all(name, "Census Tract ")
    return F.concat(
        pad_left(split_piece(code, r"\.", 2, 1), 4),
        pad_left(split_piece(code, r"\.", 2, 2), 2),
    )


def parse_tract_label(label: ColumnLike) -> Column:
    """``Census Tract 12.03, X County, State`` as a struct of its parts."""
    name = split_piece(label, ",", 2, 1)
    place = split_piece(label, ", ", 2, 2)
    legal_county = F.trim(split_piece(place, ", ", 2, 1))
    return F.struct(
        name.alias("trt_name"),
        tract_code(name).alias("tractfp"),
        legal_county.alias("countylsad"),
        F.trim(remove_all(legal_county, COUNTY_ENDINGS)).alias("county"),
        split_piece(place, ", ", 2, 2).alias("state"),
    )


def usable_tract(state: ColumnLike, name: ColumnLike) -> Column:
    """Labels of the studied states that name a real tract."""
    return ~as_col(state).isin("Puerto Rico", "") & (as_col(name) != "Tract 999999")


def earning_bounds(label: ColumnLike) -> Column:
    """Lower bound, upper bound and band of an earnings label as a struct."""
    text = as_col(label)
    low_text = split_piece(text, " to ", 2, 1)
    low = F.when(low_text.rlike("loss|No earnings"), F.lit(0.0)).otherwise(parse_number(low_text))
    high = (
        F.when(text.contains("No earnings"), F.lit(4999.0))
        .when(text.contains("or more"), F.lit(float("inf")))
        .when(text.contains("or loss"), F.lit(4999.0))
        .otherwise(parse_number(split_piece(text, " to ", 2, 2)))
    )
    return F.struct(
        F.when(low == 1, F.lit(0.0)).otherwise(low).alias("lower"),
        high.alias("upper"),
        earning_band(high).alias("band"),
    )


def earning_band(upper: ColumnLike) -> Column:
    upper = as_col(upper)
    band = F.when(upper.isNull(), F.lit(None).cast("string"))
    for bound, name in EARNING_BANDS:
        band = band.when(upper < bound, F.lit(name))
    return band.otherwise(F.lit(TOP_EARNING_BAND))


def metro_slug(name: ColumnLike) -> Column:
    """Short file-safe name: text before the first dash or comma, lower case."""
    first = split_piece(name, r"-|,", 2, 1)
    return F.lower(F.regexp_replace(remove_all(first, r"\."), " |/", "_"))


def cross_label(a: ColumnLike, b: ColumnLike, sep: str = ":") -> Column:
    """Two labels as one; NULL if either is NULL."""
    return F.concat(as_col(a), F.lit(sep), as_col(b))


def keep_label(label: ColumnLike, part: str, other: str = "Other") -> Column:
    """The label where it contains ``part``, else ``other``."""
    label = as_col(label)
    return F.when(label.isNull(), None).when(label.contains(part), label).otherwise(F.lit(other))
