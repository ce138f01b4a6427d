"""Column-level helpers: JVM-side expressions only (no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lapse.config import TENURE_BINS, TENURE_LABELS


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded_mean(c: str, digits: int = 2) -> Column:
    """Mean rounded half-up, whatever order the rows are added in: of decimals, as long as every value is one of at most
    eighteen digits before the point and ten behind it; else of doubles."""
    exact = col(c).try_cast("decimal(28,10)")
    return (F.when(F.count(exact) == F.count(col(c)), F.round(F.avg(exact), digits).cast("double"))
            .otherwise(round_half_up(F.avg(col(c)), digits)))


def round_half_up(c: str | Column, digits: int = 2) -> Column:
    """floor(x * 10^d + 0.5) / 10^d as double: the same bits in every engine."""
    scale = float(10 ** digits)
    return (F.floor(col(c) * scale + 0.5) / scale).cast("double")


def yes_flag(c: str | Column) -> Column:
    """'Yes' -> 1, anything else (including NULL) -> 0."""
    return F.when(col(c) == "Yes", 1).otherwise(0).cast("int")


def strip_ws(c: str | Column) -> Column:
    """Strip leading and trailing whitespace (not only spaces)."""
    return F.regexp_replace(F.regexp_replace(col(c), r"^\s+", ""), r"\s+$", "")


def tenure_band(tenure: str | Column = "tenure") -> Column:
    """Right-closed bins 0/12/24/48/72 with the lowest edge included; outside -> NULL."""
    t = col(tenure)
    expr = None
    for i, label in enumerate(TENURE_LABELS):
        lo, hi = TENURE_BINS[i], TENURE_BINS[i + 1]
        cond = (t >= lo) & (t <= hi) if i == 0 else (t > lo) & (t <= hi)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


def tenure_band_sql(tenure: str | Column = "tenure") -> Column:
    """The SQL pack's banding: BETWEEN 0-12, 13-24, 25-48, everything else (NULL, >48) -> '49+ mo'."""
    t = col(tenure)
    return (F.when(t.between(0, 12), TENURE_LABELS[0]).when(t.between(13, 24), TENURE_LABELS[1])
            .when(t.between(25, 48), TENURE_LABELS[2]).otherwise(TENURE_LABELS[3]))


def rate_pct(num: Column, den: Column, digits: int) -> Column:
    """100 * num / den, half-up rounded."""
    return round_half_up(F.lit(100.0) * num / den, digits)


def fmt_pct(c: str | Column, digits: int = 1) -> Column:
    """0.1234 -> '12.3%'."""
    return F.format_string(f"%.{digits}f%%", col(c) * 100.0)


def fmt_dollar(c: str | Column, digits: int = 0) -> Column:
    """1234.5 -> '$1,235' (digits=0) or '$1,234.50' (digits=2)."""
    return F.concat(F.lit("$"), F.format_number(col(c), digits))
