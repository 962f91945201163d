"""Return, attribution and risk formulas as column expressions.

Division by zero gives NULL everywhere, also in ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

DAYS_PER_YEAR = 365.25
PERIODS_PER_YEAR = 252


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(weight * value), F.sum(weight))


def sub_period_return(mv_begin: Column, mv_end: Column, flow: Column, strict: bool = False) -> Column:
    """Return of one day with the flow invested at its start; NULL on a basis <= 0.

    With `strict` such a day fails the query instead.
    """
    basis = mv_begin + flow
    bad = F.raise_error(F.lit("non-positive basis in a sub-period return")) if strict else F.lit(None)
    return F.when(basis > 0, F.try_divide(mv_end - mv_begin - flow, basis)).otherwise(bad.cast("double"))


def complete(*columns: Column) -> Column:
    """Aggregate: whether no row lacks any of the columns."""
    checks = [F.count(c) == F.count(F.lit(1)) for c in columns]
    whole = checks[0]
    for check in checks[1:]:
        whole = whole & check
    return whole


def linked(ret: Column) -> Column:
    """Aggregate: geometric link of a return column; NULL if any return is undefined."""
    return F.when(complete(ret), F.product(1 + ret) - 1)


def linked_present(ret: Column) -> Column:
    """Aggregate: geometric link of the returns there are, for a series whose own days are fewer."""
    return F.product(1 + ret) - 1


def cumulative(ret: Column, over_time: WindowSpec) -> Column:
    """Linked return from the first row of the window to the current one; NULL from an undefined one on."""
    whole = F.count(ret).over(over_time) == F.count(F.lit(1)).over(over_time)
    return F.when(whole, F.product(1 + ret).over(over_time) - 1)


def annualised(total: Column, days: Column) -> Column:
    return F.when(days >= 365, F.pow(1 + total, F.lit(DAYS_PER_YEAR) / days) - 1)


def allocation_effect(wp: Column, wb: Column, rb_i: Column, rb_total: Column) -> Column:
    return (wp - wb) * (rb_i - rb_total)


def selection_effect(wb: Column, rp: Column, rb_i: Column) -> Column:
    return wb * (rp - rb_i)


def interaction_effect(wp: Column, wb: Column, rp: Column, rb_i: Column) -> Column:
    return (wp - wb) * (rp - rb_i)


def carino_coefficient(a: Column, b: Column) -> Column:
    """Log-linking coefficient of two returns; NULL when either is -100% or less.

    Close to a = b the quotient loses all digits, so its limit is used there.
    """
    near = F.abs(a - b) < 1e-9
    return F.when(
        (a > -1) & (b > -1),
        F.when(near, 2.0 / (2.0 + a + b)).otherwise(F.try_divide(F.log(1 + a) - F.log(1 + b), a - b)),
    )


def geometric_active(rp: Column, rb: Column) -> Column:
    return F.try_divide(1 + rp, 1 + rb) - 1


def tracking_error(active: Column, periods_per_year: int = PERIODS_PER_YEAR) -> Column:
    """Aggregate: annualised sample deviation; NULL below two observations."""
    return F.stddev_samp(active) * F.sqrt(F.lit(float(periods_per_year)))


def information_ratio(active: Column, periods_per_year: int = PERIODS_PER_YEAR) -> Column:
    """Aggregate: annualised mean over tracking error; NULL when the latter is 0."""
    error = tracking_error(active, periods_per_year)
    return F.try_divide(F.avg(active) * periods_per_year, F.nullif(error, F.lit(0.0)))


def drawdown(growth: Column, over_time: WindowSpec) -> Column:
    """Distance of a growth curve from its running peak, which starts at 1."""
    peak = F.greatest(F.lit(1.0), F.max(growth).over(over_time))
    return F.try_divide(growth, peak) - 1


def percent(col: Column) -> Column:
    return col * 100


def basis_points(col: Column) -> Column:
    return col * 10000


def export_number(col: Column) -> Column:
    return F.round(col, 7)


def export_weight(col: Column) -> Column:
    return F.round(col, 5)


def is_finite(col: Column) -> Column:
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) != F.lit(float("inf")))


# Short labels of long sector names; all others keep their name.
SHORT_SECTORS = {
    "Information Technology": "Info Tech",
    "Communication Services": "Comm. Svcs.",
    "Consumer Discretionary": "Cons. Disc.",
    "Consumer Staples": "Cons. Staples",
}


def short_sector(sector: Column) -> Column:
    label = sector
    for name, short in SHORT_SECTORS.items():
        label = F.when(sector == name, short).otherwise(label)
    return label
