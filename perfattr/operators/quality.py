"""Checks that results agree with each other and with the accounting identities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perfattr.functions import measures as m
from perfattr.operators.attribution import Held
from perfattr.operators.returns import day_returns, sub_period_returns

TOLERANCE = 1e-10


def invariant_gaps(daily: DataFrame) -> DataFrame:
    """Per portfolio and day: effects against active return, weights against 1."""
    effects = F.col("allocation") + F.col("selection") + F.col("interaction")
    return (
        daily.groupBy("portfolio_id", "date")
        .agg(
            F.sum(effects).alias("effects"),
            F.sum(F.col("wp") * F.col("rp")).alias("rp"),
            F.max("rb_total").alias("rb"),
            (F.sum("wp") - 1).alias("wp_gap"),
            (F.sum("wb") - 1).alias("wb_gap"),
        )
        .select(
            "portfolio_id",
            "date",
            (F.col("effects") - (F.col("rp") - F.col("rb"))).alias("effect_gap"),
            "wp_gap",
            "wb_gap",
        )
    )


def invariant_violations(daily: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """The portfolio days on which an identity is off by more than the tolerance."""
    gaps = F.greatest(*(F.abs(c) for c in ("effect_gap", "wp_gap", "wb_gap")))
    return invariant_gaps(daily).where(gaps > tolerance)


def return_gap(valued: DataFrame, held: Held) -> DataFrame:
    """Market-value return against weight-based return, day by day.

    Days that one side lacks are rows too: `only` says which side has them.
    """
    by_value = sub_period_returns(valued).select("portfolio_id", "date", F.col("rp").alias("rp_mv"))
    by_weight = day_returns(held).select("portfolio_id", "date", F.col("rp").alias("rp_weight"))
    by_value = by_value.withColumn("has_value", F.lit(True))
    by_weight = by_weight.withColumn("has_weight", F.lit(True))
    only = F.when(F.col("has_weight").isNull(), "value").when(F.col("has_value").isNull(), "weight")
    return (
        by_value.join(by_weight, ["portfolio_id", "date"], "full")
        .withColumn("gap", F.col("rp_mv") - F.col("rp_weight"))
        .withColumn("only", only)
        .drop("has_value", "has_weight")
    )


def max_abs_diff(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row: unmatched keys on either side and the largest difference of any value."""
    a = left.select(*keys, F.struct(*values).alias("a"))
    b = right.select(*keys, F.struct(*values).alias("b"))
    diffs = [F.abs(F.col(f"a.{v}") - F.col(f"b.{v}")) for v in values]
    widest = F.greatest(*diffs) if len(diffs) > 1 else diffs[0]
    return a.join(b, list(keys), "full").agg(
        F.count("*").alias("n_keys"),
        F.count_if(F.col("b").isNull()).alias("only_left"),
        F.count_if(F.col("a").isNull()).alias("only_right"),
        F.max(widest).alias("max_abs_diff"),
    )


def bad_valuations(valued: DataFrame) -> DataFrame:
    """Days whose sub-period return is undefined."""
    return valued.where(F.col("mv_begin") + F.col("cf") <= 0)


def unlinkable_days(days: DataFrame) -> DataFrame:
    """Days with a return of -100% or less, which no log can link."""
    return days.where((F.col("rp") <= -1) | (F.col("rb") <= -1))


def uncovered_sectors(held: DataFrame, bench: DataFrame) -> DataFrame:
    """Held (portfolio, date, sector) rows that the benchmark does not span."""
    return held.join(bench, ["date", "sector"], "left_anti")


def non_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that must not be exported: NULL, NaN or infinite in a given column."""
    ok = F.lit(True)
    for name in columns:
        ok = ok & m.is_finite(F.col(name))
    return df.where(~ok)


def _holds_non_finite(value: Column, kind: T.DataType) -> Column | None:
    """Whether a value has NaN or infinity anywhere inside; None if its type has no such figures."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return value.isNotNull() & ~m.is_finite(value)
    if isinstance(kind, T.ArrayType):
        if _holds_non_finite(F.lit(None), kind.elementType) is None:
            return None
        return F.exists(value, lambda x: F.coalesce(_holds_non_finite(x, kind.elementType), F.lit(False)))
    if isinstance(kind, T.StructType):
        parts = [_holds_non_finite(value[f.name], f.dataType) for f in kind.fields]
        parts = [F.coalesce(p, F.lit(False)) for p in parts if p is not None]
        return F.array_contains(F.array(*parts), True) if parts else None
    return None


def not_finite_inside(df: DataFrame) -> DataFrame:
    """Rows with NaN or infinity in any figure, in lists and nested rows too.  NULL is an undefined figure, not one of these."""
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    found = _holds_non_finite(whole, df.schema)
    return df.where(found) if found is not None else df.limit(0)
