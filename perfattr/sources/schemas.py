"""Schemas of the star tables and of the two input contracts."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, nullable) for name, dtype, nullable in fields])


_DATE, _INT, _STR, _DBL = T.DateType(), T.IntegerType(), T.StringType(), T.DoubleType()

SECURITIES = _schema(
    ("security_id", _INT, False),
    ("ticker", _STR, False),
    ("sector", _STR, False),
    ("asset_class", _STR, False),
)
PORTFOLIOS = _schema(
    ("portfolio_id", _INT, False),
    ("name", _STR, False),
    ("inception_date", _DATE, False),
    ("base_currency", _STR, False),
)
POSITIONS_DAILY = _schema(
    ("date", _DATE, False),
    ("portfolio_id", _INT, False),
    ("security_id", _INT, False),
    ("quantity", _DBL, False),
    ("price", _DBL, False),
    ("market_value", _DBL, False),
)
# amount is the signed cash impact; only type = 'CASHFLOW' is an external flow.
TRANSACTIONS = _schema(
    ("date", _DATE, False),
    ("portfolio_id", _INT, False),
    ("security_id", _INT, True),
    ("type", _STR, False),
    ("quantity", _DBL, False),
    ("amount", _DBL, False),
)
BENCHMARK_WEIGHTS = _schema(
    ("date", _DATE, False),
    ("security_id", _INT, False),
    ("weight", _DBL, False),
)
BENCHMARK_RETURNS = _schema(
    ("date", _DATE, False),
    ("security_id", _INT, False),
    ("ret", _DBL, False),
)

STAR = {
    "securities": SECURITIES,
    "portfolios": PORTFOLIOS,
    "positions_daily": POSITIONS_DAILY,
    "transactions": TRANSACTIONS,
    "benchmark_weights": BENCHMARK_WEIGHTS,
    "benchmark_returns": BENCHMARK_RETURNS,
}

# Column order of a holdings CSV file; `account` is added by the reader.
HOLDINGS_CSV = _schema(
    ("date", _DATE, True),
    ("ticker", _STR, True),
    ("sector", _STR, True),
    ("quantity", _DBL, True),
    ("price", _DBL, True),
    ("dividend", _DBL, True),
)
TARGETS = _schema(
    ("model", _STR, False),
    ("ticker", _STR, True),
    ("weight", _DBL, True),
    ("rebalance", _STR, False),
)

# The sector names a holdings file may use.
GICS_SECTORS = (
    "Communication Services",
    "Consumer Discretionary",
    "Consumer Staples",
    "Energy",
    "Financials",
    "Health Care",
    "Industrials",
    "Information Technology",
    "Materials",
    "Real Estate",
    "Utilities",
)
