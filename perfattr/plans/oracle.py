"""DuckDB SQL for the registered queries, written against the raw tables.

Each statement starts from the definition of the derived star and states the
result in plain SQL: grids and joins where the DataFrame code uses intervals,
windows and stored steps.
"""

from __future__ import annotations

from perfattr.plans.inputs import LONG_SECTORS, MAX_HOLDINGS
from perfattr.plans.inputs import PERIODS_PER_YEAR as P
from perfattr.plans.queries import WINDOW

STAR = """
months AS (
  SELECT CAST(d AS DATE) AS date FROM (
    SELECT unnest(generate_series(date_trunc('month', min(l_shipdate)), date_trunc('month', max(l_shipdate)),
                                  INTERVAL 1 MONTH)) AS d
    FROM lineitem)),
securities AS (
  SELECT CAST(row_number() OVER (ORDER BY ticker) AS INT) AS security_id, ticker, sector, 'EQUITY' AS asset_class
  FROM (SELECT DISTINCT p_type || '-' || p_brand AS ticker, p_type AS sector FROM part)),
trades AS (
  SELECT CAST(l_suppkey AS INT) AS portfolio_id, security_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
         sum(l_quantity) AS quantity, sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS gross
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN securities ON ticker = p_type || '-' || p_brand
  GROUP BY ALL),
grid AS (
  SELECT s.security_id, m.date, coalesce(sum(t.quantity), 0) AS q, coalesce(sum(t.gross), 0) AS g
  FROM (SELECT DISTINCT security_id FROM trades) s CROSS JOIN months m
  LEFT JOIN trades t ON t.security_id = s.security_id AND t.date = m.date
  GROUP BY ALL),
vwap AS (
  SELECT security_id, date, held, greatest(floor(paid / nullif(held, 0) * 64) / 64, 1 / 64) AS price FROM (
    SELECT security_id, date, sum(q) OVER w AS held, CAST(sum(g) OVER w AS DOUBLE) AS paid
    FROM grid WINDOW w AS (PARTITION BY security_id ORDER BY date))),
first_price AS (
  SELECT security_id, arg_min(price, date) AS price FROM vwap WHERE held > 0 GROUP BY security_id),
market AS (
  SELECT security_id, date, held, price, lag(price) OVER w AS prev_price, lag(held) OVER w AS prev_held
  FROM (SELECT v.security_id, v.date, v.held, CASE WHEN v.held > 0 THEN v.price ELSE f.price END AS price
        FROM vwap v JOIN first_price f USING (security_id))
  WINDOW w AS (PARTITION BY security_id ORDER BY date)),
positions_daily AS (
  SELECT k.date, t.portfolio_id, t.security_id, t.quantity, k.price, t.quantity * k.price AS market_value
  FROM (SELECT portfolio_id, security_id, date AS since,
               sum(quantity) OVER w AS quantity, lead(date) OVER w AS until
        FROM trades WINDOW w AS (PARTITION BY portfolio_id, security_id ORDER BY date)) t
  JOIN market k ON k.security_id = t.security_id AND k.date >= t.since AND (t.until IS NULL OR k.date < t.until)),
inception AS (SELECT portfolio_id, min(date) AS inception_date FROM trades GROUP BY portfolio_id),
portfolios AS (
  SELECT portfolio_id, coalesce(s_name, 'Portfolio ' || portfolio_id) AS name, inception_date, 'USD' AS base_currency
  FROM inception LEFT JOIN supplier ON s_suppkey = portfolio_id),
transactions AS (
  SELECT date, portfolio_id, CAST(NULL AS INT) AS security_id, 'CASHFLOW' AS type, 0.0 AS quantity, amount FROM (
    SELECT t.date, t.portfolio_id, sum(t.quantity * k.prev_price) AS amount
    FROM trades t JOIN market k USING (security_id, date) JOIN inception i USING (portfolio_id)
    WHERE t.date > i.inception_date GROUP BY ALL) WHERE abs(amount) > 0.01
  UNION ALL
  SELECT t.date, t.portfolio_id, t.security_id, 'BUY', t.quantity, -t.quantity * k.price
  FROM trades t JOIN market k USING (security_id, date)),
later AS (SELECT * FROM market WHERE date > (SELECT min(date) FROM months)),
benchmark_weights AS (
    SELECT l.date, l.security_id, floor(l.prev_held * l.prev_price / t.total * CAST(70368744177664 AS DOUBLE)) / CAST(70368744177664 AS DOUBLE) AS weight
    FROM later l JOIN (SELECT date, sum(prev_held * prev_price) AS total FROM later GROUP BY date) t USING (date)),
benchmark_returns AS (
  SELECT date, security_id, floor((price / prev_price - 1) * 1048576) / 1048576 AS ret FROM later),
tcal AS (
  SELECT date, lag(date) OVER (ORDER BY date) AS prev_date, CAST(row_number() OVER (ORDER BY date) - 1 AS INT) AS idx
  FROM (SELECT DISTINCT date FROM benchmark_returns)),
sector_ranks AS (SELECT sector, CAST(row_number() OVER (ORDER BY sector) - 1 AS INT) AS srank
                 FROM (SELECT DISTINCT sector FROM securities)),
tilted AS (
  SELECT p.* FROM positions_daily p JOIN securities USING (security_id) JOIN sector_ranks USING (sector)
  WHERE srank <> portfolio_id % (SELECT count(*) FROM sector_ranks)),
sold_out AS (
  SELECT date, portfolio_id, security_id, quantity, price, quantity * price AS market_value FROM (
    SELECT p.date, portfolio_id, security_id, price,
           CASE WHEN idx BETWEEN 6 AND 8 AND srank = (portfolio_id + 1) % (SELECT count(*) FROM sector_ranks) THEN 0.0 ELSE quantity END AS quantity
    FROM positions_daily p JOIN securities USING (security_id) JOIN sector_ranks USING (sector)
    LEFT JOIN tcal ON tcal.date = p.date)),
gapped AS (
  SELECT p.* FROM positions_daily p LEFT JOIN tcal USING (date)
  WHERE NOT coalesce((portfolio_id * 3 + security_id) % 7 = 2 AND idx BETWEEN 38 AND 64
                     OR (portfolio_id * 3 + security_id) % 7 = 4 AND idx BETWEEN 57 AND 60, false)),
short_lived AS (
  SELECT p.* FROM positions_daily p, (SELECT date AS turn FROM tcal WHERE idx = (SELECT count(*) // 2 FROM tcal)) t
  WHERE (portfolio_id % 5 <> 0 OR date <= turn) AND (portfolio_id % 5 <> 1 OR date >= turn)),
sparse_weights AS (
  SELECT b.* FROM benchmark_weights b JOIN securities USING (security_id) JOIN sector_ranks USING (sector)
  WHERE NOT (srank = 0 AND month(b.date) = 1)),
bench AS (
  SELECT date, sum(weight * ret) / sum(weight) AS rb
  FROM benchmark_weights JOIN benchmark_returns USING (date, security_id) GROUP BY date)
"""


def r(expr: str, digits: int = 9) -> str:
    return f"round({expr}, {digits}) + 0.0"


def rs(columns: str, digits: int = 9) -> str:
    """Rounded columns under their own names."""
    return ", ".join(f"{r(c, digits)} AS {c}" for c in columns.split())


def text(expr: str) -> str:
    """A figure as text with seven digits."""
    return "coalesce(format('{:.7f}', round(" + expr + ", 7) + 0.0), 'null')"


def sql(ctes: str, select: str) -> str:
    body = STAR + ("," + ctes if ctes else "")
    return f"WITH {body}\n{select}"


def effects(
    name: str = "daily",
    positions: str = "positions_daily",
    weights: str = "benchmark_weights",
    start: str = "1900-01-01",
    end: str = "2999-01-01",
    lifespan: bool = False,
) -> str:
    """CTEs that end in a table of daily effects."""
    n = name
    alive = (
        f"""JOIN (SELECT portfolio_id, min(date) AS a, max(date) AS z FROM {positions} GROUP BY 1) life
            ON life.portfolio_id = pf.portfolio_id AND b.date > life.a AND b.date <= life.z"""
        if lifespan
        else ""
    )
    return f"""
{n}_basis AS (
  SELECT * FROM (
    SELECT portfolio_id, security_id, date,
           lag(market_value) OVER (PARTITION BY portfolio_id, security_id ORDER BY date) AS basis
    FROM {positions} WHERE date <= DATE '{end}')
  WHERE basis IS NOT NULL AND date >= DATE '{start}'),
{n}_earned AS (
  SELECT portfolio_id, date, security_id, sector, basis, basis * ret AS gain
  FROM {n}_basis JOIN benchmark_returns USING (security_id, date) JOIN securities USING (security_id)),
{n}_total AS (SELECT portfolio_id, date, sum(basis) AS total FROM {n}_earned GROUP BY ALL),
{n}_held AS (
  SELECT portfolio_id, date, sector, sum(basis) / nullif(any_value(total), 0) AS wp,
         sum(gain) / nullif(sum(basis), 0) AS rp
  FROM {n}_earned JOIN {n}_total USING (portfolio_id, date) GROUP BY ALL),
{n}_bench AS (
  SELECT date, sector, sum(weight) AS wb, sum(weight * ret) / sum(weight) AS rb_i
  FROM {weights} JOIN benchmark_returns USING (date, security_id) JOIN securities USING (security_id)
  WHERE date BETWEEN DATE '{start}' AND DATE '{end}' GROUP BY ALL),
{n}_market AS (SELECT date, sum(wb * rb_i) / sum(wb) AS rb_total FROM {n}_bench GROUP BY date),
{n}_grid AS (
  SELECT pf.portfolio_id, b.date, b.sector, b.wb, b.rb_i, k.rb_total
  FROM portfolios pf CROSS JOIN {n}_bench b JOIN {n}_market k ON k.date = b.date {alive}),
{n}_full AS (
  SELECT g.*, coalesce(h.wp, 0) AS wp, coalesce(h.rp, g.rb_i) AS rp
  FROM {n}_grid g LEFT JOIN {n}_held h USING (portfolio_id, date, sector)),
{n} AS (
  SELECT portfolio_id, date, sector, wp, wb, rp, rb_i, rb_total, (wp - wb) * (rb_i - rb_total) AS allocation,
         wb * (rp - rb_i) AS selection, (wp - wb) * (rp - rb_i) AS interaction
  FROM {n}_full),
{n}_days AS (SELECT portfolio_id, date, sum(wp * rp) AS rp, any_value(rb_total) AS rb FROM {n} GROUP BY ALL)"""


EFFECT_COLUMNS = "wp wb rp rb_i rb_total allocation selection interaction"


def daily_select(name: str = "daily") -> str:
    return f"SELECT portfolio_id, date, sector, {rs(EFFECT_COLUMNS)} FROM {name}"


def period_select(name: str = "daily", where: str = "") -> str:
    return f"""SELECT portfolio_id, sector, {r('avg(wp)')} AS avg_wp, {r('avg(wb)')} AS avg_wb,
      {r('sum(allocation)')} AS allocation, {r('sum(selection)')} AS selection,
      {r('sum(interaction)')} AS interaction, {r('sum(allocation) + sum(selection) + sum(interaction)')} AS total
    FROM {name} {where} GROUP BY portfolio_id, sector"""


def coefficient(a: str, b: str) -> str:
    return f"""CASE WHEN {a} > -1 AND {b} > -1 THEN CASE WHEN abs({a} - ({b})) < 1e-9 THEN 2 / (2 + {a} + {b})
      ELSE (ln(1 + {a}) - ln(1 + {b})) / ({a} - ({b})) END END"""


def linking(days: str = "daily_days", daily: str = "daily") -> str:
    return f"""
whole AS (SELECT portfolio_id, product(1 + rp) - 1 AS tp, product(1 + rb) - 1 AS tb, count(*) AS n_days,
                 count(*) FILTER (rp <= -1 OR rb <= -1) AS unlinked
          FROM {days} GROUP BY portfolio_id),
factors AS (
  SELECT portfolio_id, date, rp, rb, n_days, unlinked, k_day, k_period, k_day / k_period AS factor FROM (
    SELECT d.portfolio_id, d.date, d.rp, d.rb, w.n_days, w.unlinked, {coefficient('d.rp', 'd.rb')} AS k_day,
           CASE WHEN unlinked = 0 THEN {coefficient('w.tp', 'w.tb')} END AS k_period
    FROM {days} d JOIN whole w USING (portfolio_id))),
linked AS (
  SELECT portfolio_id, sector, sum(wp) / any_value(n_days) AS avg_wp, sum(wb) / any_value(n_days) AS avg_wb,
         sum(factor * allocation) AS allocation, sum(factor * selection) AS selection,
         sum(factor * interaction) AS interaction,
         sum(factor * allocation) + sum(factor * selection) + sum(factor * interaction) AS total,
         any_value(unlinked) AS unlinked_days
  FROM {daily} JOIN factors f USING (portfolio_id, date) GROUP BY portfolio_id, sector)"""


LINK_COLUMNS = "avg_wp avg_wb allocation selection interaction total"

VALUED = """
flows AS (SELECT portfolio_id, date, sum(amount) AS cf FROM transactions WHERE type = 'CASHFLOW' GROUP BY ALL),
valued AS (
  SELECT * FROM (
    SELECT portfolio_id, date, lag(date) OVER w AS begin_date, lag(mv) OVER w AS mv_begin, mv AS mv_end,
           coalesce(cf, 0) AS cf
    FROM (SELECT portfolio_id, date, sum(market_value) AS mv FROM positions_daily GROUP BY ALL)
    LEFT JOIN flows USING (portfolio_id, date) WINDOW w AS (PARTITION BY portfolio_id ORDER BY date))
  WHERE mv_begin IS NOT NULL),
mv_days AS (
  SELECT v.*, (mv_end - mv_begin - cf) / (mv_begin + cf) AS rp, rb FROM valued v LEFT JOIN bench USING (date))"""


def curve(days: str, keys: str = "portfolio_id") -> str:
    """Running growth and drawdown of a table of days."""
    return f"""
grown AS (
  SELECT *, product(1 + rp) OVER w AS gp, product(1 + rb) OVER w AS gb FROM {days}
  WINDOW w AS (PARTITION BY {keys} ORDER BY date ROWS UNBOUNDED PRECEDING)),
curve AS (
  SELECT *, gp / greatest(1, max(gp) OVER (PARTITION BY {keys} ORDER BY date ROWS UNBOUNDED PRECEDING)) - 1 AS dd
  FROM grown)"""


RISK = f"""count(*) AS n_days, {r('product(1 + rp) - 1', 8)} AS twr, {r('product(1 + rb) - 1', 8)} AS bench_twr,
  {r(f'stddev_samp(rp - rb) * sqrt({P})', 8)} AS te,
  {r(f'avg(rp - rb) * {P} / nullif(stddev_samp(rp - rb) * sqrt({P}), 0)', 8)} AS ir,
  {r('least(min(dd), 0)', 8)} AS max_drawdown"""

SUMMARY_SELECT = f"""
SELECT s.*, coalesce(name, 'Portfolio ' || s.portfolio_id) AS name FROM (
  SELECT portfolio_id, from_date, n_days, te, ir, max_drawdown, days AS calendar_days,
    {r('tp', 8)} AS twr, {r('tb', 8)} AS bench_twr,
    CASE WHEN days >= 365 THEN {r('pow(1 + tp, 365.25 / days) - 1', 8)} END AS twr_annualised,
    CASE WHEN days >= 365 THEN {r('pow(1 + tb, 365.25 / days) - 1', 8)} END AS bench_annualised,
    {r('tp - tb', 8)} AS active_return, {r('(1 + tp) / (1 + tb) - 1', 8)} AS active_geometric
  FROM (
    SELECT portfolio_id, min(date) AS from_date, product(1 + rp) - 1 AS tp, product(1 + rb) - 1 AS tb,
           CAST(date_diff('day', min(begin_date), {{end}}) AS INT) AS days, {RISK}
    FROM curve GROUP BY portfolio_id)) s LEFT JOIN portfolios USING (portfolio_id)"""

CONTRIBUTED = """
contributed AS (
  SELECT portfolio_id, ticker, s.sector, sum(gain / nullif(total, 0)) AS contribution
  FROM daily_earned e JOIN daily_total USING (portfolio_id, date) JOIN securities s USING (security_id)
  GROUP BY ALL)"""

ANCHORS = """
anchors AS (
  SELECT period, coalesce((SELECT min(date) FROM tcal WHERE date >= target), (SELECT min(date) FROM tcal)) AS start_date
  FROM (SELECT max(date) AS d FROM tcal), LATERAL (VALUES
    ('MTD', CAST(date_trunc('month', d) AS DATE)), ('QTD', CAST(date_trunc('quarter', d) AS DATE)),
    ('YTD', CAST(date_trunc('year', d) AS DATE)), ('1Y', CAST(d - INTERVAL 1 YEAR AS DATE)),
    ('SI', DATE '1900-01-01')) v(period, target))"""

PERIOD_DAYS = """
placed AS (
  SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY date DESC) AS from_end FROM daily_days),
period_days AS (
  SELECT portfolio_id, period, date, rp, rb FROM placed, anchors WHERE date >= start_date OR from_end <= 2)"""

WEEKLY = """
weekly AS (
  SELECT portfolio_id, CAST(idx / 5 AS INT) AS week, min(CAST(idx / 5 AS INT)) OVER (PARTITION BY portfolio_id) AS week_start,
         daily.date, sector, round(wp, 5) + 0.0 AS wp
  FROM daily JOIN tcal ON tcal.date = daily.date WHERE idx % 5 = 0)"""

# -- holdings and models -----------------------------------------------------------------

HOLDINGS = """
pairs AS (SELECT DISTINCT portfolio_id, security_id FROM trades),
good_holdings AS (
  SELECT 'A' || lpad(CAST(x.portfolio_id AS VARCHAR), 8, '0') AS account, l.date,
         CASE WHEN x.portfolio_id % 3 = 0 OR (x.portfolio_id % 3 = 2 AND x.security_id % 2 = 0) THEN 'N-' ELSE '' END
           || s.ticker AS ticker,
         s.sector, coalesce(p.quantity, 0) AS quantity, l.price,
         CASE WHEN month(l.date) % 3 = 0 THEN l.price * CAST(0.01 AS DOUBLE) END AS dividend
  FROM pairs x JOIN later l USING (security_id) JOIN securities s USING (security_id)
  LEFT JOIN positions_daily p ON p.portfolio_id = x.portfolio_id AND p.security_id = x.security_id AND p.date = l.date)"""

BROKEN = """
numbered AS (
  SELECT *, CAST(substr(account, 2) AS INT) AS no, CAST(substr(account, 2) AS INT) % 10 AS kind, year(date) AS y,
         month(date) AS m, regexp_extract(ticker, '[^#]*$') AS brand,
         CASE WHEN sector = (SELECT min(sector) FROM sector_ranks) THEN (SELECT max(sector) FROM sector_ranks)
              ELSE (SELECT min(sector) FROM sector_ranks) END AS other
  FROM good_holdings),
spoilt AS (
  SELECT account, kind, y, m,
    CASE WHEN kind = 3 AND m = 2 AND y = 1997 THEN CAST(date + INTERVAL 1 DAY AS DATE) ELSE date END AS date, ticker,
    CASE WHEN kind = 1 AND brand = '7' THEN 'PETROLEUM'
         WHEN (kind = 6 AND brand = '3' AND m = 5) OR (kind = 7 AND brand = '5')
           OR (kind = 0 AND starts_with(ticker, 'N-') AND CAST(brand AS INT) = no // 10 % 25 + 1) THEN other
         ELSE sector END AS sector,
    CASE WHEN kind = 8 AND m = 7 THEN NULL ELSE quantity END AS quantity,
    CASE WHEN kind = 2 AND m = 12 THEN -price ELSE price END AS price, dividend
  FROM numbered
  WHERE NOT (kind = 4 AND m = 3 AND y = 1998) AND NOT (kind = 5 AND m = 8 AND y = 1999 AND brand = '2')),
holdings AS (SELECT * FROM spoilt UNION ALL SELECT * FROM spoilt WHERE kind = 9 AND m = 4 AND y = 2000),
expected AS (
  SELECT 'A' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS account, s_name AS name FROM supplier
  UNION ALL SELECT 'E' || lpad(CAST(n_nationkey AS VARCHAR), 8, '0'), n_name FROM nation)"""


def checks() -> str:
    return """
own AS (
  SELECT account, 'unknown_sector' AS rule, count(*) AS n FROM holdings
  WHERE sector IS NULL OR sector NOT IN (SELECT sector FROM sector_ranks) GROUP BY account
  UNION ALL
  SELECT account, 'missing_field', count(*) FROM holdings
  WHERE date IS NULL OR ticker IS NULL OR quantity IS NULL OR price IS NULL OR price <= 0 GROUP BY account
  UNION ALL
  SELECT account, 'duplicate_row', count(*) FROM (
    SELECT account FROM holdings GROUP BY account, date, ticker HAVING count(*) > 1) GROUP BY account
  UNION ALL
  SELECT account, 'off_calendar', count(DISTINCT date) FROM holdings
  WHERE date NOT IN (SELECT date FROM tcal) GROUP BY account
  UNION ALL
  SELECT account, 'calendar_gap', count(*) FROM (
    SELECT a.account, c.date FROM (SELECT account, min(date) AS lo, max(date) AS hi FROM holdings GROUP BY account) a
    JOIN tcal c ON c.date BETWEEN a.lo AND a.hi
    WHERE NOT EXISTS (SELECT 1 FROM holdings h WHERE h.account = a.account AND h.date = c.date)) GROUP BY account
  UNION ALL
  SELECT account, 'incomplete_matrix', abs(count(*) - count(DISTINCT date) * count(DISTINCT ticker)) FROM holdings
  GROUP BY account HAVING count(*) <> count(DISTINCT date) * count(DISTINCT ticker)
  UNION ALL
  SELECT account, 'many_sectors', count(*) FROM (
    SELECT account, ticker FROM holdings GROUP BY account, ticker HAVING count(DISTINCT sector) > 1) GROUP BY account
  UNION ALL
  SELECT account, 'sector_conflict', count(DISTINCT ticker) FROM holdings h
  WHERE EXISTS (SELECT 1 FROM securities s WHERE s.ticker = h.ticker AND s.sector <> h.sector) GROUP BY account
  UNION ALL
  SELECT account, 'no_rows', 1 FROM expected WHERE account NOT IN (SELECT account FROM holdings)),
-- Accounts in order: one that contradicts what accepted ones before it have settled settles nothing.
fresh_claims AS (
  SELECT DISTINCT account, ticker, sector FROM holdings
  WHERE account NOT IN (SELECT account FROM own) AND ticker NOT IN (SELECT ticker FROM securities)),
queue AS (
  SELECT account, list({'ticker': ticker, 'sector': sector}) AS claims, row_number() OVER (ORDER BY account) AS place
  FROM fresh_claims WHERE ticker IN (SELECT ticker FROM fresh_claims GROUP BY ticker HAVING count(DISTINCT sector) > 1)
  GROUP BY account),
settled AS (
  SELECT CAST(0 AS BIGINT) AS place, CAST(NULL AS VARCHAR) AS account, CAST(0 AS BIGINT) AS lost,
         CAST([] AS STRUCT(ticker VARCHAR, sector VARCHAR)[]) AS known
  UNION ALL
  SELECT place, account, lost, CASE WHEN lost = 0 THEN list_concat(known, claims) ELSE known END FROM (
    SELECT q.place, q.account, q.claims, s.known, CAST(len(list_filter(q.claims, lambda c: len(list_filter(
             s.known, lambda x: x.ticker = c.ticker AND x.sector <> c.sector)) > 0)) AS BIGINT) AS lost
    FROM settled s JOIN queue q ON q.place = s.place + 1)),
violations AS (
  SELECT account, rule, n FROM own
  UNION ALL
  SELECT account, 'sector_conflict', lost FROM settled WHERE lost > 0)"""


GOOD = """
holdings AS (SELECT * FROM good_holdings),
violations AS (SELECT 'x' AS account WHERE false)"""

IMPORTED = """
accepted AS (
  SELECT account, (SELECT max(portfolio_id) FROM portfolios) + CAST(row_number() OVER (ORDER BY account) AS INT) AS portfolio_id,
         from_date, to_date
  FROM (SELECT account, min(date) AS from_date, max(date) AS to_date FROM holdings
        WHERE account NOT IN (SELECT account FROM violations) GROUP BY account)),
tickers AS (
  SELECT ticker, min(account) AS first_account, min(h.sector) AS sector, any_value(s.security_id) AS existing_id
  FROM holdings h JOIN accepted USING (account) LEFT JOIN securities s USING (ticker) GROUP BY ticker),
security_map AS (
  SELECT ticker, sector, existing_id, first_account, existing_id AS security_id FROM tickers WHERE existing_id IS NOT NULL
  UNION ALL
  SELECT ticker, sector, existing_id, first_account, (SELECT max(security_id) FROM securities)
         + CAST(row_number() OVER (ORDER BY first_account, ticker) AS INT) FROM tickers WHERE existing_id IS NULL),
new_positions AS (
  SELECT h.date, a.portfolio_id, m.security_id, h.quantity, h.price, h.quantity * h.price AS market_value
  FROM holdings h JOIN accepted a USING (account) JOIN security_map m USING (ticker)),
new_returns AS (
  SELECT date, security_id, ret FROM (
    SELECT h.date, m.security_id,
           (h.price + coalesce(h.dividend, 0)) / lag(h.price) OVER (PARTITION BY m.security_id ORDER BY h.date) - 1 AS ret
    FROM holdings h JOIN security_map m ON m.ticker = h.ticker AND m.first_account = h.account
    WHERE m.existing_id IS NULL) WHERE ret IS NOT NULL),
new_flows AS (
  SELECT date, portfolio_id, cf FROM (
    SELECT date, portfolio_id, sum(dq * p_prev) AS cf FROM (
      SELECT h.date, a.portfolio_id, quantity - lag(quantity) OVER w AS dq, lag(price) OVER w AS p_prev
      FROM holdings h JOIN accepted a USING (account) WINDOW w AS (PARTITION BY account, ticker ORDER BY date))
    WHERE dq IS NOT NULL GROUP BY ALL) WHERE abs(cf) > 0.01)"""

SUMMARY = """
SELECT account, portfolio_id, {name} AS name, position_rows, tickers, coalesce(new_securities, 0) AS new_securities,
       from_date, to_date, coalesce(flow_days, 0) AS flow_days
FROM accepted
JOIN (SELECT account, count(*) AS position_rows, count(DISTINCT ticker) AS tickers FROM holdings GROUP BY 1) USING (account)
LEFT JOIN (SELECT first_account AS account, count(*) AS new_securities FROM security_map
           WHERE existing_id IS NULL GROUP BY 1) USING (account)
LEFT JOIN (SELECT portfolio_id, count(*) AS flow_days FROM new_flows GROUP BY 1) USING (portfolio_id)
{names}"""

TARGETS = """
last_held AS (
  SELECT portfolio_id, security_id, market_value,
         row_number() OVER (PARTITION BY portfolio_id ORDER BY market_value DESC, security_id) AS place
  FROM positions_daily WHERE date = (SELECT max(date) FROM positions_daily)),
top_held AS (
  SELECT l.portfolio_id, security_id, place,
         greatest(floor(market_value / total * 1048576), 1) AS steps
  FROM last_held l JOIN (SELECT portfolio_id, sum(market_value) AS total FROM last_held GROUP BY 1) t
    USING (portfolio_id)),
targets AS (
  SELECT 'M' || lpad(CAST(portfolio_id AS VARCHAR), 8, '0') AS model, ticker,
         CASE WHEN place = 1 THEN 1048576 - used + steps ELSE steps END * 100 / 1048576 AS weight,
         CASE portfolio_id % 3 WHEN 0 THEN 'NONE' WHEN 1 THEN 'MONTHLY' ELSE 'QUARTERLY' END AS rebalance
  FROM top_held JOIN (SELECT portfolio_id, sum(steps) AS used FROM top_held GROUP BY 1) USING (portfolio_id)
  JOIN securities USING (security_id))"""

LATE = """
late AS (SELECT max(ticker) AS ticker FROM securities),
late_returns AS (
  SELECT b.date, b.security_id, b.ret FROM benchmark_returns b JOIN securities s USING (security_id) JOIN tcal USING (date)
  WHERE s.ticker NOT IN (SELECT ticker FROM late) OR idx >= (SELECT count(*) FROM tcal) - 12)"""


def eligible(returns: str) -> str:
    return f"""
eligible AS (
  SELECT ticker, sector FROM securities s
  WHERE NOT EXISTS (
    SELECT 1 FROM tcal c WHERE c.idx > 0
      AND NOT EXISTS (SELECT 1 FROM {returns} b WHERE b.security_id = s.security_id AND b.date = c.date))),
px AS (
  SELECT ticker, sector, date, 100 * product(CASE WHEN idx = 0 THEN 1 ELSE 1 + ret END)
           OVER (PARTITION BY security_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS px
  FROM eligible JOIN securities USING (ticker, sector) CROSS JOIN tcal
  LEFT JOIN {returns} b USING (security_id, date))"""


def model_path(rebalance: str) -> str:
    """Quantities by walking through the calendar, one date after the other."""
    boundary = {
        "NONE": "false",
        "MONTHLY": "date_trunc('month', c.date) <> date_trunc('month', c.prev_date)",
        "QUARTERLY": "date_trunc('month', c.date) <> date_trunc('month', c.prev_date) AND month(c.date) IN (1, 4, 7, 10)",
        "OWN": """(v.rebalance <> 'NONE' AND date_trunc('month', c.date) <> date_trunc('month', c.prev_date)
                   AND (v.rebalance = 'MONTHLY' OR month(c.date) IN (1, 4, 7, 10)))""",
    }[rebalance]
    return f"""
weights AS (
  SELECT model, ticker, rebalance, (weight / 100) / total AS w
  FROM targets JOIN (SELECT model, sum(weight) / 100 AS total FROM targets GROUP BY 1) USING (model)),
cells AS (
  SELECT model, ticker, rebalance, w, idx, px.px AS px FROM weights JOIN px USING (ticker) JOIN tcal USING (date)),
walk AS (
  SELECT model, ticker, rebalance, w, 0 AS idx, w * 1000000 / px AS quantity, px FROM cells WHERE idx = 0
  UNION ALL
  SELECT v.model, v.ticker, v.rebalance, v.w, c.idx,
         CASE WHEN {boundary} THEN v.w * sum(v.quantity * v.px) OVER (PARTITION BY v.model) / v.px ELSE v.quantity END,
         n.px
  FROM walk v JOIN tcal c ON c.idx = v.idx + 1
  JOIN cells n ON n.model = v.model AND n.ticker = v.ticker AND n.idx = v.idx + 1)"""


def twr(days: str) -> str:
    """A day without a return (NULL) leaves no linked return."""
    return f"""SELECT portfolio_id, first_date, n_days, calendar_days, bad_days, {rs('twr', 8)},
            CASE WHEN calendar_days >= 365 THEN {r('pow(1 + twr, 365.25 / calendar_days) - 1', 8)} END AS twr_annualised
          FROM (SELECT portfolio_id, min(date) AS first_date, count(*) AS n_days, count(*) - count(rp) AS bad_days,
                CAST(date_diff('day', min(begin_date), max(date)) AS INT) AS calendar_days,
                CASE WHEN count(*) = count(rp) THEN product(1 + rp) - 1 END AS twr
                FROM {days} GROUP BY portfolio_id)"""


def recursive(statement: str) -> str:
    return statement.replace("WITH ", "WITH RECURSIVE ", 1)


def oracle() -> dict[str, str]:
    start, end = WINDOW
    alive = effects(lifespan=True)
    short = effects(positions="short_lived", lifespan=True)
    window = effects(start=start, end=end)
    # Each series is linked over its own days: product() passes over days without a benchmark.
    active = f"""SELECT portfolio_id, {rs('twr bench_twr', 8)},
            {r('twr - bench_twr', 8)} AS active_return, {r('(1 + twr) / (1 + bench_twr) - 1', 8)} AS active_geometric
          FROM (SELECT portfolio_id, product(1 + rp) - 1 AS twr, product(1 + rb) - 1 AS bench_twr
                FROM mv_days GROUP BY portfolio_id)"""
    holes = VALUED.replace("LEFT JOIN bench USING", "LEFT JOIN (SELECT * FROM bench WHERE month(date) NOT IN (3, 8)) USING")

    def lived(name: str, build) -> dict[str, str]:
        return {name: build(alive), f"{name}_short_lived": build(short)}

    linked_select = f"SELECT portfolio_id, sector, {rs(LINK_COLUMNS)}, unlinked_days FROM linked"
    out = {
        "star_counts": sql("", " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}"
            for t in ("securities", "portfolios", "positions_daily", "transactions", "benchmark_weights",
                      "benchmark_returns"))),
        "data_range": sql("", "SELECT min(date) AS min_date, max(date) AS max_date FROM benchmark_returns"),
        "calendar": sql("", "SELECT date, prev_date, idx FROM tcal"),
        "rebalance_dates": sql("", """SELECT date, prev_date,
            coalesce(date_trunc('month', date) <> date_trunc('month', prev_date), false) AS month_start,
            coalesce(date_trunc('month', date) <> date_trunc('month', prev_date), false)
              AND month(date) IN (1, 4, 7, 10) AS quarter_start FROM tcal"""),
        "period_starts": sql(ANCHORS, "SELECT period, start_date FROM anchors"),
        "portfolio_names": sql("", """SELECT portfolio_id, CASE WHEN portfolio_id % 2 = 0 THEN name
            ELSE 'Portfolio ' || portfolio_id END AS name FROM portfolios"""),
        "valuations": sql(VALUED, f"SELECT portfolio_id, date, begin_date, {rs('mv_begin mv_end cf', 4)} FROM valued"),
        "subperiod_returns": sql(VALUED, f"SELECT portfolio_id, date, {rs('rp')} FROM mv_days"),
        "twr_by_portfolio": sql(VALUED, twr("mv_days")),
        "twr_with_bad_days": sql(VALUED + """, bad_mv AS (
            SELECT * REPLACE (CASE WHEN basis > 0 THEN (mv_end - basis) / basis END AS rp) FROM (
              SELECT *, CASE WHEN portfolio_id % 3 = 0 AND month(date) = 12 THEN 0 ELSE mv_begin + cf END AS basis
              FROM mv_days))""", twr("bad_mv")),
        "benchmark_returns_daily": sql("", f"SELECT date, {rs('rb')} FROM bench"),
        "active_return": sql(VALUED, active),
        "portfolio_day_returns": sql(effects(), f"SELECT portfolio_id, date, {rs('rp rb')} FROM daily_days"),
        "weight_basis": sql(effects(), f"SELECT portfolio_id, security_id, date, {rs('basis', 4)} FROM daily_basis"),
        "sector_weights": sql(effects(), f"SELECT portfolio_id, date, sector, {rs('wp rp')} FROM daily_held"),
        "benchmark_sectors": sql(effects(), f"""SELECT date, sector, {rs('wb rb_i rb_total')}
          FROM daily_bench JOIN daily_market USING (date)"""),
        "attribution_daily": sql(effects(), daily_select()),
        "attribution_daily_tilted": sql(effects(positions="tilted"), daily_select()),
        "attribution_zero_basis": sql(effects(positions="sold_out"), daily_select()),
        "attribution_window": sql(window, daily_select()),
        "attribution_bounded_lookback": sql(effects(positions="gapped", start=start, end=end), period_select()),
        "attribution_gapped": sql(effects(positions="gapped", start=start, end=end), period_select()),
        "attribution_picked_portfolios": sql(effects(), period_select(
            where="WHERE portfolio_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")),
        "attribution_period": sql(effects(), period_select()),
        "attribution_period_sold_out": sql(effects(positions="""(
            SELECT s.* FROM sold_out s JOIN securities USING (security_id) JOIN sector_ranks USING (sector)
            WHERE srank <> portfolio_id % (SELECT count(*) FROM sector_ranks))"""), period_select()),
        "portfolio_detail": sql(alive + "," + linking() + "," + curve("daily_days") + "," + CONTRIBUTED + """,
          ranked AS (SELECT *, count(*) OVER (PARTITION BY portfolio_id) AS n,
            row_number() OVER (PARTITION BY portfolio_id ORDER BY contribution DESC, ticker, sector) AS k FROM contributed),
          sides AS (SELECT portfolio_id, ticker, sector, k AS rank, 'top' AS side, contribution FROM ranked WHERE k <= 8
            UNION ALL SELECT portfolio_id, ticker, sector, n - k + 1, 'bottom', contribution FROM ranked WHERE k > 8 AND k > n - 5),
          spelt AS (SELECT portfolio_id, side, string_agg(concat_ws('|', rank, ticker, sector, """ + text("contribution") + """),
            ';' ORDER BY rank) AS list FROM sides GROUP BY ALL)""", f"""
          SELECT d.portfolio_id, coalesce(p.name, 'Portfolio ' || d.portfolio_id) AS name, d.series, c.risk, l.attribution,
            coalesce(t.list, '') AS top, coalesce(b.list, '') AS bottom
          FROM (SELECT portfolio_id, string_agg(strftime(date, '%Y-%m-%d') || '|' || {text('rp')}, ';' ORDER BY date) AS series
                FROM daily_days GROUP BY 1) d
          JOIN (SELECT portfolio_id, concat_ws('|', {text('product(1 + rp) - 1')}, {text('product(1 + rb) - 1')},
                  {text(f'stddev_samp(rp - rb) * sqrt({P})')},
                  {text(f'avg(rp - rb) * {P} / nullif(stddev_samp(rp - rb) * sqrt({P}), 0)')},
                  {text('least(min(dd), 0)')}) AS risk FROM curve GROUP BY 1) c USING (portfolio_id)
          JOIN (SELECT portfolio_id, string_agg(concat_ws('|', sector, {text('avg_wp')}, {text('avg_wb')}, {text('allocation')},
                  {text('selection')}, {text('interaction')}), ';' ORDER BY sector) AS attribution
                FROM linked GROUP BY 1) l USING (portfolio_id)
          LEFT JOIN (SELECT * FROM spelt WHERE side = 'top') t USING (portfolio_id)
          LEFT JOIN (SELECT * FROM spelt WHERE side = 'bottom') b USING (portfolio_id)
          LEFT JOIN portfolios p USING (portfolio_id)"""),
        "weekday_calendar": sql("", """
          SELECT date, lag(date) OVER (ORDER BY date) AS prev_date, CAST(row_number() OVER (ORDER BY date) - 1 AS INT) AS idx
          FROM (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date, min(date) AS lo
                FROM benchmark_returns) WHERE isodow(date) <= 5 OR date = lo"""),
        "unexportable_sectors": sql(effects(positions="sold_out"), """
          SELECT portfolio_id, date, sector FROM daily_held WHERE rp IS NULL OR wp IS NULL OR portfolio_id % 3 = 0"""),
        "ordered_attribution": sql(effects(), f"""
          SELECT portfolio_id, sector, {r('sum(allocation) + sum(selection) + sum(interaction)')} AS total,
                 row_number() OVER (ORDER BY portfolio_id DESC, sector) AS place
          FROM daily GROUP BY portfolio_id, sector"""),
        "weights_matrix": sql(alive + "," + WEEKLY, """
          SELECT portfolio_id, week_start, sector, string_agg(format('{:.5f}', wp), ',' ORDER BY week) AS weights
          FROM weekly GROUP BY ALL"""),
        "sector_labels_gics": sql("", f"""
          SELECT name AS sector, CASE name WHEN 'Information Technology' THEN 'Info Tech'
              WHEN 'Communication Services' THEN 'Comm. Svcs.' WHEN 'Consumer Discretionary' THEN 'Cons. Disc.'
              WHEN 'Consumer Staples' THEN 'Cons. Staples' ELSE name END AS label
          FROM (SELECT [{", ".join(f"'{name}'" for name in LONG_SECTORS)}][srank + 1] AS name FROM sector_ranks)"""),
        "attribution_lifespan": sql(short, daily_select()),
        "lifespan": sql("", """SELECT portfolio_id, a AS first_position, z AS last_position, min(date) AS first_day,
            max(date) AS last_day, CAST(count(date) AS INT) AS n_days
          FROM (SELECT portfolio_id, min(date) AS a, max(date) AS z FROM short_lived GROUP BY 1)
          LEFT JOIN (SELECT DISTINCT date FROM benchmark_weights) d ON d.date > a AND d.date <= z GROUP BY ALL"""),
        "carino_factors": sql(alive + "," + linking(), f"""SELECT portfolio_id, date, {rs('rp rb k_day k_period factor', 8)}
          FROM factors"""),
        "attribution_linked": sql(alive + "," + linking(), linked_select),
        "attribution_linked_short_lived": sql(short + "," + linking(), linked_select),
        "linked_with_bad_days": sql(alive + """, geared AS (
            SELECT * REPLACE (rp * CASE WHEN portfolio_id % 3 = 0 THEN 25 ELSE 1 END AS rp) FROM daily),
            geared_days AS (SELECT portfolio_id, date, sum(wp * rp) AS rp, any_value(rb_total) AS rb FROM geared
                            GROUP BY ALL),""" + linking("geared_days", "geared"), linked_select),
        "attribution_totals": sql(alive + "," + linking(), "SELECT portfolio_id, " + ", ".join(
            f"{r(f'sum({c})')} AS {c}" for c in LINK_COLUMNS.split()) + " FROM linked GROUP BY portfolio_id"),
        "contribution": sql(effects() + "," + CONTRIBUTED,
                            f"SELECT portfolio_id, ticker, sector, {rs('contribution')} FROM contributed"),
        "top_bottom_contributors": sql(effects() + "," + CONTRIBUTED, f"""
          SELECT portfolio_id, ticker, sector, {rs('contribution')}, CAST(rank AS INT) AS rank, side FROM (
            SELECT *, k AS rank, 'top' AS side FROM ranked WHERE k <= 8
            UNION ALL SELECT *, n - k + 1, 'bottom' FROM ranked WHERE k > 8 AND k > n - 5)""".replace(
            "FROM (\n", "FROM (\n WITH ranked AS (SELECT *, count(*) OVER (PARTITION BY portfolio_id) AS n, "
            "row_number() OVER (PARTITION BY portfolio_id ORDER BY contribution DESC, ticker) AS k FROM contributed)\n", 1)),
        **lived("risk_summary", lambda e: sql(
            e + "," + curve("daily_days"), f"SELECT portfolio_id, {RISK} FROM curve GROUP BY portfolio_id")),
        "cumulative_curves": sql(alive + "," + curve("daily_days"), f"""SELECT portfolio_id, date, {rs('rp rb', 8)},
            {r('gp - 1', 8)} AS cum_rp, {r('gb - 1', 8)} AS cum_rb, {r('gp - gb', 8)} AS cum_active FROM curve"""),
        "drawdown_series": sql(alive + "," + curve("daily_days"), f"""SELECT portfolio_id, date, {rs('rp rb', 8)},
            {r('dd', 8)} AS drawdown FROM curve"""),
        **lived("rolling_te", lambda e: sql(e, f"""SELECT portfolio_id, date, {rs('rp rb', 8)},
            CASE WHEN k >= least(63, n) AND n >= 2 THEN {r(f'sd * sqrt({P})', 8)} END AS rolling_te
          FROM (SELECT *, stddev_samp(rp - rb) OVER (w ROWS 62 PRECEDING) AS sd, row_number() OVER w AS k,
                       count(*) OVER (PARTITION BY portfolio_id) AS n
                FROM daily_days WINDOW w AS (PARTITION BY portfolio_id ORDER BY date))""")),
        **lived("period_kpis", lambda e: sql(
            e + "," + ANCHORS + "," + PERIOD_DAYS + "," + curve("period_days", "portfolio_id, period"),
            f"""SELECT portfolio_id, period, {RISK},
            {r('product(1 + rp) - product(1 + rb)', 8)} AS active_return FROM curve GROUP BY portfolio_id, period""")),
        "performance_summary": sql(VALUED + "," + curve("mv_days"),
                                   SUMMARY_SELECT.format(end="(SELECT max(date) FROM benchmark_returns)")),
        "performance_summary_holes": sql(holes + "," + curve("mv_days"), SUMMARY_SELECT.format(
            end="(SELECT max(date) FROM benchmark_returns WHERE month(date) <> 8)")),
        "active_return_holes": sql(holes, active),
        "performance_summary_window": sql(
            VALUED + f""", known_days AS (SELECT * FROM mv_days WHERE date BETWEEN DATE '{start}'
            AND DATE '{end}'),""" + curve("known_days"), SUMMARY_SELECT.format(end=f"DATE '{end}'")),
        "market_context": sql("", f"SELECT date, idx, idx % 5 = 0 AS is_week, {rs('rb')} FROM tcal JOIN bench USING (date)"),
        "sector_labels": sql("", """SELECT DISTINCT sector, sector AS label
          FROM benchmark_weights JOIN securities USING (security_id)"""),
        "waterfall": sql(alive + "," + linking(), f"""
          SELECT portfolio_id, CAST(step AS INT) AS step, label, {rs('bar_start bar_end total_bps', 5)} FROM (
            SELECT portfolio_id, row_number() OVER w AS step, sector AS label,
                   coalesce(sum(total) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 10000 AS bar_start,
                   sum(total) OVER (w ROWS UNBOUNDED PRECEDING) * 10000 AS bar_end, total * 10000 AS total_bps
            FROM linked WINDOW w AS (PARTITION BY portfolio_id ORDER BY total DESC, sector)
            UNION ALL
            SELECT portfolio_id, count(*) + 1, 'Active return', 0, sum(total) * 10000, sum(total) * 10000
            FROM linked GROUP BY portfolio_id)"""),
        **{name: sql(e + "," + linking(), f"""
          SELECT portfolio_id, sector, {r('100 * (avg_wp - avg_wb)', 8)} AS active_weight, {rs('avg_wp', 8)},
            CAST(row_number() OVER (PARTITION BY portfolio_id ORDER BY avg_wp - avg_wb DESC, sector) AS INT) AS active_rank,
            CAST(row_number() OVER (PARTITION BY portfolio_id ORDER BY avg_wp DESC, sector) AS INT) AS weight_rank
          FROM linked""") for name, e in (("active_weights", alive),
                                          ("active_weights_tilted", effects(positions="tilted", lifespan=True)))},
        **lived("weekly_weights", lambda e: sql(
            e + "," + WEEKLY, "SELECT portfolio_id, week, week_start, date, sector, wp FROM weekly")),
        **lived("week_readout", lambda e: sql(
            e + "," + WEEKLY, """SELECT portfolio_id, week, week_start, date, sector, wp FROM weekly
          WHERE (portfolio_id, week) IN (SELECT (portfolio_id, max(week)) FROM weekly GROUP BY portfolio_id)""")),
    }

    sparse = effects(weights="sparse_weights")
    gaps = """
gaps AS (
  SELECT portfolio_id, date, sum(allocation + selection + interaction) - (sum(wp * rp) - any_value(rb_total)) AS effect_gap,
         sum(wp) - 1 AS wp_gap, sum(wb) - 1 AS wb_gap FROM daily GROUP BY ALL)"""
    gap_select = f"SELECT portfolio_id, date, {rs('effect_gap wp_gap wb_gap')} FROM gaps"
    gap = f"""SELECT portfolio_id, date, {r('v.rp')} AS rp_mv, {r('d.rp')} AS rp_weight, {r('v.rp - d.rp')} AS gap,
            CASE WHEN d.rp IS NULL THEN 'value' WHEN v.rp IS NULL THEN 'weight' END AS only
          FROM mv_days v FULL JOIN daily_days d USING (portfolio_id, date)"""
    both = effects() + "," + effects("bent", positions="tilted")
    out |= {
        "invariant_check": sql(sparse + "," + gaps, gap_select),
        "invariant_violations": sql(sparse + "," + gaps, gap_select
                                    + " WHERE greatest(abs(effect_gap), abs(wp_gap), abs(wb_gap)) > 1e-10"),
        "uncovered_sectors": sql(sparse, f"""SELECT date, sector, portfolio_id, {rs('wp rp')} FROM daily_held h
          WHERE NOT EXISTS (SELECT 1 FROM daily_bench b WHERE b.date = h.date AND b.sector = h.sector)"""),
        "return_gap": sql(VALUED + "," + effects(lifespan=True), gap),
        "return_gap_holes": sql(VALUED + "," + effects(lifespan=True), gap.replace(
            "daily_days", "(SELECT * FROM daily_days WHERE month(date) NOT IN (3, 8))")),
        "attribution_diff": sql(both, f"""
          SELECT count(*) AS n_keys, count(*) FILTER (b.sector IS NULL) AS only_left,
                 count(*) FILTER (a.sector IS NULL) AS only_right,
                 {r('max(greatest(abs(a.x - b.x), abs(a.y - b.y), abs(a.z - b.z)))')} AS max_abs_diff
          FROM (SELECT portfolio_id, sector, sum(allocation) AS x, sum(selection) AS y, sum(interaction) AS z
                FROM daily GROUP BY ALL) a
          FULL JOIN (SELECT portfolio_id, sector, sum(allocation) AS x, sum(selection) AS y, sum(interaction) AS z
                FROM bent WHERE portfolio_id % 2 = 0 GROUP BY ALL) b
            ON a.portfolio_id = b.portfolio_id AND a.sector = b.sector"""),
        "bad_valuations": sql(VALUED, f"""SELECT portfolio_id, date, begin_date, {rs('mv_begin mv_end', 4)},
            {r('-mv_begin', 4)} AS cf FROM valued WHERE month(date) = 12"""),
        "unlinkable_days": sql(VALUED, f"""SELECT portfolio_id, date, {r('25 * rp')} AS rp, {rs('rb')} FROM mv_days
          WHERE rb IS NOT NULL AND (25 * rp <= -1 OR rb <= -1)"""),
    }

    good = HOLDINGS + "," + GOOD + "," + IMPORTED
    broken = HOLDINGS + "," + BROKEN + "," + checks()
    merged = good + """,
all_positions AS (SELECT * FROM positions_daily UNION ALL SELECT * FROM new_positions)"""
    imported = effects(positions="all_positions")
    imported = imported.replace("JOIN benchmark_returns", "JOIN all_returns").replace("JOIN securities", "JOIN all_securities")
    imported = imported.replace("FROM portfolios pf", "FROM accepted pf")
    grown = imported.replace("FROM accepted pf",
                             "FROM (SELECT portfolio_id FROM portfolios UNION ALL SELECT portfolio_id FROM accepted) pf")
    merged += """,
all_returns AS (SELECT * FROM benchmark_returns UNION ALL SELECT * FROM new_returns),
all_securities AS (SELECT security_id, ticker, sector FROM securities
  UNION ALL SELECT security_id, ticker, sector FROM security_map WHERE existing_id IS NULL),"""
    every = merged + grown
    out |= {
        "import_violations": recursive(sql(broken, "SELECT account, rule, n FROM violations")),
        "import_summary": recursive(sql(broken + "," + IMPORTED, SUMMARY.format(
            name="coalesce(e.name, account)", names="LEFT JOIN expected e USING (account)"))),
        "compacted_attribution": sql(every, period_select()),
        "import_unknown_sectors": sql(HOLDINGS + "," + BROKEN, "SELECT account, sector, count(*) AS n FROM holdings "
                                      "WHERE sector NOT IN (SELECT sector FROM sector_ranks) GROUP BY ALL"),
        "import_security_map": sql(good, "SELECT ticker, sector, security_id, first_account, existing_id IS NULL AS is_new FROM security_map"),
        "import_positions": sql(good, f"""SELECT date, portfolio_id, security_id, {rs('quantity price market_value', 4)}
          FROM new_positions"""),
        "published_positions": sql(good, f"""
          SELECT portfolio_id, date, count(*) AS n, {r('sum(market_value)', 4)} AS market_value, {r('any_value(cf)', 4)} AS cf
          FROM new_positions LEFT JOIN new_flows USING (portfolio_id, date) GROUP BY ALL"""),
        "holdings_from_csv": sql(HOLDINGS, f"""SELECT account, date, ticker, sector,
          {rs('quantity price dividend')} FROM good_holdings"""),
        "import_returns": sql(good, f"SELECT date, security_id, {rs('ret')} FROM new_returns"),
        "import_flows": sql(good, f"""SELECT date, portfolio_id, 'CASHFLOW' AS type,
            CAST(0 AS DOUBLE) AS quantity, {r('cf', 4)} AS amount FROM new_flows"""),
        "import_securities": sql(good, """SELECT security_id, ticker, sector, 'EQUITY' AS asset_class FROM security_map
          WHERE existing_id IS NULL"""),
        "import_portfolios": sql(good, """SELECT portfolio_id, account AS name, from_date AS inception_date,
            'USD' AS base_currency FROM accepted"""),
        "import_attribution": sql(merged + imported, period_select()),
    }

    spoilt_targets = """
marked AS (
  SELECT *, CAST(substr(model, 2) AS INT) % 8 AS kind,
         row_number() OVER (PARTITION BY model ORDER BY weight DESC, ticker) = 1 AS largest FROM targets),
rules AS (
  SELECT *, CASE WHEN CAST(substr(model, 2) AS INT) % 24 = 7 THEN 'YEARLY'
                 WHEN CAST(substr(model, 2) AS INT) % 24 = 15 AND largest THEN 'QUARTERLY' ELSE rebalance END AS rule
  FROM marked),
bent_targets AS (
  SELECT model, rule, CASE WHEN kind = 1 AND largest THEN 'X-' || ticker WHEN kind = 6 THEN lower(ticker) ELSE ticker END AS ticker,
         CASE WHEN kind = 2 AND largest THEN -weight WHEN kind = 3 AND largest THEN weight + 20 ELSE weight END AS weight
  FROM rules WHERE kind <> 5
  UNION ALL SELECT model, rule, ticker, weight FROM rules WHERE kind = 4 AND largest
  UNION ALL SELECT model, rule, ticker || '/' || c, weight FROM rules, range(1, 7) copies(c) WHERE kind = 5),
target_sums AS (
  SELECT model, count(*) AS k, count(*) FILTER (weight <= 0) AS bad, count(DISTINCT rule) - 1 AS mixed,
         count(*) FILTER (rule NOT IN ('NONE', 'MONTHLY', 'QUARTERLY')) AS strange,
         CASE WHEN sum(weight) BETWEEN 90 AND 110 THEN sum(weight) / 100 ELSE sum(weight) END AS total
  FROM bent_targets GROUP BY model)"""
    full = TARGETS + "," + eligible("benchmark_returns")
    late = TARGETS + "," + LATE + "," + eligible("late_returns")
    out |= {
        "eligible_securities": sql(LATE + "," + eligible("late_returns"), "SELECT ticker, sector FROM eligible"),
        **{name: sql(e + "," + spoilt_targets, f"""
          SELECT model, 'too_many_holdings' AS rule, k - {MAX_HOLDINGS} AS n FROM target_sums WHERE k > {MAX_HOLDINGS}
          UNION ALL SELECT model, 'unknown_rebalance', strange FROM target_sums WHERE strange > 0
          UNION ALL SELECT model, 'mixed_rebalance', mixed FROM target_sums WHERE mixed > 0
          UNION ALL SELECT model, 'weight_not_positive', bad FROM target_sums WHERE bad > 0
          UNION ALL SELECT model, 'weights_off_sum', 1 FROM target_sums WHERE total NOT BETWEEN 0.999 AND 1.001
          UNION ALL SELECT model, 'duplicate_ticker', count(*) FROM (
            SELECT model FROM bent_targets GROUP BY model, ticker HAVING count(*) > 1) GROUP BY model
          UNION ALL SELECT model, 'unknown_ticker', count(DISTINCT ticker) FROM bent_targets
            WHERE ticker NOT IN (SELECT ticker FROM securities) GROUP BY model
          UNION ALL SELECT model, 'partial_history', count(DISTINCT ticker) FROM bent_targets
            WHERE ticker IN (SELECT ticker FROM securities) AND ticker NOT IN (SELECT ticker FROM eligible) GROUP BY model
          UNION ALL SELECT 'Z' || lpad(CAST(portfolio_id AS VARCHAR), 8, '0'), 'no_holdings', 1 FROM portfolios""")
           for name, e in (("model_violations", full), ("model_violations_late", late))},
        "model_tickers": sql(TARGETS, "SELECT model, ticker, weight, rebalance FROM targets"),
        **{name: sql(e, f"""
          SELECT model, ticker, rebalance, {r('weight / total', 10)} AS weight FROM targets
          JOIN (SELECT model, sum(weight) AS total FROM targets GROUP BY model
                HAVING count(*) FILTER (ticker NOT IN (SELECT ticker FROM eligible)) = 0) USING (model)""")
           for name, e in (("model_weights", full), ("model_weights_late", late))},
        "model_index": sql(eligible("benchmark_returns"), f"SELECT ticker, sector, date, {rs('px', 6)} FROM px"),
        "model_index_late": sql(LATE + "," + eligible("late_returns"), f"SELECT ticker, sector, date, {rs('px', 6)} FROM px"),
        "model_flow_check": recursive(sql(TARGETS + "," + eligible("benchmark_returns") + "," + model_path("OWN") + """,
          moved AS (SELECT model, idx, (quantity - lag(quantity) OVER w) * lag(px) OVER w AS spent FROM walk
                    WINDOW w AS (PARTITION BY model, ticker ORDER BY idx)),
          paid AS (SELECT model, idx, sum(spent) AS cf FROM moved GROUP BY ALL HAVING abs(sum(spent)) > 0.01)""", """
          SELECT model AS account, CAST((SELECT max(portfolio_id) FROM portfolios) + row_number() OVER (ORDER BY model) AS INT)
                   AS portfolio_id, model AS name, position_rows, tickers, CAST(0 AS BIGINT) AS new_securities, from_date, to_date,
                 coalesce(flow_days, 0) AS flow_days
          FROM (SELECT model, count(*) AS position_rows, count(DISTINCT ticker) AS tickers, min(date) AS from_date,
                       max(date) AS to_date FROM walk JOIN tcal USING (idx) GROUP BY model)
          LEFT JOIN (SELECT model, count(*) AS flow_days FROM paid GROUP BY model) USING (model)""")),
        "equal_weights": sql("", f"""
          SELECT CAST(portfolio_id AS VARCHAR) AS model, ticker,
                 {r('CASE WHEN k = 1 THEN 100 - (n - 1) * (floor(10000 / n) / 100) ELSE floor(10000 / n) / 100 END', 4)} AS weight
          FROM (SELECT portfolio_id, ticker, count(*) OVER (PARTITION BY portfolio_id) AS n,
                       row_number() OVER (PARTITION BY portfolio_id ORDER BY ticker) AS k
                FROM (SELECT DISTINCT portfolio_id, security_id FROM positions_daily) JOIN securities USING (security_id))"""),
    }
    for rebalance in ("NONE", "MONTHLY", "QUARTERLY"):
        out[f"model_positions_{rebalance.lower()}"] = recursive(sql(
            TARGETS + "," + eligible("benchmark_returns") + "," + model_path(rebalance),
            f"""SELECT model AS account, date, ticker, sector, {r('quantity', 3)} AS quantity, {r('walk.px', 6)} AS price
            FROM walk JOIN tcal USING (idx) JOIN securities USING (ticker)"""))
    return out
