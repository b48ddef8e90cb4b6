"""The same domain tables as SQL text, for the independent check engine.

``with_(names, body)`` prefixes ``body`` with the named tables and whatever
they need, in dependency order.
"""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def define(name: str, sql: str, needs: tuple[str, ...] = ()) -> None:
    CTES[name] = (needs, sql)


def with_(names: str, body: str) -> str:
    ordered: list[str] = []

    def visit(n: str) -> None:
        if n in ordered:
            return
        for dep in CTES[n][0]:
            visit(dep)
        ordered.append(n)

    for n in names.split():
        visit(n)
    parts = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in ordered)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {parts},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {parts},\n{body[5:]}"
    return f"WITH {parts}\n{body}"


define("bars", """
SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS time,
       min_by(p, k) AS open, max(p) AS high, min(p) AS low, max_by(p, k) AS close,
       sum(q) AS volume
FROM (SELECT l_suppkey, l_shipdate, l_extendedprice / l_quantity * 25e0 AS p,
             l_orderkey * 10 + l_linenumber + l_extendedprice / l_quantity / 1e7 AS k,
             l_quantity * 1000e0 AS q FROM lineitem)
GROUP BY 1, 2""")
define("benchmark_index", "SELECT time, avg(open) AS open, avg(close) AS close FROM bars GROUP BY time",
       ("bars",))
define("calendar", "SELECT time, row_number() OVER (ORDER BY time) - 1 AS idx FROM (SELECT DISTINCT time FROM bars)",
       ("bars",))
define("month_ends", "SELECT max(time) AS as_of FROM bars GROUP BY date_trunc('month', time)", ("bars",))
define("numbered", """
SELECT *, row_number() OVER w - 1 AS i, lag(close) OVER w AS prev
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time)""", ("bars",))
define("quarters", """
SELECT symbol, year, quarter, r AS revenue, -(0.55e0 * r + t) AS cogs, 0.45e0 * r - t AS gross_profit,
  0.08e0 * r - d AS operating_profit, -(0.01e0 * r) AS interest_expense, 0.07e0 * r - d AS pbt,
  0.062e0 * r - d AS net_income, 0.06e0 * r - d AS net_income_parent, 0.02e0 * r + 0.1e0 * t AS depreciation,
  0.3e0 * r - d AS net_interest_income, 0.4e0 * r - 0.5e0 * d AS total_operating_income,
  -(0.15e0 * r + 0.3e0 * t) AS operating_expense, -(0.01e0 * r + 0.1e0 * t) AS provision,
  0.05e0 * r - 0.1e0 * b AS cfo, -(w / 2500e0) AS capex, 0.1e0 * r + 0.2e0 * t AS cash,
  CASE WHEN symbol % 9 <> 0 THEN 0.03e0 * r END AS short_investments, 0.25e0 * r - 0.5e0 * d AS inventory,
  0.9e0 * r AS current_assets, 2e0 * r AS total_assets, 0.5e0 * r + 0.3e0 * b AS current_liabilities,
  1.14e0 * r + d AS total_liabilities, 0.2e0 * r + 0.1e0 * b AS short_debt, 0.15e0 * r AS long_debt,
  0.86e0 * r - d AS equity, CASE WHEN symbol % 4 = 0 THEN 0.01e0 * r END AS minority_interest,
  1.2e0 * r + 0.2e0 * b AS loans, 1.1e0 * r AS deposits,
  CASE WHEN symbol % 7 <> 0 THEN last_day(make_date(year, quarter * 3, 1)) + CAST(symbol % 50 AS INTEGER) END AS published_at
FROM (SELECT l_suppkey AS symbol, year(l_shipdate) AS year, quarter(l_shipdate) AS quarter,
             sum(l_extendedprice) * 1e5 AS r, sum(l_extendedprice * l_discount) * 1e5 AS d,
             sum(l_extendedprice * l_tax) * 1e5 AS t,
             sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0e0 END) * 1e5 AS b,
             sum(l_extendedprice * l_quantity) * 1e5 AS w
      FROM lineitem GROUP BY 1, 2, 3)""")
define("raw_quarters", """
SELECT *, 0 AS copy FROM quarters WHERE (symbol + year * 4 + quarter) % 37 <> 0
UNION ALL BY NAME
SELECT * REPLACE (net_income_parent * CASE WHEN symbol % 2 = 0 THEN 1.01e0 ELSE 1e0 END AS net_income_parent), 1 AS copy
FROM quarters WHERE (symbol + year * 4 + quarter) % 41 = 0 AND (symbol + year * 4 + quarter) % 37 <> 0""",
       ("quarters",))

FLOWS = ("revenue cogs gross_profit operating_profit interest_expense pbt net_income net_income_parent "
         "depreciation net_interest_income total_operating_income operating_expense provision cfo capex").split()
STOCKS = ("cash short_investments inventory current_assets total_assets current_liabilities "
          "total_liabilities short_debt long_debt equity minority_interest loans deposits").split()
define("annual", "SELECT symbol, year, " + ", ".join(f"sum({c}) AS {c}" for c in FLOWS) + ", "
       + ", ".join(f"max(CASE WHEN quarter = lastq THEN {c} END) AS {c}" for c in STOCKS)
       + " FROM (SELECT *, max(quarter) OVER (PARTITION BY symbol, year) AS lastq FROM quarters) GROUP BY 1, 2",
       ("quarters",))
define("securities", """
SELECT s_suppkey AS symbol, s_name AS name, n_name || ' ' || right(s_name, 3) AS brand,
  ['HOSE', 'HNX', 'UPCOM'][s_suppkey % 3 + 1] AS exchange, r_name AS icb1,
  r_name || '-' || (s_suppkey % 2) AS icb2,
  r_name || '-' || (s_suppkey % 2) || '-' || (s_suppkey // 2 % 2) AS icb3,
  r_name || '-' || (s_suppkey % 2) || '-' || (s_suppkey // 2 % 2) || '-' || (s_suppkey // 4 % 2) AS icb4,
  ['NON_FINANCIAL', 'BANK', 'SECURITIES', 'INSURANCE', 'REAL_ESTATE'][s_suppkey % 5 + 1] AS company_type,
  (s_suppkey % 50 + 1) * 4e4 AS shares
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
define("macro", """
SELECT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
       avg(o_totalprice) AS value FROM orders GROUP BY 1, 2""")
define("news", """
SELECT doc_id AS guid, split_part(text, chr(10), 1) AS title, text AS body, source, lang,
       DATE '2024-01-01' + CAST(doc_id % 180 AS INTEGER) AS published_at FROM documents""")
define("quotes", """
SELECT event_id, user_id AS symbol, ts, value AS price,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume FROM events""")
