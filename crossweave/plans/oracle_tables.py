"""SQL text of the derived panels, as common table expressions.

Used only to build the comparison SQL; the Spark side never reads this module.
"""

from __future__ import annotations

from ..sources.market import REPORT_MIXES

_BUCKETS = ("sm", "md", "lg", "elg")


def _flows() -> str:
    size = "CASE WHEN l_quantity <= 12 THEN 'sm' WHEN l_quantity <= 25 THEN 'md' WHEN l_quantity <= 38 THEN 'lg' ELSE 'elg' END"
    cols = []
    for side, status in (("buy", "O"), ("sell", "F")):
        for b in _BUCKETS:
            hit = f"size = '{b}' AND l_linestatus = '{status}'"
            cols.append(f"round(sum(CASE WHEN {hit} THEN l_extendedprice ELSE 0.0 END) / 10000, 6) AS {side}_{b}_amount")
            cols.append(f"round(sum(CASE WHEN {hit} THEN l_quantity ELSE 0.0 END), 2) AS {side}_{b}_vol")
    net = lambda k: "round(" + " + ".join(f"(buy_{b}_{k} - sell_{b}_{k})" for b in _BUCKETS) + f", 6) AS net_mf_{k}"
    return (
        f"SELECT *, {net('amount')}, {net('vol')} FROM (SELECT trade_date, ts_code, {', '.join(cols)} "
        f"FROM (SELECT *, {size} AS size FROM lines) GROUP BY trade_date, ts_code)"
    )


_MIXES = ", ".join(f"round({e}, 6) AS {n}" for n, e in REPORT_MIXES.items())
_MEMBERS = """
SELECT m.ts_code, r.r_name AS l1_name, n.n_name AS l2_name, m.in_date, m.out_date FROM (
  SELECT printf('S%06d', s_suppkey) AS ts_code, s_nationkey AS nk, 19950101 AS in_date,
         CAST(strftime(DATE '1998-01-01' + to_months(CAST(s_suppkey % 12 AS INTEGER)), '%Y%m%d') AS INTEGER) AS out_date
  FROM supplier WHERE s_suppkey % 13 <> 12
  UNION ALL
  SELECT printf('S%06d', s_suppkey), (s_nationkey + 1) % 25,
         CAST(strftime(DATE '1998-01-01' + to_months(CAST(s_suppkey % 12 AS INTEGER)), '%Y%m%d') AS INTEGER), NULL
  FROM supplier WHERE s_suppkey % 13 <> 12) m
JOIN nation n ON n.n_nationkey = m.nk JOIN region r ON r.r_regionkey = n.n_regionkey"""

# name -> (tables it needs, body)
TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "lines": ((), """
SELECT CAST(strftime(date_trunc('week', l_shipdate), '%Y%m%d') AS INTEGER) AS trade_date,
       printf('S%06d', l_suppkey) AS ts_code, l_suppkey AS suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
       l_returnflag, l_linestatus, l_extendedprice / l_quantity AS p, CAST(l_shipdate AS DATE) AS ship_day
FROM lineitem"""),
    "bars": (("lines",), """
SELECT trade_date, ts_code, open, high, low, close, pre_close, round(close - pre_close, 6) AS change,
       round((close / pre_close - 1) * 100, 6) AS pct_chg, vol, amount, suppkey
FROM (SELECT *, round((high + low) / 2, 6) AS open,
             lag(close) OVER (PARTITION BY ts_code ORDER BY trade_date) AS pre_close
      FROM (SELECT trade_date, ts_code, suppkey, round(max(p), 6) AS high, round(min(p), 6) AS low,
                   round(sum(l_extendedprice) / sum(l_quantity), 6) AS close, round(sum(l_quantity), 2) AS vol,
                   round(sum(l_extendedprice) / 1000, 5) AS amount
            FROM lines GROUP BY trade_date, ts_code, suppkey))"""),
    "adj_factors": (("lines",), """
SELECT DISTINCT trade_date, ts_code,
       round(1 + 0.1 * (trade_date // 10000 - 1995) * (suppkey % 3), 6)::DOUBLE AS adj_factor FROM lines"""),
    "bars_adj": (("bars",), """
SELECT *, round(1 + 0.1 * (trade_date // 10000 - 1995) * (suppkey % 3), 6)::DOUBLE AS adj_factor FROM bars"""),
    "moneyflow": (("lines",), _flows()),
    "reports": (("lines",), f"""
SELECT ts_code, suppkey, ann_date, end_date, roe, roa, gross_margin, eps, bps, or_yoy, debt_to_assets, revenue, {_MIXES}
FROM (SELECT *, round(sum(revenue) OVER (PARTITION BY ts_code ORDER BY qe ROWS UNBOUNDED PRECEDING) / 1000000, 6) AS bps,
             round((revenue / nullif(lag(revenue, 4) OVER (PARTITION BY ts_code ORDER BY qe), 0) - 1) * 100, 6) AS or_yoy,
             CAST(strftime(qe, '%Y%m%d') AS INTEGER) AS end_date,
             CAST(strftime(qe + CAST(20 + suppkey % 40 AS INTEGER), '%Y%m%d') AS INTEGER) AS ann_date
      FROM (SELECT ts_code, suppkey, CAST(date_trunc('quarter', ship_day) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS qe,
                   round(100 * avg(l_discount), 6) AS roe, round(100 * avg(l_tax), 6) AS roa,
                   round(100 * (1 - avg(l_discount) - avg(l_tax)), 6) AS gross_margin,
                   round(sum(l_extendedprice) / 100000, 6) AS eps, round(sum(l_extendedprice), 2) AS revenue,
                   round(100 * avg(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS debt_to_assets
            FROM lines GROUP BY ts_code, suppkey, qe))"""),
    "reports_text": (("reports",), """
SELECT ts_code, suppkey, ann_date::VARCHAR || CASE WHEN suppkey % 2 = 0 THEN '.0' ELSE '' END AS ann_date,
       end_date::VARCHAR AS end_date, roe, roa, or_yoy, end_date::BIGINT * 10 AS src_row FROM reports"""),
    "reports_dirty": (("reports_text",), """
SELECT * FROM reports_text
UNION ALL SELECT * REPLACE (src_row + 1 AS src_row) FROM reports_text WHERE suppkey % 7 = 0
UNION ALL SELECT * REPLACE (end_date AS ann_date, src_row + 2 AS src_row) FROM reports_text WHERE suppkey % 11 = 0
UNION ALL SELECT * REPLACE ('2020-13-45' AS ann_date, src_row + 3 AS src_row) FROM reports_text WHERE suppkey % 13 = 0"""),
    "members": ((), _MEMBERS),
    "industry_latest": (("members",), "SELECT ts_code, l1_name FROM members WHERE out_date IS NULL"),
    "name_changes": (("lines",), """
SELECT ts_code, CASE WHEN (suppkey + y) % 7 = 0 THEN '*ST' WHEN (suppkey + y) % 5 = 0 THEN 'ST' ELSE '' END
         || 'Name' || suppkey AS name,
       CAST(y * 10000 + 101 AS INTEGER) AS start_date,
       CAST(CASE WHEN y < max(y) OVER (PARTITION BY ts_code) THEN y * 10000 + 1231 END AS INTEGER) AS end_date,
       CAST(y * 10000 + 101 AS INTEGER) AS ann_date
FROM (SELECT DISTINCT ts_code, suppkey, year(ship_day) AS y FROM lines)"""),
    "suspensions": (("lines",), """
SELECT trade_date, ts_code, CASE WHEN l_returnflag = 'R' THEN 'S' ELSE 'R' END AS suspend_type
FROM lines WHERE round(l_discount, 2) = 0.10 AND l_returnflag IN ('R', 'A')"""),
    "scores": (("lines",), """
SELECT trade_date, ts_code, round(100 * (avg(l_discount) - avg(l_tax)), 6) AS score FROM lines GROUP BY trade_date, ts_code"""),
    "param_grid": ((), "SELECT * FROM (VALUES (5, 1), (5, 10), (10, 1), (10, 10), (20, 1), (20, 10)) g(topk, cost_bp)"),
}


# the panels round with the same nudge as the Spark side
TABLES = {n: (deps, text.replace(", 6)", " + 3.71728349e-9, 6)")) for n, (deps, text) in TABLES.items()}


def with_tables(body: str, needs: tuple[str, ...], doubles: tuple[str, ...], recursive: bool = False, digits: int = 6) -> str:
    """``body`` behind the tables it needs, floating outputs rounded.

    A body that starts with ``WITH`` simply continues the list of expressions.
    """
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done:
            return
        deps, text = TABLES[name]
        for d in deps:
            add(d)
        done[name] = text.strip()

    for n in needs:
        add(n)
    # materialised: a panel read by many branches is computed once
    ctes = [f"{n} AS MATERIALIZED (\n{t})" for n, t in done.items()]
    body = body.strip().rstrip(";")
    if body.upper().startswith("WITH "):
        rest, select = _split_with(body[5:])
        ctes.append(rest)
        body = select
    if doubles:
        # the nudge settles decimal ties, adding 0.0 turns a negative zero into zero
        nudge = repr(0.371728349 * 10.0 ** -(digits + 2))
        reps = ", ".join(f"round({d} + {nudge}, {digits}) + 0.0 AS {d}" for d in doubles)
        body = f"SELECT * REPLACE ({reps}) FROM (\n{body})"
    if not ctes:
        return body
    head = "WITH RECURSIVE" if recursive else "WITH"
    return f"{head} " + ",\n".join(ctes) + "\n" + body


def _split_with(text: str) -> tuple[str, str]:
    """Split the expression list from the final SELECT (first SELECT at depth 0)."""
    depth = 0
    i = 0
    quoted = False
    while i < len(text):
        ch = text[i]
        if ch == "'":
            quoted = not quoted
        elif not quoted:
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif depth == 0 and text[i : i + 6].upper() == "SELECT" and (i == 0 or text[i - 1].isspace()):
                return text[:i].strip(), text[i:]
        i += 1
    raise ValueError("no final SELECT")
