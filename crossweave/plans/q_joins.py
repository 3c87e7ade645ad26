"""Queries: panel joins, calendars, intervals, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import intervals as I
from ..operators import joins as J
from ..sources.market import _code, _r6
from ..functions.columns import as_date, as_int
from .registry import query


@query(
    "keyed_left_join", "J1", needs="bars moneyflow", doubles="close buy_elg_amount",
    sql="""SELECT b.trade_date, b.ts_code, b.close, f.buy_elg_amount FROM bars b LEFT JOIN
           (SELECT * FROM moneyflow WHERE buy_elg_amount > 0) f ON f.trade_date = b.trade_date AND f.ts_code = b.ts_code""",
)
def _(m):
    flow = m.moneyflow().where("buy_elg_amount > 0").select("trade_date", "ts_code", "buy_elg_amount")
    return J.left_join_key(m.bars().select("trade_date", "ts_code", "close"), flow)


# the right side collapsed to one report per announcement date
PIT = """(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY ts_code, ann_date ORDER BY end_date DESC) AS rn
          FROM reports) WHERE rn = 1)"""


@query(
    "point_in_time_join", "J2", needs="bars reports", doubles="roe or_yoy",
    sql=f"""SELECT b.trade_date, b.ts_code, coalesce(r.ann_date, 0) AS ann_date, coalesce(r.end_date, 0) AS end_date, r.roe, r.or_yoy
            FROM bars b ASOF LEFT JOIN {PIT} r ON b.ts_code = r.ts_code AND b.trade_date >= r.ann_date""",
)
def _(m):
    df = J.asof_join(m.bars().select("trade_date", "ts_code"), m.reports(), ["ann_date", "end_date", "roe", "or_yoy"])
    return df.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("ann_date", "end_date")})


_GAPS = """(SELECT ts_code, l1_name, in_date, CASE WHEN out_date IS NOT NULL THEN out_date - 300 END AS out_date FROM members)"""


def _gappy(m):
    """Memberships that end before the next one starts."""
    return m.industry_members().withColumn("out_date", F.col("out_date") - 300)


@query(
    "expiring_point_in_time_join", "J3", needs="bars members",
    sql=f"""SELECT b.trade_date, b.ts_code, CASE WHEN g.out_date IS NULL OR g.out_date > b.trade_date THEN g.l1_name END AS l1_name
            FROM bars b ASOF LEFT JOIN {_GAPS} g ON b.ts_code = g.ts_code AND b.trade_date >= g.in_date""",
)
def _(m):
    df = J.expiring_asof_join(m.bars().select("trade_date", "ts_code"), _gappy(m), ["l1_name"])
    return df.select("trade_date", "ts_code", "l1_name")


@query(
    "half_open_interval_join", "J4", needs="bars members",
    sql="""SELECT b.trade_date, b.ts_code, g.l1_name, g.l2_name FROM bars b LEFT JOIN members g ON g.ts_code = b.ts_code
           AND g.in_date <= b.trade_date AND (g.out_date IS NULL OR b.trade_date < g.out_date)""",
)
def _(m):
    return J.interval_join(m.bars().select("trade_date", "ts_code"), m.industry_members(), ["l1_name", "l2_name"])


@query(
    "closed_interval_join", "J5", needs="bars members",
    sql="""SELECT trade_date, ts_code, l1_name FROM (SELECT b.trade_date, b.ts_code, g.l1_name,
             row_number() OVER (PARTITION BY b.ts_code, b.trade_date ORDER BY g.in_date, g.l1_name) AS rn
           FROM bars b LEFT JOIN members g ON g.ts_code = b.ts_code AND g.in_date <= b.trade_date
           AND (g.out_date IS NULL OR b.trade_date <= g.out_date)) WHERE rn = 1""",
)
def _(m):
    return J.interval_join(
        m.bars().select("trade_date", "ts_code"), m.industry_members(), ["l1_name"], closed="both", first=True
    )


@query(
    "prediction_label_join", "J6", needs="bars scores", doubles="score label",
    sql="""SELECT s.trade_date, s.ts_code, s.score, l.label FROM scores s JOIN
           (SELECT trade_date, ts_code, lead(close) OVER (PARTITION BY ts_code ORDER BY trade_date) / close - 1 AS label FROM bars) l
           ON l.trade_date = s.trade_date AND l.ts_code = s.ts_code WHERE l.label IS NOT NULL""",
)
def _(m):
    return pred_label(m).where("label IS NOT NULL")


def pred_label(m):
    """Scores beside the next bar's return."""
    from ..operators.price_volume import BY_STOCK

    lab = m.bars().select("trade_date", "ts_code", (BY_STOCK.lead("close") / F.col("close") - 1).alias("label"))
    return m.scores().join(lab, ["trade_date", "ts_code"])


PRED_LABEL = """SELECT s.trade_date, s.ts_code, s.score, l.label FROM scores s JOIN
  (SELECT trade_date, ts_code, lead(close) OVER (PARTITION BY ts_code ORDER BY trade_date) / close - 1 AS label FROM bars) l
  ON l.trade_date = s.trade_date AND l.ts_code = s.ts_code"""


def horizon_scores(m):
    """Three model scores per row, as three separate tables joined on the key."""
    h = [
        m.scores().withColumnRenamed("score", "score_1d"),
        m._panel({"score_5d": _r6(F.avg("l_quantity"))}),
        m._panel({"score_20d": _r6(F.max("l_discount") * 100 + F.avg("l_tax"))}),
    ]
    df = h[0]
    for t in h[1:]:
        df = df.join(t, ["trade_date", "ts_code"])
    return df


def all_scores(m):
    """The same three scores from one aggregation."""
    return m._panel(
        {
            "score_1d": _r6(100 * (F.avg("l_discount") - F.avg("l_tax"))),
            "score_5d": _r6(F.avg("l_quantity")),
            "score_20d": _r6(F.max("l_discount") * 100 + F.avg("l_tax")),
        }
    )


HORIZONS_SQL = """SELECT trade_date, ts_code, round(100 * (avg(l_discount) - avg(l_tax)) + 3.71728349e-9, 6) AS score_1d,
  round(avg(l_quantity) + 3.71728349e-9, 6) AS score_5d, round(max(l_discount) * 100 + avg(l_tax) + 3.71728349e-9, 6) AS score_20d
  FROM lines GROUP BY trade_date, ts_code"""


@query("horizon_join", "J7", needs="lines", doubles="score_1d score_5d score_20d", sql=HORIZONS_SQL)
def _(m):
    return horizon_scores(m)


@query(
    "market_series_join", "J8 A2", needs="bars", doubles="excess",
    sql="""SELECT b.trade_date, b.ts_code, b.pct_chg / 100.0 - k.mkt AS excess FROM bars b LEFT JOIN
           (SELECT trade_date, avg(pct_chg) / 100.0 AS mkt FROM bars WHERE pct_chg IS NOT NULL GROUP BY trade_date) k
           ON k.trade_date = b.trade_date""",
)
def _(m):
    b = m.bars()
    df = J.join_calendar(b, A.market_return(b))
    return df.select("trade_date", "ts_code", (F.col("pct_chg") / 100.0 - F.col("mkt_ret")).alias("excess"))


@query(
    "aligned_weights", "J11", needs="bars", doubles="w0 w1",
    sql="""WITH w AS MATERIALIZED (SELECT trade_date, ts_code, vol / 1000 AS w FROM bars),
           d AS MATERIALIZED (SELECT trade_date, strftime(strptime(trade_date::VARCHAR, '%Y%m%d') + INTERVAL 7 DAY, '%Y%m%d')::INTEGER AS next_date FROM (SELECT DISTINCT trade_date FROM bars)),
           b AS MATERIALIZED (SELECT d.next_date AS trade_date, w.ts_code, w.w FROM w JOIN d USING (trade_date))
           SELECT trade_date, ts_code, coalesce(b.w, 0.0) AS w0, coalesce(w.w, 0.0) AS w1 FROM w FULL JOIN b USING (trade_date, ts_code)""",
)
def _(m):
    # every week against the week before it
    b = m.bars().select("trade_date", "ts_code", (F.col("vol") / 1000).alias("w"))
    next_week = as_int(F.date_add(as_date("trade_date"), 7)).alias("trade_date")
    before = b.select(next_week, "ts_code", F.col("w").alias("w0"))
    return J.align_weights(before, b.withColumnRenamed("w", "w1"), ["trade_date", "ts_code"])


@query(
    "dense_calendar", "J12", needs="bars",
    sql="""SELECT s.ts_code, CAST(strftime(d.day, '%Y%m%d') AS INTEGER) AS trade_date FROM (SELECT DISTINCT ts_code FROM bars) s,
           (SELECT unnest(generate_series((SELECT strptime(min(trade_date)::VARCHAR, '%Y%m%d') FROM bars), (SELECT strptime(max(trade_date)::VARCHAR, '%Y%m%d') FROM bars), INTERVAL 1 DAY)) AS day) d""",
)
def _(m):
    lo, hi = m.lines().agg(F.min("trade_date"), F.max("trade_date")).first()
    return J.dense_calendar(m.lines(), lo, hi).select("ts_code", "trade_date")


_SIGNALS = "(SELECT DISTINCT trade_date FROM bars WHERE (trade_date // 100) % 2 = 0)"


def _signal_sql(op: str, k: int) -> str:
    return f"""(SELECT max(x.trade_date) FROM (SELECT s.trade_date, t.trade_date AS t,
      row_number() OVER (PARTITION BY t.trade_date ORDER BY s.trade_date DESC) AS rn
      FROM {_SIGNALS} s, (SELECT DISTINCT trade_date FROM bars) t WHERE s.trade_date {op} t.trade_date) x
      WHERE x.t = d.trade_date AND x.rn = {k})"""


@query(
    "signal_date_mapping", "J13", needs="bars",
    sql=f"""SELECT trade_date, coalesce({_signal_sql('<=', 1)}, 0) AS delay0, coalesce({_signal_sql('<', 1)}, 0) AS delay1,
                   coalesce({_signal_sql('<', 2)}, 0) AS delay2 FROM (SELECT DISTINCT trade_date FROM bars) d""",
)
def _(m):
    dates = m.lines().select("trade_date").distinct()
    signals = dates.where(F.floor(F.col("trade_date") / 100) % 2 == 0)
    out = None
    for k in (0, 1, 2):
        one = J.signal_dates(dates, signals, k).select("trade_date", F.coalesce("signal_date", F.lit(0)).alias(f"delay{k}"))
        out = one if out is None else out.join(one, "trade_date")
    return out


@query(
    "forward_filled_benchmark", "J14 T12", needs="bars", doubles="filled benchmark_ret",
    sql="""WITH mk AS (SELECT trade_date, avg(pct_chg) / 100.0 AS r, row_number() OVER (ORDER BY trade_date) AS i FROM bars
             WHERE pct_chg IS NOT NULL GROUP BY trade_date),
           bench AS (SELECT trade_date, r FROM mk WHERE i % 5 <> 0)
           SELECT d.trade_date, f.r AS filled, coalesce(b.r, mk.r) AS benchmark_ret FROM (SELECT DISTINCT trade_date FROM bars) d
           ASOF LEFT JOIN bench f ON d.trade_date >= f.trade_date
           LEFT JOIN bench b ON b.trade_date = d.trade_date LEFT JOIN mk ON mk.trade_date = d.trade_date""",
)
def _(m):
    from ..operators.portfolio import benchmark_returns

    mk = A.market_return(m.bars())
    bench = index_series(m)
    dates = m.lines().select("trade_date").distinct()
    filled = J.forward_fill_series(dates, bench, ["r"]).select("trade_date", F.col("r").alias("filled"))
    return filled.join(benchmark_returns(dates, bench, mk), "trade_date")


def index_series(m):
    """A benchmark table that lacks every fifth week."""
    from pyspark.sql import Window

    mk = A.market_return(m.bars())
    numbered = mk.withColumn("_i", F.row_number().over(Window.orderBy("trade_date")))
    return numbered.where("_i % 5 <> 0").select("trade_date", F.col("mkt_ret").alias("r"))


@query(
    "parameter_grid_join", "J15", needs="scores param_grid", doubles="score",
    sql="SELECT g.topk, g.cost_bp, s.trade_date, s.ts_code, s.score FROM scores s, param_grid g WHERE g.cost_bp < g.topk",
)
def _(m):
    return J.with_grid(m.scores(), GRID, lambda r: r["cost_bp"] < r["topk"]).select(
        "topk", "cost_bp", "trade_date", "ts_code", "score"
    )


GRID = [{"topk": k, "cost_bp": c} for k in (5, 10, 20) for c in (1, 10)]


@query(
    "latest_classification", "J16", needs="bars members",
    sql="""SELECT b.ts_code, g.l1_name FROM bars b JOIN members g ON g.ts_code = b.ts_code AND g.in_date <= b.trade_date
           AND (g.out_date IS NULL OR b.trade_date < g.out_date)
           WHERE b.trade_date = (SELECT max(trade_date) FROM bars)""",
)
def _(m):
    panel = J.interval_join(m.bars().select("trade_date", "ts_code"), m.industry_members(), ["l1_name"])
    return J.latest_label(panel, "l1_name").where("l1_name IS NOT NULL")


# ---------------------------------------------------------------- intervals and sets


@query(
    "daily_listing_status", "N1", needs="name_changes",
    sql="""WITH hi AS (SELECT greatest(max(start_date), max(end_date), max(ann_date)) AS hi, min(start_date) AS lo FROM name_changes),
      days AS (SELECT CAST(strftime(unnest(generate_series(strptime(lo::VARCHAR, '%Y%m%d'), strptime(hi::VARCHAR, '%Y%m%d'),
               INTERVAL 1 DAY)), '%Y%m%d') AS INTEGER) AS trade_date FROM hi),
      codes AS (SELECT DISTINCT ts_code FROM name_changes)
      SELECT trade_date, ts_code, CAST(status = 0 AS INTEGER) AS no_st_stock, CAST(status = 1 AS INTEGER) AS st_stock,
             CAST(status = 2 AS INTEGER) AS star_st_stock FROM (
        SELECT d.trade_date, c.ts_code, coalesce(CASE WHEN n.name LIKE '*ST%' THEN 2 WHEN n.name LIKE 'ST%' THEN 1
               WHEN n.name IS NULL THEN 0 ELSE 0 END, 0) AS status
        FROM days d CROSS JOIN codes c LEFT JOIN name_changes n ON n.ts_code = c.ts_code AND n.start_date <= d.trade_date
          AND d.trade_date <= coalesce(n.end_date, (SELECT hi FROM hi)))""",
)
def _(m):
    df = I.daily_name_status(m.name_changes())
    flags = ("no_st_stock", "st_stock", "star_st_stock")
    return df.withColumns({c: F.col(c).cast("int") for c in flags})


def coded_members(m):
    """Memberships with a code, current flag and a competing mapped record."""
    base = m.industry_members().withColumns(
        {
            "l1_code": F.concat(F.lit("C"), F.substring("l1_name", 1, 3)),
            "is_new": F.when(F.col("out_date").isNull(), "Y").otherwise("N"),
        }
    )
    return I.normalize_members(base, "L1", "base")


def _basics(m):
    n = m.table("nation")
    return (
        m.table("supplier")
        .join(n, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            _code("s_suppkey").alias("ts_code"),
            F.col("n_name").alias("secondary"),
            F.lit(19960101).alias("list_date"),
        )
    )


def _lookup(m):
    n, r = m.table("nation"), m.table("region").where("r_regionkey < 4")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("secondary"), F.col("r_name").alias("industry"))


_CODED = """SELECT ts_code, 'C' || substr(l1_name, 1, 3) AS industry_code, l1_name AS industry, 'L1' AS level, 'base' AS src,
  in_date, out_date, CASE WHEN out_date IS NULL THEN 'Y' ELSE 'N' END AS is_new FROM members"""
_MAPPED = """SELECT printf('S%06d', s_suppkey) AS ts_code, 'MAPPED' AS industry_code, r_name AS industry, 'L1' AS level, 'mapped' AS src,
  19960101 AS in_date, NULL AS out_date, 'N' AS is_new FROM supplier JOIN nation ON n_nationkey = s_nationkey
  JOIN region ON r_regionkey = n_regionkey WHERE r_regionkey < 4"""


@query(
    "normalized_members", "N4", needs="members",
    sql=f"SELECT ts_code, industry_code, industry, level, src, in_date, is_new FROM ({_CODED})",
)
def _(m):
    return coded_members(m).select("ts_code", "industry_code", "industry", "level", "src", "in_date", "is_new")


@query(
    "supplemented_members", "N5 N6", needs="members",
    sql=f"SELECT ts_code, industry_code, industry, level, src, in_date, is_new FROM ({_CODED} UNION ALL {_MAPPED})",
)
def _(m):
    df = I.supplement_members(coded_members(m), _basics(m), _lookup(m))
    return df.select("ts_code", "industry_code", "industry", "level", "src", "in_date", "is_new")


@query(
    "industry_daily_snapshot", "N2", needs="bars members",
    sql=f"""SELECT trade_date, ts_code, industry, src FROM (SELECT d.trade_date, x.*, row_number() OVER (
              PARTITION BY d.trade_date, x.ts_code ORDER BY x.is_new DESC, x.in_date DESC, x.industry_code) AS rn
            FROM (SELECT DISTINCT trade_date FROM bars) d JOIN ({_CODED} UNION ALL {_MAPPED}) x
            ON x.in_date <= d.trade_date AND (x.out_date IS NULL OR d.trade_date < x.out_date)) WHERE rn = 1""",
)
def _(m):
    members = I.supplement_members(coded_members(m), _basics(m), _lookup(m))
    snap = I.membership_snapshot(members, m.lines().select("trade_date"))
    return snap.select("trade_date", "ts_code", "industry", "src")


@query(
    "calendar_days", "N3", needs="bars",
    sql="""SELECT CAST(strftime(unnest(generate_series(strptime(min(trade_date)::VARCHAR, '%Y%m%d'),
             strptime(max(trade_date)::VARCHAR, '%Y%m%d'), INTERVAL 1 DAY)), '%Y%m%d') AS INTEGER) AS trade_date FROM bars""",
)
def _(m):
    r = m.lines().agg(F.min("trade_date"), F.max("trade_date")).first()
    return I.calendar_days(m.spark, r[0], r[1])


@query(
    "concatenated_frames", "N6", needs="bars", doubles="close amount",
    sql="""SELECT trade_date, ts_code, close, CASE WHEN suppkey % 2 = 1 THEN amount END AS amount FROM bars""",
)
def _(m):
    b = m.bars()
    return I.concat_frames(
        [
            b.where("suppkey % 2 = 0").select("trade_date", "ts_code", "close"),
            b.where("suppkey % 2 = 1").select("trade_date", "ts_code", "close", "amount"),
        ]
    )


@query(
    "stitched_windows", "N7 M8", needs="scores", doubles="score",
    sql="""SELECT trade_date, ts_code, CASE WHEN trade_date >= 19980601 THEN score + 1 ELSE score END AS score FROM scores""",
)
def _(m):
    s = m.scores()
    early = s.where("trade_date <= 19981231")
    late = s.where("trade_date >= 19980601").withColumn("score", F.col("score") + 1)
    return I.stitch_keep_last([early, late], ["trade_date", "ts_code"])


@query(
    "key_difference", "N9 J10", needs="bars",
    sql="""SELECT DISTINCT ts_code FROM bars WHERE ts_code NOT IN (SELECT ts_code FROM bars WHERE trade_date = 19980105)""",
)
def _(m):
    b = m.lines().select("ts_code", "trade_date")
    return I.keys_only_in(b, b.where("trade_date = 19980105"), ["ts_code"])


@query(
    "key_intersection", "N8", needs="bars moneyflow",
    sql="""SELECT trade_date, ts_code FROM bars INTERSECT SELECT trade_date, ts_code FROM moneyflow WHERE buy_elg_amount > 0""",
)
def _(m):
    return I.shared_keys(m.bars(), m.moneyflow().where("buy_elg_amount > 0"), ["trade_date", "ts_code"])


@query(
    "sorted_panel", "N10", needs="bars", doubles="close", sql="SELECT trade_date, ts_code, close FROM bars ORDER BY 1, 2",
)
def _(m):
    return I.sort_panel(m.bars().select("trade_date", "ts_code", "close"))


@query(
    "first_dates", "N11", needs="bars", doubles="close",
    sql="""SELECT trade_date, ts_code, close FROM bars WHERE trade_date IN
           (SELECT DISTINCT trade_date FROM bars ORDER BY trade_date LIMIT 20)""",
)
def _(m):
    return I.first_dates(m.bars().select("trade_date", "ts_code", "close"), 20)


@query("seeded_sample", "N11", needs="bars", doubles="close",
       sql="SELECT trade_date, ts_code, close FROM bars ORDER BY md5('42|' || trade_date || '|' || ts_code), trade_date, ts_code LIMIT 200")
def _(m):
    return I.seeded_sample(m.bars().select("trade_date", "ts_code", "close"), ["trade_date", "ts_code"], 200)


@query(
    "codes_without_membership", "N5", needs="members",
    sql="""SELECT printf('S%06d', s_suppkey) AS ts_code FROM supplier WHERE printf('S%06d', s_suppkey) NOT IN (SELECT ts_code FROM members)""",
)
def _(m):
    return I.missing_codes(m.industry_members(), _basics(m))


