"""Queries: wide table, training matrix, walk-forward windows, window models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import clean as C
from ..operators import matrix as M
from ..operators import price_volume as PV
from ..sources.datasets import materialize, materialize_bucketed, materialize_counted
from .q_ic import ic_sql
from .q_joins import HORIZONS_SQL, PIT, all_scores
from .q_tables import ENHANCED, ENHANCED_NEEDS, ENHANCED_SQL, enhanced_table
from .registry import query
from .sqltext import BY, pct, roll

KEYS = ["trade_date", "ts_code"]

_STATUS = """SELECT b.trade_date, b.ts_code, max(CASE WHEN n.name LIKE '*ST%' THEN 2 WHEN n.name LIKE 'ST%' THEN 1 WHEN n.name IS NOT NULL THEN 0 END) AS st_status
  FROM bars b LEFT JOIN name_changes n ON n.ts_code = b.ts_code AND n.start_date <= b.trade_date AND (n.end_date IS NULL OR b.trade_date <= n.end_date) GROUP BY ALL"""
WIDE = f"""SELECT b.trade_date, b.ts_code, b.open, b.high, b.low, b.close, b.pre_close, b.vol, b.amount, a.adj_factor, r.ann_date, r.roe, r.or_yoy, f.net_mf_amount, g.l1_name, s.st_status,
    (coalesce(s.st_status, 0) = 0)::INT AS no_st_stock, (coalesce(s.st_status, 0) = 1)::INT AS st_stock, (coalesce(s.st_status, 0) = 2)::INT AS star_st_stock,
    coalesce(u.is_suspect, 0) AS is_suspect
  FROM bars b ASOF LEFT JOIN {PIT} r ON b.ts_code = r.ts_code AND b.trade_date >= r.ann_date
  LEFT JOIN ({_STATUS}) s ON s.trade_date = b.trade_date AND s.ts_code = b.ts_code
  LEFT JOIN (SELECT trade_date, ts_code, max((suspend_type = 'S')::INT) AS is_suspect FROM suspensions GROUP BY ALL) u ON u.trade_date = b.trade_date AND u.ts_code = b.ts_code
  LEFT JOIN adj_factors a ON a.trade_date = b.trade_date AND a.ts_code = b.ts_code
  LEFT JOIN moneyflow f ON f.trade_date = b.trade_date AND f.ts_code = b.ts_code
  LEFT JOIN members g ON g.ts_code = b.ts_code AND g.in_date <= b.trade_date AND (g.out_date IS NULL OR b.trade_date < g.out_date)"""
_NEEDS = "bars reports name_changes suspensions adj_factors moneyflow members"


def wide(m):
    status = m.name_changes().withColumn("st_status", C.name_status("name"))
    return M.wide_table(
        m.bars().drop("suppkey", "change", "pct_chg"), status, A.suspend_daily(m.suspensions()), m.adj_factors(), m.reports(),
        m.moneyflow(), m.industry_members(), ["roe", "or_yoy"], ["net_mf_amount"],
    )


@query(
    "wide_table", "M1 J1 J2 J4 P18", needs=_NEEDS, doubles="open high low close pre_close vol amount adj_factor roe or_yoy net_mf_amount",
    sql=f"SELECT * REPLACE (coalesce(ann_date, 0) AS ann_date, coalesce(st_status, -1) AS st_status) FROM ({WIDE})",
)
def _(m):
    df = wide(m).withColumns({"ann_date": F.coalesce("ann_date", F.lit(0)), "st_status": F.coalesce("st_status", F.lit(-1))})
    flags = ("no_st_stock", "st_stock", "star_st_stock", "is_suspect")
    return df.withColumns({c: F.col(c).cast("int") for c in flags})


@query(
    "wide_table_match_counts", "M1 A12 C15", needs=_NEEDS,
    sql=f"""SELECT count(*) AS rows, count(st_status) AS st_status_matched, count(adj_factor) AS adj_factor_matched, count(ann_date) AS ann_date_matched,
            count(l1_name) AS l1_name_matched FROM ({WIDE})""",
)
def _(m):
    return M.wide_table_matches(wide(m))


_MATCHED, _EMPTY = ["st_status", "adj_factor", "ann_date", "l1_name"], ["roe", "or_yoy"]


@query(
    "wide_table_written_summary", "C15 A8 A12", needs=_NEEDS,
    sql=f"""SELECT count(*) AS rows, {', '.join(f'count({c}) AS {c}_matched' for c in _MATCHED)},
            {', '.join(f'sum(({c} IS NULL)::INT)::BIGINT AS {c}_nulls' for c in _EMPTY)} FROM ({WIDE})""",
)
def _(m):
    # the table is written once and the figures of the job are seen on the way
    _, figures = materialize_counted(wide(m), "wide-table", {**A.match_figures(_MATCHED), **A.null_figures(_EMPTY)})
    return m.spark.createDataFrame([figures], ", ".join(f"{n} long" for n in figures))


@query(
    "bucketed_panel_join", "C10 J1", needs="bars moneyflow", doubles="close amount net_mf_amount",
    sql="SELECT b.trade_date, b.ts_code, b.close, b.amount, f.net_mf_amount FROM bars b LEFT JOIN moneyflow f USING (trade_date, ts_code)",
)
def _(m):
    panel, flows = bucketed_sources(m)
    return panel.join(flows.hint("merge"), KEYS, "left")


def bucketed_sources(m):
    """Bars and money flows in equal buckets of the panel key: they meet without an exchange."""
    buckets = int(m.spark.conf.get("spark.sql.shuffle.partitions"))
    panel = materialize_bucketed(m.bars().select(*KEYS, "close", "amount"), "bucketed-bars", KEYS, buckets)
    return panel, materialize_bucketed(m.moneyflow().select(*KEYS, "net_mf_amount"), "bucketed-flows", KEYS, buckets)


_FEATS = ["ret_5", "volatility_5", "net_mf_amount", "score_5d", "roe"]
_PVF = f"SELECT trade_date, ts_code, {pct('close', 5)} AS ret_5, {roll('stddev_samp', 'pct_chg', 5)} AS volatility_5 FROM bars"
_LAB = f"SELECT trade_date, ts_code, lead(close) OVER ({BY}) / lead(open) OVER ({BY}) - 1 AS label_1d FROM bars"
MATRIX = f"""SELECT b.trade_date, b.ts_code, p.ret_5, p.volatility_5, f.net_mf_amount, h.score_5d, r.roe, l.label_1d FROM bars b
  ASOF LEFT JOIN {PIT} r ON b.ts_code = r.ts_code AND b.trade_date >= r.ann_date
  JOIN ({_PVF}) p ON p.trade_date = b.trade_date AND p.ts_code = b.ts_code JOIN moneyflow f ON f.trade_date = b.trade_date AND f.ts_code = b.ts_code
  JOIN ({HORIZONS_SQL}) h ON h.trade_date = b.trade_date AND h.ts_code = b.ts_code JOIN ({_LAB}) l ON l.trade_date = b.trade_date AND l.ts_code = b.ts_code
  WHERE l.label_1d IS NOT NULL"""


def sources(m):
    from ..operators.fundamental import to_daily

    b = m.bars()
    return {
        "price": PV.volatility(PV.returns(b, (5,)), (5,)),
        "flow": m.moneyflow(),
        "scores": all_scores(m),
        "reports": to_daily(b.select(*KEYS), m.reports(), ["roe"]),
    }


def labels(m):
    s = PV.BY_STOCK
    return m.bars().select(*KEYS, (s.lead("close") / s.lead("open") - 1).alias("label_1d"))


def matrix(m):
    return M.training_matrix(m.bars().select(*KEYS), sources(m), labels(m), _FEATS, "label_1d")


_D = " ".join(_FEATS) + " label_1d"


@query("training_matrix", "M2 P33", needs="bars moneyflow reports lines", doubles=_D, sql=MATRIX)
def _(m):
    return matrix(m)


@query(
    "filled_training_matrix", "M3", needs="bars moneyflow reports lines", doubles=_D + " absent",
    sql=f"SELECT trade_date, ts_code, {', '.join(f'coalesce({c}, 0.0) AS {c}' for c in _FEATS if c != 'roe')}, 0.0::DOUBLE AS roe, 0.0::DOUBLE AS absent, label_1d FROM ({MATRIX})",
)
def _(m):
    src = {**sources(m), "reports": None}
    return M.training_matrix_filled(m.bars().select(*KEYS), src, labels(m), [*_FEATS, "absent"], "label_1d")


_WARGS = ("1995-01-01", "1997-06-01", "2001-12-31", 2, 1)


def windows_sql(expanding: bool) -> str:
    begin = "DATE '1995-01-01'" if expanding else "DATE '1995-01-01' + to_years(CAST(k AS INTEGER))"
    i = lambda e: f"CAST(strftime({e}, '%Y%m%d') AS INTEGER)"
    return f"""SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS "window", {i('b')} AS train_start, {i('v - INTERVAL 1 DAY')} AS train_end, {i('v')} AS valid_start, {i('e')} AS valid_end,
      {i("greatest(e + 1, DATE '1997-06-01')")} AS test_start, {i("least((e + 1 + INTERVAL 1 YEAR - INTERVAL 1 DAY)::DATE, DATE '2001-12-31')")} AS test_end FROM (
      SELECT *, e - CAST(floor((e - b) * 0.2) AS INTEGER) + 1 AS v FROM (SELECT k, CAST({begin} AS DATE) AS b,
        CAST(DATE '1995-01-01' + to_years(CAST(k + 2 AS INTEGER)) - INTERVAL 1 DAY AS DATE) AS e FROM range(0, 12) t(k)))
      WHERE e + 1 <= DATE '2001-12-31' AND (e + 1 + INTERVAL 1 YEAR - INTERVAL 1 DAY) >= DATE '1997-06-01'"""


def assigned_sql(expanding: bool) -> str:
    return f"""SELECT w."window", s.split, count(*) AS rows, min(b.trade_date) AS first_date, max(b.trade_date) AS last_date FROM ({windows_sql(expanding)}) w
      CROSS JOIN (VALUES ('train'), ('valid'), ('test')) s(split) JOIN bars b ON b.trade_date BETWEEN
        CASE split WHEN 'train' THEN train_start WHEN 'valid' THEN valid_start ELSE test_start END AND
        CASE split WHEN 'train' THEN train_end WHEN 'valid' THEN valid_end ELSE test_end END GROUP BY ALL"""


for _name, _mode in (("rolling_windows", "rolling"), ("expanding_windows", "expanding")):

    @query(_name, "M4", needs="bars", sql=assigned_sql(_mode == "expanding"))
    def _(m, mode=_mode):
        w = M.walk_forward_windows(*_WARGS, mode=mode)
        df = M.assign_windows(m.bars().select(*KEYS), w)
        return df.groupBy("window", "split").agg(
            F.count("*").alias("rows"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date")
        )


@query(
    "sample_weights", "M5", needs="bars", doubles="sample_weight",
    sql=f"""WITH w AS ({windows_sql(False)}), x AS (SELECT l.*, w."window" FROM ({_LAB}) l JOIN w ON l.trade_date BETWEEN train_start AND train_end WHERE label_1d IS NOT NULL),
      s AS (SELECT *, 0.5 + pow((label_1d - min(label_1d) OVER d) / (max(label_1d) OVER d - min(label_1d) OVER d), 2.0) * 0.5 AS v FROM x WINDOW d AS (PARTITION BY "window"))
      SELECT trade_date, ts_code, "window", v / avg(v) OVER (PARTITION BY "window") AS sample_weight FROM s""",
)
def _(m):
    w = M.walk_forward_windows(*_WARGS)
    df = M.assign_windows(labels(m).where("label_1d IS NOT NULL"), w).where("split = 'train'")
    return M.sample_weights(df, "label_1d", 0.5, 2.0).select(*KEYS, "window", "sample_weight")


@query("ranking_group_sizes", "M6", needs="bars", sql="SELECT trade_date, count(*) AS size FROM bars GROUP BY trade_date ORDER BY 1")
def _(m):
    return M.group_sizes(m.bars())


@query(
    "window_prediction_errors", "M9 A26", needs="bars lines scores", doubles="rmse pooled_ic mean_rank_ic",
    sql=f"""WITH p AS MATERIALIZED (SELECT s.*, round(l.label_1d + 3.71728349e-9, 6) AS label, w."window" FROM scores s JOIN ({_LAB}) l ON l.trade_date = s.trade_date AND l.ts_code = s.ts_code
        JOIN ({windows_sql(False)}) w ON s.trade_date BETWEEN test_start AND test_end WHERE label_1d IS NOT NULL),
      i AS ({ic_sql('SELECT * FROM p', '"window", trade_date', 2)})
      SELECT e.*, r.mean_rank_ic FROM (SELECT "window", sqrt(avg((score - label) * (score - label))) AS rmse, corr(score, label) AS pooled_ic, count(*) AS rows FROM p GROUP BY "window") e
      JOIN (SELECT "window", avg(rank_ic) AS mean_rank_ic FROM i GROUP BY "window") r ON r."window" = e."window" """,
)
def _(m):
    p = m.scores().join(labels(m), KEYS).where("label_1d IS NOT NULL")
    p = p.withColumn("label", F.round(F.col("label_1d") + 3.71728349e-9, 6))
    p = M.assign_windows(p, M.walk_forward_windows(*_WARGS)).where("split = 'test'")
    return M.window_errors(p, "label", m.names)


_MODEL = dict(maxDepth=3, maxIter=5, stepSize=0.1, seed=42, maxBins=32)
_MF = ["ret_5", "volatility_5", "net_mf_amount", "score_5d"]


def filled(m):
    """The matrix is read many times by each fit, so it is written once. Features keep their gaps: the models fill them."""
    src = {k: v for k, v in sources(m).items() if k != "reports"}
    return materialize(M.training_matrix(m.bars().select(*KEYS), src, labels(m), _MF, "label_1d"), "matrix")


def predictions(m):
    w, x = M.walk_forward_windows(*_WARGS), filled(m)
    return M.walk_forward_predictions(x, w, M.fit_window_models(x, w, _MF, "label_1d", **_MODEL), "label_1d")


@query("walk_forward_predictions", "M7 M8")
def _(m):
    return predictions(m)


@query(
    "walk_forward_rows", "M7 M8 M4", needs="bars",
    sql=f"""SELECT l.trade_date, l.ts_code, w."window", 1 AS scored FROM ({_LAB}) l JOIN ({windows_sql(False)}) w ON l.trade_date BETWEEN test_start AND test_end WHERE label_1d IS NOT NULL""",
)
def _(m):
    return predictions(m).select(*KEYS, "window", F.col("score").isNotNull().cast("int").alias("scored"))


@query("batch_inference", "M10 M7")
def _(m):
    w, x = M.walk_forward_windows(*_WARGS)[-1:], filled(m)
    models = M.fit_window_models(x, w, _MF, "label_1d", **_MODEL)
    return M.predict_range(models[w[0]["window"]], x, 20010101, 20011231)


# ---------------------------------------------------------------- the whole factor list

_FINITE = ", ".join(f"CASE WHEN isfinite({c}::DOUBLE) THEN {c} END AS {c}" for c in ENHANCED)


def enhanced_matrix(m):
    """Every enhanced factor beside the label: the matrix that models of the whole list learn from."""
    return M.training_matrix(m.bars().select(*KEYS), {"factors": enhanced_table(m)}, labels(m), ENHANCED, "label_1d")


@query(
    "enhanced_training_matrix", "M2", needs=ENHANCED_NEEDS, doubles=" ".join([*ENHANCED, "label_1d"]),
    sql=f"SELECT e.trade_date, e.ts_code, {_FINITE}, l.label_1d FROM ({ENHANCED_SQL}) e JOIN ({_LAB}) l ON l.trade_date = e.trade_date AND l.ts_code = e.ts_code WHERE l.label_1d IS NOT NULL",
)
def _(m):
    return enhanced_matrix(m)


def enhanced_predictions(m):
    w, x = M.walk_forward_windows(*_WARGS), materialize(enhanced_matrix(m), "enhanced-matrix")
    return M.walk_forward_predictions(x, w, M.fit_window_models(x, w, ENHANCED, "label_1d", **_MODEL), "label_1d")


@query(
    "enhanced_walk_forward_rows", "M7 M8", needs="bars",
    sql=f"""SELECT l.trade_date, l.ts_code, w."window", 1 AS scored, label_1d FROM ({_LAB}) l JOIN ({windows_sql(False)}) w ON l.trade_date BETWEEN test_start AND test_end WHERE label_1d IS NOT NULL""",
    doubles="label_1d",
)
def _(m):
    return enhanced_predictions(m).select(*KEYS, "window", F.col("score").isNotNull().cast("int").alias("scored"), "label_1d")
