"""Equity-style panels derived from the order tables.

An instrument is a supplier, a trading date is the Monday of a ship week. Each
panel is one aggregation of ``lineitem``, so a hot supplier or week shrinks in the
map-side combine, and each panel holds one row per (trade_date, ts_code).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import as_int, col, rounded, safe_div
from ..functions.rolling import Series

# Report columns made as linear mixes of the aggregated ones.
REPORT_MIXES: dict[str, str] = {
    "netprofit_margin": "roe + 0.5 * roa - 4.0",
    "ocf_to_or": "1.2 * roe + 0.3 * roa - 5.0",
    "grossprofit_margin": "gross_margin",
    "assets_turn": "0.1 * roa + 0.2",
    "ebit_of_gr": "roe + 2.0 * roa",
    "finaexp_of_gr": "0.5 * roa - 1.5",
    "roic": "0.7 * roe + 0.3 * roa",
    "netprofit_yoy": "or_yoy - 2.0 * roe",
    "q_netprofit_yoy": "or_yoy + roe",
    "revenue_ps": "3.0 * eps",
    "total_revenue_ps": "2.0 * eps",
    "cfps": "0.8 * eps + 0.1 * roa",
    "undist_profit_ps": "0.4 * bps",
    "current_ratio": "3.0 - 0.02 * debt_to_assets",
    "quick_ratio": "2.0 - 0.015 * debt_to_assets",
    "debt_to_eqt": "0.01 * debt_to_assets",
    "ocf_to_debt": "0.1 * roe",
    "ebitda_to_debt": "0.2 * roe + 0.1 * roa",
    "roe_yearly": "4.0 * roe",
    "roa_yearly": "4.0 * roa",
    "cash_to_liqdebt": "0.05 * roa",
    "op_yoy": "1.1 * or_yoy",
    "roe_yoy": "or_yoy - roa",
    "bps_yoy": "0.5 * or_yoy",
    "assets_yoy": "0.4 * or_yoy + 1.0",
    "equity_yoy": "0.3 * or_yoy + 2.0",
    "basic_eps_yoy": "0.9 * or_yoy",
    "cfps_yoy": "0.8 * or_yoy - 1.0",
    "rd_exp": "1000000.0 * eps + 100000.0",
    "turn_days": "30.0 + roe",
}


def _r6(x) -> Column:
    """Six digits; the nudge settles exact decimal ties whatever the summing order."""
    return rounded(col(x) + 3.71728349e-9, 6)


def _code(suppkey) -> Column:
    """Instrument code: the key padded to at least six digits."""
    k = F.col(suppkey).cast("string")
    return F.concat(F.lit("S"), F.when(F.length(k) < 6, F.lpad(k, 6, "0")).otherwise(k))


class Market:
    """Lazy panels over one folder of order tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self._tables[name]

    @cached_property
    def names(self) -> int:
        """Number of instruments: proven bound on the rows of one date (a footer count)."""
        return self.table("supplier").count()

    def _weekly(self) -> DataFrame:
        """Order lines with their week; codes and integer dates are formed after aggregation."""
        li = self.table("lineitem")
        return li.select(
            F.date_trunc("week", "l_shipdate").cast("date").alias("week"),
            F.col("l_suppkey").alias("suppkey"),
            "l_quantity",
            "l_extendedprice",
            "l_discount",
            "l_tax",
            "l_returnflag",
            "l_linestatus",
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"),
            F.col("l_shipdate").cast("date").alias("ship_day"),
        )

    def lines(self) -> DataFrame:
        """Order lines with trade date, instrument code and unit price."""
        return self._weekly().select(
            as_int(F.col("week")).alias("trade_date"),
            _code("suppkey").alias("ts_code"),
            "suppkey",
            "l_quantity",
            "l_extendedprice",
            "l_discount",
            "l_tax",
            "l_returnflag",
            "l_linestatus",
            "p",
            "ship_day",
        )

    def _panel(self, aggs, keep=()) -> DataFrame:
        """One aggregation of the lines per (week, supplier), keyed by date and code."""
        by_key = self._weekly().groupBy("week", "suppkey")
        g = by_key.agg(*[a.alias(n) for n, a in aggs.items()]) if aggs else by_key.count()
        return g.select(as_int(F.col("week")).alias("trade_date"), _code("suppkey").alias("ts_code"), *keep, *aggs)

    def bars(self) -> DataFrame:
        """Weekly bars: trade_date, ts_code, open … amount, suppkey."""
        agg = self._panel(
            {
                "high": _r6(F.max("p")),
                "low": _r6(F.min("p")),
                "close": _r6(F.sum("l_extendedprice") / F.sum("l_quantity")),
                "vol": F.round(F.sum("l_quantity"), 2),
                "amount": F.round(F.sum("l_extendedprice") / 1000, 5),
            },
            keep=["suppkey"],
        )
        s = Series()
        agg = agg.withColumn("open", _r6((F.col("high") + F.col("low")) / 2))
        agg = agg.withColumn("pre_close", s.lag("close"))
        return agg.select(
            "trade_date",
            "ts_code",
            "open",
            "high",
            "low",
            "close",
            "pre_close",
            _r6(F.col("close") - F.col("pre_close")).alias("change"),
            _r6((F.col("close") / F.col("pre_close") - 1) * 100).alias("pct_chg"),
            "vol",
            "amount",
            "suppkey",
        )

    def adj_factors(self) -> DataFrame:
        b = self._panel({}, keep=["suppkey"])
        year = F.floor(F.col("trade_date") / 10000)
        factor = 1 + 0.1 * (year - 1995) * (F.col("suppkey") % 3)
        return b.select("trade_date", "ts_code", _r6(factor).alias("adj_factor"))

    def bars_adj(self) -> DataFrame:
        """Bars with the adjustment factor (same derivation, no join needed)."""
        year = F.floor(F.col("trade_date") / 10000)
        factor = 1 + 0.1 * (year - 1995) * (F.col("suppkey") % 3)
        return self.bars().withColumn("adj_factor", _r6(factor))

    def moneyflow(self) -> DataFrame:
        """Buys and sells by order size."""
        size = (
            F.when(F.col("l_quantity") <= 12, "sm")
            .when(F.col("l_quantity") <= 25, "md")
            .when(F.col("l_quantity") <= 38, "lg")
            .otherwise("elg")
        )
        aggs = {}
        for side, status in (("buy", "O"), ("sell", "F")):
            for b in ("sm", "md", "lg", "elg"):
                hit = (size == b) & (F.col("l_linestatus") == status)
                aggs[f"{side}_{b}_amount"] = _r6(F.sum(F.when(hit, F.col("l_extendedprice")).otherwise(0.0)) / 10000)
                aggs[f"{side}_{b}_vol"] = F.round(F.sum(F.when(hit, F.col("l_quantity")).otherwise(0.0)), 2)
        mf = self._panel(aggs)

        def net(kind):
            parts = [F.col(f"buy_{b}_{kind}") - F.col(f"sell_{b}_{kind}") for b in ("sm", "md", "lg", "elg")]
            return _r6(parts[0] + parts[1] + parts[2] + parts[3]).alias(f"net_mf_{kind}")

        return mf.select("*", net("amount"), net("vol"))

    def reports(self) -> DataFrame:
        """Quarterly reports: ts_code, ann_date, end_date and ratios."""
        quarter_end = F.date_add(F.add_months(F.date_trunc("quarter", "ship_day").cast("date"), 3), -1)
        agg = (
            self._weekly()
            .groupBy("suppkey", quarter_end.alias("_qe"))
            .agg(
                _r6(100 * F.avg("l_discount")).alias("roe"),
                _r6(100 * F.avg("l_tax")).alias("roa"),
                _r6(100 * (1 - F.avg("l_discount") - F.avg("l_tax"))).alias("gross_margin"),
                _r6(F.sum("l_extendedprice") / 100000).alias("eps"),
                F.round(F.sum("l_extendedprice"), 2).alias("revenue"),
                _r6(100 * F.avg((F.col("l_linestatus") == "F").cast("double"))).alias("debt_to_assets"),
            )
            .withColumn("ts_code", _code("suppkey"))
        )
        s = Series("ts_code", "_qe")
        agg = agg.withColumns(
            {
                "bps": _r6(F.sum("revenue").over(s.so_far) / 1000000),
                "or_yoy": _r6((safe_div("revenue", s.lag("revenue", 4)) - 1) * 100),
                "end_date": as_int(F.col("_qe")),
                "ann_date": as_int(F.date_add(F.col("_qe"), (20 + F.col("suppkey") % 40).cast("int"))),
            }
        )
        mixes = [_r6(F.expr(e)).alias(n) for n, e in REPORT_MIXES.items()]
        return agg.select(
            "ts_code", "suppkey", "ann_date", "end_date", "roe", "roa", "gross_margin", "eps", "bps",
            "or_yoy", "debt_to_assets", "revenue", *mixes,
        )

    def reports_dirty(self) -> DataFrame:
        """Reports with exact copies, wrong date order and float-like date text."""
        r = self.reports().select("ts_code", "suppkey", "ann_date", "end_date", "roe", "roa", "or_yoy")
        text = r.withColumns(
            {
                "ann_date": F.concat(F.col("ann_date").cast("string"), F.when(F.col("suppkey") % 2 == 0, ".0").otherwise("")),
                "end_date": F.col("end_date").cast("string"),
                "src_row": F.col("end_date").cast("long") * 10,
            }
        )
        # one pass over the reports: each row becomes its variants. Dates leave the generator, so that what is asked of
        # them is asked of reports and does not move down to the order lines
        variant = lambda n, ann: F.struct(F.lit(n).alias("n"), ann.alias("ann"), F.col("end_date").alias("end"))
        variants = F.array(
            variant(0, F.col("ann_date")),
            F.when(F.col("suppkey") % 7 == 0, variant(1, F.col("ann_date"))),
            F.when(F.col("suppkey") % 11 == 0, variant(2, F.col("end_date"))),
            F.when(F.col("suppkey") % 13 == 0, variant(3, F.lit("2020-13-45"))),
        )
        rows = text.withColumn("_v", F.explode(F.filter(variants, lambda v: v.isNotNull())))
        changed = {"ann_date": F.col("_v.ann"), "end_date": F.col("_v.end"), "src_row": F.col("src_row") + F.col("_v.n")}
        return rows.withColumns(changed).drop("_v")

    def industry_members(self) -> DataFrame:
        """Two membership intervals per instrument; every 13th instrument has none."""
        sup = self.table("supplier").where(F.col("s_suppkey") % 13 != 12)
        nat, reg = self.table("nation"), self.table("region")
        labels = nat.join(F.broadcast(reg), F.col("n_regionkey") == F.col("r_regionkey")).select(
            "n_nationkey", F.col("r_name").alias("l1_name"), F.col("n_name").alias("l2_name")
        )  # 25 nations, 5 regions: fixed tables
        switch = F.add_months(F.lit("1998-01-01").cast("date"), (F.col("s_suppkey") % 12).cast("int"))
        code = _code("s_suppkey").alias("ts_code")
        first = sup.select(
            code, F.col("s_nationkey").alias("_n"), F.lit(19950101).alias("in_date"), as_int(switch).alias("out_date")
        )
        second = sup.select(
            code,
            ((F.col("s_nationkey") + 1) % 25).alias("_n"),
            as_int(switch).alias("in_date"),
            F.lit(None).cast("int").alias("out_date"),
        )
        both = first.unionByName(second)
        return both.join(F.broadcast(labels), F.col("_n") == F.col("n_nationkey")).select(
            "ts_code", "l1_name", "l2_name", "in_date", "out_date"
        )

    def industry_latest(self) -> DataFrame:
        """Current label of every classified instrument."""
        return self.industry_members().where(F.col("out_date").isNull()).select("ts_code", "l1_name")

    def name_changes(self) -> DataFrame:
        """One name per supplier-year, the last one open-ended."""
        y = self.lines().select("ts_code", "suppkey", F.year("ship_day").alias("_y")).distinct()
        k = F.col("suppkey") + F.col("_y")
        prefix = F.when(k % 7 == 0, "*ST").when(k % 5 == 0, "ST").otherwise("")
        last = F.max("_y").over(Window.partitionBy("ts_code"))
        return y.withColumn("_last", last).select(
            "ts_code",
            F.concat(prefix, F.lit("Name"), F.col("suppkey").cast("string")).alias("name"),
            (F.col("_y") * 10000 + 101).cast("int").alias("start_date"),
            F.when(F.col("_y") < F.col("_last"), (F.col("_y") * 10000 + 1231).cast("int")).alias("end_date"),
            (F.col("_y") * 10000 + 101).cast("int").alias("ann_date"),
        )

    def suspensions(self) -> DataFrame:
        """Raw suspension flags, with the duplicates and conflicts of the source."""
        li = self.lines().where((F.round("l_discount", 2) == 0.10) & F.col("l_returnflag").isin("R", "A"))
        return li.select(
            "trade_date",
            "ts_code",
            F.when(F.col("l_returnflag") == "R", "S").otherwise("R").alias("suspend_type"),
        )

    def scores(self) -> DataFrame:
        """Model score per date and instrument."""
        return self._panel({"score": _r6(100 * (F.avg("l_discount") - F.avg("l_tax")))})

    def param_grid(self) -> DataFrame:
        """Six parameter rows, as a local table."""
        rows = [(k, n) for k in (5, 10, 20) for n in (1, 5)]
        return self.spark.createDataFrame(rows, "topk int, n_drop int")
