"""Row filters, deduplication, category mapping and trading-rule flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip, finite, is_blank, safe_div, yyyymmdd


def parse_dates(df: DataFrame, columns: Sequence[str], strict: bool = False) -> DataFrame:
    """YYYYMMDD integers; ``strict`` fails the job at the first value that is no date."""
    out = {}
    for c in columns:
        parsed = yyyymmdd(c)
        if strict:
            parsed = F.coalesce(
                parsed, F.raise_error(F.concat(F.lit(f"{c} is no YYYYMMDD date: "), F.coalesce(F.col(c).cast("string"), F.lit("null")))).cast("int")
            )
        out[c] = parsed
    return df.withColumns(out)


def optional_date(c: str) -> Column:
    """Empty text is an open date."""
    return yyyymmdd(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")))


def drop_invalid_keys(df: DataFrame, date_col: str = "trade_date", code_col: str = "ts_code") -> DataFrame:
    return df.where(F.col(date_col).isNotNull() & ~is_blank(code_col))


def invalid_key_count(df: DataFrame, date_col: str = "trade_date", code_col: str = "ts_code") -> DataFrame:
    bad = F.col(date_col).isNull() | is_blank(code_col)
    return df.agg(F.sum(F.when(bad, 1).otherwise(0)).alias("invalid_keys"), F.count("*").alias("rows"))


def ordered_dates(df: DataFrame, earlier: str = "end_date", later: str = "ann_date") -> DataFrame:
    """Rows whose two dates parse and stand in the right order."""
    a, b = yyyymmdd(earlier), yyyymmdd(later)
    return df.where(a.isNotNull() & b.isNotNull() & (b > a)).withColumns({earlier: a, later: b})


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """First (or last) row per key by an explicit order; Spark pre-filters per task before the exchange."""
    cols = [F.desc(o) if last else F.asc(o) for o in order]
    w = Window.partitionBy(*keys).orderBy(*cols)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count (partial aggregation, no row is shipped)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row of a duplicated key."""
    return df.join(duplicate_keys(df, keys).drop("n_rows"), list(keys), "left_semi")


def conflicting_keys(df: DataFrame, keys: Sequence[str], attribute: str) -> DataFrame:
    """Keys with more than one distinct attribute value."""
    agg = df.groupBy(*keys).agg(F.min(attribute).alias("lo"), F.max(attribute).alias("hi"))
    return agg.where(F.col("lo") < F.col("hi"))


def filter_instruments(df: DataFrame, instruments, col: str = "ts_code", time_col: str = "trade_date") -> DataFrame:
    """``'all'``, a list of codes, a map code -> (start, end), or a table of codes."""
    if isinstance(instruments, str) and instruments.lower() == "all":
        return df
    if isinstance(instruments, DataFrame):
        return df.join(instruments.select(col).distinct(), col, "left_semi")
    if isinstance(instruments, Mapping):
        cond = F.lit(False)
        for code, (lo, hi) in instruments.items():
            cond = cond | ((F.col(col) == code) & F.col(time_col).between(lo, hi))
        return df.where(cond)
    return df.where(F.col(col).isin(list(instruments)))


def filter_time(df: DataFrame, start: int | None = None, end: int | None = None, col: str = "trade_date") -> DataFrame:
    if start is not None:
        df = df.where(F.col(col) >= start)
    if end is not None:
        df = df.where(F.col(col) <= end)
    return df


def filter_dates(df: DataFrame, dates: DataFrame, col: str = "trade_date") -> DataFrame:
    return df.join(dates.select(col).distinct(), col, "left_semi")


def fill_defaults(df: DataFrame, defaults: Mapping[str, int]) -> DataFrame:
    """Flag columns with a default after a left join."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)).cast("tinyint") for c, v in defaults.items()})


def normalize_symbol(c: str) -> Column:
    """``000001.SZ`` → ``sz000001``; a code without a suffix is only lowered."""
    parts = F.split(F.col(c), r"\.")
    return F.when(F.size(parts) == 2, F.lower(F.concat(parts[1], parts[0]))).otherwise(F.lower(F.col(c)))


def derived_features(df: DataFrame) -> DataFrame:
    """Ratios a training matrix adds to raw bars."""
    log_of = lambda c: F.when(F.col(c) >= 0, F.log1p(F.col(c)))
    return df.withColumns(
        {
            "ret_1": safe_div("close", "pre_close") - 1,
            "range": safe_div(F.col("high") - F.col("low"), "close"),
            "close_open": safe_div("close", "open") - 1,
            "high_open": safe_div("high", "open") - 1,
            "low_open": safe_div("low", "open") - 1,
            "log_volume": log_of("vol"),
            "log_amount": log_of("amount"),
            "vwap": safe_div("amount", "vol"),
        }
    )


def alias_columns(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rename the first alias present to its canonical name."""
    for name, options in aliases.items():
        if name in df.columns:
            continue
        hit = next((o for o in options if o in df.columns), None)
        if hit:
            df = df.withColumnRenamed(hit, name)
    return df


# Listing-status marks in a security's name.
STAR_MARK, WARN_MARK, DELISTING_MARK = "*ST", "ST", "退"


def name_status(c: str) -> Column:
    """2 for a star or delisting mark, 1 for a warning mark, else 0."""
    name = F.trim(F.coalesce(F.col(c), F.lit("")))
    upper = F.upper(name)
    return (
        F.when(upper.startswith(STAR_MARK), 2)
        .when(upper.startswith(WARN_MARK), 1)
        .when(name.endswith(DELISTING_MARK), 2)
        .otherwise(0)
    )


def map_categories(df: DataFrame, lookup: DataFrame, col: str, out: str) -> DataFrame:
    """Translate a category; unmapped rows are dropped. ``lookup`` has columns (col, out)."""
    return df.join(lookup, col, "inner")


def unmapped_categories(df: DataFrame, lookup: DataFrame, col: str) -> DataFrame:
    return df.select(col).where(F.col(col).isNotNull()).distinct().join(lookup, col, "left_anti")


def onehot_to_label(columns: Sequence[str], prefix: str) -> Column:
    """Name of the first set column, null if none is set."""
    return F.coalesce(*[F.when(F.col(c) == 1, F.lit(c.removeprefix(prefix))) for c in columns])


def label_to_onehot(df: DataFrame, label: str, values: Sequence[str], prefix: str) -> DataFrame:
    return df.withColumns(
        {f"{prefix}{v}": F.coalesce((F.col(label) == v).cast("tinyint"), F.lit(0).cast("tinyint")) for v in values}
    )


def drop_benchmark_category(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop the first dummy so that the rest is not collinear with an intercept."""
    return df.drop(sorted(columns)[0])


def session_returns(bars: DataFrame, lo: float = -0.35, hi: float = 0.60) -> DataFrame:
    """Full-day, overnight and intraday return, clipped, and the opening gap in percent.

    A gap or intraday move without two positive prices is zero.
    """

    def move(a: str, b: str) -> Column:
        usable = (F.col(a) > 0) & (F.col(b) > 0)
        return F.when(usable, clip(safe_div(F.col(a) - F.col(b), b), lo, hi)).otherwise(0.0)

    df = bars.withColumns(
        {
            "full_ret": clip(F.col("pct_chg") / 100.0, lo, hi),
            "gap_ret": move("open", "pre_close"),
            "intraday_ret": move("close", "open"),
        }
    )
    return df.withColumn("open_gap_pct", F.col("gap_ret") * 100.0)


def is_st(st: str = "st_stock", star: str = "star_st_stock") -> Column:
    return F.when((F.coalesce(F.col(st), F.lit(0)) == 1) | (F.coalesce(F.col(star), F.lit(0)) == 1), 1).otherwise(0)


def price_limit(code: str = "ts_code", st: str = "is_st") -> Column:
    """Daily limit by board prefix. 0.29, 0.19, 0.049 and 0.095."""
    c = F.col(code)
    return (
        F.when(c.startswith("8") | c.startswith("92"), 0.29)
        .when(c.startswith("68") | c.startswith("30"), 0.19)
        .when(F.col(st) == 1, 0.049)
        .otherwise(0.095)
    )


def change_rate(price: str = "open") -> Column:
    """Day's change: the quoted one, else from the price, else zero."""
    usable = F.col(price).isNotNull() & (F.col("pre_close") > 0)
    return (
        F.when(F.col("pct_chg").isNotNull(), F.col("pct_chg") / 100.0)
        .when(usable, F.col(price) / F.nullif(F.col("pre_close"), F.lit(0.0)) - 1)
        .otherwise(0.0)
    )


def trade_blocks(df: DataFrame, price: str = "open") -> DataFrame:
    """Flags for names that cannot be bought (at either limit) or sold (at the lower limit)."""
    change, limit = change_rate(price), F.col("price_limit")
    dead = F.coalesce(F.col(price) <= 0, F.lit(True)) | F.coalesce(F.col("vol") <= 0, F.lit(False))
    return df.withColumns(
        {
            "buy_blocked": (dead | (change >= limit) | (change <= -limit)).cast("int"),
            "sell_blocked": (dead | (change <= -limit)).cast("int"),
        }
    )


def eligible_universe(
    df: DataFrame, min_listed_days: int = 0, min_avg_amount: float = 0.0
) -> DataFrame:
    """Buyable, unflagged, old enough and liquid names.

    Expects buy_blocked, is_st, is_suspect, listed_days and avg_amount_20d. An unknown
    listing date counts as old, an unknown liquidity as zero.
    """
    cond = (F.col("buy_blocked") == 0) & (F.coalesce("is_st", F.lit(0)) == 0)
    cond = cond & (F.coalesce("is_suspect", F.lit(0)) == 0)
    if min_listed_days > 0:
        cond = cond & (F.coalesce(F.col("listed_days"), F.lit(2**31 - 1)) >= min_listed_days)
    if min_avg_amount > 0:
        cond = cond & (F.coalesce(F.col("avg_amount_20d"), F.lit(0.0)) >= min_avg_amount)
    return df.where(cond)


def finite_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: finite(c) for c in columns})


def split_feature_label(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Rows with a label; features without gaps."""
    df = df.withColumns({c: F.coalesce(finite(c), F.lit(0.0)) for c in features})
    return df.withColumn(label, finite(label)).where(F.col(label).isNotNull())


def select_features(sources: Mapping[str, DataFrame], wanted: Sequence[str], keys: Sequence[str]) -> dict[str, DataFrame]:
    """Read only the wanted columns of each source; a name no source has is an error."""
    known = {c for df in sources.values() for c in df.columns}
    unknown = [w for w in wanted if w not in known]
    if unknown:
        raise ValueError(f"unknown features: {unknown}")
    plan: dict[str, DataFrame] = {}
    left = list(wanted)
    for name, df in sources.items():
        here = [w for w in left if w in df.columns and w not in keys]
        if here:
            plan[name] = df.select(*keys, *here)
            left = [w for w in left if w not in here]
    return plan
