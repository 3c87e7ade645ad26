"""Small text builders for the comparison SQL."""

from __future__ import annotations

BY = "PARTITION BY ts_code ORDER BY trade_date"


def over(n: int, end: int = 0, by: str = BY) -> str:
    hi = "CURRENT ROW" if end == 0 else (f"{-end} PRECEDING" if end < 0 else f"{end} FOLLOWING")
    return f"OVER ({by} ROWS BETWEEN {n - 1} PRECEDING AND {hi})"


def roll(fn: str, x: str, n: int, m: int | None = None, by: str = BY) -> str:
    m = n if m is None else m
    w = over(n, by=by)
    call = fn.format(x=x) if "{x}" in fn else f"{fn}({x})"
    return f"(CASE WHEN count({x}) {w} >= {m} THEN {call} {w} END)"


def lag(x: str, n: int = 1, by: str = BY) -> str:
    return f"(lag({x}, {n}) OVER ({by}))"


def lead(x: str, n: int = 1, by: str = BY) -> str:
    return f"(lead({x}, {n}) OVER ({by}))"


def pct(x: str, n: int, by: str = BY) -> str:
    return f"({x} / nullif({lag(x, n, by)}, 0) - 1)"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif(({b}), 0))"


def corr(x: str, y: str, n: int, m: int | None = None, by: str = BY) -> str:
    m = n if m is None else m
    w = over(n, by=by)
    px = f"CASE WHEN {y} IS NOT NULL THEN {x} END"
    py = f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    return (
        f"(CASE WHEN count({px}) {w} >= {m} AND max({px}) {w} > min({px}) {w} AND max({py}) {w} > min({py}) {w} "
        f"THEN corr({px}, {py}) {w} END)"
    )


def rank_pct(x: str, part: str) -> str:
    """Average rank over the non-null count; null stays null."""
    return (
        f"(CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {part} ORDER BY {x} NULLS LAST) "
        f"+ (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0) / (count({x}) OVER (PARTITION BY {part})) END)"
    )


def avg_rank(x: str, part: str) -> str:
    return (
        f"(CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {part} ORDER BY {x} NULLS LAST) "
        f"+ (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0 END)"
    )


def select(cols: dict[str, str], table: str, keys: str = "trade_date, ts_code") -> str:
    body = ", ".join(f"{e} AS {n}" for n, e in cols.items())
    return f"SELECT {keys}, {body} FROM {table}"
