"""Import every query module once; importing registers its queries."""

from . import (  # noqa: F401
    q_aggregates, q_clean, q_cross_section, q_fundamental, q_ic, q_joins, q_matrix, q_moneyflow, q_portfolio, q_price_volume, q_risk, q_sources, q_tables, q_timing,
)
