"""Code and label mappings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the source pipeline's mappings).
# ---------------------------------------------------------------------------
# Region of a store province; provinces not listed keep their own code.
REGION_SINGLE = {"ON": "ONTARIO", "QC": "QUEBEC"}
REGION_WEST = ["AB", "BC", "MB", "SK", "YT", "NT"]
REGION_EAST = ["NS", "NB", "NL", "PE"]

# Projection year of a demographic variable, from its 3-character prefix.
YEAR_BY_PREFIX = {"EHY": 2018, "ECY": 2023, "P3Y": 2026, "P5Y": 2028, "P0Y": 2033}

# Newcomer variables (prefix NC24) belong to 2024 in the current-year leg.
NEWCOMER_PREFIX = "NC24"
NEWCOMER_YEAR = 2024
CURRENT_YEAR = 2023

# Prefix length of variable codes; the rest is the variable's suffix key.
CODE_PREFIX_LEN = 3


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def region(province) -> Column:
    p = _c(province)
    out = F.when(p == "ON", REGION_SINGLE["ON"]).when(p == "QC", REGION_SINGLE["QC"])
    return out.when(p.isin(REGION_WEST), "WEST").when(p.isin(REGION_EAST), "EAST").otherwise(p)


def code_prefix(code) -> Column:
    return F.substring(_c(code), 1, CODE_PREFIX_LEN)


def suffix_key(code) -> Column:
    """The code without its 3-character year prefix."""
    return F.substr(_c(code), F.lit(CODE_PREFIX_LEN + 1))


def year_from_code(code) -> Column:
    """Year tag from the variable prefix; NULL for unknown prefixes."""
    prefix = code_prefix(code)
    out = None
    for p, yr in YEAR_BY_PREFIX.items():
        out = (F.when if out is None else out.when)(prefix == p, F.lit(yr))
    return out


def newcomer_year(variable) -> Column:
    """2024 for newcomer variables, else the current year (2023 leg)."""
    return F.when(_c(variable).startswith(NEWCOMER_PREFIX), F.lit(NEWCOMER_YEAR)).otherwise(F.lit(CURRENT_YEAR))
