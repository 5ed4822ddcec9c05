"""Text clean-up as native regexp expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the source pipeline's patterns), applied in order.
# ---------------------------------------------------------------------------
CURRENT_YEAR_DOLLARS = r" \(Current Year \$\)"
IVORY_COAST = ("Côte d'Ivoire", "Cote d Ivoire")
PUNCTUATION = r"[$,.\-'()]"

# Customer groups whose chain name is taken from the store name.
CHAIN_FROM_NAME_GROUPS = ["AOL_AO LOCAL", "AON_AO NATL RETAIL"]
# Store number and up to two following words, e.g. "#123 NORTH YORK ".
STORE_NUMBER_WORDS = r"#\d+\s*[A-Z]*\s*[A-Z]*\s*"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_description(text) -> Column:
    """Drop ' (Current Year $)', spell out Cote d Ivoire, drop $ , . - ' ( )."""
    out = F.regexp_replace(_c(text), CURRENT_YEAR_DOLLARS, "")
    out = F.regexp_replace(out, IVORY_COAST[0], IVORY_COAST[1])
    return F.regexp_replace(out, PUNCTUATION, "")


def store_chain(customer_group, store_name) -> Column:
    """Chain label: for local / national-retail groups the store name without
    its number block, else the customer group."""
    group = _c(customer_group)
    return F.when(
        group.isin(CHAIN_FROM_NAME_GROUPS), F.regexp_replace(_c(store_name), STORE_NUMBER_WORDS, "")
    ).otherwise(group)


def excluded_label(name) -> Column:
    """Label of an excluded competitor as written in column names: spaces
    become underscores.  Only a label; comparisons use the real value."""
    return F.translate(_c(name), " ", "_")
