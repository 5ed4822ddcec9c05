"""Output presentation for comparable results: fixed column lists and
per-column rounding (summation order differs between engines)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Digits kept per floating-point output column.
ROUND_DIGITS = {
    "HAVERSINE_DISTANCE": 4,
    "CUMULATIVE_PERCENT_ATTRACTION": 6,
    "PERCENT_ATTRACTION": 6,
    "EXCLUDED_ATTRACTION": 6,
    "REVENUE_CY": 4,
    "STORE_LATITUDE": 6,
    "STORE_LONGITUDE": 6,
    "LATITUDE": 6,
    "LONGITUDE": 6,
    "AREA": 4,
    "value": 4,
    "val": 4,
    "TOTAL_HOUSEHOLDS": 4,
    "TOTAL_HOUSEHOLD_POPULATION": 4,
    "TOTAL_HOUSEHOLD_POPULATION_15_YEARS_OR_OVER": 4,
    "TOTAL_POPULATION": 4,
    "TOTAL_CATEGORY": 4,
    "STORE_VALUE": 6,
    "STORE_RATIO": 6,
    "BANNER_VALUE": 6,
    "CHANNEL_RE_VALUE": 6,
    "REGION_VALUE": 6,
    "CHANNEL_VALUE": 6,
    "BANNER_VALUE_PERCENT": 6,
    "CHANNEL_RE_VALUE_PERCENT": 6,
    "REGION_VALUE_PERCENT": 6,
    "CHANNEL_VALUE_PERCENT": 6,
    "Median_BANNER_VALUE": 6,
    "Median_REGION_VALUE": 6,
    "Median_CHANNEL_VALUE": 6,
    "MEDIAN": 6,
}
# Columns with a value of its own for every pair, rounded by ``decimals``.  Not
# all are: a stage whose code outgrows 8,000 bytes is not compiled by the JVM.
QUICK = {"HAVERSINE_DISTANCE", "CUMULATIVE_PERCENT_ATTRACTION", "PERCENT_ATTRACTION"}
# Columns whose values span many magnitudes keep significant digits instead.
SIGNIFICANT = {"Attraction": 9, "Max_Attraction": 9, "TOTAL_POSTALCODE_ATTRACTION": 9}
PREFIX_DIGITS = {"COMPETITION_ATTRACTION_": 6}


def digits(name: str) -> int | None:
    if name in ROUND_DIGITS:
        return ROUND_DIGITS[name]
    for prefix, d in PREFIX_DIGITS.items():
        if name.startswith(prefix):
            return d
    return None


def decimals(x: Column, n: int) -> Column:
    """``round(x, n)`` of a double.  Spark rounds its decimal text; the whole
    number next to ``x * 10 ** n`` over ``10 ** n`` is the same double, but
    for values near a half and large ones, which Spark rounds."""
    ten = F.lit(float(10**n))
    plain = F.abs(x * ten - F.rint(x * ten)) + F.abs(x) * 1e-8 < 0.499
    return F.when(plain, F.rint(x * ten) / ten + 0.0).otherwise(F.round(x, n))  # + 0.0: Spark's round has no -0.0


def significant(x: Column, n: int) -> Column:
    """``x`` rounded to ``n`` significant digits, the double nearest to that
    decimal: a whole number of ``n`` digits times or over a power of ten, both
    exact up to 10 ** 22.  Other magnitudes are rounded as text."""
    text = F.format_string(f"%.{n - 1}e", x).cast("double")
    shift = F.lit(n - 1) - F.floor(F.log10(F.abs(x)))
    tens = F.array(*[F.lit(float(f"1e{k}")) for k in range(23)])
    ten = F.element_at(tens, (F.abs(shift) + 1).cast("int"))
    scaled = F.when(shift >= 0, F.rint(x * ten) / ten).otherwise(F.rint(x / ten) * ten)
    plain = (F.abs(x) > 1e-14) & (F.abs(x) < 1e30)
    return F.when(plain, scaled).when(x.isNotNull(), text)


def present(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Select ``columns`` (default: all) and round the floating-point ones, to
    decimals or to significant digits."""
    cols = columns or df.columns
    double = {name for name, kind in df.dtypes if kind == "double"}
    out = []
    for c in cols:
        d = digits(c)
        if c in SIGNIFICANT:
            out.append(significant(F.col(f"`{c}`"), SIGNIFICANT[c]).alias(c))
            continue
        if d is None:
            out.append(F.col(f"`{c}`"))
            continue
        rounded = decimals if c in QUICK & double else F.round
        out.append(rounded(F.col(f"`{c}`"), d).alias(c))
    return df.select(*out)


def sql_select_list(columns: list[str], table_alias: str = "q") -> str:
    """The oracle-side counterpart of ``present`` as a SELECT list."""
    parts = []
    for c in columns:
        d = digits(c)
        ref = f'{table_alias}."{c}"'
        if c in SIGNIFICANT:
            parts.append(f"CAST(printf('%.{SIGNIFICANT[c] - 1}e', CAST({ref} AS DOUBLE)) AS DOUBLE) AS \"{c}\"")
            continue
        parts.append(f'round({ref}, {d}) AS "{c}"' if d is not None else f'{ref} AS "{c}"')
    return ", ".join(parts)
