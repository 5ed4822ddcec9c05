"""Pipeline inputs derived from the driver's TPC-H-style parquet tables.

The production inputs are warehouse tables (stores, postal-code polygons,
long feature tables, variable master dimension, language mapping).  Here
``supplier`` plays the stores and ``customer`` the postal-code polygons
(three customers per postal code); the long feature tables are generated per
postal code.  Every derivation is a projection of the base tables, so its
size grows with them.  The definitions match FIXTURES.md section B, whose SQL
text is the oracle's copy.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from .tables import literal_rows_sql, local_table

# ---------------------------------------------------------------------------
# Fixed values of the fixtures (FIXTURES.md section B).
# ---------------------------------------------------------------------------
PROVINCE_CODES = ["ON", "QC", "AB", "BC", "SK", "MB", "NB", "NL", "NS", "PE", "YT", "NT", "NU"]

# Customers per postal code: customers 3k, 3k+1, 3k+2 are the polygons of
# postal code number 3k; customer 3k is the postal code's own record.
POLYGONS_PER_POSTAL = 3

# (suffix, Description, Category, ADD_TO_PROFILE, LEAF_NODE_FLAG, TOTAL_FLAG)
FEATURE_VARIABLES = [
    ("BASPOP", "Total Population", "Basics", 1, 0, 1),
    ("BASHHD", "Total Households", "Basics", 1, 0, 0),
    ("BASHPOP", "Total Household Population", "Basics", 1, 0, 0),
    ("BAS15HP", "Total Household Population 15+", "Basics", 1, 0, 0),
    ("INC0", "Household Income ($0-$50) (Current Year $)", "Income", 1, 1, 0),
    ("INC1", "Household Income, Over $50.", "Income", 1, 1, 0),
    ("INCT", "Household Income Total", "Income", 1, 0, 1),
    ("INCM", "Household Income Mid Node", "Income", 1, 0, 0),
    ("CIV", "Born in Côte d'Ivoire", "Birthplace", 1, 1, 0),
    ("BPT", "Household Population For Recent Immigration By Place Of Birth", "Birthplace", 1, 0, 1),
    ("TR1", "Trend One", "Trends", 1, 1, 0),
    ("HID", "Hidden", "Income", 0, 1, 0),
]

# (code prefix, projection year)
FEATURE_YEARS = [("EHY", 2018), ("ECY", 2023), ("P3Y", 2026), ("P5Y", 2028), ("P0Y", 2033)]

NEWCOMER_CATEGORY = "23Q2 to 24Q1 - Temporary Resident - Region of Citizenship"
# (code, description, leaf flag)
NEWCOMER_VARIABLES = [
    ("NC24TR01", "Temporary Resident - Asia", 1),
    ("NC24TR02", "Temporary Resident - Europe", 1),
    ("NC24TRT", "Temporary Resident Total", 0),
]

LANGUAGE_ROWS = [("ECYCIV", "French"), ("P3YCIV", "French"), ("NC24TR01", "Asian")]

# (code, description, category)
SOCIAL_VALUE_VARIABLES = [
    ("SVBAS15HP", "Household Population 15+", "Basics"),
    ("SV001", "Importance of Price", "Consumption"),
    ("SV002", "Brand Apathy", "Attitudes"),
    ("SV003", "Uncategorised", None),
]
SOCIAL_VALUE_YEARS = [2023, 2024]


# ---------------------------------------------------------------------------
# Base tables
# ---------------------------------------------------------------------------
def read_base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of a base table, from wherever Spark finds the folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _province(key: Column) -> Column:
    """Province code by position (key modulo 13)."""
    codes = F.array(*[F.lit(c) for c in PROVINCE_CODES])
    return F.element_at(codes, (key % len(PROVINCE_CODES) + 1).cast("int"))


def _case(key: Column, labels: list[str]) -> Column:
    """labels[key % len(labels)]."""
    return F.element_at(F.array(*[F.lit(x) for x in labels]), (key % len(labels) + 1).cast("int"))


def _postal_code(number: Column) -> Column:
    return F.concat(F.lit("P"), F.lpad(number.cast("string"), 7, "0"))


# ---------------------------------------------------------------------------
# Stores and postal-code polygons
# ---------------------------------------------------------------------------
def stores_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    chain = (
        F.when(s % 37 == 36, F.lit(None).cast("string"))
        .when(s % 5 == 0, "AOL_AO LOCAL")
        .when(s % 5 == 1, "AON_AO NATL RETAIL")
        .when(s % 5 == 2, "GROUP A")
        .otherwise("GROUP B")
    )
    return (
        read_base(spark, sf_dir, "supplier")
        .select(
            s.cast("bigint").alias("STORE_NUM"),
            F.concat(
                _case(s, ["ACME", "BIG MART", "CORNER", "DEPOT"]),
                F.lit(" #"),
                s.cast("string"),
                F.lit(" NORTH YORK FOODS"),
            ).alias("STORE_NAME"),
            _case(s, ["FRESH MART", "VALUE STOP", "CITY GROCER", "PRIME", "CLUB", "LOCAL CO"]).alias("BANNER"),
            F.concat(s.cast("string"), F.lit(" MAIN ST")).alias("STREET"),
            F.lit(None).cast("string").alias("POSTAL_CODE"),
            _province(F.col("s_nationkey")).alias("PROVINCE"),
            chain.alias("STORE_CHAIN"),
            (F.lit(-60.0) - (s * 53) % 6000 / F.lit(100.0)).alias("LONGITUDE"),
            (F.lit(43.0) + (s * 37) % 1000 / F.lit(100.0)).alias("LATITUDE"),
            F.when(s % 29 == 28, F.lit(None).cast("double")).otherwise(F.abs("s_acctbal")).alias("REVENUE_CY"),
            _case(s, ["GROCERY", "MASS", "DRUG"]).alias("CHANNEL"),
            _case(s, ["EAST TEAM", "WEST TEAM"]).alias("SALES_GROUP"),
        )
        .filter(F.col("PROVINCE").isNotNull())
    )


def _ldu_part(spark: SparkSession, sf_dir: str, keep: Column) -> DataFrame:
    c = F.col("c_custkey")
    number = c - c % POLYGONS_PER_POSTAL
    return (
        read_base(spark, sf_dir, "customer")
        .filter(keep)
        .select(
            _postal_code(number).alias("POSTALCODE"),
            _province(number).alias("PROV"),
            (F.lit(-60.005) - (c * 59) % 6000 / F.lit(100.0)).alias("LONGITUDE"),
            (F.lit(43.005) + (c * 41) % 1000 / F.lit(100.0)).alias("LATITUDE"),
            F.col("c_acctbal").alias("AREA"),
        )
        .filter(F.col("PROV").isNotNull())
    )


def ldu_part1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygon part 1: even customers."""
    return _ldu_part(spark, sf_dir, F.col("c_custkey") % 2 == 0)


def ldu_part2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygon part 2: odd customers plus those divisible by 6, so the two
    parts overlap and a set union has duplicates to remove."""
    c = F.col("c_custkey")
    return _ldu_part(spark, sf_dir, (c % 2 == 1) | (c % 6 == 0))


# ---------------------------------------------------------------------------
# Long feature tables
# ---------------------------------------------------------------------------
def _postal_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per postal code from all of its customers: the postal
    code's number (as c_custkey) and their balances added up, in cents."""
    c = F.col("c_custkey")
    cents = F.round(F.col("c_acctbal") * 100).cast("long")
    return read_base(spark, sf_dir, "customer").groupBy((c - c % POLYGONS_PER_POSTAL).alias("c_custkey")).agg(
        F.abs(F.sum(cents)).alias("cents")
    )


def _literal_rows(rows: list[tuple], names: list[str]) -> Column:
    """An array of structs built from literal rows (explode it to expand)."""
    return F.expr(literal_rows_sql(rows, names))


def features_demo(spark: SparkSession, sf_dir: str, prefixes: list[str] | None = None) -> DataFrame:
    """Demographic long features for the given year prefixes (default: all)
    and every variable."""
    combos = [
        (prefix, yr, suffix, desc, cat)
        for (suffix, desc, cat, *_flags) in FEATURE_VARIABLES
        for (prefix, yr) in FEATURE_YEARS
        if prefixes is None or prefix in prefixes
    ]
    c = F.col("c_custkey")
    v = F.col("v")
    value = (
        F.when(
            (v.Category != "Basics") & ((c + v.yr) % 11 == 0), F.lit(None).cast("double")
        ).otherwise(((c * 31 + v.yr * 7 + F.length(v.suffix) * 13 + F.col("cents")) % 997 + 1).cast("double"))
    )
    return (
        _postal_customers(spark, sf_dir)
        .select(c, "cents", F.explode(_literal_rows(combos, ["prefix", "yr", "suffix", "Description", "Category"])).alias("v"))
        .filter(~((v.suffix == "INC1") & (c % 21 == 0)))
        .select(
            _postal_code(c).alias("CODE"),
            F.concat(v.prefix, v.suffix).alias("var_code"),
            value.alias("var_value"),
            v.Description.alias("Description"),
            v.Category.alias("Category"),
        )
    )


def features_newcomer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newcomer (temporary resident) long features."""
    c = F.col("c_custkey")
    v = F.col("v")
    rows = [(code, desc) for code, desc, _leaf in NEWCOMER_VARIABLES]
    return _postal_customers(spark, sf_dir).select(
        c, "cents", F.explode(_literal_rows(rows, ["code", "descr"])).alias("v")
    ).select(
        _postal_code(c).alias("CODE"),
        v.code.alias("var_code"),
        ((c * 17 + F.length(v.descr) + F.col("cents")) % 101).cast("double").alias("var_value"),
        v.descr.alias("Description"),
        F.lit(NEWCOMER_CATEGORY).alias("Category"),
    )


def features_social(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Social-value long features for both years (YEAR tells the tables apart)."""
    combos = [(code, desc, cat, yr) for (code, desc, cat) in SOCIAL_VALUE_VARIABLES for yr in SOCIAL_VALUE_YEARS]
    c = F.col("c_custkey")
    v = F.col("v")
    return _postal_customers(spark, sf_dir).select(
        c, "cents", F.explode(_literal_rows(combos, ["code", "descr", "cat", "yr"])).alias("v")
    ).select(
        _postal_code(c).alias("CODE"),
        v.code.alias("var_code"),
        ((c * 13 + v.yr + F.length(v.descr) + F.col("cents")) % 211 + 1).cast("double").alias("var_value"),
        v.descr.alias("Description"),
        v.cat.cast("string").alias("Category"),
        v.yr.cast("int").alias("YEAR"),
    )


def feature_parts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The six raw feature tables: four projection-year tables and two
    newcomer parts.  The year tables are the demographic features split by
    code prefix (EHY/ECY together, as the current-year table carries both);
    the newcomer parts split the newcomer rows by postal-code parity."""
    years = [
        features_demo(spark, sf_dir, ["EHY", "ECY"]),
        features_demo(spark, sf_dir, ["P3Y"]),
        features_demo(spark, sf_dir, ["P5Y"]),
        features_demo(spark, sf_dir, ["P0Y"]),
    ]
    new = features_newcomer(spark, sf_dir)
    number = F.substring("CODE", 2, 7).cast("bigint")
    return years + [new.filter(number % 2 == 0), new.filter(number % 2 == 1)]


def social_value_parts(spark: SparkSession, sf_dir: str) -> dict[int, DataFrame]:
    """One raw social-value table per year (without the YEAR column)."""
    sv = features_social(spark, sf_dir)
    return {yr: sv.filter(F.col("YEAR") == yr).drop("YEAR") for yr in SOCIAL_VALUE_YEARS}


# ---------------------------------------------------------------------------
# Small dimensions
# ---------------------------------------------------------------------------
def master_dim(spark: SparkSession) -> DataFrame:
    rows = [
        (f"ECY{suffix}", cat, f"All > {cat} > {suffix}", "N", add, leaf, total, None)
        for (suffix, _desc, cat, add, leaf, total) in FEATURE_VARIABLES
    ] + [
        (code, NEWCOMER_CATEGORY, f"New > {code}", "N", 0, leaf, 1 - leaf, 2024)
        for (code, _desc, leaf) in NEWCOMER_VARIABLES
    ]
    return local_table(spark, rows, schemas.MASTER_DIM)


def language_mapping(spark: SparkSession) -> DataFrame:
    return local_table(spark, LANGUAGE_ROWS, schemas.LANGUAGE_MAPPING)
