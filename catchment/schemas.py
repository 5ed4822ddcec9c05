"""Column contracts at module edges.

Names follow the warehouse tables the pipeline reads and writes, so results
can be published into existing tables unchanged.
"""

from pyspark.sql import types as T

# Store attributes carried through attraction, competition and profiles.
STORE_COLUMNS = [
    "STORE_NUM",
    "CUSTOMER_GROUP",
    "STORE_NAME",
    "CHANNEL",
    "SALES_GROUP",
    "BANNER",
    "STORE_STREET",
    "STORE_PROVINCE",
    "STORE_LATITUDE",
    "STORE_LONGITUDE",
]

STORES_RAW = T.StructType(
    [
        T.StructField("STORE_NUM", T.LongType()),
        T.StructField("STORE_NAME", T.StringType()),
        T.StructField("BANNER", T.StringType()),
        T.StructField("STREET", T.StringType()),
        T.StructField("POSTAL_CODE", T.StringType()),
        T.StructField("PROVINCE", T.StringType()),
        T.StructField("STORE_CHAIN", T.StringType()),
        T.StructField("LONGITUDE", T.DoubleType()),
        T.StructField("LATITUDE", T.DoubleType()),
        T.StructField("REVENUE_CY", T.DoubleType()),
        T.StructField("CHANNEL", T.StringType()),
        T.StructField("SALES_GROUP", T.StringType()),
    ]
)

LDU_POLYGONS = T.StructType(
    [
        T.StructField("POSTALCODE", T.StringType()),
        T.StructField("PROV", T.StringType()),
        T.StructField("LONGITUDE", T.DoubleType()),
        T.StructField("LATITUDE", T.DoubleType()),
        T.StructField("AREA", T.DoubleType()),
    ]
)

# Fixed values (column names and orders of published tables): full attraction
# table, one row per store x postal code.
ATTRACTION_COLUMNS = [
    "STORE_NUM",
    "CUSTOMER_GROUP",
    "STORE_NAME",
    "CHANNEL",
    "SALES_GROUP",
    "BANNER",
    "STORE_STREET",
    "STORE_PROVINCE",
    "POSTALCODE",
    "STORE_LATITUDE",
    "STORE_LONGITUDE",
    "LATITUDE",
    "LONGITUDE",
    "PROV",
    "Attraction",
    "TOTAL_POSTALCODE_ATTRACTION",
    "CUMULATIVE_PERCENT_ATTRACTION",
    "REVENUE_CY",
    "HAVERSINE_DISTANCE",
]

# Attraction after the share cut, with PERCENT_ATTRACTION.
SHARE_COLUMNS = [
    "STORE_NUM",
    "CUSTOMER_GROUP",
    "STORE_NAME",
    "CHANNEL",
    "SALES_GROUP",
    "BANNER",
    "STORE_STREET",
    "STORE_PROVINCE",
    "POSTALCODE",
    "STORE_LATITUDE",
    "STORE_LONGITUDE",
    "LATITUDE",
    "LONGITUDE",
    "PROV",
    "Attraction",
    "TOTAL_POSTALCODE_ATTRACTION",
    "CUMULATIVE_PERCENT_ATTRACTION",
    "PERCENT_ATTRACTION",
    "REVENUE_CY",
    "HAVERSINE_DISTANCE",
]

# Raw long features (one table per projection year / newcomer part).
# VARIABLES / VALUES are keywords in most SQL dialects; the fixtures call
# them var_code / var_value and the loaders rename them to variable / value.
RAW_FEATURES = T.StructType(
    [
        T.StructField("CODE", T.StringType()),
        T.StructField("var_code", T.StringType()),
        T.StructField("var_value", T.DoubleType()),
        T.StructField("Description", T.StringType()),
        T.StructField("Category", T.StringType()),
    ]
)

MASTER_DIM = T.StructType(
    [
        T.StructField("variable", T.StringType()),
        T.StructField("Category", T.StringType()),
        T.StructField("Hierarchy_Description", T.StringType()),
        T.StructField("MEDIAN_AVERAGE", T.StringType()),
        T.StructField("ADD_TO_PROFILE", T.IntegerType()),
        T.StructField("LEAF_NODE_FLAG", T.IntegerType()),
        T.StructField("TOTAL_FLAG", T.IntegerType()),
        T.StructField("YEAR", T.IntegerType()),
    ]
)

LANGUAGE_MAPPING = T.StructType(
    [
        T.StructField("Variable", T.StringType()),
        T.StructField("Language_Grouping", T.StringType()),
    ]
)

DIM_COLUMNS = ["Hierarchy_Description", "MEDIAN_AVERAGE", "ADD_TO_PROFILE", "LEAF_NODE_FLAG", "TOTAL_FLAG"]

# Melted demographic features.
TOTAL_COLUMNS = [
    "TOTAL_HOUSEHOLDS",
    "TOTAL_HOUSEHOLD_POPULATION",
    "TOTAL_HOUSEHOLD_POPULATION_15_YEARS_OR_OVER",
    "TOTAL_POPULATION",
]
MELTED_COLUMNS = (
    ["variable", "POSTALCODE", "Description", "Category", "val"]
    + TOTAL_COLUMNS
    + DIM_COLUMNS
)

# Final demographic store profile (28 columns).
PROFILE_FINAL_COLUMNS = [
    "Category",
    "STORE_NUM",
    "STORE_NAME",
    "STORE_CHAIN",
    "BANNER",
    "CHANNEL",
    "SALES_GROUP",
    "STORE_STREET",
    "STORE_LONGITUDE",
    "STORE_LATITUDE",
    "STORE_PROVINCE",
    "Region",
    "variable",
    "Description",
    "Language_Grouping",
    "YEAR",
    "val",
    "TOTAL_HOUSEHOLDS",
    "TOTAL_HOUSEHOLD_POPULATION",
    "TOTAL_HOUSEHOLD_POPULATION_15_YEARS_OR_OVER",
    "TOTAL_POPULATION",
    "BANNER_VALUE_PERCENT",
    "CHANNEL_RE_VALUE_PERCENT",
    "REGION_VALUE_PERCENT",
    "CHANNEL_VALUE_PERCENT",
    "Hierarchy_Description",
    "TOTAL_CATEGORY",
    "STORE_VALUE",
]
