"""Independent SQL oracle for every registered query.

Each entry is plain SQL that DuckDB runs against the same parquet tables
(``supplier`` and ``customer`` views).  The fixture blocks are FIXTURES.md
section B; the stage blocks restate each operator's definition in SQL, written
separately from the DataFrame code it checks.  The final SELECT lists come
from ``present.sql_select_list`` so both sides round the same columns.
"""

from __future__ import annotations

from .present import sql_select_list

# ---------------------------------------------------------------------------
# Fixture blocks (FIXTURES.md section B).
# ---------------------------------------------------------------------------
FIXTURE_BLOCKS = {
    "prov": """SELECT * FROM (VALUES (0,'ON'),(1,'QC'),(2,'AB'),(3,'BC'),(4,'SK'),(5,'MB'),(6,'NB'),(7,'NL'),(8,'NS'),(9,'PE'),(10,'YT'),(11,'NT'),(12,'NU')) t(k, code)""",
    "adj": """SELECT * FROM (VALUES ('AB','AB'),('AB','BC'),('AB','SK'),('AB','NT'),('BC','AB'),('BC','BC'),('BC','YT'),('SK','AB'),('SK','MB'),('SK','SK'),('SK','NT'),('MB','ON'),('MB','MB'),('MB','SK'),('MB','NU'),('ON','ON'),('ON','MB'),('ON','QC'),('QC','ON'),('QC','NL'),('QC','QC'),('QC','NB'),('NB','QC'),('NB','NS'),('NB','NB'),('NB','PE'),('NL','NL'),('NL','QC'),('NL','PE'),('YT','YT'),('YT','NT'),('YT','BC'),('NS','NS'),('NS','NB'),('NS','PE'),('NT','NT'),('NT','YT'),('NT','NU'),('NT','AB'),('NT','SK'),('NU','NT'),('NU','NU'),('NU','MB'),('PE','PE'),('PE','NS'),('PE','NB')) t(STORE_PROV, LDU_PROV)""",
    "stores_raw": """SELECT CAST(s_suppkey AS BIGINT) AS STORE_NUM,
  concat(CASE s_suppkey % 4 WHEN 0 THEN 'ACME' WHEN 1 THEN 'BIG MART' WHEN 2 THEN 'CORNER' ELSE 'DEPOT' END, ' #', CAST(s_suppkey AS VARCHAR(20)), ' NORTH YORK FOODS') AS STORE_NAME,
  CASE s_suppkey % 6 WHEN 0 THEN 'FRESH MART' WHEN 1 THEN 'VALUE STOP' WHEN 2 THEN 'CITY GROCER' WHEN 3 THEN 'PRIME' WHEN 4 THEN 'CLUB' ELSE 'LOCAL CO' END AS BANNER,
  concat(CAST(s_suppkey AS VARCHAR(20)), ' MAIN ST') AS STREET, CAST(NULL AS VARCHAR) AS POSTAL_CODE, p.code AS PROVINCE,
  CASE WHEN s_suppkey % 37 = 36 THEN NULL WHEN s_suppkey % 5 = 0 THEN 'AOL_AO LOCAL' WHEN s_suppkey % 5 = 1 THEN 'AON_AO NATL RETAIL' WHEN s_suppkey % 5 = 2 THEN 'GROUP A' ELSE 'GROUP B' END AS STORE_CHAIN,
  CAST(-60 - (s_suppkey * 53) % 6000 / CAST(100 AS DOUBLE) AS DOUBLE) AS LONGITUDE,
  CAST(43 + (s_suppkey * 37) % 1000 / CAST(100 AS DOUBLE) AS DOUBLE) AS LATITUDE,
  CASE WHEN s_suppkey % 29 = 28 THEN NULL ELSE abs(s_acctbal) END AS REVENUE_CY,
  CASE s_suppkey % 3 WHEN 0 THEN 'GROCERY' WHEN 1 THEN 'MASS' ELSE 'DRUG' END AS CHANNEL,
  CASE s_suppkey % 2 WHEN 0 THEN 'EAST TEAM' ELSE 'WEST TEAM' END AS SALES_GROUP
FROM supplier JOIN prov p ON p.k = s_nationkey % 13""",
    "ldu_p1": """SELECT concat('P', lpad(CAST(c_custkey - c_custkey % 3 AS VARCHAR(20)), 7, '0')) AS POSTALCODE, p.code AS PROV,
  CAST(-60.005 - (c_custkey * 59) % 6000 / CAST(100 AS DOUBLE) AS DOUBLE) AS LONGITUDE,
  CAST(43.005 + (c_custkey * 41) % 1000 / CAST(100 AS DOUBLE) AS DOUBLE) AS LATITUDE, c_acctbal AS AREA
FROM customer JOIN prov p ON p.k = (c_custkey - c_custkey % 3) % 13 WHERE c_custkey % 2 = 0""",
    "ldu_p2": """SELECT concat('P', lpad(CAST(c_custkey - c_custkey % 3 AS VARCHAR(20)), 7, '0')) AS POSTALCODE, p.code AS PROV,
  CAST(-60.005 - (c_custkey * 59) % 6000 / CAST(100 AS DOUBLE) AS DOUBLE) AS LONGITUDE,
  CAST(43.005 + (c_custkey * 41) % 1000 / CAST(100 AS DOUBLE) AS DOUBLE) AS LATITUDE, c_acctbal AS AREA
FROM customer JOIN prov p ON p.k = (c_custkey - c_custkey % 3) % 13 WHERE c_custkey % 2 = 1 OR c_custkey % 6 = 0""",
    "fvars": """SELECT * FROM (VALUES ('BASPOP','Total Population','Basics',1,0,1),('BASHHD','Total Households','Basics',1,0,0),('BASHPOP','Total Household Population','Basics',1,0,0),('BAS15HP','Total Household Population 15+','Basics',1,0,0),('INC0','Household Income ($0-$50) (Current Year $)','Income',1,1,0),('INC1','Household Income, Over $50.','Income',1,1,0),('INCT','Household Income Total','Income',1,0,1),('INCM','Household Income Mid Node','Income',1,0,0),('CIV','Born in Côte d''Ivoire','Birthplace',1,1,0),('BPT','Household Population For Recent Immigration By Place Of Birth','Birthplace',1,0,1),('TR1','Trend One','Trends',1,1,0),('HID','Hidden','Income',0,1,0)) t(suffix, Description, Category, ADD_TO_PROFILE, LEAF_NODE_FLAG, TOTAL_FLAG)""",
    "fyrs": """SELECT * FROM (VALUES ('EHY',2018),('ECY',2023),('P3Y',2026),('P5Y',2028),('P0Y',2033)) t(prefix, yr)""",
    "features_demo": """SELECT concat('P', lpad(CAST(c_custkey AS VARCHAR(20)), 7, '0')) AS CODE, concat(y.prefix, v.suffix) AS var_code,
  CASE WHEN v.Category <> 'Basics' AND (c_custkey + y.yr) % 11 = 0 THEN NULL ELSE CAST((c_custkey * 31 + y.yr * 7 + length(v.suffix) * 13 + cents) % 997 + 1 AS DOUBLE) END AS var_value,
  v.Description AS Description, v.Category AS Category
FROM (SELECT c_custkey - c_custkey % 3 AS c_custkey, CAST(abs(sum(CAST(round(c_acctbal * 100) AS BIGINT))) AS BIGINT) AS cents FROM customer GROUP BY 1) customer CROSS JOIN fvars v CROSS JOIN fyrs y
WHERE NOT (v.suffix = 'INC1' AND c_custkey % 21 = 0)""",
    "features_newcomer": """SELECT concat('P', lpad(CAST(c_custkey AS VARCHAR(20)), 7, '0')) AS CODE, v.code AS var_code,
  CAST((c_custkey * 17 + length(v.descr) + cents) % 101 AS DOUBLE) AS var_value, v.descr AS Description, '23Q2 to 24Q1 - Temporary Resident - Region of Citizenship' AS Category
FROM (SELECT c_custkey - c_custkey % 3 AS c_custkey, CAST(abs(sum(CAST(round(c_acctbal * 100) AS BIGINT))) AS BIGINT) AS cents FROM customer GROUP BY 1) customer CROSS JOIN (SELECT * FROM (VALUES ('NC24TR01','Temporary Resident - Asia'),('NC24TR02','Temporary Resident - Europe'),('NC24TRT','Temporary Resident Total')) t(code, descr)) v
""",
    "master_dim": """SELECT concat('ECY', suffix) AS variable, Category, concat('All > ', Category, ' > ', suffix) AS Hierarchy_Description, 'N' AS MEDIAN_AVERAGE, ADD_TO_PROFILE, LEAF_NODE_FLAG, TOTAL_FLAG, CAST(NULL AS INT) AS YEAR FROM fvars
UNION ALL SELECT code, '23Q2 to 24Q1 - Temporary Resident - Region of Citizenship', concat('New > ', code), 'N', 0, leaf, 1 - leaf, 2024 FROM (VALUES ('NC24TR01',1),('NC24TR02',1),('NC24TRT',0)) t(code, leaf)""",
    "language_mapping": """SELECT * FROM (VALUES ('ECYCIV','French'),('P3YCIV','French'),('NC24TR01','Asian')) t(Variable, Language_Grouping)""",
    "features_sv": """SELECT concat('P', lpad(CAST(c_custkey AS VARCHAR(20)), 7, '0')) AS CODE, v.code AS var_code,
  CAST((c_custkey * 13 + y.yr + length(v.descr) + cents) % 211 + 1 AS DOUBLE) AS var_value, v.descr AS Description, v.cat AS Category, y.yr AS YEAR
FROM (SELECT c_custkey - c_custkey % 3 AS c_custkey, CAST(abs(sum(CAST(round(c_acctbal * 100) AS BIGINT))) AS BIGINT) AS cents FROM customer GROUP BY 1) customer CROSS JOIN (SELECT * FROM (VALUES ('SVBAS15HP','Household Population 15+','Basics'),('SV001','Importance of Price','Consumption'),('SV002','Brand Apathy','Attitudes'),('SV003','Uncategorised',NULL)) t(code, descr, cat)) v
CROSS JOIN (SELECT * FROM (VALUES (2023),(2024)) t(yr)) y""",
}

HAVERSINE = (
    "2*6371.009*asin(sqrt(power(sin(radians(l.LATITUDE - s.STORE_LATITUDE)/2),2)"
    " + power(sin(radians(l.LONGITUDE - s.STORE_LONGITUDE)/2),2)*cos(radians(s.STORE_LATITUDE))*cos(radians(l.LATITUDE))))"
)

RUNNING_ORDER = "Attraction / nullif(TOTAL_POSTALCODE_ATTRACTION, 0) ASC NULLS FIRST, " + ", ".join(
    f"{c} ASC NULLS FIRST"
    for c in ["STORE_NUM", "STORE_NAME", "CUSTOMER_GROUP", "BANNER", "STORE_STREET", "CHANNEL", "SALES_GROUP",
              "STORE_PROVINCE", "STORE_LATITUDE", "STORE_LONGITUDE", "REVENUE_CY", "PROV"]
)

ATT_COLS = (
    "STORE_NUM, CUSTOMER_GROUP, STORE_NAME, CHANNEL, SALES_GROUP, BANNER, STORE_STREET, STORE_PROVINCE, POSTALCODE,"
    " STORE_LATITUDE, STORE_LONGITUDE, LATITUDE, LONGITUDE, PROV, Attraction, TOTAL_POSTALCODE_ATTRACTION,"
    " CUMULATIVE_PERCENT_ATTRACTION, REVENUE_CY, HAVERSINE_DISTANCE"
)
SHARE_COLS_SQL = (
    "STORE_NUM, CUSTOMER_GROUP, STORE_NAME, CHANNEL, SALES_GROUP, BANNER, STORE_STREET, STORE_PROVINCE, POSTALCODE,"
    " STORE_LATITUDE, STORE_LONGITUDE, LATITUDE, LONGITUDE, PROV, Attraction, TOTAL_POSTALCODE_ATTRACTION,"
    " CUMULATIVE_PERCENT_ATTRACTION, PERCENT_ATTRACTION, REVENUE_CY, HAVERSINE_DISTANCE"
)

# ---------------------------------------------------------------------------
# Stage blocks: each operator's definition restated in SQL.
# ---------------------------------------------------------------------------
STAGE_BLOCKS = {
    "stores": """SELECT STORE_NUM, STORE_NAME, BANNER, STREET AS STORE_STREET, POSTAL_CODE, PROVINCE AS STORE_PROVINCE,
  STORE_CHAIN AS CUSTOMER_GROUP, CAST(LONGITUDE AS DOUBLE) AS STORE_LONGITUDE, CAST(LATITUDE AS DOUBLE) AS STORE_LATITUDE,
  REVENUE_CY, CHANNEL, SALES_GROUP
FROM stores_raw WHERE STORE_CHAIN IS NOT NULL AND REVENUE_CY IS NOT NULL""",
    "ldu_union": "SELECT * FROM ldu_p1 UNION SELECT * FROM ldu_p2",
    "ldu": """SELECT POSTALCODE, PROV, LONGITUDE, LATITUDE FROM (
  SELECT *, row_number() OVER (PARTITION BY POSTALCODE, PROV ORDER BY AREA DESC NULLS LAST, LONGITUDE, LATITUDE) AS rn
  FROM ldu_union) r WHERE rn = 1""",
    "pairs": f"""SELECT s.*, l.POSTALCODE, l.PROV, l.LATITUDE, l.LONGITUDE, {HAVERSINE} AS HAVERSINE_DISTANCE
FROM stores s JOIN adj a ON s.STORE_PROVINCE = a.STORE_PROV JOIN ldu l ON a.LDU_PROV = l.PROV""",
    "att": "SELECT *, REVENUE_CY / nullif(power(HAVERSINE_DISTANCE, 2), 0) AS Attraction FROM pairs",
    "att_tot": "SELECT *, sum(Attraction) OVER (PARTITION BY POSTALCODE) AS TOTAL_POSTALCODE_ATTRACTION FROM att",
    "att_full": f"""SELECT {ATT_COLS} FROM (SELECT *, sum(Attraction / nullif(TOTAL_POSTALCODE_ATTRACTION, 0)) OVER (
  PARTITION BY POSTALCODE ORDER BY {RUNNING_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS CUMULATIVE_PERCENT_ATTRACTION
  FROM att_tot) x""",
    "att_half": f"""SELECT {SHARE_COLS_SQL} FROM (SELECT *, Attraction / nullif(sum(Attraction) OVER (PARTITION BY POSTALCODE), 0) AS PERCENT_ATTRACTION
  FROM att_full WHERE Attraction > CAST(0.005 AS DOUBLE) * TOTAL_POSTALCODE_ATTRACTION) x""",
    "att_onep": f"""SELECT {SHARE_COLS_SQL} FROM (SELECT *, Attraction / nullif(sum(Attraction) OVER (PARTITION BY POSTALCODE), 0) AS PERCENT_ATTRACTION
  FROM att_full WHERE Attraction > CAST(0.01 AS DOUBLE) * TOTAL_POSTALCODE_ATTRACTION) x""",
}

CLEAN_SQL = (
    "regexp_replace(regexp_replace(regexp_replace(Description, ' \\(Current Year \\$\\)', '', 'g'),"
    " 'Côte d''Ivoire', 'Cote d Ivoire', 'g'), '[$,.\\-''()]', '', 'g')"
)

DEMO_TOTALS_SQL = {
    "TOTAL_HOUSEHOLDS": "BASHHD",
    "TOTAL_HOUSEHOLD_POPULATION": "BASHPOP",
    "TOTAL_HOUSEHOLD_POPULATION_15_YEARS_OR_OVER": "BAS15HP",
    "TOTAL_POPULATION": "BASPOP",
}


def totals_sql(leg: str, prefix: str, totals: dict[str, str]) -> str:
    cols = ", ".join(f"max(CASE WHEN variable = '{prefix}{sfx}' THEN value END) AS {name}" for name, sfx in totals.items())
    return f"SELECT CODE AS POSTALCODE, {cols} FROM {leg} GROUP BY CODE"


def _melt_sql(leg: str, prefix: str, year_expr: str) -> str:
    """Dense melt of one leg: every (postal code, variable) of the leg."""
    tot = ", ".join(f"t.{name}" for name in DEMO_TOTALS_SQL)
    return f"""SELECT g.variable, g.POSTALCODE, m.Description, m.Category, c.val, {tot},
  m.Hierarchy_Description, m.MEDIAN_AVERAGE, m.ADD_TO_PROFILE, m.LEAF_NODE_FLAG, m.TOTAL_FLAG, {year_expr} AS YEAR
FROM (SELECT cc.POSTALCODE, vv.variable FROM (SELECT DISTINCT CODE AS POSTALCODE FROM {leg}) cc
      CROSS JOIN (SELECT DISTINCT variable FROM {leg}) vv) g
LEFT JOIN (SELECT CODE, variable, max(value) AS val FROM {leg} GROUP BY CODE, variable) c
  ON c.CODE = g.POSTALCODE AND c.variable = g.variable
LEFT JOIN (SELECT DISTINCT variable, Description, Category, Hierarchy_Description, MEDIAN_AVERAGE, ADD_TO_PROFILE,
  LEAF_NODE_FLAG, TOTAL_FLAG FROM {leg}) m ON m.variable = g.variable
JOIN ({totals_sql(leg, prefix, DEMO_TOTALS_SQL)}) t ON t.POSTALCODE = g.POSTALCODE"""


def _sv_melt_sql(year: int) -> str:
    leg = f"(SELECT CODE, var_code AS variable, var_value AS value, Description, Category FROM features_sv WHERE YEAR = {year})"
    return f"""SELECT g.variable, g.POSTALCODE, m.Description, m.Category, c.val, t.TOTAL_POPULATION, {year} AS YEAR
FROM (SELECT cc.POSTALCODE, vv.variable FROM (SELECT DISTINCT CODE AS POSTALCODE FROM {leg} x1) cc
      CROSS JOIN (SELECT DISTINCT variable FROM {leg} x2) vv) g
LEFT JOIN (SELECT CODE, variable, max(value) AS val FROM {leg} x3 GROUP BY CODE, variable) c
  ON c.CODE = g.POSTALCODE AND c.variable = g.variable
LEFT JOIN (SELECT DISTINCT variable, Description, Category FROM {leg} x4) m ON m.variable = g.variable
JOIN (SELECT CODE AS POSTALCODE, max(CASE WHEN variable = 'SVBAS15HP' THEN value END) AS TOTAL_POPULATION
      FROM {leg} x5 GROUP BY CODE) t ON t.POSTALCODE = g.POSTALCODE"""


FEATURE_BLOCKS = {
    "feat_union": "SELECT * FROM features_demo UNION SELECT * FROM features_newcomer",
    "feat_sel": """SELECT u.*, d.Hierarchy_Description, d.MEDIAN_AVERAGE, d.ADD_TO_PROFILE, d.LEAF_NODE_FLAG, d.TOTAL_FLAG,
  d.YEAR AS WHOLE_YEAR
FROM feat_union u LEFT JOIN master_dim d ON substr(d.variable, 4) = substr(u.var_code, 4)
WHERE (u.Category IN (SELECT DISTINCT Category FROM master_dim WHERE ADD_TO_PROFILE = 1 OR YEAR IS NOT NULL)
       AND d.ADD_TO_PROFILE = 1) OR d.YEAR IS NOT NULL""",
    "feat_tag": f"""SELECT CODE, var_code AS variable, var_value AS value, {CLEAN_SQL} AS Description, Category,
  Hierarchy_Description, MEDIAN_AVERAGE, ADD_TO_PROFILE, LEAF_NODE_FLAG, TOTAL_FLAG, WHOLE_YEAR,
  CASE substr(var_code, 1, 3) WHEN 'EHY' THEN 2018 WHEN 'ECY' THEN 2023 WHEN 'P3Y' THEN 2026 WHEN 'P5Y' THEN 2028
    WHEN 'P0Y' THEN 2033 END AS YEAR
FROM feat_sel""",
    "leg23": "SELECT * FROM feat_tag WHERE YEAR IN (2023, 2024) OR WHOLE_YEAR IS NOT NULL",
    "leg26": "SELECT * FROM feat_tag WHERE YEAR = 2026",
    "leg28": "SELECT * FROM feat_tag WHERE YEAR = 2028",
    "leg33": "SELECT * FROM feat_tag WHERE YEAR = 2033",
    "melt23": _melt_sql("leg23", "ECY", "CASE WHEN g.variable LIKE 'NC24%' THEN 2024 ELSE 2023 END"),
    "melt26": _melt_sql("leg26", "P3Y", "2026"),
    "melt28": _melt_sql("leg28", "P5Y", "2028"),
    "melt33": _melt_sql("leg33", "P0Y", "2033"),
    "melted": "SELECT * FROM melt23 UNION ALL SELECT * FROM melt26 UNION ALL SELECT * FROM melt28 UNION ALL SELECT * FROM melt33",
    "sv_melted": f"{_sv_melt_sql(2024)}\nUNION ALL\n{_sv_melt_sql(2023)}",
}

STORE_KEYS_SQL = (
    "s.CUSTOMER_GROUP, s.STORE_NAME, s.STORE_NUM, s.CHANNEL, s.SALES_GROUP, s.BANNER, s.STORE_STREET,"
    " s.STORE_LONGITUDE, s.STORE_LATITUDE, s.STORE_PROVINCE"
)
LABELS_SQL = (
    "CASE WHEN CUSTOMER_GROUP IN ('AOL_AO LOCAL', 'AON_AO NATL RETAIL')"
    " THEN regexp_replace(STORE_NAME, '#\\d+\\s*[A-Z]*\\s*[A-Z]*\\s*', '', 'g') ELSE CUSTOMER_GROUP END AS STORE_CHAIN,"
    " CASE WHEN STORE_PROVINCE = 'ON' THEN 'ONTARIO' WHEN STORE_PROVINCE = 'QC' THEN 'QUEBEC'"
    " WHEN STORE_PROVINCE IN ('AB', 'BC', 'MB', 'SK', 'YT', 'NT') THEN 'WEST'"
    " WHEN STORE_PROVINCE IN ('NS', 'NB', 'NL', 'PE') THEN 'EAST' ELSE STORE_PROVINCE END AS Region"
)


def ratio_sql(keys: str, name: str) -> str:
    return (
        f"sum(val) OVER (PARTITION BY {keys}) / nullif(sum(TOTAL_POPULATION) OVER (PARTITION BY {keys}), 0) AS {name}"
    )


def percent_sql(value: str, keys: str, name: str) -> str:
    return (
        f"{value} / nullif(sum(CASE WHEN LEAF_NODE_FLAG = 1 THEN {value} ELSE 0 END) OVER (PARTITION BY {keys}), 0)"
        f" AS {name}"
    )


LEVELS_SQL = ", ".join(
    [
        ratio_sql("BANNER, variable, YEAR", "BANNER_VALUE"),
        ratio_sql("Region, CHANNEL, variable, YEAR", "CHANNEL_RE_VALUE"),
        ratio_sql("Region, variable, YEAR", "REGION_VALUE"),
        ratio_sql("CHANNEL, variable, YEAR", "CHANNEL_VALUE"),
    ]
)
PERCENTS_SQL = ", ".join(
    [
        percent_sql("BANNER_VALUE", "Category, BANNER, STORE_NAME, YEAR", "BANNER_VALUE_PERCENT"),
        percent_sql("CHANNEL_RE_VALUE", "Region, CHANNEL, STORE_NAME, Category, YEAR", "CHANNEL_RE_VALUE_PERCENT"),
        percent_sql("REGION_VALUE", "Region, STORE_NAME, Category", "REGION_VALUE_PERCENT"),
        percent_sql("CHANNEL_VALUE", "CHANNEL, STORE_NAME, Category, YEAR", "CHANNEL_VALUE_PERCENT"),
    ]
)

PROFILE_BLOCKS = {
    "prof_demo_raw": f"""SELECT {STORE_KEYS_SQL}, m.variable, m.Description, l.Language_Grouping, m.Category, m.YEAR,
  sum(s.PERCENT_ATTRACTION * m.val) AS val,
  sum(s.PERCENT_ATTRACTION * m.TOTAL_HOUSEHOLDS) AS TOTAL_HOUSEHOLDS,
  sum(s.PERCENT_ATTRACTION * m.TOTAL_HOUSEHOLD_POPULATION) AS TOTAL_HOUSEHOLD_POPULATION,
  sum(s.PERCENT_ATTRACTION * m.TOTAL_HOUSEHOLD_POPULATION_15_YEARS_OR_OVER) AS TOTAL_HOUSEHOLD_POPULATION_15_YEARS_OR_OVER,
  sum(s.PERCENT_ATTRACTION * m.TOTAL_POPULATION) AS TOTAL_POPULATION,
  max(m.Hierarchy_Description) AS Hierarchy_Description, max(m.MEDIAN_AVERAGE) AS MEDIAN_AVERAGE,
  max(m.ADD_TO_PROFILE) AS ADD_TO_PROFILE, max(m.LEAF_NODE_FLAG) AS LEAF_NODE_FLAG, max(m.TOTAL_FLAG) AS TOTAL_FLAG
FROM att_half s LEFT JOIN melted m ON s.POSTALCODE = m.POSTALCODE
LEFT JOIN language_mapping l ON m.variable = l.Variable
WHERE m.Category NOT IN ('Trends', 'Attitudes') AND m.val IS NOT NULL
GROUP BY {STORE_KEYS_SQL}, m.variable, m.Description, l.Language_Grouping, m.Category, m.YEAR""",
    "prof_demo": f"SELECT *, {LABELS_SQL} FROM prof_demo_raw",
    "prof_lev": f"SELECT *, {LEVELS_SQL} FROM prof_demo",
    "prof_pct": f"SELECT *, {PERCENTS_SQL} FROM prof_lev",
    "prof_total": "SELECT STORE_NAME, STORE_NUM, Category, YEAR, val AS TOTAL_CATEGORY FROM prof_pct WHERE TOTAL_FLAG = 1",
    "prof_final": """SELECT b.*, t.TOTAL_CATEGORY,
  CASE WHEN b.LEAF_NODE_FLAG = 0 AND b.TOTAL_FLAG = 0 THEN 0
       WHEN b.Description = 'Household Population For Recent Immigration By Place Of Birth'
         THEN b.val / nullif(b.TOTAL_HOUSEHOLD_POPULATION, 0)
       ELSE b.val / nullif(t.TOTAL_CATEGORY, 0) END AS STORE_VALUE
FROM prof_pct b LEFT JOIN prof_total t
  ON b.Category = t.Category AND b.STORE_NUM = t.STORE_NUM AND b.STORE_NAME = t.STORE_NAME AND b.YEAR = t.YEAR""",
    "prof_sv_raw": f"""SELECT {STORE_KEYS_SQL}, m.variable, m.Description, m.Category, m.YEAR,
  sum(s.PERCENT_ATTRACTION * m.val) AS val, sum(s.PERCENT_ATTRACTION * m.TOTAL_POPULATION) AS TOTAL_POPULATION
FROM att_half s LEFT JOIN sv_melted m ON s.POSTALCODE = m.POSTALCODE
WHERE m.val IS NOT NULL
GROUP BY {STORE_KEYS_SQL}, m.variable, m.Description, m.Category, m.YEAR""",
    "prof_sv": f"SELECT *, {LABELS_SQL} FROM prof_sv_raw",
    "sv_lev": f"SELECT *, CAST(NULL AS DOUBLE) AS LONGITUDE, CAST(NULL AS DOUBLE) AS LATITUDE, {LEVELS_SQL} FROM prof_sv",
    "sv_basics": "SELECT STORE_NAME, STORE_NUM, val AS TOTAL_CATEGORY FROM sv_lev WHERE Category = 'Basics'",
    "sv_final": """SELECT b.*, t.TOTAL_CATEGORY, b.val / nullif(t.TOTAL_CATEGORY, 0) AS STORE_VALUE
FROM sv_lev b LEFT JOIN sv_basics t ON b.STORE_NUM = t.STORE_NUM AND b.STORE_NAME = t.STORE_NAME""",
}

ALL_BLOCKS = {**FIXTURE_BLOCKS, **STAGE_BLOCKS, **FEATURE_BLOCKS, **PROFILE_BLOCKS}


def with_prefix(extra: dict[str, str] | None = None) -> str:
    blocks = {**ALL_BLOCKS, **(extra or {})}
    return "WITH " + ",\n".join(f"{name} AS (\n{body}\n)" for name, body in blocks.items())


def oracle(body: str, columns: list[str], extra: dict[str, str] | None = None) -> str:
    """Full oracle text: the block prefix, then ``body`` wrapped in the
    rounding SELECT list for ``columns``."""
    return f"{with_prefix(extra)}\nSELECT {sql_select_list(columns)} FROM (\n{body}\n) q"
