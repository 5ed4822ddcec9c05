"""Readers and input shaping: stores, postal-code centroids, feature tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sql_literal(value, sql_type: str | None = None) -> str:
    """A Spark SQL literal for a Python value (strings escaped), optionally
    cast to ``sql_type``."""
    if value is None:
        text = "NULL"
    elif isinstance(value, bool):
        text = "TRUE" if value else "FALSE"
    elif isinstance(value, int):
        text = str(value)
    elif isinstance(value, float):
        text = f"CAST('{value!r}' AS DOUBLE)"
    else:
        escaped = str(value).replace("\\", "\\\\").replace("'", "\\'")
        text = f"'{escaped}'"
    return f"CAST({text} AS {sql_type})" if sql_type else text


def literal_rows_sql(rows: list[tuple], names: list[str]) -> str:
    """SQL text of an array of named structs holding ``rows`` (explode it to
    expand every input row by the list)."""
    structs = (
        "named_struct(" + ", ".join(f"'{n}', {sql_literal(v)}" for v, n in zip(row, names)) + ")" for row in rows
    )
    return "array(" + ", ".join(structs) + ")"


def local_table(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A small table held in the plan itself (an inline VALUES relation):
    its row count is known to the planner without running a job, and it is
    folded into the query like a literal."""
    if not rows:
        return spark.createDataFrame([], schema)
    types = [f.dataType.simpleString().upper() for f in schema.fields]
    tuples = ("(" + ", ".join(sql_literal(v, t) for v, t in zip(row, types)) + ")" for row in rows)
    names = ", ".join(f"`{f.name}`" for f in schema.fields)
    return spark.sql(f"SELECT * FROM VALUES {', '.join(tuples)} AS t({names})")


def load_stores(raw: DataFrame) -> DataFrame:
    """Store scan: 12 columns, renamed, coordinates cast to double; stores
    without a chain or without revenue are dropped."""
    return raw.filter(F.col("STORE_CHAIN").isNotNull() & F.col("REVENUE_CY").isNotNull()).select(
        "STORE_NUM",
        "STORE_NAME",
        "BANNER",
        F.col("STREET").alias("STORE_STREET"),
        "POSTAL_CODE",
        F.col("PROVINCE").alias("STORE_PROVINCE"),
        F.col("STORE_CHAIN").alias("CUSTOMER_GROUP"),
        F.col("LONGITUDE").cast("double").alias("STORE_LONGITUDE"),
        F.col("LATITUDE").cast("double").alias("STORE_LATITUDE"),
        "REVENUE_CY",
        "CHANNEL",
        "SALES_GROUP",
    )


def union_distinct(*dfs: DataFrame) -> DataFrame:
    """SQL ``UNION``: by position, duplicates removed once at the end."""
    return reduce(lambda a, b: a.union(b), dfs).distinct()


def stack_by_position(*dfs: DataFrame) -> DataFrame:
    """``UNION ALL`` by position (duplicates kept)."""
    return reduce(lambda a, b: a.union(b), dfs)


def largest_polygon(polygons: DataFrame) -> DataFrame:
    """One centroid per (POSTALCODE, PROV): that of the largest polygon.

    Ties on AREA are broken by the smaller longitude, then latitude, so the
    pick is deterministic (and repeatable after a task retry).  A plain
    ``min`` over a struct is an ordinary aggregate with map-side partial
    aggregation, so a postal code with very many polygons is combined before
    the shuffle.  Exact duplicate polygons cannot change the pick, so the set
    union of the polygon parts needs no separate distinct step.
    """
    best = F.min(
        F.struct(
            F.col("AREA").isNull().alias("no_area"),
            (-F.col("AREA")).alias("neg_area"),
            F.col("LONGITUDE").alias("LONGITUDE"),
            F.col("LATITUDE").alias("LATITUDE"),
        )
    ).alias("best")
    return polygons.groupBy("POSTALCODE", "PROV").agg(best).select(
        "POSTALCODE", "PROV", "best.LONGITUDE", "best.LATITUDE"
    )


def load_ldu(*parts: DataFrame) -> DataFrame:
    """Postal-code centroids from the polygon parts (SQL UNION + largest
    polygon per postal code and province)."""
    return largest_polygon(reduce(lambda a, b: a.unionByName(b), parts))


def load_features(*parts: DataFrame) -> DataFrame:
    """Union (distinct) of the raw long feature tables."""
    return union_distinct(*parts)


def load_social_values(raw: DataFrame) -> DataFrame:
    """Social-value table with VARIABLES / VALUES renamed to variable / value."""
    return raw.withColumnsRenamed({"var_code": "variable", "var_value": "value"})
